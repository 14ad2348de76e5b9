"""Decontamination, near-duplicates and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgauge.llm import decontam, embdedup, minhash
from cloudgauge.llm.common import Scratch
from cloudgauge.llm.components import components


def words_of(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def brute_leaks(docs, items, size=5, threshold=0.8):
    out = {}
    for item, text in items:
        wanted = words_of(text)
        k = min(size, len(wanted))
        target = Counter(tuple(wanted[i : i + k]) for i in range(len(wanted) - k + 1)) if wanted else Counter()
        for doc, body in docs:
            own = words_of(body)
            for s in range(k - len(wanted), len(own) - k + 1) if wanted else []:
                window = own[max(s, 0) : s + len(wanted)]
                have = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
                both, total = sum((have & target).values()), sum((have | target).values())
                if total and both / total >= threshold:
                    out[doc, item] = max(out.get((doc, item), 0), both / total)
    return out


def test_leaks(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(8, 60)))) for i in range(12)] + [(20, "Tiny item"), (21, None), (22, ""), (23, "a b c d e"), (24, "a b c d e")]
    items.append((25, "la " * 30))
    docs = []
    for d in range(60):
        body = some(rng.randint(0, 200))
        if d % 2 == 0:
            part = words_of(items[d % 12][1])
            for _ in range(d // 15):
                part[rng.randrange(len(part))] = "zz"
            if d % 10 == 8:
                part.insert(len(part) // 2, "extra")
            at = rng.randint(0, len(body))
            body = body[:at] + [p.upper() for p in part] + body[at:]
        docs.append((d, ", ".join(body)))
    docs += [(100, None), (101, ""), (102, "tiny ITEM!"), (103, "x a b c d e y"), (104, "la " * 29), (105, "la " * 400), (None, items[3][1]), (7, items[4][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, _n int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find_leaks(df, bench).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 or got[k] >= 0.8 for k in want)
    clean = {r["doc_id"] for r in decontam.decontaminate(df, bench).collect()}
    dirty = {d for d, _ in want}
    assert clean == {d for d, _ in docs if d not in dirty} | {7}  # the other document with id 7 is clean
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.find_leaks(df.limit(0), bench).count() == 0


def test_leaks_with_moved_parts(spark):
    """Items whose parts are swapped, doubled, interleaved with others or cut by the text's ends."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(100)) for i in range(8)] + [(8, some(10) * 6), (9, ["la"] * 30)]
    docs = []
    for i, item in items:
        a, b, c = item[: len(item) // 2], item[len(item) // 2 :], item[len(item) // 3 :]
        for parts in (b + a, a + some(1) + b, a + a + b, c + item[: len(item) // 3], a[:40] + some(3) + a[40:] + b, b + some(30) + a, c, item[:-8]):
            docs.append((len(docs), some(rng.choice([0, 0, 50])) + parts + some(rng.choice([0, 0, 50]))))
    docs = [(d, " ".join(w)) for d, w in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = [(i, " ".join(w)) for i, w in items]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert set(got) == set(want) and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_repeated_text(spark):
    """A repeated word makes one window, not one per place."""
    docs = [(1, "la " * 300_000), (2, "la lo " * 100_000), (3, "la " * 10)]
    items = [(1, "la " * 30), (2, "la lo " * 20)]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 2)}


def test_more_items_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 700)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(9)]
    docs = [(i, "before " + items[i][1] + " after") for i in range(9)]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(i, i) for i in range(9)]


def test_every_verbatim_item_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, items).collect()}
    bodies = {r["doc_id"]: " " + " ".join(words_of(r["text"])) + " " for r in docs.collect()}
    verbatim = {(d, r["item_id"]) for r in items.collect() for d, t in bodies.items() if f" {' '.join(words_of(r['text']))} " in t}
    assert verbatim and verbatim <= found


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_groups(docs, size, percent):
    sets = {d: shingle_set(t, size) for d, t in docs if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(rng, n, edits, length=120):
    base = [f"b{rng.randrange(9999)}" for _ in range(length)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"e{rng.randrange(99999)}"
        yield " ".join(copy)


@pytest.mark.parametrize("short_list", [32, 2])
def test_near_duplicates(spark, monkeypatch, short_list):
    monkeypatch.setattr(minhash, "SHORT_LIST", short_list)
    monkeypatch.setattr(minhash, "FREQUENT", 5)
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "one two\tthree", "one two three four", " ", "x " * 40_000]
    texts += list(family(rng, 60, 12)) + list(family(rng, 25, 6, 400)) + ["same text of six words here"] * 8
    passage = " ".join(f"p{i}" for i in range(90))
    texts += [" ".join(f"r{rng.randrange(99999)}" for _ in range(rng.randint(5, 60))) + " " + passage for _ in range(40)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(*d, 1, 2) for d in docs] + [(None, "one", 1, 2)], "doc_id long, text string, n int, id int").repartition(5)
    rows = minhash.near_duplicates(df, shingle=4).collect()
    assert len(rows) == len(docs) + 1
    want = brute_groups(docs, 4, 80)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    kept = [r["doc_id"] for r in minhash.deduplicate(df, shingle=4).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(d for d, (_, c) in want.items() if c == d)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (2, "g h i j k l"), (9, "a b c d e f"), (1, "z")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (1, 1)}


def test_one_row_of_a_repeated_document_stays(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (2, "g h i j k l"), (2, "m n o p q r"), (2, "g h i j k l"),
            (3, None), (3, None), (None, "z"), (None, "z"), (9, "s t u v w x")]
    got = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([
        (5, "a b c d e f"), (2, "g h i j k l"), (2, "m n o p q r"), (3, None), (None, "z"), (None, "z"), (9, "s t u v w x")])


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark)).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root[v] for v in linked}


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        v = rng.normal(size=16)
        copies = rng.integers(1, 6) if i % 3 == 0 else 1
        for c in range(copies):
            rows.append((len(rows), (v + rng.normal(size=16) * 0.12 * (c % 2)).astype("float32").tolist(), i % 4 if i % 17 else None))
    centre = rng.normal(size=16)
    rows += [(1000 + i, (centre + rng.normal(size=16) * 0.02).astype("float32").tolist(), 2) for i in range(150)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1e-30] * 16, [1e30] * 16, [1.0] * 3]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(4)
    good = [(i, np.asarray(v, float), label) for i, v, label in rows if i is not None and v and label is not None and None not in v
            and np.isfinite(np.asarray(v, float)).all() and np.any(v)]
    ids = [g[0] for g in good]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v, _ in good}
    links = {i: set() for i in ids}
    for a, (i, _, p) in enumerate(good):
        for j, _, q in good[a + 1 :]:
            if p == q and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    for sizes in ((1500, 4000, 750), (60, 4000, 20), (60, 40, 20)):
        for name, value in zip(("SHARD", "BLOCK", "ASK_BLOCK"), sizes):
            monkeypatch.setattr(embdedup, name, value)
        got = embdedup.near_vectors(df)
        found = {r["vec_id"]: r for r in got.collect()}
        assert got.count() == len(rows)
        total = sum(map(len, links.values()))
        assert sum(min(found[i]["n_links"], len(links[i])) for i in ids) >= 0.97 * total
        assert all(found[i]["n_links"] <= len(links[i]) for i in ids)
        assert found[2000]["n_links"] == 0 and found[2000]["kept"] and found[2006]["component_id"] == found[2007]["component_id"] == 2006
        assert len({found[1000 + i]["component_id"] for i in range(150)}) == 1
        audit = embdedup.audit_recall(df, got, "vec_id % 10 = 0").first()
        assert audit["recall"] >= 0.9
    assert embdedup.near_vectors(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 100_000).union(docs.limit(2).withColumn("text", F.lit("12 34")).withColumn(
        "doc_id", F.col("doc_id") + 200_000)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(300_000)))
    docs.union(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    texts = [(r["doc_id"], r["text"]) for r in docs.union(extra).select("doc_id", "text").collect()]
    texts = [(d, t) for d, t in texts if t and any(c.isalpha() for c in t)]
    groups = brute_groups(texts, 5, 80)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in texts if groups[d][1] == d]
    leaks = {d for d, _ in brute_leaks(kept, items)}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows == {d: library.encode(t, add_special_tokens=False).ids for d, t in kept if d not in leaks}


def test_neighbourhood_over_many_shards(spark, monkeypatch):
    """Links between vectors whose nearest centroids are not among each other's two are found as well."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(embdedup, "SHARD", 50)
    centre, far = rng.normal(size=(2, 16))
    dense = centre + rng.normal(size=(600, 16)) * 0.26
    mixed = np.concatenate([rng.normal(size=(150, 16)), far + rng.normal(size=(150, 16)) * 0.2])
    rows = [(i, v.tolist(), 1 if i < 600 else 2) for i, v in enumerate(np.concatenate([dense, mixed]))]
    rows += [(1000 + i, rows[i][1], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    unit = embdedup.normalised(np.array([v for _, v, _ in rows]))
    labels = np.array([label for _, _, label in rows])
    close = (unit @ unit.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(rows), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in embdedup.near_vectors(df).collect()}
    assert [got[i] for i, _, _ in rows] == close.sum(axis=1).tolist()


def test_audit_of_a_neighbourhood_over_six_shards(spark, monkeypatch):
    used = {}
    fit = embdedup.centroids
    monkeypatch.setattr(embdedup, "centroids", lambda *a: used.update(fit(*a)) or used)
    monkeypatch.setattr(embdedup, "SHARD", 40)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=12) + rng.normal(size=(500, 12)) * 0.25
    df = spark.createDataFrame([(i, v.tolist(), i % 5 == 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, other boolean")
    df = df.select("vec_id", "embedding", F.when(F.col("other"), 2).otherwise(1).alias("label")).repartition(4)
    got = embdedup.near_vectors(df)
    unit = embdedup.normalised(vectors[np.arange(500) % 5 > 0])
    homes = (unit @ used["1:12"].T).argmax(axis=1)
    assert max(len(set(homes[near])) for near in unit @ unit.T >= 0.93) >= 6
    audit = embdedup.audit_recall(df, got, "vec_id % 2 = 0").first()
    assert audit["wanted"] > 1000 and audit["found"] == audit["wanted"]
