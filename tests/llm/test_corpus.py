"""Packing, prefix trie and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cloudgauge.llm import packing, scans, search, trie
from cloudgauge.llm.common import Scratch
from cloudgauge.llm.wordtokens import WordTokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_word_tokens_equal_the_library():
    rng = random.Random(1)
    alphabet = [*"abcXYZ  '\"\n\t.,;!0129é̈́ÀßẞİıŉŁœſḴ́̈   \x1c\x1f\x85\x0b\x0c²¼ªºµ–—…€😀中Σςσ_|<>·nhHtTwWyYjJ̌̊",
                "<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'RE", "don't", "ẖ", "ΑΣ", "ﬁ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["", "x" * 5000, "ab " * 5000, "é" * 3000]
    coder = WordTokens(VOCABULARY)
    got = [ids.tolist() for ids in coder.encode([t.encode() for t in texts])]
    assert got == [e.ids for e in coder.model.encode_batch(texts, add_special_tokens=False)]


def fewest(lengths, capacity):
    """Exact number of bins for a few lengths, by trying every place."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                put(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best[0]


def test_bounds_and_bins():
    rng = random.Random(2)
    for _ in range(300):
        capacity = rng.choice([7, 10, 24, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        bins, offsets, used = packing.best_fit_decreasing(np.array(lengths), capacity)
        exact = fewest(lengths, capacity)
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        assert bound <= exact <= used
        for b in range(used):
            places = sorted((o, n) for x, o, n in zip(bins.tolist(), offsets.tolist(), lengths) if x == b)
            assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
            assert places and sum(n for _, n in places) <= capacity
    assert packing.lower_bound(np.bincount([51] * 10, minlength=101), 100) == 10  # the sum alone asks for 6


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
        assert sum(n for _, n in places) <= capacity
    return len(by)


def test_pack_documents(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["Alpha", "beta's", "42", "ñandú", "gamma!"]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(400, None), (401, ""), (5, docs[5][1]), (None, "nobody's"), (402, "long text " * 700)]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, piece string, extra int").repartition(5)
    pieces = packing.token_pieces(df, VOCABULARY, capacity=128, ids="ids")
    assert pieces.columns == ["doc_id", "extra", "piece", "start", "length", "ids_crc32", "ids"]
    packed = packing.pack(pieces, capacity=128, group=64).cache()
    rows = packed.collect()
    model = WordTokens(VOCABULARY).model
    want = Counter()
    for doc, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 128)):
            part = ids[at : at + 128]
            want[doc, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows)
    lengths = [r["length"] for r in rows]
    assert check_packed(rows, 128) <= packing.lower_bound(np.bincount(lengths, minlength=129), 128) * 1.02 + 1
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert joined[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    packed.unpersist()


def test_exchange_saves_sequences(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 1500, 6000)
    df = spark.createDataFrame([(int(n),) for n in lengths], "length long").repartition(7)
    alone = packing.pack(df, group=100, rounds=0).collect()
    rows = packing.pack(df, group=100).collect()
    assert Counter(r["length"] for r in rows) == Counter(lengths.tolist())
    bound = packing.lower_bound(np.bincount(lengths, minlength=4097), 4096)
    assert check_packed(rows, 4096) < check_packed(alone, 4096)
    assert check_packed(rows, 4096) <= bound * 1.002 + 1
    same = packing.pack(spark.createDataFrame([(2049,)] * 500, "length long"), group=50).collect()
    assert check_packed(same, 4096) == 500


def test_pack_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.token_pieces(empty, VOCABULARY)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, 9), (4096, 9), (0, 9)], "length long, offset int")).collect()
    assert check_packed([{**r.asDict(), "length": r["length"] or 0} for r in rows], 4096) >= 1 and len(rows) == 3
    with pytest.raises(Exception, match="longer than"):
        packing.pack(spark.createDataFrame([(4097,)], "length long"))
    with pytest.raises(ValueError, match="rename"):
        packing.pack(spark.createDataFrame([(1, 1)], "length long, _bin long"))


def brute_trie(rows, head, base):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in said.items()}
    members = defaultdict(list)
    rebuilt = {c: tuple(said.get(base(c), [])[: head(c)] + v[head(c) :]) for c, v in said.items()}
    for c, r in rebuilt.items():
        for d in range(len(r) + 1):
            members[r[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = set()
    for p, convs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in convs if rebuilt[c] == p)
        out.add((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), kids[p], sum(not kids[q] for q in under),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def trie_rows(rng, n):
    texts = ["hi", "hé", "", "long " * 50, None, "ok"]
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, 6, 9, 14])):
            rows.append((c * rng.choice([1, 1, 1, -1]), t, rng.choice(["user", "assistant"]) if t else "user", texts[rng.randrange(2 if t < 4 else 6)]))
    rows += [(c, t, "user", f"copy {t}") for c in (500, 501, 502, 700) for t in range(30)]
    rows += [(7, None, "user", "first"), (7, None, None, None), (7, 3, "user", "hi"), (7, 3, "user", "hi"), (None, 0, "user", "lost")]
    return rows


def run_trie(spark, rows, head="crc32(cast(cast({} as string) as binary)) % 9"):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv int").repartition(3)
    got = trie.prefix_trie(df, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, lambda c: c - c % 5, 8).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def head_of(c):
    return zlib.crc32(str(c).encode()) % 9


def base_of(c):
    return c - int(math.fmod(c, 5))


def test_trie(spark, monkeypatch):
    rows = trie_rows(random.Random(5), 60)
    want = brute_trie(rows, head_of, base_of)
    assert run_trie(spark, rows) == want
    monkeypatch.setattr(scans, "SLICE", 4)
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    assert run_trie(spark, rows) == want


def test_trie_survives_collisions(spark, monkeypatch):
    """Fields of a few elements collide; the work starts anew with larger ones."""
    rows = trie_rows(random.Random(6), 20)
    true, tried = trie._rebuilt, []

    def small(*args):
        with pytest.MonkeyPatch.context() as m:
            if not tried:
                m.setattr(trie, "LANES", ((3, 2), (3, 2), (3, 2)))
            tried.append(1)
            return true(*args)

    monkeypatch.setattr(trie, "_rebuilt", small)
    assert run_trie(spark, rows) == brute_trie(rows, head_of, base_of)
    assert len(tried) == 2


def test_trie_empty(spark):
    assert run_trie(spark, []) == set()
    assert run_trie(spark, [(None, 1, "user", "x")]) == set()
    # Conversation 3 loses its only turns and its base is absent.
    assert {r[:5] for r in run_trie(spark, [(3, 0, "user", "x")])} == {(3, 0, None, 1, 0)} == {r[:5] for r in brute_trie([(3, 0, "user", "x")], head_of, base_of)}


def test_latest(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, "a", "b"]), i, rng.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(4)
    got = {r["at"]: r["seen"] for r in scans.latest(df, ["g"], ["at"], F.col("v"), "seen", Scratch(spark)).collect()}
    last = {}
    for g, at, v in rows:
        last[g] = last.get(g) if v is None else v
        assert got[at] == last[g]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute_search(docs, items, k):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    n = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    held = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        scores = []
        for doc, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in set(terms_of(text)) if t in bag)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out.update((item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("entries", [50, 10**6])
def test_search(spark, monkeypatch, entries):
    monkeypatch.setattr(search, "SHARD_ENTRIES", entries)
    monkeypatch.setattr(search, "FIRST_READ", 2)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)] + ["Ñu", "ñu", "ÀB", "x9", "the"]
    weights = [1 / (i + 1) for i in range(45)]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.randint(0, 50)))) for i in range(300)]
    docs += [(300 + i, docs[i % 3][1]) for i in range(80)] + [(900, None), (901, ""), (902, "?!"), (None, docs[1][1]), (4, docs[4][1]), (903, "the " * 20_000)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "unheard"), (53, "THE the"), (3, items[3][1]), (3, "w5 w6"), (None, "w7 ñu")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n string").repartition(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = search.search(df, bench, k=7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_search(docs, items, 7)
    monkeypatch.setattr(search, "BLOCK_BYTES", 100)
    assert Counter(tuple(r) for r in search.search(df, bench, k=7).collect()) == brute_search(docs, items, 7)


def test_search_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.search(docs, bench).count() == 0
    assert search.search(spark.createDataFrame([(1, "a"), (2, None)], docs.schema), bench.limit(0)).count() == 0
    assert [tuple(r) for r in search.search(spark.createDataFrame([(1, "a")], docs.schema), bench).collect()][0][:3] == (1, 1, 1)


def test_best_positions_stop_early(spark):
    """A few high scores end the search before the lists are read."""
    n = np.full(5000, 10)
    times = np.ones(5000, np.int64)
    times[:3] = 500
    doc, term = np.tile(np.arange(5000), 2), np.repeat([0, 1], 5000)
    shard = search.Shard(n, doc, term, np.tile(times, 2), np.array([100, 100]), 5000, 50_000)
    found, _ = shard.best(np.array([0, 1]), 3, [])
    assert found.tolist() == [0, 1, 2]
