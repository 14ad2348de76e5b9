"""Near-duplicate vectors of equal labels through a robust-pruned flat graph.

Vectors are assigned to the nearest ``OVERLAP`` of their label's centroids, so shards overlap. Each shard's
graph is built by robust pruning; the adjacency lists of a vector in all its shards are united. Every
vector is then a query in its home, the shard of its nearest centroid: a greedy beam search from the shard's medoid
(and from the query's own node) finds the neighbourhood, and while vectors within the range turn up, the search
expands from each of them. Links between vectors of different homes are found without the graphs: a vector is compared
with all vectors at home in each shard that bounds on the angles cannot exclude, so a border loses no pair. Cosines in
double precision verify every link. Equal vectors are one node with a count; links leave a task as counts and as one
edge per vector, so groups of copies are never expanded to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudgauge.llm.common import Scratch
from cloudgauge.llm.components import components

COSINE = 0.93
#: Vectors that the centroids are fitted on (the smallest id hashes); every vector is indexed.
FIT_SAMPLE = 4096
SHARD = 700
OVERLAP = 2
#: Nodes that one task holds. Larger shards are cut into blocks of nodes, each searched by all blocks of queries.
BLOCK = 4000
#: Queries that one task holds.
ASK_BLOCK = 750
DEGREE, POOL, RANDOM, ALPHA, BEAM = 24, 64, 16, 1.2, 48


def normalised(vectors: pd.Series) -> np.ndarray:
    out = np.stack([np.asarray(v, np.float64) for v in vectors])
    # The largest component first, so that neither huge nor tiny components leave the range of doubles.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def robust_prune(vectors: np.ndarray) -> list[np.ndarray]:
    """Out-neighbours of each node: of the nearest (and some random) nodes those that no chosen one covers."""
    n = len(vectors)
    if n == 1:
        return [np.zeros(0, np.int64)]
    random = np.random.default_rng(n)
    pool = min(POOL, n - 1)
    chosen = np.full((n, DEGREE), -1, np.int64)
    for start in range(0, n, 512):
        rows = np.arange(start, min(start + 512, n))
        similar = vectors[rows] @ vectors.T
        similar[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-similar, pool - 1, axis=1)[:, :pool]
        far = random.integers(0, n, (len(rows), RANDOM))
        candidates = np.concatenate([near, far], axis=1)
        distance = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(similar, candidates, 1)))
        alive = np.isfinite(distance) & (candidates != rows[:, None])
        for d in range(DEGREE):
            masked = np.where(alive, distance, np.inf)
            best = masked.argmin(axis=1)
            live = np.isfinite(masked[np.arange(len(rows)), best])
            if not live.any():
                break
            picked = candidates[np.arange(len(rows)), best]
            chosen[rows[live], d] = picked[live]
            between = np.einsum("ijk,ik->ij", vectors[candidates], vectors[picked])
            covered = ALPHA * np.sqrt(np.maximum(0, 2 - 2 * between)) <= distance
            alive &= ~(covered & live[:, None]) & (candidates != picked[:, None])
    # Reverse edges: at most twice the degree for each node, but always the one to a node's nearest, so that
    # whoever finds the nearest finds the node.
    out = [row[row >= 0] for row in chosen]
    sources = np.repeat(np.arange(n), [len(o) for o in out])
    nearest = np.concatenate([np.arange(len(o)) == 0 for o in out])
    targets = np.concatenate(out)
    order = np.lexsort((sources, ~nearest, targets))
    sources, targets, nearest = sources[order], targets[order], nearest[order]
    kept = nearest | (np.arange(len(targets)) - np.searchsorted(targets, targets) < 2 * DEGREE)
    sources, ends = sources[kept], np.searchsorted(targets[kept], np.arange(n + 1))
    return [np.unique(np.concatenate([out[i], sources[ends[i] : ends[i + 1]]])) for i in range(n)]


def range_search(
    vectors: np.ndarray, neighbours: list[np.ndarray], queries: np.ndarray, own: np.ndarray, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with at least ``cosine`` that a greedy search and its expansion meet.

    ``own`` is each query's own node, or -1. All queries advance together: a step opens each query's best unopened
    node of its beam; afterwards all nodes in range are opened until no new one is.
    """
    n, m = len(vectors), len(queries)
    degree = np.array([len(x) for x in neighbours], np.int64)
    flat = np.concatenate([*neighbours, np.zeros(0, np.int64)]).astype(np.int64)
    begin = np.cumsum(degree) - degree

    def around(r: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each (query, neighbour of its node)."""
        count = degree[nodes]
        return np.repeat(r, count), flat[np.arange(count.sum()) + np.repeat(begin[nodes] - (np.cumsum(count) - count), count)]

    medoid = int((vectors @ vectors.mean(axis=0)).argmax())
    found_q, found_n = [], []
    step = max(1, (32 << 20) // max(n, 1))
    step = min(step, 256)
    for at in range(0, m, step):
        q = queries[at : at + step]
        b = len(q)
        rows = np.arange(b)
        seen = np.zeros((b, n), bool)
        score = np.full((b, n), -np.inf, np.float64)
        opened = np.zeros((b, n), bool)

        def visit(r: np.ndarray, nodes: np.ndarray) -> None:
            new = (nodes >= 0) & ~seen[r, nodes]
            r, nodes = r[new], nodes[new]
            for s in range(0, len(r), 1 << 16):
                a, c = r[s : s + (1 << 16)], nodes[s : s + (1 << 16)]
                score[a, c] = waiting[a, c] = np.einsum("ij,ij->i", q[a], vectors[c])
            seen[r, nodes] = True

        waiting = score.copy()  # scores of the nodes met and not yet opened
        visit(rows, np.full(b, medoid))
        visit(rows, own[at : at + step])
        beam = min(BEAM, n)
        going, turn = rows, 0
        floor = np.full(b, -np.inf)
        while len(going):
            # The beam: the best nodes met so far; the best of them not yet opened comes next. Its floor only
            # rises, so an older one is safe.
            if turn % 8 == 7:
                floor[going] = np.partition(score[going], n - beam, axis=1)[:, n - beam]
            turn += 1
            open_score = waiting[going]
            best = open_score.argmax(axis=1)
            top = open_score[np.arange(len(going)), best]
            live = np.isfinite(top) & (top >= floor[going])
            going, best = going[live], best[live]
            if len(going):
                opened[going, best] = True
                waiting[going, best] = -np.inf
                visit(*around(going, best))
        near = np.zeros((b, n), bool)
        while True:
            r, nodes = np.nonzero((score >= cosine) & ~opened)
            if not len(r):
                break
            opened[r, nodes] = True
            for s in range(0, len(r), 1 << 16):
                near[around(r[s : s + (1 << 16)], nodes[s : s + (1 << 16)])] = True
            near &= ~seen
            visit(*np.nonzero(near))
            near[:] = False
        r, nodes = np.nonzero(score >= cosine)
        found_q.append(r + at)
        found_n.append(nodes)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_n)


def centroids(sample: pd.DataFrame, counts: dict[str, int]) -> dict[str, np.ndarray]:
    """Per label one centroid for every ``SHARD`` vectors, by a few rounds of k-means on the sample."""
    out = {}
    for label, part in sample.groupby("label"):
        vectors = normalised(part["embedding"])
        k = min(len(vectors), max(1, -(-counts[label] // SHARD)))
        centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
        for _ in range(8):
            nearest = (vectors @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, nearest, vectors)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
        out[label] = centres
    return out


def roots_of(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each position's component under the links (a, b): minimum labels with jumps."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def reachable(
    vectors: np.ndarray, home: np.ndarray, centres: np.ndarray, widest: np.ndarray, narrowest: np.ndarray, cosine: float
) -> np.ndarray:
    """For each vector and shard: may the shard be home to a vector with at least ``cosine``?

    ``widest`` and ``narrowest`` are the least and the largest cosine between a shard's centroid and a vector at home in
    it (NaN without one). Two bounds exclude a shard: the triangle inequality of the angles to its centroid, and the
    distance to the plane between the vector's own centroid and the shard's, beyond which the shard's vectors lie.
    """
    slack = 1e-7  # far above the rounding of the angles
    reach, chord = np.arccos(np.clip(cosine, -1, 1)), np.sqrt(max(0.0, 2 - 2 * cosine))
    along = vectors @ centres.T
    angle = np.arccos(np.clip(along, -1, 1))
    near = angle <= np.arccos(np.clip(widest, -1, 1)) + reach + slack
    near &= angle >= np.arccos(np.clip(narrowest, -1, 1)) - reach - slack
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))[home]
    return near & (along[np.arange(len(vectors)), home][:, None] - along <= chord * apart + slack)


def summary(
    ids: np.ndarray, q_ids: np.ndarray, a: np.ndarray, b: np.ndarray, copies: np.ndarray, q_copies: np.ndarray | None = None
) -> pd.DataFrame:
    """``node``, ``links``, ``root`` for the links (query a, node b) of a task; with ``q_copies`` the nodes get them too."""
    every = np.unique(np.concatenate([ids, q_ids]))
    at, q_at = np.searchsorted(every, ids), np.searchsorted(every, q_ids)
    root = roots_of(q_at[a], at[b], every)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, q_at[a], copies[b])
    if q_copies is not None:
        np.add.at(total, at[b], q_copies[a])
    used = (total > 0) | (root != every)
    return pd.DataFrame({"node": every[used], "links": total[used], "root": root[used]})


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """``key``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors``.

    Only vectors of equal, non-null labels and equal length are compared. Vectors that are null, empty, zero or hold
    null or non-finite components, and rows with a null key, link with nothing and are their own component.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    values = F.col(vector)
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(values) > 0) & ~F.exists(
        values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = vectors.select(
        F.col(key).alias("id"), F.col(label).alias("_label"), F.coalesce(usable, F.lit(False)).alias("_ok"),
        values.cast("array<double>").alias("embedding")).withColumn("label", F.concat_ws(
            ":", F.col("_label").cast("string"), F.size("embedding").cast("string")))
    group = ["_label", "embedding"]
    classes = scratch.write(rows.filter("_ok").groupBy(*group).agg(
        F.min("id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label")))
    sample = classes.select("label", "embedding", "node").orderBy(F.xxhash64("node"), "node").limit(FIT_SAMPLE).toPandas()
    sampled = spark.createDataFrame([(x,) for x in sorted(set(sample["label"]))], "label string")  # at most FIT_SAMPLE labels
    counts = {r["label"]: r["count"] for r in classes.join(F.broadcast(sampled), "label").groupBy("label").count().collect()}
    shared = spark.sparkContext.broadcast(centroids(sample, counts))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for value, part in batch.groupby("label"):
                centres = shared.value.get(value)
                if centres is None:  # a label without sampled vectors is one shard
                    order, along = np.zeros((len(part), 1), np.int64), np.ones((len(part), 1))
                else:
                    along = normalised(part["embedding"]) @ centres.T
                    order = np.argsort(-along, axis=1, kind="stable")[:, :OVERLAP]
                yield pd.DataFrame({
                    "label": part["label"], "node": part["node"], "copies": part["copies"], "embedding": part["embedding"],
                    "shards": [o.tolist() for o in order], "along": along[np.arange(len(part)), order[:, 0]]})

    kind = vectors.schema[key].dataType.simpleString()
    assigned = scratch.write(classes.select("label", "node", "copies", "embedding").mapInPandas(
        assign, f"label string, node {kind}, copies long, embedding array<double>, shards array<int>, along double"))
    members = assigned.withColumn("shard", F.explode("shards"))
    sizes = members.groupBy("label", "shard").agg(F.count("*").alias("_members"))
    sizes = sizes.select("label", "shard", F.ceil(F.col("_members") / F.lit(BLOCK)).cast("int").alias("blocks"),
                         F.ceil(F.col("_members") / F.lit(ASK_BLOCK)).cast("int").alias("ask_blocks"))
    members = members.join(sizes, ["label", "shard"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        lists = robust_prune(normalised(pdf["embedding"]))
        ids = pdf["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[x].tolist() for x in lists]})

    adjacency = members.select("label", "shard", "block", "node", "embedding").groupBy("label", "shard", "block").applyInPandas(
        build, f"node {kind}, near array<{kind}>")
    united = scratch.write(adjacency.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    nodes = members.join(united, "node").select(
        "label", "shard", "block", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("q_block"), F.lit(False).alias("asks"),
        "node", "copies", "embedding", "shards", "near")
    asks = members.filter(F.col("shards")[0] == F.col("shard")).select(
        "label", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("node"), F.col("ask_blocks")).cast("int").alias("q_block"),
        F.lit(True).alias("asks"), "node", "copies", "embedding", "shards", F.lit(None).cast(f"array<{kind}>").alias("near"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        there = pdf[~pdf["asks"]].sort_values("node").reset_index(drop=True)
        query = pdf[pdf["asks"]].sort_values("node").reset_index(drop=True)
        empty = pd.DataFrame({"node": [], "links": [], "root": []})
        if not len(there) or not len(query):
            return empty
        ids, q_ids = there["node"].to_numpy(), query["node"].to_numpy()
        place = pd.Series(np.arange(len(ids)), index=ids)
        counts = np.array([len(x) for x in there["near"]])
        listed = place.reindex(np.concatenate(there["near"].tolist())).fillna(-1).to_numpy(np.int64)
        lists = [x[x >= 0] for x in np.split(listed, np.cumsum(counts)[:-1])]
        own = place.reindex(q_ids).fillna(-1).to_numpy(np.int64)
        v, q = normalised(there["embedding"]), normalised(query["embedding"])
        a, b = range_search(v, lists, q, own, cosine)
        # Nodes at home elsewhere only lead on; their links are those of ``_across``.
        home = pdf["shard"].iloc[0]
        own_home = np.array([s[0] == home for s in there["shards"]])
        other = own_home[b] & (ids[b] != q_ids[a])
        a, b = a[other], b[other]
        return summary(ids, q_ids, a, b, there["copies"].to_numpy())

    found = nodes.union(asks).groupBy("label", "shard", "block", "q_block").applyInPandas(
        search, f"node {kind}, links long, root {kind}")
    if any(len(centres) > 1 for centres in shared.value.values()):
        found = found.union(_across(assigned, shared.value, cosine))
    found = scratch.write(found)
    groups = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")), scratch)
    summed = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(summed, "node", "left").join(groups.withColumnRenamed("id", "node"), "node", "left").select(
        *group, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"))
    # Equal vectors have equal bits but for the sign of zero, which grouping and joining both ignore.
    good = rows.filter("_ok").join(named, group).select("id", "n_links", "component_id")
    bad = rows.filter("not _ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(bad).select(
        F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _across(assigned: DataFrame, centres: dict[str, np.ndarray], cosine: float) -> DataFrame:
    """``node``, ``links``, ``root`` of the links between vectors of different homes, all of them.

    A vector asks the shards after its home that ``reachable`` leaves; a link counts for both of its ends.
    """
    spark, kind = assigned.sparkSession, assigned.schema["node"].dataType.simpleString()
    homes = assigned.withColumn("shard", F.col("shards")[0])
    bounds = {label: np.full((2, len(c)), np.nan) for label, c in centres.items()}
    sampled = spark.createDataFrame([(label,) for label in bounds], "label string")
    widths = homes.join(F.broadcast(sampled), "label").groupBy("label", "shard").agg(F.min("along"), F.max("along"))
    for label, shard, least, most in widths.collect():  # one row per centroid
        bounds[label][:, shard] = least, most
    shared = spark.sparkContext.broadcast({x: (c, bounds[x]) for x, c in centres.items() if len(c) > 1})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for value, part in batch.groupby("label"):
                if value in shared.value:
                    centroid, (widest, narrowest) = shared.value[value]
                    home = part["shard"].to_numpy()
                    near = reachable(normalised(part["embedding"]), home, centroid, widest, narrowest, cosine)
                    near &= np.arange(len(centroid)) > home[:, None]
                    row, shard = np.nonzero(near)
                    yield part.iloc[row].assign(shard=shard)

    columns = ["label", "shard", "node", "copies", "embedding"]
    asks = homes.select(*columns).mapInPandas(
        ask, f"label string, shard int, node {kind}, copies long, embedding array<double>")
    asked = asks.groupBy("label", "shard").agg(F.ceil(F.count("*") / F.lit(ASK_BLOCK)).cast("int").alias("ask_blocks"))
    sizes = homes.groupBy("label", "shard").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).join(
        asked, ["label", "shard"])

    def dealt(rows: DataFrame, asks: bool, own: str, other: str, blocks: str, other_blocks: str) -> DataFrame:
        return rows.select(*columns).join(sizes, ["label", "shard"]).withColumn(
            own, F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).select(
            "label", "shard", "block", "q_block", F.lit(asks).alias("asks"), "node", "copies", "embedding")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        there, query = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        if not len(there) or not len(query):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        v, q = normalised(there["embedding"]), normalised(query["embedding"])
        met = [np.nonzero(q[at : at + 256] @ v.T >= cosine) for at in range(0, len(q), 256)]
        a = np.concatenate([r + 256 * i for i, (r, _) in enumerate(met)])
        b = np.concatenate([n for _, n in met])
        return summary(there["node"].to_numpy(), query["node"].to_numpy(), a, b, there["copies"].to_numpy(), query["copies"].to_numpy())

    both = dealt(homes, False, "block", "q_block", "blocks", "ask_blocks").union(
        dealt(asks, True, "q_block", "block", "ask_blocks", "blocks"))
    return both.groupBy("label", "shard", "block", "q_block").applyInPandas(compare, f"node {kind}, links long, root {kind}")


def audit_recall(
    vectors: DataFrame, found: DataFrame, queries: str, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """One row: ``found``, ``wanted`` and ``recall`` of the links of the queries, against brute force in blocks.

    ``queries`` is a condition such as ``vec_id % 100 = 0``. The query vectors are collected to be compared with every
    row, so the condition must select a bounded set.
    """
    asked = vectors.filter(queries).select(key, vector, label).dropna().toPandas()
    asked = asked[[len(v) > 0 and np.isfinite(np.asarray(v, np.float64)).all() and np.any(v) for v in asked[vector]]]
    shared = vectors.sparkSession.sparkContext.broadcast(
        (asked[key].to_numpy(), asked[label].to_numpy(), normalised(asked[vector]) if len(asked) else np.zeros((0, 1))))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, wanted = shared.value
        for batch in batches:
            batch = batch.dropna()
            keep = [len(v) == wanted.shape[1] and np.isfinite(np.asarray(v, np.float64)).all() and np.any(v) for v in batch[vector]]
            batch = batch[np.array(keep, bool)] if len(batch) else batch
            if len(batch) and len(ids):
                close = (wanted @ normalised(batch[vector]).T >= cosine) & (labels[:, None] == batch[label].to_numpy()[None, :])
                close &= ids[:, None] != batch[key].to_numpy()[None, :]
                yield pd.DataFrame({key: ids, "n": close.sum(axis=1)})

    kind = vectors.schema[key].dataType.simpleString()
    truth = vectors.select(key, vector, label).mapInPandas(compare, f"{key} {kind}, n long").groupBy(key).agg(F.sum("n").alias("n"))
    both = truth.join(found.select(key, "n_links"), key)
    return both.agg(F.sum(F.least("n", "n_links")).alias("found"), F.sum("n").alias("wanted")).withColumn(
        "recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(1.0))
