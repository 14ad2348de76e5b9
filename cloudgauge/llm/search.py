"""Ranked lexical search by the Best Position Algorithm.

Documents are turned once into the frequencies of the terms that a query set uses. A task then holds shards of
documents. In a shard every term has an impact list (documents by falling score) and, for direct access, the same
entries by document. For each query the lists are read from the top in blocks; every document met is looked up in all
lists, which also marks its positions there as seen. The best position of a list is the last of its unbroken run of
seen positions, so a document not met yet scores at most the sum of the scores there; reading stops as soon as this
sum lies strictly below the k-th best score. The best documents of a task's earlier shards count too. Queries run in blocks whose
terms have a bounded size; rankings of tasks are merged by windows, first inside salts, then over all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudgauge.llm.common import Scratch, slices

TOP = 50
#: Bytes of query text whose terms one pass over the documents looks for.
BLOCK_BYTES = 4 << 20
#: Documents and frequencies (document, term) in a shard; a document belongs to one shard.
SHARD_ENTRIES = 600_000
#: Positions of every list that the first round of a query reads; each later round reads twice as many.
FIRST_READ = 16
#: Rankings are merged inside this many salts of a query before they are merged over all.
SALTS = 64
#: Bytes that separate terms become a space, A-Z become lower case; digits, letters and all of non-ASCII stay.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order: runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(TERM_BYTES).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def frequencies(docs: DataFrame, key: str, text: str, wanted: dict[bytes, int]) -> DataFrame:
    """``key``, ``n`` (terms of the document with repeats), ``terms`` (numbers of its wanted terms), ``times``."""
    known = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in slices(batches, "_text"):
            sizes, ends, terms, times = [], [0], [], []
            for raw in batch.column("_text").to_pylist():
                own = terms_of(raw)
                sizes.append(len(own))
                found = [(numbers[w], n) for w, n in Counter(own).items() if w in numbers]
                terms.extend(t for t, _ in found)
                times.extend(n for _, n in found)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))], ["_key", "n", "terms", "times"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    return source.mapInArrow(run, f"_key {kind}, n long, terms array<int>, times array<int>")


class Shard:
    """Impact lists of some documents, and the same entries by document for direct access."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray, weights: np.ndarray,
                 documents: int, total: int) -> None:
        m = 50 + (50 * n * documents) // max(total, 1)
        score = weights[term] * ((1_000_000_000 * times) // (1000 * times + 20 * m[doc]))
        self.docs = len(n)
        by_doc = np.lexsort((doc, term))
        self.keys = term[by_doc] * self.docs + doc[by_doc]  # sorted: (term, document)
        self.scores = score[by_doc]
        by_score = np.lexsort((doc, -score, term))
        self.ranked_doc, self.ranked_score = doc[by_score], score[by_score]
        self.bounds = np.searchsorted(term[by_score], np.arange(len(weights) + 1))
        place = np.empty(len(doc), np.int64)
        place[by_score] = np.arange(len(doc))
        self.place = place[by_doc]  # position of each (term, document) in its impact list

    def best(self, terms: np.ndarray, k: int, floor: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that may be among the ``k`` best, given scores ``floor`` found elsewhere."""
        first, ends = self.bounds[terms], self.bounds[terms + 1]
        live = ends > first
        terms, first, ends = terms[live], first[live], ends[live]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum(ends - first)])
        shift = first - base[:-1]
        seen = np.zeros(base[-1], bool)  # positions of all lists of the query, one list after the other
        met = np.zeros(self.docs, bool)
        best = base[:-1].copy()  # first position of each list that is not seen
        at, read = first.copy(), FIRST_READ
        docs, scores = [], []
        top = np.array(floor, np.int64)
        while True:
            to = np.minimum(at + read, ends)
            lengths = to - at
            total = int(lengths.sum())
            if not total:
                break
            new = self.ranked_doc[np.arange(total) + np.repeat(at - np.cumsum(lengths) + lengths, lengths)]
            new = np.unique(new[~met[new]])
            met[new] = True
            at, read = to, read * 2
            if len(new):
                wanted = (terms[:, None] * self.docs + new[None, :]).ravel()
                slot = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[slot] == wanted
                own = np.where(hit, self.scores[slot], 0).reshape(len(terms), len(new)).sum(axis=0)
                lists = np.repeat(np.arange(len(terms)), len(new))[hit]
                seen[self.place[slot[hit]] - shift[lists]] = True
                docs.append(new)
                scores.append(own)
                top = np.sort(np.concatenate([top, own]))[-k:]
            limit = 0
            for i in range(len(terms)):
                rest = seen[best[i] : base[i + 1]]
                run = int(rest.argmin()) if len(rest) else 0
                best[i] = best[i] + run if len(rest) and not rest[run] else base[i + 1]
                # An unseen document stands below the best position, so at most at the score of the first unseen one.
                if best[i] < base[i + 1]:
                    limit += int(self.ranked_score[best[i] + shift[i]])
            if len(top) == k and limit < top[0] or limit == 0:
                break
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, points = np.concatenate(docs), np.concatenate(scores)
        keep = points >= (top[0] if len(top) == k else 1)
        keep &= points > 0
        return found[keep], points[keep]


def _ranked(
    table: DataFrame, queries: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int,
) -> DataFrame:
    """``query`` (place in ``queries``), ``_key``, ``score``: per task the documents that may be among the ``k`` best."""
    known = table.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = known.value
        held: list[pa.RecordBatch] = []
        entries = 0
        tops: list[list[int]] = [[] for _ in queries]

        def answer() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            counts = whole.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            shard = Shard(
                whole.column("n").to_numpy(), np.repeat(np.arange(len(counts)), counts),
                whole.column("terms").combine_chunks().flatten().to_numpy().astype(np.int64),
                whole.column("times").combine_chunks().flatten().to_numpy().astype(np.int64), weights, documents, total)
            rows, found, points = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for q, terms in enumerate(queries):
                doc, score = shard.best(terms, k, tops[q])
                tops[q] = sorted([*tops[q], *score.tolist()])[-k:]
                rows.append(np.full(len(doc), q))
                found.append(doc)
                points.append(score)
            keys = whole.column("_key").combine_chunks().take(pa.array(np.concatenate(found)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(rows).astype(np.int32)), keys, pa.array(np.concatenate(points))], ["query", "_key", "score"])

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                held.append(part)
                entries += part.num_rows + len(part.column("terms").flatten())
                if entries >= SHARD_ENTRIES:
                    yield answer()
                    held.clear()
                    entries = 0
        if held:
            yield answer()

    kind = table.schema["_key"].dataType.simpleString()
    return table.select("_key", "n", "terms", "times").mapInArrow(run, f"query int, _key {kind}, score long")


def search(
    docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item``, ``rank`` (from 1), ``key``, ``score``: the ``k`` best documents above 0 of every query.

    Equal scores go by ascending ``key``, nulls first. Documents without a term (null, empty) count nowhere; queries
    without a term have no rows. Repeated document rows are documents of their own; queries equal in id and text count
    once, different texts under one id are ranked each on its own. Queries run in blocks; the texts of one block pass through
    the driver (``BLOCK_BYTES``, or one longer text).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    asked = queries.select(F.col(item).alias("_item"), F.col(item_text).cast("binary").alias("_asked")).filter(
        F.octet_length("_asked") > 0).distinct()
    size = asked.agg(F.sum(F.octet_length("_asked"))).first()[0] or 0
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_item", "_asked"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        rows = asked.filter(F.col("_block") == block).select("_item", "_asked").collect()
        sets = [sorted(set(terms_of(bytes(r["_asked"])))) for r in rows]
        numbers = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        table = scratch.write(frequencies(docs, key, text, numbers))
        documents, total = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        # One row per term of the block.
        holding = np.zeros(len(numbers), np.int64)
        for term, n in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            holding[term] = n
        weights = np.array([term_weight(documents, int(n)) for n in holding], np.int64)
        places = [np.array([numbers[t] for t in s if weights[numbers[t]] > 0], np.int64) for s in sets]
        found = _ranked(table, places, weights, documents, total, k)
        order = [F.desc("score"), F.asc("_key")]
        near = Window.partitionBy("query", "_salt").orderBy(*order)
        found = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn(
            "_rank", F.row_number().over(near)).filter(F.col("_rank") <= k)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(
            F.col("rank") <= k)
        kind = asked.schema["_item"].dataType.simpleString()
        named = spark.createDataFrame([(i, r["_item"]) for i, r in enumerate(rows)], f"query int, _item {kind}")
        ranked = ranked.join(named, "query").select(
            F.col("_item").alias(item), "rank", F.col("_key").alias(key), "score")
        out = ranked if out is None else out.union(ranked)
    return out
