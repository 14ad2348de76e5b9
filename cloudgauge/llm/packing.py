"""Packing of token pieces into sequences: best-fit decreasing with certified bin counts.

Pieces are dealt to groups of about ``GROUP`` by row, so no key can make a group hot. Each group is packed by
best-fit decreasing and compared with a lower bound from dual-feasible functions. A group whose count equals its bound
is certified and keeps all sequences but its emptiest one; a group with a gap gives up all sequences with room. What
was given up is dealt to new groups with pieces of other groups and packed again, until the bound of all pieces is
met or rounds save no sequence. Only lengths decide; a round that saves nothing is thrown away.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.llm.common import Scratch, slices
from cloudgauge.llm.wordtokens import WordTokens

CAPACITY = 4096
#: Pieces of a first group on average. More make better groups, fewer make more tasks.
GROUP = 2048
#: Each round of exchange has groups of twice as many pieces, up to this many times ``GROUP``.
GROWTH = 16
#: Rounds of exchange at most, and rounds in a row that may save nothing.
ROUNDS, PATIENCE = 12, 2
#: Largest k of the dual-feasible functions u_k.
STEPS = 40


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every length, and the number of bins. Longest first, each into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: some bin has exactly r left
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, place = capacity, used
            used += 1
        left = room - n
        rooms |= 1 << left
        by_room[left].append(place)
        bins[i], offsets[i] = place, capacity - room
    return bins, offsets, used


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``counts[n]`` pieces of each length n needs.

    The largest of the dual-feasible functions: for every cut c up to half the capacity, lengths above
    ``capacity - c`` weigh a whole bin, lengths below c nothing, and the others their share or its rounding u_k.
    """
    size = np.arange(capacity + 1)
    counts = np.asarray(counts, np.int64)
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # pieces of at least this length
    cuts = np.arange(capacity // 2 + 1)
    best = 0
    for k in range(STEPS + 1):
        scale = capacity * max(k, 1)
        if k == 0:
            value = size
        else:
            value = np.where((k + 1) * size % capacity == 0, k * size, capacity * ((k + 1) * size // capacity))
        sums = np.concatenate([[0], np.cumsum(value * counts)])
        middle = sums[capacity - cuts + 1] - sums[cuts]
        total = above[capacity - cuts + 1] * scale + middle
        best = max(best, int((-(-total // scale)).max()))
    return best


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, text: str = "text", ids: str | None = None,
) -> DataFrame:
    """One row per piece of every document: the other columns of ``docs`` and ``piece`` (from 0), ``start``, ``length``,
    ``ids_crc32`` (of little-endian unsigned 32-bit ids), and the ids themselves in ``ids`` if a name is given.

    A document is its token ids and ``end_id``; one longer than ``capacity`` is cut into pieces of that length, the last
    of which may be shorter. Null and empty texts are ``end_id`` alone. Columns of the named ones are replaced, ``text``
    is left out. Repeated rows are documents of their own. Nothing is shuffled.
    """
    new = ["piece", "start", "length", "ids_crc32", *([ids] if ids else [])]
    kept = [c for c in docs.columns if c != text and c not in new]
    fields = [docs.schema[c] for c in kept] + [T.StructField("piece", T.IntegerType())] + [
        T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    if ids:
        fields.append(T.StructField(ids, T.ArrayType(T.LongType(), False)))
    source = docs.select(*kept, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokens.of(vocabulary)
        for batch in slices(batches, "_text"):
            rows, piece, start, length, crc, tokens = [], [], [], [], [], []
            for row, own in enumerate(coder.encode(batch.column("_text").to_pylist())):
                whole = np.append(own, np.uint32(end_id)).astype("<u4")
                for n, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    rows.append(row), piece.append(n), start.append(at), length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if ids:
                        tokens.append(part.astype(np.int64))
            at = pa.array(rows)
            arrays = [batch.column(c).take(at) for c in kept] + [
                pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])

    return source.mapInArrow(run, T.StructType(fields))


def _packed(rows: DataFrame, groups: int, step: int, length: str, capacity: int) -> DataFrame:
    """``rows`` with their bin inside a new group; ``_bins`` and ``_bound`` belong to the group."""
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(step)), F.lit(groups)))
    new = ["_bin", "offset", "_bins", "_bound"]
    schema = T.StructType(dealt.schema.fields + [T.StructField(n, T.LongType()) for n in new])

    def fit(table: pa.Table) -> pa.Table:
        sizes = table.column(length).fill_null(0).to_numpy().astype(np.int64)
        if sizes.max() > capacity or sizes.min() < 0:
            raise ValueError(f"a piece is longer than {capacity} or negative; cut it first")
        place, offset, used = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        for name, column in zip(new, (place, offset, np.full(len(sizes), used), np.full(len(sizes), bound))):
            table = table.append_column(name, pa.array(column))
        return table

    return dealt.groupBy("_group").applyInArrow(fit, schema)


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", group: int = GROUP, rounds: int = ROUNDS,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` (any long, one per sequence) and ``offset`` (place there, gapless from 0).

    Every row is packed once; repeated rows are pieces of their own. A null length counts as 0, a length above
    ``capacity`` is an error. Columns of the two names are replaced; names that begin with ``_`` and equal a helper
    (``_row _group _bin _bins _bound``) are refused. An empty table gives an empty one.
    """
    clash = {"_row", "_group", "_bin", "_bins", "_bound"} & set(pieces.columns)
    if clash:
        raise ValueError(f"rename {sorted(clash)} first")
    scratch = Scratch(pieces.sparkSession)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pool = scratch.write(pieces.select(*columns, F.monotonically_increasing_id().alias("_row")))
    # One row per length, so at most capacity + 1.
    lengths = pool.groupBy(F.coalesce(length, F.lit(0)).cast("long").alias("n")).count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for n, rows in lengths:
        if not 0 <= n <= capacity:
            raise ValueError(f"a piece is longer than {capacity} or negative; cut it first")
        counts[n] = rows
    least = lower_bound(counts, capacity)
    done: list[DataFrame] = []
    rows, before, fixed, failed = int(counts.sum()), None, 0, 0
    last = None  # the packing of the pool as the round before left it
    for step in range(rounds + 1):
        if not rows:
            break
        size = group * min(2**step, GROWTH)
        packed = scratch.write(_packed(pool, max(1, -(-rows // size)), step, length, capacity))
        fill = packed.groupBy("_group", "_bin").agg(
            F.sum(F.coalesce(F.col(length), F.lit(0))).alias("_fill"), F.count("*").alias("_n"),
            F.max("_bins").alias("_bins"), F.max("_bound").alias("_bound"))
        fill = scratch.write(fill)
        now = fill.count()
        if before is not None and now >= before:
            failed += 1
            if failed == PATIENCE or step == rounds:
                done.append(last)
                break
            continue
        failed = 0
        ids = packed.withColumn("sequence_id", F.lit(step << 56) + F.shiftleft("_group", 20) + F.col("_bin"))
        emptiest = fill.groupBy("_group").agg(F.min(F.struct("_fill", "_bin")).alias("_least")).select(
            "_group", F.col("_least._bin").alias("_bin"), F.lit(True).alias("_tail"))
        open_bins = fill.filter(F.col("_fill") < capacity).join(emptiest, ["_group", "_bin"], "left").filter(
            (F.col("_bins") > F.col("_bound")) | F.col("_tail")).select("_group", "_bin", "_n")
        open_bins = scratch.write(open_bins)
        before, rows = (int(x or 0) for x in open_bins.agg(F.count("*"), F.sum("_n")).first())
        if fixed + now <= least or before < 2 or step == rounds:
            done.append(ids)
            break
        keys = open_bins.select("_group", "_bin")
        done.append(ids.join(keys, ["_group", "_bin"], "left_anti"))
        last = ids.join(keys, ["_group", "_bin"], "left_semi")
        fixed += now - before
        pool = last.select(*columns, "_row")
    if not done:
        return pool.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = None
    for part in done:
        part = part.select(*columns, "sequence_id", "offset")
        out = part if out is None else out.unionByName(part)
    return out


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """``sequence_id``, ``ids``: the token ids of each sequence in order of offset. A sequence's pieces meet in one row,
    which its capacity bounds."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("offset"), F.col(ids).alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
