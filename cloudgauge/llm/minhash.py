"""Near-duplicate texts by bottom-k sketches of one hash function.

A sketch holds the ``SKETCH`` smallest shingle hashes of a text. Inverted lists of retained values
give candidates, the sketch of the union estimates their similarity, the full sets confirm it.

*Lists.* Two texts at the threshold share at least ``SHARED`` retained values (all but 5e-7 of such
pairs; texts whose sketch is their whole set: always). By the prefix argument it is enough to list each
text under its first ``size - shared + 1`` values of any common order; values that are frequent in the
corpus come last, so a passage in a third of all texts hardly gets a list.
*Groups.* Equal sets are one vertex. Each list first links its members to one of them, so a group of copies costs its
size, not its square. Lists that this leaves in several components are compared pair by pair if they are short. Members
of the long ones get exact lists instead: whole sets with the rarest shingles first, where two texts meet only if both
positions leave room for the overlap that the threshold demands. Families of edited copies below the
threshold, and texts around a common passage, then hardly meet, and no pair of different texts is left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudgauge.llm.common import Scratch, slices
from cloudgauge.llm.components import components

SHINGLE = 5
PERCENT = 80
SKETCH = 128
#: Standard deviations that the lists and the estimate leave below the threshold.
MARGIN = 5.0
#: Values in at least this many sketches count as frequent. Only the order of lists depends on it, never the result.
FREQUENT = 50
#: Frequent values, and candidate ids, that a broadcast may hold. More ids are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members up to which an open list is compared pair by pair.
SHORT_LIST = 32
_WORDS: dict[bytes, int] = {}


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of all runs of ``size`` words; with fewer words, of the whole sequence."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(codes) - size + 1, size, np.uint64)
    for j in range(size):
        out = (out ^ codes[j : len(codes) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out ^ (out >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key``, ``n`` (set size), ``print`` (128-bit fingerprint of the set), ``sketch`` (its smallest hashes)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            counts, prints, kept = [], [], []
            for raw in batch.column("_text").to_pylist():
                hashes = shingle_hashes(raw, size)
                counts.append(len(hashes))
                prints.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                kept.append(hashes[:SKETCH])
            ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else []))],
                ["_key", "n", "print", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    return source.mapInArrow(run, f"_key {kind}, n long, print binary, sketch array<long>")


def needed_overlap(n: int, share: float) -> int:
    """Retained values that a set of ``n`` shares with any set at the threshold ``share``."""
    if n <= share * SKETCH:  # every partner's sketch is its whole set
        return math.ceil(share * n - 1e-9)
    # Of a union of at most n / share values the sketches see a sample without replacement.
    spread = math.sqrt(SKETCH * share * (1 - share) * (1 - SKETCH * share / n)) if n > SKETCH * share else 0.0
    return max(1, math.floor(SKETCH * share - MARGIN * spread))


def postings(sets: DataFrame, share: float, scratch: Scratch) -> DataFrame:
    """``value``, ``id``, ``n``: the prefix of every sketch with frequent values last, by their number of sketches.

    Of more than ``BROADCAST_IDS`` frequent values only the most frequent get a rank; any order gives the same pairs."""
    counts = sets.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    frequent = scratch.write(counts.filter(F.col("n") >= FREQUENT))
    levels = frequent.groupBy(F.floor(F.log2(F.col("n").cast("double"))).alias("level")).count().orderBy(F.desc("level")).collect()
    least, held = 1 << 62, 0
    for level, n in levels:  # one row per power of two
        held += n
        if held > BROADCAST_IDS:
            break
        least = 1 << level
    top = frequent.filter(F.col("n") >= least).toPandas().sort_values("value")
    scratch.drop(frequent)
    known = sets.sparkSession.sparkContext.broadcast((top["value"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, often = known.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                out_values, out_rows = [], []
                sizes = part.column("n").to_pylist()
                for row, raw in enumerate(part.column("sketch").to_numpy(zero_copy_only=False)):
                    keep = len(raw) - min(needed_overlap(sizes[row], share), len(raw)) + 1
                    if len(values):
                        at = np.minimum(np.searchsorted(values, raw), len(values) - 1)
                        rank = np.where(values[at] == raw, often[at], 0)
                        raw = raw[np.lexsort((raw, rank))]
                    out_values.append(raw[:keep])
                    out_rows.append(np.full(min(keep, len(raw)), row))
                rows = np.concatenate(out_rows) if out_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_values) if out_values else np.zeros(0, np.int64)),
                     part.column("id").take(pa.array(rows)), part.column("n").take(pa.array(rows))], ["value", "id", "n"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "n", "sketch").mapInArrow(run, f"value long, id {kind}, n long")


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``_key``, ``hashes`` of the documents whose key is among ``wanted`` (distinct ``_key``)."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            kept = [shingle_hashes(raw, size) for raw in batch.column("_text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))],
                ["_key", "hashes"])

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")).join(wanted, "_key")
    return texts.mapInArrow(run, f"_key {kind}, hashes array<long>")


def verified(
    pairs: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int, scratch: Scratch
) -> DataFrame:
    """The pairs (src, dst) whose full sets reach the threshold; sketches of the unions filter them first."""
    share = percent / 100
    side = sets.select("id", "sketch")
    both = pairs.join(side.withColumnsRenamed({"id": "src", "sketch": "_a"}), "src").join(
        side.withColumnsRenamed({"id": "dst", "sketch": "_b"}), "dst")
    union = F.slice(F.array_sort(F.array_union("_a", "_b")), 1, SKETCH)
    common = F.size(F.array_intersect(union, F.array_intersect("_a", "_b")))
    floor = share - MARGIN * math.sqrt(share * (1 - share) / SKETCH)
    near = scratch.write(both.filter(common >= F.size(union) * F.lit(floor)).select("src", "dst").distinct())
    wanted = near.select(F.col("src").alias("_key")).union(near.select(F.col("dst").alias("_key"))).distinct()
    full = scratch.write(_full_sets(docs, wanted, key, text, size))
    checked = near.join(full.withColumnsRenamed({"_key": "src", "hashes": "_a"}), "src").join(
        full.withColumnsRenamed({"_key": "dst", "hashes": "_b"}), "dst")
    shared = F.size(F.array_intersect("_a", "_b"))
    out = scratch.write(checked.filter(
        F.lit(100) * shared >= F.lit(percent) * (F.size("_a") + F.size("_b") - shared)).select("src", "dst").distinct())
    scratch.drop(near, full)
    return out


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``.

    Two texts are linked when 100 * |intersection| >= ``percent`` * |union| of their shingle sets; the component
    id is the smallest key reachable by links. Texts without words, null texts and rows with a null key are
    linked with nothing (their component is their own key). Rows that share a key are one document, linked by
    any of its texts. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    share = percent / 100
    signed = scratch.write(sketches(docs, key, text, shingle))
    usable = signed.filter("n > 0 and _key is not null")
    classes = usable.groupBy("print").agg(F.min("_key").alias("id"))
    firsts = usable.join(classes.withColumnRenamed("id", "_key"), ["print", "_key"])
    sets = scratch.write(firsts.select(F.col("_key").alias("id"), "n", "print", "sketch").dropDuplicates(["print"]))
    # Sizes of pairs at the threshold differ by less than one step, so neighbouring steps hold all partners.
    lists = postings(sets, share, scratch)
    lists = lists.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(share))).cast("int"))
    lists = scratch.write(lists)
    heads = lists.groupBy("value", "step").agg(F.min("id").alias("head"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
    star = lists.join(heads, ["value", "step"]).filter("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst"))
    edges = verified(star.distinct(), sets, docs, key, text, shingle, percent, scratch)
    labels = scratch.write(components(edges, scratch))
    open_pairs = _open_pairs(lists, labels, docs, key, text, shingle, share, scratch)
    rest = verified(open_pairs, sets, docs, key, text, shingle, percent, scratch)
    same_key = usable.join(classes, "print").filter("_key <> id").select(F.col("_key").alias("src"), F.col("id").alias("dst"))
    repeated = usable.groupBy("_key").agg(F.countDistinct("print").alias("_k")).filter("_k > 1").select(F.col("_key").alias("src"))
    ties = same_key.join(repeated, "src", "left_semi").union(
        usable.join(classes, "print").join(repeated.withColumnRenamed("src", "_key"), "_key", "left_semi").select(
            F.col("_key").alias("src"), F.col("id").alias("dst")))
    found = components(labels.select(F.col("id").alias("src"), F.col("root").alias("dst")).union(rest).union(ties), scratch)
    named = classes.join(found, "id", "left").select(
        "print", F.coalesce("root", "id").alias("component_id"))
    return signed.join(named, "print", "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("_key").isNotNull(), F.col("component_id")).otherwise(F.col("_key")).alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def _open_pairs(
    lists: DataFrame, labels: DataFrame, docs: DataFrame, key: str, text: str, size: int, share: float, scratch: Scratch
) -> DataFrame:
    """Pairs of different components that a list brings together: all of short lists, those of ``_whole_pairs`` of long ones."""
    sizes = lists.groupBy("value").agg(F.count("*").alias("_m")).filter("_m > 1")
    rooted = scratch.write(lists.join(sizes, "value").join(labels, "id", "left").select(
        "value", "id", "n", "_m", F.coalesce("root", "id").alias("root")))
    several = rooted.groupBy("value").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo <> _hi").select("value")
    opened = scratch.write(rooted.join(several, "value"))
    scratch.drop(rooted)
    short = opened.filter(F.col("_m") <= SHORT_LIST)
    other = short.select("value", F.col("id").alias("_a"), F.col("n").alias("_na"), F.col("root").alias("_ra"))
    direct = other.join(short, "value").filter(
        (F.col("_ra") != F.col("root")) & (F.col("_a") < F.col("id"))
        & (F.least("_na", "n") >= F.lit(share) * F.greatest("_na", "n") - 1e-9)).select(
        F.col("_a").alias("src"), F.col("id").alias("dst"))
    long = opened.filter(F.col("_m") > SHORT_LIST).select("id", "root").distinct()
    return direct.union(_whole_pairs(scratch.write(long), docs, key, text, size, share, scratch)).distinct()


def _whole_pairs(
    members: DataFrame, docs: DataFrame, key: str, text: str, size: int, share: float, scratch: Scratch
) -> DataFrame:
    """Pairs of members (id, root) of different roots whose whole sets may reach the threshold: the exact prefix and
    position filter, shingles in the order of their number of members."""
    full = scratch.write(_full_sets(docs, members.select(F.col("id").alias("_key")), key, text, size))
    values = full.select(F.col("_key").alias("id"), F.size("hashes").alias("n"), F.explode("hashes").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("_m")).filter("_m > 1")
    shared = values.join(often, "value").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("_m", "value"))).alias("_shared"))
    # Values of one member only come first in the order; they take positions but bring nobody together.
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1 - (F.col("n") - F.size("_shared"))
    placed = shared.filter(keep > 0).select("id", "n", F.posexplode(F.slice("_shared", F.lit(1), keep.cast("int"))).alias("_i", "_s"), "_shared")
    placed = placed.select(
        "id", "n", F.col("_s.value").alias("value"), (F.size("_shared") - F.col("_i")).alias("_room")).join(members, "id")
    placed = scratch.write(placed)
    other = placed.select("value", F.col("id").alias("_a"), F.col("n").alias("_na"), F.col("root").alias("_ra"), F.col("_room").alias("_rooma"))
    need = (F.col("_na") + F.col("n")) * F.lit(share / (1 + share)) - 1e-9
    return other.join(placed, "value").filter(
        (F.col("_a") < F.col("id")) & (F.col("_ra") != F.col("root")) & (F.least("_rooma", "_room") >= need)).select(
        F.col("_a").alias("src"), F.col("id").alias("dst")).distinct()


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest key; columns as they are.

    Rows that share a key are one document: of its rows with equal texts (or null texts) any one stays, and different
    texts under that key all stay. Rows with a null key all stay.
    """
    scratch = Scratch(docs.sparkSession)
    kept = scratch.write(near_duplicates(docs, key, text, **options).filter("kept").groupBy(F.col(key).alias("_kept")).agg(
        (F.col("_kept").isNotNull() & (F.count("*") > 1)).alias("_many")))
    single, many = kept.filter("not _many").select("_kept"), kept.filter("_many").select("_kept")
    out = docs.join(single, docs[key].eqNullSafe(F.col("_kept")), "left_semi")
    if many.isEmpty():
        return out
    repeated = docs.join(many, docs[key] == F.col("_kept"), "left_semi").withColumn("_print", F.sha2(F.col(text).cast("binary"), 256))
    return out.union(repeated.dropDuplicates([key, "_print"]).drop("_print"))
