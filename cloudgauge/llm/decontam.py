"""Benchmark passages inside documents: SimHash of item-sized windows.

A window is as long as the item and may reach beyond the text's ends. Moved to its first shared shingle it keeps all
that it shares, so every window that begins with one is tried, and every one that starts before the text and ends with
one, provided that enough of its shingles are the item's; of windows that only turn round in a repeating text the first. The
order of an item's parts plays no role. Each window's
64-bit SimHash is looked up in a multi-index: eight blocks of eight bits, items listed under
every value within two bits of theirs, so that all items of that length within ``RADIUS`` bits
are met; for a pair at similarity 0.8 a greater distance has a chance below 1e-5. The exact
weighted similarity of shingle counts then decides. Everything is DataFrame expressions; documents
are read once per block of items and never shuffled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
#: Two differing bits in each block, and one more bit anywhere would leave some block within two.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Rows of the item tables (shingles and index entries) that one broadcast may hold; more items mean more passes.
BROADCAST_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: lower case, runs of letters, digits and non-ASCII characters; empty array for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(tokens: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; empty for fewer words."""
    last = F.size(tokens) - F.lit(size)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        *[F.get(tokens, i + F.lit(j)) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes; repeated hashes weigh by their count."""
    half = F.size(hashes)

    def bit(j: int) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > half, F.shiftleft(F.lit(1).cast("bigint"), j)).otherwise(F.lit(0).cast("bigint"))

    out = bit(0)
    for j in range(1, BLOCKS * BLOCK_BITS):
        out = out.bitwiseOR(bit(j))
    return out


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of smaller counts over sum of larger counts of all hashes in either array; 0 if both are empty."""
    def times(array: Column, h: Column) -> Column:
        return F.size(F.filter(array, lambda x: x == h))

    shared = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.when(plain, F.size(shared)).otherwise(
        F.aggregate(shared, F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h))))
    total = F.size(a) + F.size(b) - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def block_value(fingerprint: Column, block: int) -> Column:
    return F.shiftrightunsigned(fingerprint, block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def flips() -> list[int]:
    """Masks of up to ``BLOCK_RADIUS`` bits in a block."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= BLOCK_RADIUS]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD,
) -> DataFrame:
    """``key``, ``text_hash``, ``item``, ``start_word``, ``n_words``, ``similarity``: the best window of each document
    and item with a similarity of at least ``threshold``.

    Items of fewer than ``size`` words are one shingle. Null or empty texts on either side match nothing; items with
    equal words are each reported; rows with equal ``key`` and text are one document. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("_item"), words(F.col(item_text)).alias("_words")).filter(F.size("_words") > 0)
    items = items.withColumn("_text", F.xxhash64("_words"))
    distinct = items.select("_text", "_words").dropDuplicates(["_text"]).withColumn("_n", F.size("_words"))
    totals = distinct.agg(F.sum("_n"), F.count("*"), F.collect_set(F.least("_n", F.lit(size)))).first()
    entries = (totals[0] or 0) + totals[1] * BLOCKS * len(flips())
    passes = max(1, -(-entries // BROADCAST_ROWS))
    source = docs.select(
        F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), words(F.col(text)).alias("_words"))
    found = None
    for k in sorted(totals[2]):
        hashed = source.select("_key", "_hash", shingles(F.col("_words"), k).alias("_h"))
        sized = distinct.filter(F.least("_n", F.lit(size)) == k).withColumn("_shingles", shingles(F.col("_words"), k))
        for n in range(passes):
            part = sized.filter(F.pmod("_text", F.lit(passes)) == n)
            hits = _hits(hashed, part.select("_text", "_n", "_shingles"), k, threshold)
            found = hits if found is None else found.union(hits)
    if found is None:
        found = spark.createDataFrame([], "_key long, _hash long, _text long, _start int, _n int, _similarity double")
    best = found.groupBy("_key", "_hash", "_text").agg(
        F.max_by(F.struct("_start", "_n", "_similarity"), F.struct("_similarity", -F.col("_start"))).alias("_best"))
    return best.join(items.select("_text", "_item"), "_text").select(
        F.col("_key").alias(key), F.col("_hash").alias("text_hash"), F.col("_item").alias(item),
        F.col("_best._start").alias("start_word"), F.col("_best._n").alias("n_words"),
        F.col("_best._similarity").alias("similarity"))


def _hits(hashed: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    """Verified windows of one pass: its items fit into a broadcast."""
    at = items.select("_n", F.explode(F.array_distinct("_shingles")).alias("_shingle"), F.col("_shingles").alias("_all"))
    # posexplode_outer: a plain one makes the planner test the array's size first, which would compute it twice
    runs = hashed.select("_key", "_hash", "_h", F.posexplode_outer("_h").alias("_pos", "_shingle")).join(F.broadcast(at), "_shingle")
    full, pos, last = F.col("_n") - F.lit(k - 1), F.col("_pos"), F.size("_h")
    # A window begins here, or is what lies before the text's start and ends here. The text's array stays inside this
    # projection: a row that carried it along would be copied for every place.
    size, dropped = F.least(full, last - pos), F.get("_h", pos - 1)
    turned = (pos > 0) & (pos + full <= last) & (dropped == F.get("_h", pos + full - 1)) & F.array_contains("_all", dropped)
    begins = (size >= threshold * full - 1e-9) & ~F.coalesce(turned, F.lit(False))
    ends = (pos + 1 < full) & (pos + 1 >= threshold * full - 1e-9)
    cut = runs.filter(begins | ends).select(
        "_key", "_hash", "_n", "_all", pos.alias("_start"), F.when(begins, F.slice("_h", pos + 1, size)).alias("_ahead"),
        F.when(ends, F.slice("_h", 1, pos + 1)).alias("_behind"))
    windows = cut.select("_key", "_hash", "_n", "_all", F.explode(F.array(
        F.struct("_start", F.col("_ahead").alias("_window")),
        F.struct(F.lit(0).alias("_start"), F.col("_behind").alias("_window")))).alias("_w"))
    windows = windows.select("_key", "_hash", "_n", "_all", "_w.*").filter("_window is not null")
    # Similarity t of sizes a and b needs t * (a + b) / (1 + t) shared shingles.
    needed = threshold / (1 + threshold) * (F.size("_all") + F.size("_window")) - 1e-9
    windows = windows.filter(F.size(F.filter("_window", lambda x: F.array_contains("_all", x))) >= needed).drop("_all")
    marked = windows.withColumn("_print", simhash(F.col("_window")))
    index = items.select("_text", "_n", simhash(F.col("_shingles")).alias("_item_print"), "_shingles")
    block = F.posexplode(F.array(*[block_value(F.col("_item_print"), b) for b in range(BLOCKS)])).alias("_block", "_own")
    keys = index.select("_text", "_n", "_item_print", block).select(
        "_text", "_n", "_item_print", "_block", F.explode(F.array(*[
            F.col("_own").bitwiseXOR(F.lit(m)) for m in flips()])).alias("_value"))
    probes = marked.select("*", F.posexplode(F.array(*[
        block_value(F.col("_print"), b) for b in range(BLOCKS)])).alias("_block", "_value"))
    near = probes.join(F.broadcast(keys), ["_n", "_block", "_value"])
    apart = F.col("_print").bitwiseXOR(F.col("_item_print"))
    first = F.array_position(F.array(*[
        F.bit_count(block_value(apart, b)) <= BLOCK_RADIUS for b in range(BLOCKS)]), True) - 1
    near = near.filter((F.bit_count(apart) <= RADIUS) & (first == F.col("_block"))).drop("_block", "_value", "_print", "_item_print")
    checked = near.join(F.broadcast(index.select("_text", "_shingles")), "_text").withColumn(
        "_similarity", weighted_similarity(F.col("_window"), F.col("_shingles")))
    return checked.filter(F.col("_similarity") >= threshold).select("_key", "_hash", "_text", "_start", "_n", "_similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents in which ``find_leaks`` finds an item; all other rows and columns as they are."""
    leaks = find_leaks(docs, benchmark, key, text, **options)
    gone = leaks.select(F.col(key).alias("_gone_key"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = F.col(key).eqNullSafe(F.col("_gone_key")) & (F.xxhash64(text) == F.col("_gone_hash"))
    return docs.join(gone, same, "left_anti")
