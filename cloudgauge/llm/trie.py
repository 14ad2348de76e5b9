"""Prefix trie of conversations that are rebuilt from another conversation's head and their own suffix.

The fingerprint of a sequence of turns is an element of a monoid: its length and, in ``LANES`` prime fields, the
polynomial of its turns' hashes. A product needs only the two elements, so a rebuilt prefix is the product of a prefix
of the base conversation and a part of the own one, taken from running sums over the stored turns. Rebuilt turns are rows
of numbers with a reference to the stored turn; no text is copied. Prefixes with equal fingerprints are one node. Then every
node with several references checks role and text of the stored turns, and that all members have the same parent;
a collision starts the work anew with other hashes, so the result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudgauge.llm.common import Scratch
from cloudgauge.llm.scans import numbered, ranges, running

#: Prime moduli below 2**31, so that products fit into 64 bits; the generator of positions in each field. Fixed values.
LANES = ((2147483647, 1103515245), (2147483629, 1664525), (2147483587, 22695477))
#: Powers are looked up digit by digit.
DIGIT = 1 << 10
#: Ids of a node that one row of the digest's first step holds.
CHUNK_IDS = 4096
ATTEMPTS = 5


def numbers(values: Iterable[int]) -> Column:
    """A constant array of numbers."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def power(lane: int, exponent: Column) -> Column:
    """Generator of the lane to the power of a number from 0 to below 2**30, modulo its prime."""
    prime, base = LANES[lane]
    out = None
    for digit in range(3):
        table = numbers([pow(base, (DIGIT**digit) * i, prime) for i in range(DIGIT)])
        part = F.get(table, F.shiftright(exponent.cast("int"), 10 * digit).bitwiseAND(F.lit(DIGIT - 1)))
        out = part if out is None else F.pmod(out * part, F.lit(prime))
    return out


def stored_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, scratch: Scratch) -> DataFrame:
    """``conv``, ``at`` (place from 1), ``role``, ``text``: turns in order of ``turn`` (null first), then role and text."""
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row"))
    order = ["conv", "_turn", "role", "text", "_row"]
    return scratch.write(numbered(ranges(rows, order, scratch), "conv", order[1:], "at").select("conv", "at", "role", "text"))


def _digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``sha``: digest of the ascending, comma-joined ``conv`` of every key.

    Sorted ranges join ids into chunks in parallel; the digest, a chain by its nature, then streams through a node's chunks.
    """
    kinds = ", ".join(f"{k} {ends.schema[k].dataType.simpleString()}" for k in keys)

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], t) for v, t in zip(node, types)], pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
                [*keys, "first", "ids"])

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            out = []
            for *key, conv in zip(*[batch.column(k).to_pylist() for k in [*keys, "conv"]]):
                if key != node or len(ids) >= CHUNK_IDS:
                    if ids:
                        out.append(flush())
                    node, ids = key, []
                ids.append(conv)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield flush()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], t) for v, t in zip(node, types)], pa.array([state.hexdigest()])], [*keys, "sha"])

        for batch in batches:
            types = [batch.column(k).type for k in keys]
            out = []
            for *key, ids in zip(*[batch.column(k).to_pylist() for k in [*keys, "ids"]]):
                if key != node:
                    if state is not None:
                        out.append(flush())
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if state is not None:
            yield flush()

    ranged = ends.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")
    joined = ranged.mapInArrow(chunks, f"{kinds}, first long, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{kinds}, sha string")


def _rebuilt(
    stored: DataFrame, head: Callable[[Column], Column], base: Callable[[Column], Column], longest: int, seed: int,
    scratch: Scratch,
) -> DataFrame:
    """``conv``, ``depth``, fingerprint ``f0``.. and the one before ``p0``.., ``source``, ``at``, ``bytes``, ``ends``: one
    row per rebuilt turn and one of depth 0 per conversation."""
    lanes = range(len(LANES))
    hashed = stored.select("conv", "at", F.octet_length("text").cast("long").alias("bytes"), *[
        F.pmod(F.pmod(F.xxhash64(F.lit(seed * 31 + k), "role", "text"), F.lit(LANES[k][0])) * power(k, F.col("at")), F.lit(LANES[k][0]))
        .alias(f"v{k}") for k in lanes])
    sums = running(hashed, "conv", "at", {f"s{k}": F.col(f"v{k}") for k in lanes}).withColumns(
        {f"s{k}": F.pmod(F.col(f"s{k}"), F.lit(LANES[k][0])) for k in lanes})
    sums = scratch.write(sums)
    convs = sums.groupBy("conv").agg(F.max("at").alias("n"))
    convs = convs.withColumn("h", F.least(head(F.col("conv")), F.lit(longest)).cast("long")).withColumn("base", base(F.col("conv")))
    # The first turns of every base in one row: at most ``longest`` of them.
    heads = sums.filter(F.col("at") <= longest).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(
        "at", "bytes", *[f"s{k}" for k in lanes], *[f"v{k}" for k in lanes]))).alias("head"))
    known = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left").join(
        heads.withColumnRenamed("head", "own"), "conv", "left")
    known = known.withColumns({
        "head": F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")),
        "own": F.slice("own", 1, F.col("h").cast("int"))}).withColumn("shift", F.col("h") - F.size("head"))
    last = lambda c, k: F.coalesce(F.get(c, F.size(c) - 1)[f"s{k}"], F.lit(0))
    known = scratch.write(known.select(
        "conv", "n", "h", "base", "shift", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depths"), *[
            last(F.col("head"), k).alias(f"b{k}") for k in lanes], *[last(F.col("own"), k).alias(f"o{k}") for k in lanes]))
    zero = F.lit(0).cast("long")
    tops = known.select(
        "conv", zero.alias("depth"), *[zero.alias(f"f{k}") for k in lanes], *[zero.alias(f"p{k}") for k in lanes],
        F.lit(None).cast("long").alias("source"), zero.alias("at"), zero.alias("bytes"), (F.col("depths") == 0).alias("ends"))

    def less(a: Column, b: Column, k: int) -> Column:
        return F.pmod(a - b, F.lit(LANES[k][0]))

    taken = known.select("conv", "base", "depths", F.explode("head").alias("t"))
    taken = taken.select(
        "conv", F.col("t.at").alias("depth"), *[F.col(f"t.s{k}").alias(f"f{k}") for k in lanes], *[
            less(F.col(f"t.s{k}"), F.col(f"t.v{k}"), k).alias(f"p{k}") for k in lanes],
        F.col("base").alias("source"), F.col("t.at").alias("at"), F.col("t.bytes").alias("bytes"), (F.col("t.at") == F.col("depths")).alias("ends"))
    # A conversation's facts reach its turns by a join whose many side adaptive execution may split.
    own = sums.join(known.drop("n", "base", "head"), "conv").filter(F.col("at") > F.col("h"))

    def product(part: Column, k: int) -> Column:
        """The head's element times the own part from the head's end, whose places move by the shift."""
        prime, generator = LANES[k]
        back = numbers(pow(generator, -i, prime) for i in range(longest + 1))
        return F.pmod(F.col(f"b{k}") + F.pmod(less(part, F.col(f"o{k}"), k) * F.get(back, F.col("shift").cast("int")), F.lit(prime)), F.lit(prime))

    own = own.select(
        "conv", (F.col("at") - F.col("shift")).alias("depth"), *[product(F.col(f"s{k}"), k).alias(f"f{k}") for k in lanes], *[
            product(less(F.col(f"s{k}"), F.col(f"v{k}"), k), k).alias(f"p{k}") for k in lanes],
        F.col("conv").alias("source"), "at", "bytes", (F.col("at") - F.col("shift") == F.col("depths")).alias("ends"))
    return scratch.write(tops.unionByName(taken).unionByName(own))


def _collides(rows: DataFrame, nodes: DataFrame, stored: DataFrame, keys: list[str]) -> bool:
    """Whether a node has members with different last turns or different parents."""
    if nodes.filter("not one_parent").limit(1).count():
        return True
    several = nodes.filter("one_source = false").select(*keys)
    refs = rows.join(several, keys, "left_semi").filter("source is not null").select(*keys, "source", "at").distinct()
    texts = refs.join(stored.withColumnRenamed("conv", "source"), ["source", "at"])
    seen = texts.groupBy(*keys).agg(F.min("role").alias("r0"), F.max("role").alias("r1"), F.min("text").alias("t0"), F.max("text").alias("t1"))
    return seen.filter("r0 <> r1 or t0 <> t1").limit(1).count() > 0


def prefix_trie(
    turns: DataFrame, head: Callable[[Column], Column], base: Callable[[Column], Column], longest: int,
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree, ``ends_sha256``.

    Conversation c is the first ``head(c)`` (at most ``longest``) turns of conversation ``base(c)``, all if it has
    fewer, none if it is absent, and c's own turns after its first ``head(c)``. Turns go by ``turn``, null first, then role
    and text; null role or text is empty; repeated rows are turns of their own. Rows without a conversation id belong to no
    conversation. Other columns are not read. An empty table has no conversation and no node.
    """
    scratch = Scratch(turns.sparkSession)
    stored = stored_turns(turns, conv, turn, role, text, scratch)
    keys = ["depth", *[f"f{k}" for k in range(len(LANES))]]
    parent = [f"p{k}" for k in range(len(LANES))]
    for attempt in range(ATTEMPTS):
        rows = _rebuilt(stored, head, base, longest, attempt, scratch)
        ref = F.struct("source", "at")
        nodes = scratch.write(rows.groupBy(*keys).agg(
            F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
            (F.min(F.struct(*parent)) == F.max(F.struct(*parent))).alias("one_parent"),
            (F.min(ref) == F.max(ref)).alias("one_source"), F.min(F.struct(*parent)).alias("parent")))
        if not _collides(rows, nodes, stored, keys):
            break
        scratch.drop(rows, nodes)
    else:
        raise RuntimeError(f"fingerprints collide in {ATTEMPTS} attempts")
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), *[F.col(f"f{k}").alias(f"p{k}") for k in range(len(LANES))], F.col("conv").alias("parent_conv_id"))
    linked = nodes.select(*keys, "conv", "n_convs", "bytes", *[F.col(f"parent.{p}").alias(p) for p in parent])
    linked = linked.join(above, ["depth", *parent], "left")
    children = linked.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *parent).agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed({f"p{k}": f"f{k}" for k in range(len(LANES))})
    linked = scratch.write(linked.join(children, keys, "left").fillna(0, ["n_children"]))
    # A node's own value lies on its smallest member; summed from the end it counts at every prefix of that member.
    values = linked.select(
        "conv", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    valued = rows.select("conv", *keys).join(values, ["conv", "depth"], "left")
    below = running(valued, "conv", "depth", {
        "n_leaves": F.coalesce("leaf", F.lit(0)), "saved_tokens": F.coalesce("saved", F.lit(0))}, backwards=True)
    totals = below.groupBy(*keys).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    digests = _digests(rows.filter("ends"), keys)
    return linked.join(totals, keys).join(digests, keys, "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
