"""Language of whole texts by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is a border. The 1- to 3-grams of a text fall into
``buckets`` by a hash; training sums their counts per language on all labelled rows, scoring adds
up rows of the log-probability matrix. Texts are handled in blocks of positions, so a text of any
length takes bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.llm.common import Scratch, appended, slices, with_field

UNDETERMINED = "und"
BUCKETS = 1 << 16
#: Bytes of the log-probability matrix that a pass may hold; more languages take more passes.
MODEL_BYTES = 64 << 20
BLOCK = 1 << 17
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a border, 0 for all that is no letter; where each text begins."""
    joined = "\n".join(texts) + "\n"
    lowered = joined.lower()
    if len(lowered) != len(joined):  # some capitals become two characters
        texts = [t.lower() for t in texts]
        lowered = "\n".join(texts) + "\n"
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.where(letters()[codes], codes, 0), starts


def grams(codes: np.ndarray, start: int, stop: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram length the buckets of the n-grams that end in [start, stop), and where they count."""
    lead = min(start, 2)
    c = codes[start - lead : stop].astype(np.uint64)
    c = np.concatenate([np.zeros(2 - lead, np.uint64), c])
    one, two, three = c[2:], c[1:-1], c[:-2]
    shift = np.uint64(64 - buckets.bit_length() + 1)
    mixed = one * np.uint64(0x9E3779B97F4A7C15)
    yield (mixed >> shift).astype(np.int64), one > 0
    mixed = (mixed ^ (two + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)
    yield (mixed >> shift).astype(np.int64), (one > 0) | (two > 0)
    mixed = (mixed ^ (three + np.uint64(1)) * np.uint64(0x85EBCA77C2B2AE63)) * np.uint64(0x27D4EB2F165667C5)
    yield (mixed >> shift).astype(np.int64), ((one > 0) & (two > 0)) | ((two > 0) & (three > 0))


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages
    prior: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.log_probability)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each language and the number of letters per text."""
        codes, starts = codes_of(texts)
        total = np.tile(self.prior, (len(texts), 1))
        n_letters = np.zeros(len(texts), np.int64)
        for at in range(0, len(codes), BLOCK):
            stop = min(at + BLOCK, len(codes))
            first = np.searchsorted(starts, at, "right") - 1
            last = np.searchsorted(starts, stop, "left")
            cuts = np.maximum(starts[first:last], at) - at
            n_letters[first:last] += np.add.reduceat(codes[at:stop] > 0, cuts, dtype=np.int64)
            for bucket, counts in grams(codes, at, stop, self.buckets):
                rows = self.log_probability[bucket]
                rows[~counts] = 0.0
                total[first:last] += np.add.reduceat(rows, cuts, axis=0)
        return total, n_letters


@dataclass
class Trained:
    """Counts of all languages; ``parts`` gives their matrix by groups of languages, in order of their names."""

    languages: list[str]
    counts: DataFrame  # lang, bucket (-1: rows of the language), n
    buckets: int
    smoothing: float

    def parts(self) -> Iterator[Model]:
        """Models of at most ``MODEL_BYTES``. Priors refer to all languages, so scores of the parts compare."""
        width = max(1, MODEL_BYTES // (self.buckets * 8))
        if len(self.languages) <= width:
            got = self.counts.toArrow()
            yield self._model(self.languages, got, None)
            return
        all_rows = self.counts.filter("bucket < 0").agg(F.sum("n")).first()[0]
        for at in range(0, len(self.languages), width):
            names = self.languages[at : at + width]
            got = self.counts.filter(F.col("lang").between(names[0], names[-1])).toArrow()
            yield self._model(names, got, all_rows)

    def _model(self, languages: list[str], got: pa.Table, all_rows: int | None) -> Model:
        names = np.array(got.column("lang").to_pylist(), object)
        bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
        counts = np.zeros((self.buckets, max(1, len(languages))))
        rows = np.zeros(max(1, len(languages)))
        for i, lang in enumerate(languages):
            own = names == lang
            real = own & (bucket >= 0)
            counts[bucket[real], i] = n[real]
            rows[i] = n[own & (bucket < 0)].sum()
        counts += self.smoothing
        share = np.log(np.maximum(rows, 1) / max(1.0, rows.sum() if all_rows is None else all_rows))
        return Model(languages, np.log(counts / counts.sum(axis=0)), share)


def train(
    docs: DataFrame, text: str = "text", label: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5
) -> Trained:
    """A model from all rows with a label; rows with a null label or text teach nothing.

    Every task sums its rows into one counter per language; only (language, bucket) sums leave it. The
    driver receives the names and, a group of languages at a time, their bucket sums, whatever the number of rows.
    """
    labelled = docs.select(F.col(label).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    labelled = labelled.filter("lang is not null and text is not null")
    names = sorted((r["lang"] for r in labelled.select("lang").distinct().collect()), key=str.encode)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in slices(batches, "text"):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = np.array(batch.column("text").to_pylist(), object)
            for lang in set(langs):
                chosen = texts[langs == lang].tolist()
                codes, _ = codes_of(chosen)
                rows[lang] = rows.get(lang, 0) + len(chosen)
                total = sums.setdefault(lang, np.zeros(buckets, np.int64))
                for at in range(0, len(codes), BLOCK):
                    for bucket, counts in grams(codes, at, min(at + BLOCK, len(codes)), buckets):
                        total += np.bincount(bucket[counts], minlength=buckets)
                if len(sums) * buckets * 8 > MODEL_BYTES:
                    yield from told(sums, rows)
        yield from told(sums, rows)

    def told(sums: dict[str, np.ndarray], rows: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array(np.concatenate([[-1], used])),
                 pa.array(np.concatenate([[rows[lang]], total[used]]))], ["lang", "bucket", "n"])
        sums.clear()
        rows.clear()

    counted = labelled.mapInArrow(count, "lang string, bucket long, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(names) * buckets * 8 > MODEL_BYTES:
        summed = Scratch(docs.sparkSession).write(summed)
    return Trained(names, summed, buckets, smoothing)


def identify(docs: DataFrame, model: Model | Trained, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of the predicted language.

    Null texts, texts without a letter, and all texts under a model without languages are ``und`` with
    score 0. Equal scores go to the first language by name. Columns of these two names are replaced; all
    other columns and rows stay. A pass holds at most ``MODEL_BYTES`` of the model; with more languages there
    are more passes, each over the written rows of the one before, which carry the best score and the
    sum of the likelihoods relative to it.
    """
    spark = docs.sparkSession
    schema = with_field(docs.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()))
    top = "_top"
    while top in docs.columns:
        top += "_"
    if isinstance(model, Model):
        languages, parts = model.languages, iter([model])
    else:
        languages, parts = model.languages, model.parts()

    def scored(df: DataFrame, part: Model, first: bool) -> DataFrame:
        out = with_field(schema, (top, T.DoubleType()))
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in slices(batches, text):
                total, n_letters = known.scores([x or "" for x in batch.column(text).to_pylist()])
                if not languages:
                    n_letters[:] = 0
                best, high = total.argmax(axis=1), total.max(axis=1)
                mass = np.exp(total - high[:, None]).sum(axis=1)
                names = [known.languages[b] if n else UNDETERMINED for b, n in zip(best, n_letters)]
                if not first:
                    earlier = batch.column(top).to_numpy(zero_copy_only=False)
                    score = batch.column("score").to_numpy(zero_copy_only=False)
                    both = np.maximum(high, earlier)
                    with np.errstate(divide="ignore"):
                        mass = mass * np.exp(high - both) + np.exp(earlier - both) / score
                    names = [n if new else o for n, o, new in zip(names, batch.column("lang_pred").to_pylist(), high > earlier)]
                    high = both
                yield appended(batch, out, lang_pred=pa.array(names, pa.string()), **{
                    "score": pa.array(np.where(n_letters > 0, 1.0 / mass, 0.0)), top: pa.array(high)})

        return df.mapInArrow(run, out)

    scratch, found, written = Scratch(spark), docs, None
    for i, part in enumerate(parts):
        if i:
            before, written = written, scratch.write(found)
            if before is not None:
                scratch.drop(before)
            found = written
        found = scored(found, part, i == 0)
    return found.drop(top)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fixed test fold: rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
