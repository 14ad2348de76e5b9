"""Byte-pair encoding and decoding with a byte-level vocabulary.

A text is cut into pre-tokens. The distinct pre-tokens of a slice are encoded together by a
contiguous rank array: a row per word holds its parts side by side and, beside them, the
merge rank of every adjacent pair. Each step scans the rows for their smallest rank,
deletes that boundary, and looks up only the two ranks next to it. Words of more than
``LONG_WORD`` bytes, where repeated scans would be quadratic, take the same merges from a
heap. Results equal the public library's for the same vocabulary file.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloudgauge.llm.common import appended, slices, with_field

#: Pre-token pattern of byte-level vocabularies. Fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
#: Distinct pre-tokens a worker remembers before it starts anew; bounds memory only.
CACHE_WORDS = 150_000
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        symbols[chr(256 + n)] = b
    return symbols


class Vocabulary:
    """Merge table, token bytes and special strings of a vocabulary file."""

    loaded: dict[str, Vocabulary] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        ids, symbols = content["model"]["vocab"], byte_symbols()
        specials = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.size = max([*ids.values(), *specials.values()]) + 1
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = token.encode() if token in specials else bytes(symbols[c] for c in token)
        for token, i in specials.items():
            pieces[i] = token.encode()
        self.known = np.zeros(self.size, bool)
        self.known[[*ids.values(), *specials.values()]] = True
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_ids = np.array([ids[c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.pattern = regex.compile(PRETOKEN)
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") \
            if specials else None
        self.words: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.words.clear()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.counts = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def encode_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of every word as a matrix, and how many parts of each row count."""
        sizes = np.array([len(w) for w in words], np.int64)
        parts = np.zeros((len(words), int(sizes.max()) + 1), np.int64)
        column = np.arange(parts.shape[1])
        inside = column < sizes[:, None]
        parts[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full(parts.shape, NO_RANK, np.int64)
        paired = column[:-1] < sizes[:, None] - 1
        ranks[:, :-1][paired] = self.pair_ranks(parts[:, :-1][paired], parts[:, 1:][paired])
        done_parts, done_sizes = np.zeros_like(parts), np.zeros_like(sizes)
        row = np.arange(len(words))
        while len(row):
            best = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(row)), best]
            ended = lowest == NO_RANK
            if ended.any():
                done_parts[row[ended], : parts.shape[1]] = parts[ended]
                done_sizes[row[ended]] = sizes[ended]
                going = ~ended
                row, parts, ranks, sizes = row[going], parts[going], ranks[going], sizes[going]
                best, lowest = best[going], lowest[going]
                if not len(row):
                    break
                width = int(sizes.max()) + 1
                parts, ranks = parts[:, :width], ranks[:, :width]
            here = np.arange(len(row))
            # Delete the boundary: everything right of the merged pair moves one place to the left.
            columns = np.arange(parts.shape[1])
            source = np.minimum(columns + (columns > best[:, None]), parts.shape[1] - 1)
            parts = np.take_along_axis(parts, source, 1)
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= best[:, None]), parts.shape[1] - 1), 1)
            parts[here, best] = self.merged[lowest]
            sizes = sizes - 1
            ranks[here, -1] = NO_RANK
            # Refresh the ranks of the pairs that end and start at the merged part.
            right = best + 1 < sizes
            ranks[here, best] = NO_RANK
            ranks[here[right], best[right]] = self.pair_ranks(
                parts[here[right], best[right]], parts[here[right], best[right] + 1])
            left = best > 0
            ranks[here[left], best[left] - 1] = self.pair_ranks(
                parts[here[left], best[left] - 1], parts[here[left], best[left]])
        return done_parts, done_sizes

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same merges, lowest rank first and leftmost among equals, from a heap."""
        part = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        first = self.pair_ranks(np.array(part[:-1]), np.array(part[1:])).tolist()
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)
        alive = [True] * len(part)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else len(part)
            if j >= len(part) or part[i] != a or part[j] != b:
                continue
            part[i], alive[j], after[i] = int(self.merged[rank]), False, after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(part):
                    r = int(self.pair_ranks(np.array([part[x]]), np.array([part[y]]))[0])
                    if r != NO_RANK:
                        heapq.heappush(heap, (r, x, part[x], part[y]))
        return np.array([p for p, a in zip(part, alive) if a], np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode the words and remember them."""
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            size = len(raw[order[at]])
            if size > LONG_WORD:
                self.store(words[order[at]], self.encode_long(raw[order[at]]))
                at += 1
                continue
            # Words of similar length share a matrix of bounded size.
            end = at + 1
            while end < len(order) and end - at < 20_000 and len(raw[order[end]]) <= min(size + size // 4 + 1, LONG_WORD):
                end += 1
            chosen = order[at:end]
            parts, counts = self.encode_short([raw[i] for i in chosen])
            flat = parts[np.arange(parts.shape[1]) < counts[:, None]]
            self.store_many([words[i] for i in chosen], flat, counts)
            at = end

    def store(self, word: str, ids: np.ndarray) -> None:
        self.store_many([word], ids, np.array([len(ids)], np.int64))

    def store_many(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        first, n = len(self.words), len(words)
        while first + n > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.counts[first : first + n] = counts
        self.starts[first : first + n] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        self.words.update(zip(words, range(first, first + n)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many belong to each text."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        find = self.pattern.findall
        found: list[list[str]] = []
        for text in texts:
            if self.special is not None and self.special.search(text):
                pieces = [p for p in self.special.split(text) if p]
                found.append([w for p in pieces for w in ([p] if p in self.specials else find(p))])
            else:
                found.append(find(text))
        every = [w for words in found for w in words]
        missing = set(every).difference(self.words)
        for special in missing & self.specials.keys():
            # As a pre-token such a string can only be the special one: the pattern cuts it up elsewhere.
            self.store(special, np.array([self.specials[special]], np.int32))
            missing.discard(special)
        if missing:
            self.learn(list(missing))
        at = np.fromiter(map(self.words.__getitem__, every), np.int64, len(every))
        counts = self.counts[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], counts)]
        ends = np.cumsum([len(words) for words in found]) if found else np.zeros(0, np.int64)
        return ids.astype(np.int32), np.diff(total[np.concatenate([[0], ends])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of the ids; ids outside the vocabulary are skipped, broken UTF-8 is replaced."""
        sane = (ids >= 0) & (ids < self.size)
        sane[sane] = self.known[ids[sane]]
        used = np.where(sane, ids, 0)
        lengths = np.where(sane, self.lengths[used], 0)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        raw = self.bytes[np.arange(ends[-1]) + np.repeat(self.offsets[used] - ends[:-1], lengths)].tobytes()
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in ``out`` (array of int).

    Null and empty texts give an empty array. A column named ``out`` is replaced; all other
    columns and rows stay. Nothing is shuffled; a task holds a slice of about 2 MB of text.
    """
    schema = with_field(docs.schema, (out, T.ArrayType(T.IntegerType(), False)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.of(vocabulary)
        for batch in slices(batches, text):
            ids, counts = vocab.encode([x or "" for x in batch.column(text).to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield appended(batch, schema, **{out: pa.ListArray.from_arrays(offsets, pa.array(ids))})

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the text of ``ids`` in ``out``; null ids give null, special tokens are kept."""
    schema = with_field(tokens.schema, (out, T.StringType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.of(vocabulary)
        for whole in batches:
            step = max(1, int(whole.num_rows * (8 << 20) / max(1, whole.column(ids).nbytes)))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                column = batch.column(ids)
                counts = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
                values = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = vocab.decode(values, counts)
                missing = column.is_null().to_pylist()
                yield appended(batch, schema, **{out: pa.array(
                    [None if m else t for m, t in zip(missing, texts)], pa.string())})

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and the text ``decoded`` from them."""
    return decode(encode(docs, vocabulary, text), vocabulary)
