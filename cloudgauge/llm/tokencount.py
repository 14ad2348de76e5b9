"""Token counts of whole texts without token ids.

A text is cut into pre-tokens, the distinct ones of a slice of documents are counted once by
the public library, and the counts are joined to each document's pre-token frequencies and
summed. The join stays inside the task: a row per document and distinct pre-token costs more
to shuffle (about 350 rows a document) than counting a frequent word again in another task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloudgauge.llm.bpe import PRETOKEN
from cloudgauge.llm.common import appended, slices, with_field

#: Distinct pre-tokens a worker remembers before it starts anew; bounds memory only.
CACHE_WORDS = 200_000
#: Words of a piece model: white space belongs to the word after it. No piece joins a word to later white space,
#: which ``PieceCounter`` checks, so words are encoded independently.
PIECE_WORD = regex.compile("[ ▁]*[^ ▁]+|[ ▁]+")


class PieceCounter:
    """Pieces per pre-token of a sentencepiece model that keeps white space."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(regex.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of this model spans words; its texts can't be counted by pre-token")
        if self.model.encode("a  b ", out_type=str)[-1] != "▁":
            raise ValueError("this model removes white space; its texts can't be counted by pre-token")

    def split(self, text: str) -> list[str]:
        # The model puts one space before the text; as every word then starts with one, the library adds it to each.
        return PIECE_WORD.findall(" " + text) if text else []

    def count(self, words: list[str]) -> list[int]:
        out = [len(ids) for ids in self.model.encode([w[1:] for w in words], num_threads=1)]
        return [n if len(w) > 1 else 1 for w, n in zip(words, out)]


class ByteCounter:
    """Tokens per pre-token of a byte-level vocabulary; special strings in a text count as one token."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.pattern = regex.compile("|".join([*map(regex.escape, specials), PRETOKEN]))
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.plain = regex.compile(PRETOKEN)

    def split(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.plain.findall(text)
        return [w for i, p in enumerate(self.special.split(text)) for w in ([p] if i % 2 else self.plain.findall(p))]

    def count(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(words, add_special_tokens=False)]


def counter_of(path: str) -> PieceCounter | ByteCounter:
    """The counter for a vocabulary file: ``.model`` for pieces, ``.json`` for a byte-level one."""
    return PieceCounter(path) if path.endswith(".model") else ByteCounter(path)


class Counted:
    """Counts of the distinct pre-tokens this worker has met."""

    loaded: dict[str, Counted] = {}

    @classmethod
    def of(cls, path: str) -> Counted:
        if path not in cls.loaded:
            cls.loaded[path] = cls(counter_of(path))
        return cls.loaded[path]

    def __init__(self, counter: PieceCounter | ByteCounter) -> None:
        self.split: Callable[[str], list[str]] = counter.split
        self.count = counter.count
        self.known: dict[str, int] = {}

    def totals(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        frequencies = [Counter(self.split(t)) for t in texts]
        missing = sorted(set().union(*frequencies).difference(self.known))
        if missing:
            self.known.update(zip(missing, self.count(missing)))
        known = self.known
        return [sum(known[w] * n for w, n in f.items()) for f in frequencies]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    Null and empty texts count 0. Columns of these three names are replaced; all other columns and
    rows stay. Nothing is shuffled.
    """
    schema = with_field(
        docs.schema, ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted.of(vocabulary)
        for batch in slices(batches, text):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            tokens = np.array(counted.totals(texts), np.int64)
            n_bytes = [len(t.encode()) for t in texts]
            yield appended(
                batch, schema, n_bytes=pa.array(n_bytes, pa.int64()), n_tokens=pa.array(tokens),
                over_limit=pa.array(tokens > limit))

    return docs.mapInArrow(run, schema)
