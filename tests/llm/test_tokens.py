"""Encoding, decoding and counting against the public libraries."""

import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloudgauge.llm import bpe, tokencount

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abcdefgh   \n\t'sre<|endoftext|><s></s>▁éßÉ中文𝒳\x00\x1c\x85　᠎​½²٣12  .,!$%\xa0"


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return made + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "ab" * 3000, " " * 3000, "é" * 900,
                   "x" * 255, "x" * 257, " ", "▁", "<s>", " a<unk>", "", None, "word " * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(i, t, "x", 5) for i, t in enumerate(texts())], "doc_id long, text string, ids string, n_tokens int").repartition(3)


def test_round_trip(docs):
    library = Tokenizer.from_file(BYTES)
    rows = bpe.round_trip(docs, BYTES).collect()
    assert len(rows) == len(texts())
    for row in rows:
        text = texts()[row["doc_id"]] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert row["ids"] == want
        assert row["decoded"] == library.decode(want, skip_special_tokens=False)
        assert row["text"] == texts()[row["doc_id"]] and row["n_tokens"] == 5


def test_decode_takes_any_ids(spark):
    library = Tokenizer.from_file(BYTES)
    cases = [[220, 50256, 11], [], None, [128], [-1, 64, 99_999_999], [447, 247, 447], [None, 64]]
    df = spark.createDataFrame(list(enumerate(cases)), "k long, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(df, BYTES).collect()}
    for k, ids in enumerate(cases):
        sane = [i for i in ids or [] if i is not None and 0 <= i <= 50256]
        assert got[k] == (None if ids is None else library.decode(sane, skip_special_tokens=False))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_any_text(many):
    library, own = Tokenizer.from_file(BYTES), bpe.Vocabulary.of(BYTES)
    many = [t.encode("utf-8", "ignore").decode() for t in many]
    ids, counts = own.encode(many)
    assert ids.tolist() == [i for t in many for i in library.encode(t, add_special_tokens=False).ids]
    assert own.decode(ids.astype("int64"), counts) == many


def test_long_words_from_the_heap():
    own = bpe.Vocabulary.of(BYTES)
    rng = random.Random(5)
    for _ in range(30):
        word = bytes(rng.choice(b"abcdeaeinst") for _ in range(rng.randint(2, 200)))
        parts, counts = own.encode_short([word])
        assert own.encode_long(word).tolist() == parts[0, : counts[0]].tolist()


@pytest.mark.parametrize("path", [PIECES, BYTES])
def test_counts(docs, path):
    if path == PIECES:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(library.encode(t or "")) for t in texts()]
    else:
        want = [len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for t in texts()]
    rows = tokencount.token_counts(docs, path, limit=10).collect()
    assert len(rows) == len(want)
    for r in rows:
        n = want[r["doc_id"]]
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 10)
        assert r["n_bytes"] == len((texts()[r["doc_id"]] or "").encode())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(empty, BYTES).count() == 0
    assert tokencount.token_counts(empty, PIECES).count() == 0
