"""Token ids of whole texts for a vocabulary with word ends, through the public library.

Such a vocabulary drops white space, so a text's ids are those of its white-space-separated chunks one after the
other, and the ids of a plain chunk are those of its words. Chunks and words are looked up in caches; only words that
a worker has not met go through the library, and chunks with rare characters do so whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Entries a worker remembers before it starts anew, and the longest entry it remembers; both bound memory only.
CACHE_ENTRIES = 400_000
CACHE_BYTES = 64
#: Pre-token pattern of the vocabulary for plain chunks: contractions, letters, one digit, other signs. Fixed value.
LETTERS = "a-zß-öø-ķĺ-ňŋ-ſ"
PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
#: Chunks of these characters are plain: no composition, white space or letter rule beyond the pattern applies to them.
SAFE = re.compile("[!-~À-ÖØ-öø-įı-ķĺ-ňŋ-ſ]+")
#: A chunk that is one word, and a single mark after such a word, which is a chunk of its own.
WORD = re.compile(b"[a-z]+")
MARK = re.compile(rb"[.,;:!?](?=[ \n\r\t]|\Z)(?<=[a-z0-9].)")


class WordTokens:
    """Encoder of one vocabulary file with the caches of this worker."""

    loaded: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        if any(self.model.encode(x, add_special_tokens=False).ids for x in (" ", "\t\n")):
            raise ValueError("this vocabulary keeps white space; its texts can't be encoded by chunk")
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.chunks: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def encode_words(self, words: list[str]) -> None:
        found = self.model.encode_batch_fast(words, add_special_tokens=False)
        self.words.update((w, np.array(e.ids, np.uint32)) for w, e in zip(words, found))

    def encode_chunks(self, chunks: list[bytes]) -> list[np.ndarray]:
        """Ids of each chunk; a chunk has no white space of ASCII."""
        plan: list[list[str]] = []
        for raw in chunks:
            text = raw.decode()
            plain = b"<|" not in raw and SAFE.fullmatch(text) is not None
            plan.append(PLAIN.findall(text.lower()) if plain else [text])
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        missing = list(set().union(*plan).difference(self.words))
        for i in range(0, len(missing), 20_000):
            self.encode_words(missing[i : i + 20_000])
        known = self.words
        out = [known[p[0]] if len(p) == 1 else np.concatenate([known[w] for w in p]) for p in plan]
        for w in missing:
            if len(w) > CACHE_BYTES:
                del known[w]
        return out

    def encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the letters a to z, one after the other, and how many belong to each: a word's last token ends it."""
        ids = np.array(self.model.encode(b" ".join(words).decode(), add_special_tokens=False).ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def learn(self, chunks: list[bytes]) -> None:
        plain = [c for c in chunks if WORD.fullmatch(c)]
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            self.store(part, *self.encode_plain(part))
        rest = [c for c in chunks if not WORD.fullmatch(c)]
        if rest:
            ids = self.encode_chunks(rest)
            self.store(rest, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def store(self, chunks: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        first, n = len(self.chunks), len(chunks)
        while first + n > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.counts[first : first + n] = counts
        self.starts[first : first + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.chunks.update(zip(chunks, range(first, first + n)))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of every UTF-8 text."""
        if len(self.chunks) > CACHE_ENTRIES or self.used > 16 * CACHE_ENTRIES:
            self.forget()
        found = []
        for raw in texts:
            # Lower case is safe before composition unless a combining mark follows; special strings are case-sensitive.
            kept = b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw
            found.append((raw if kept else MARK.sub(rb" \g<0>", raw.lower())).split())
        missing = list(set().union(*found).difference(self.chunks))
        if missing:
            self.learn(missing)
        out = []
        for chunks in found:
            at = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
            counts = self.counts[at]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.arange(total) + np.repeat(self.starts[at] - ends + counts, counts)])
        return out
