"""Licence statements in texts, found through a positional index of their rare words.

The index maps the words of all templates to (template, position). A file's own licence words
are looked up from the highest IDF on, per template as many as no statement can do without, and the
places are intersected by relative position: each proposes starts of the template, up to ``SLACK`` words
off. A start counts when enough of the template's IDF weight stands at its place or up to ``SLACK`` words beside it
and the mandatory phrases do. Of overlapping starts of one template the best stays. Templates of two
or three words must match whole, so all their places are found.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudgauge.llm.common import appended, slices, with_field

#: Words: everything but ASCII characters that are neither letters nor digits. A-Z is lower-cased before.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...] = ()  # must stand in the text at their places, or up to ``SLACK`` words beside them
    base: bool = False


#: Short phrases that count wherever they stand.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)
#: Statements by which projects declare their licence.
NOTICES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files", ("permission is hereby granted",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
             "compliance with the license", ("apache license",)),
    Template("apache", "licensed under the apache license", ("apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", ("redistribution and use", "binary forms")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "general public license as published by the free software foundation", ("general public license",)),
    Template("gpl", "licensed under the gnu general public license version 3", ("general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
             "is hereby granted", ("permission to use",)),
)
SLACK = 2
MIN_SCORE = 0.6


@dataclass
class Index:
    """Postings of all words of the templates."""

    templates: tuple[Template, ...]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self) -> None:
        self.words = [t.text.encode().split() for t in self.templates]
        self.phrases = [[(p.encode().split(), self.words[i]) for p in t.phrases] for i, t in enumerate(self.templates)]
        self.phrases = [[(p, next(k for k in range(len(w)) if w[k : k + len(p)] == p)) for p, w in found]
                        for found in self.phrases]
        spread = Counter(w for words in self.words for w in set(words))
        self.idf = {w: math.log(1 + len(self.templates) / n) for w, n in spread.items()}
        self.weights = [sum(self.idf[w] for w in words) for words in self.words]
        for i, words in enumerate(self.words):
            for k, w in enumerate(words):
                self.postings[w].append((i, k))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) of all statements in the text, in order of start."""
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, w in enumerate(words):
            if w in self.postings:
                places[w].append(at)
        have: dict[int, float] = defaultdict(float)
        for w in places:
            for template, _ in self.postings[w]:
                have[template] += self.idf[w]
        found = []
        for template, weight in have.items():
            if self.templates[template].base:
                found += self._phrase_places(template, words, places)
            elif weight >= MIN_SCORE * self.weights[template] * (1 - 1e-9):
                found += self._statements(template, words, places, weight)
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _phrase_places(self, template: int, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, int, float]]:
        wanted = self.words[template]
        if any(w not in places for w in wanted):
            return []
        rarest = min(range(len(wanted)), key=lambda k: (len(places[wanted[k]]), k))
        return [(template, at - rarest, 1.0) for at in places[wanted[rarest]]
                if at >= rarest and words[at - rarest : at - rarest + len(wanted)] == wanted]

    def _statements(
        self, template: int, words: list[bytes], places: dict[bytes, list[int]], left: float
    ) -> list[tuple[int, int, float]]:
        wanted, least = self.words[template], MIN_SCORE * self.weights[template] * (1 - 1e-9)
        ranked = sorted((k for k, w in enumerate(wanted) if w in places),
                        key=lambda k: (-self.idf[wanted[k]], len(places[wanted[k]]), k))
        votes: dict[int, float] = defaultdict(float)
        for k in ranked:
            if left < least / 2:  # what the other words can add; half of the least weight must come from those looked up
                break
            w = wanted[k]
            for start in {at - k + j for at in places[w] for j in range(-SLACK, SLACK + 1)}:
                votes[start] += self.idf[w]
            left -= self.idf[w]
        passed = []
        for start, voted in votes.items():
            if voted + left < least:
                continue
            exact = near = 0.0
            for k, w in enumerate(wanted):
                at = start + k
                if 0 <= at < len(words) and words[at] == w:
                    exact += self.idf[w]
                    near += self.idf[w]
                elif w in words[max(0, at - SLACK) : max(0, at + SLACK + 1)]:
                    near += self.idf[w]
            if near >= least and all(
                any(x >= 0 and words[x : x + len(p)] == p for x in range(start + k - SLACK, start + k + SLACK + 1))
                for p, k in self.phrases[template]
            ):
                passed.append((-round(exact, 9), -round(near, 9), start))
        taken: set[int] = set()
        for _, near, start in sorted(passed):
            if not any(x in taken for x in range(start - len(wanted) + 1, start + len(wanted))):
                taken.add(start)
        score = {start: min(1.0, -near / self.weights[template]) for _, near, start in passed}
        return [(template, max(start, 0), score[start]) for start in taken]


MATCH = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()), T.StructField("start", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())])


def scan_licenses(
    docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = BASE + NOTICES
) -> DataFrame:
    """``docs`` with ``n_words`` and ``licenses``: label, base, start word, n_words and score of every statement.

    Null and empty texts have no words and no statements; columns of these two names are replaced;
    all other columns and rows stay. Overlapping statements are all reported, in order of their start.
    """
    schema = with_field(docs.schema, ("n_words", T.LongType()), ("licenses", T.ArrayType(MATCH)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()),
                                   ("n_words", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, text):
            counts, rows = [], []
            for raw in batch.column(text).cast(pa.binary()).to_pylist():
                words = WORD.findall((raw or b"").lower())
                counts.append(len(words))
                rows.append([
                    {"label": templates[t].label, "base": templates[t].base, "start": start,
                     "n_words": len(index.words[t]), "score": score} for t, start, score in index.scan(words)])
            yield appended(batch, schema, n_words=pa.array(counts, pa.int64()), licenses=pa.array(rows, kind))

    return docs.mapInArrow(run, schema)


def labels_of(matches: Column) -> Column:
    """Distinct labels in order, joined by commas; empty if there are none."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
