"""Licences, chats, main text, languages and revisits."""

import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloudgauge.llm import chat, html, langid, license, warc

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEXTS = [
    None, "", "All rights reserved.", "ALL RIGHTS, reserved all rights reserved; cc by cc-by CC BY-SA", "cc  by" * 3,
    "general public license general public", "License: GNU General Public License, version 3", "all rights reserved",
    "Released under the MIT License.", "x " * 50_000 + "all rights reserved", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "mit license", "KELVIN K all rights reserved", "cc cc by by"]


def brute_licenses(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words))
              if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, licenses int")
    for row in license.scan_licenses(df).collect():
        n, places = brute_licenses(TEXTS[row["doc_id"]])
        assert row["n_words"] == n
        assert sorted((m["start"], m["label"]) for m in row["licenses"] if m["base"]) == places
        assert all(0 <= m["score"] <= 1 for m in row["licenses"])
    labels = {r["doc_id"]: r["l"] for r in license.scan_licenses(df).select(
        "doc_id", license.labels_of(F.col("licenses")).alias("l")).collect()}
    assert labels[8] == "mit" and labels[10] == "gpl" and labels[11] == "apache" and labels[12] == "" and labels[0] == ""


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("all rights reserved general public license cc by x".split()), max_size=40))
def test_all_places_of_phrases(words):
    index = license.Index(license.BASE + license.NOTICES)
    found = [(s, index.templates[t].label) for t, s, _ in index.scan([w.encode() for w in words]) if index.templates[t].base]
    assert sorted(found) == brute_licenses(" ".join(words))[1]


def brute_statements(words, template):
    """Every start of a template, in order of preference, without an index."""
    idf = {w: np.log(1 + len(license.BASE + license.NOTICES) / sum(w in t.text.split() for t in license.BASE + license.NOTICES))
           for w in template.text.split()}
    wanted, slack, passed = template.text.split(), license.SLACK, []
    for start in range(-len(wanted) - slack, len(words) + slack):
        near = sum(idf[w] for k, w in enumerate(wanted) if w in words[max(0, start + k - slack) : max(0, start + k + slack + 1)])
        exact = sum(idf[w] for k, w in enumerate(wanted) if 0 <= start + k < len(words) and words[start + k] == w)
        if near < license.MIN_SCORE * sum(idf[w] for w in wanted) * (1 - 1e-9):
            continue
        firm = True
        for phrase in template.phrases:
            p = phrase.split()
            k = next(k for k in range(len(wanted)) if wanted[k : k + len(p)] == p)
            firm &= any(x >= 0 and words[x : x + len(p)] == p for x in range(start + k - slack, start + k + slack + 1))
        if firm:
            passed.append((-round(exact, 9), -round(near, 9), start))
    taken = []
    for _, _, start in sorted(passed):
        if all(abs(start - t) >= len(wanted) for t in taken):
            taken.append(start)
    return sorted(max(0, t) for t in taken)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(
    [t.text for t in license.NOTICES] + ["licensed under x the apache y license", "the", "license", "software and", "mit license", "x"]),
    max_size=6), st.lists(st.integers(0, 200), max_size=8), st.lists(st.tuples(st.integers(0, 200), st.sampled_from("x the of".split())), max_size=6))
def test_statements_are_those_of_brute_force(pieces, gone, added):
    words = " ".join(pieces).split()
    for i in gone:
        if words:
            words.pop(i % len(words))
    for i, w in added:
        words.insert(i % (len(words) + 1), w)
    index = license.Index(license.BASE + license.NOTICES)
    found = index.scan([w.encode() for w in words])
    for i, template in enumerate(index.templates):
        if not template.base:
            assert sorted(s for t, s, _ in found if t == i) == brute_statements(words, template), template.text


def test_words_put_in_or_left_out_keep_the_label(spark):
    texts = ["Licensed under, as of today, the Apache License, Version 2.0 (the License); you may use this file except in compliance with the License",
             "this program is free software you can redistribute it or modify it under the terms of the general public license as published",
             "the apache server has a license", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = license.scan_licenses(df).select("doc_id", license.labels_of(F.col("licenses")).alias("l"))
    labels = {r["doc_id"]: r["l"] for r in out.collect()}
    assert "apache" in labels[0] and labels[1] == "gpl" and labels[2] == "" and labels[3] == ""
    assert license.scan_licenses(df.limit(0)).count() == 0


LAYOUTS = [
    ('{"role":"system","text":"x"}', "turn", [("system", "x")]),
    ('{"messages":[{"role":"user","content":"b","n":1},{"content":null,"role":null}],"id":5}', "messages", [("user", "b"), ("", "")]),
    ('{"response":"b","prompt":null,"a b":{"k":[1]}}', "prompt_response", [("user", ""), ("assistant", "b")]),
    ('{"instruction":"x","meta":{"k":1},"output":"o","input":"i"}', "instruction_input", [("user", "x\n\ni"), ("assistant", "o")]),
    ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "conversations", [("user", "q"), ("assistant", "a")]),
    ('{"question":"q","answer":"a"}', "question_answer", [("user", "q"), ("assistant", "a")]),
    ("{x", None, []), (None, None, []), ("[1]", None, []), ("{}", None, []), ('{"messages":[]}', None, [])]


def test_layouts(spark):
    df = spark.createDataFrame([(i, r[0], "clash") for i, r in enumerate(LAYOUTS)], "k long, record string, turns string")
    for row in chat.canonical_turns(df).collect():
        _, layout, turns = LAYOUTS[row["k"]]
        assert (row["layout"], [tuple(t) for t in row["turns"]]) == (layout, turns)


DEEP = '{"a":[[{"b":{"c":{"d":{"text":[{"e":[[1,"x"]]}]}}}}]]}'
UNUSED = [
    ('{"prompt":"p","response":"r","meta":%s}' % DEEP, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ('{"x y":%s,"messages":[{"role":"user","content":"b","n":%s},null]}' % (DEEP, DEEP), "messages", [("user", "b"), ("", "")]),
    ('{"messages":[{"role":"user","content":%s}]}' % DEEP, None, []), ('{"messages":[{"role":"user","content":"b"},1]}', None, []),
    ('{"prompt":"p","response":%s}' % DEEP, None, []), ('{"prompt":"p","response":"r","text":"t"}', None, []),
    ('{"messages":"b"}', None, []), ('{"messages":{"role":"user","content":"b"}}', None, [])]


def test_depth_of_unused_fields_does_not_matter(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(UNUSED)], "k long, record string")
    rows = chat.canonical_turns(df).collect()
    assert len(rows) == len(UNUSED)
    for row in rows:
        _, layout, turns = UNUSED[row["k"]]
        assert (row["layout"], [tuple(t) for t in row["turns"]]) == (layout, turns)


SAID = ["", None, "<|turn|><|text|><|end|>", "\\", "\\b\\l<|", "a\\", "<", "|x", "\\### Assistant: </turn> ok", "é\n𝒳", "<<||>", "x" * 200_000]


def test_formatting_is_reversible(spark):
    rows = [(c, t, ["user", "assistant", None, "<|end|>"][(c + t) % 4], SAID[(c * 5 + t) % len(SAID)]) for c in range(6) for t in range(9)]
    rows += [(None, 1, "assistant", "z"), (9, None, "assistant", "first"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(3)
    out = chat.format_chats(df, "conv", ["turn"]).withColumn("back", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == 8
    for row in out:
        own = sorted((r for r in rows if r[0] == row["conv"]), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        assert [tuple(t) for t in row["back"]] == [(r[2] or "", r[3] or "") for r in own]
        assert row["loss"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat.format_chats(df.limit(0), "conv", ["turn"]).count() == 0


PAGES = [
    (1, '<html><body><nav><ul><li><a href="/">Home</a></ul></nav><article><h1>Head &amp; title</h1><p>First\n <b>bold</b> text of it,'
        ' long enough to be read.<p>Second&nbsp;part<br>of the text.</article><footer>legal matter</footer>',
     "Head & title\n\nFirst bold text of it, long enough to be read.\n\nSecond part of the text."),
    (2, '<div class="header">Site</div><div class="content"><h1>Words about things</h1><p>A paragraph of text that goes on for a while, with'
        ' commas.</p><script>x="</p>"</script><div class="ad">Buy this</div><p>Another paragraph. It has two sentences.</p></div>'
        '<div class="comments"><p>I liked this article a lot, thanks for it.</p></div><div class="sidebar"><p>Other stories</p></div>',
     "Words about things\n\nA paragraph of text that goes on for a while, with commas.\n\nAnother paragraph. It has two sentences."),
    (3, None, ""), (4, "", ""), (5, "<p", ""), (6, "<!-- <article><p>x</p></article>", "")]


def test_main_text(spark):
    body = "".join(f"<p>Sentence {i} of the text, which is long. And another one.</p>" for i in range(5))
    train = spark.createDataFrame([(i, f'<html><body><nav><ul><li><a href="/{i}">go {i}</a></ul></nav><div class="ad">Buy {i} now</div><article>'
                                    f"<h1>Title {i}</h1>{body}</article><footer>c {i}</footer></body></html>") for i in range(40)], "id long, html string")
    model = html.train(train)
    df = spark.createDataFrame([(k, h, 1) for k, h, _ in PAGES], "page_id long, html string, main_text int")
    got = {r["page_id"]: r["main_text"] for r in html.extract(df, model).collect()}
    assert got == {k: want for k, _, want in PAGES}
    assert html.extract(df, html.train(train.limit(0))).count() == len(PAGES)
    deep = "<div>" * 3000 + "text" + "</b></i>" * 3000 + "<p>" * 3000
    assert len(html.parse(deep).blocks) == 1


def plain_page(i, wrap="<div>{}</div>"):
    body = "".join(f"<p>Paragraph {i}-{j} tells of the things that happened there. It has several sentences, and commas.</p>" for j in range(5))
    menu = "".join(f'<li><a href="/{j}">Entry {j}</a></li>' for j in range(6))
    return f"<html><body><div><ul>{menu}</ul></div>{wrap.format(f'<h1>Title {i}</h1>{body}')}<div><ul>{menu}</ul>Imprint {i}</div></body></html>"


@pytest.mark.parametrize("marked", [0, 10, 100])
def test_pages_without_labels_teach_nothing(spark, marked):
    """No page, a tenth of the pages, or every page marks its main text; none comes out empty."""
    rows = [(i, plain_page(i, "<article>{}</article>" if i < marked else "<div>{}</div>")) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["page_id"]: r["main_text"] for r in html.extract(df, html.train(df)).collect()}
    for i in range(100):
        assert got[i].startswith(f"Title {i}\n\nParagraph {i}-0") and got[i].endswith("commas.") and got[i].count("\n\n") == 5, got[i]


def test_parser_is_linear_and_keeps_fallback_text():
    for text in ("<div>" * 200_000, "<div>" * 100_000 + "</section>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<i><p>" + "<b>" * 100_000 + "</i>" * 100_000,
                 "<p>x<li>" * 60_000, "<ul>" * 60_000 + "<li>x" * 60_000):
        start = time.process_time()
        html.parse(text)
        assert time.process_time() - start < 6
    page = html.parse("<article><p>a <math><mi>x</mi></math> b</p><object>fallback</object><p>i <b>j <i>k</b> l</i> m</p></article>")
    assert [t for _, t in page.blocks] == ["a x b", "fallback", "i j k l m"]


def test_kept_blocks_have_kept_ancestors():
    page = html.parse('<div class="a"><p>one</p></div><div class="b"><p>two</p></div>')
    import numpy as np

    odds = np.array([0.1, -9.0, 2.0, 0.5, 2.0])
    assert html.decode(page, odds) == "two"


def test_language(spark):
    words = {"aa": "the and of to in that it was", "bb": "der die und das ist nicht ein zu", "cc": "les des est une dans pour que"}
    rows = [(i, " ".join((w.split() * 5)[i % 5 :]), lang, 1) for lang, w in words.items() for i in range(20)]
    rows += [(100, None, "aa", 1), (101, "12 !?", None, 1), (102, "", "bb", 1), (103, "die und das " * 60_000, None, 1), (104, "DIE UND", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(3)
    model = langid.train(df)
    assert model.languages == ["aa", "bb", "cc"]
    got = {(r["doc_id"], r["lang"]): (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    for i, _, lang, _ in rows[:60]:
        assert got[i, lang][0] == lang and 0.5 < got[i, lang][1] <= 1
    assert got[100, "aa"] == ("und", 0.0) and got[101, None] == ("und", 0.0) and got[102, "bb"] == ("und", 0.0)
    assert got[103, None][0] == "bb" and got[104, None][0] == "bb"
    nothing = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df, nothing).collect()} == {"und"}


def test_more_languages_than_a_pass_holds(spark, monkeypatch):
    """Passes over groups of languages give what one matrix gives."""
    rng = np.random.default_rng(5)
    rows = []
    for lang in range(11):
        alphabet = [chr(c) for c in rng.choice(np.arange(0x61, 0x7b), 9, False)]
        rows += [(len(rows) + i, "".join(rng.choice([*alphabet, " "], 60)), f"l{lang}", 1.0) for i in range(6)]
    rows += [(900, "", "l1", 2.0), (901, None, "l2", 2.0), (902, "12 34", "l3", 2.0), (903, "abc", None, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _top double")

    def told():
        return {r["doc_id"]: (r["lang_pred"], r["score"], r["_top"]) for r in langid.identify(df, langid.train(df, buckets=1024)).collect()}

    whole = told()
    monkeypatch.setattr(langid, "MODEL_BYTES", 4 * 1024 * 8)
    assert len(list(langid.train(df, buckets=1024).parts())) == 3
    parted = told()
    assert whole.keys() == parted.keys() and {parted[i][0] for i in (900, 901, 902)} == {"und"}
    for i, (lang, score, top) in whole.items():
        assert parted[i][0] == lang and abs(parted[i][1] - score) < 1e-9 and parted[i][2] == top



def test_blocks_do_not_change_scores(monkeypatch):
    import numpy as np

    model = langid.Model(["a", "b"], np.random.default_rng(1).normal(size=(256, 2)), np.zeros(2))
    texts = ["héllo wörld " * 9, "", "x", "a bc def ghij" * 5, "İstanbul"]
    whole = model.scores(texts)
    for block in (1, 7, 64):
        monkeypatch.setattr(langid, "BLOCK", block)
        part = model.scores(texts)
        assert np.allclose(whole[0], part[0]) and (whole[1] == part[1]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter("not held_out"))
    tested = langid.identify(docs.filter("held_out and lang is not null"), model)
    assert tested.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_canonical_urls(spark):
    cases = {
        "HTTPS://www.Example.com:443/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2", "http://example.com/": "example.com",
        "http://m.example.com/en/9.html": "m.example.com/en/9.html", "example.com?x": "example.com?x", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r[0]: r[1] for r in df.select("url", warc.canonical_url(F.col("url"))).collect()} == cases


def record(kind, url, at, rid, status, headers, body=""):
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n" + body
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:{at:02d}Z\r\n"
            f"WARC-Record-ID: {rid}\r\nContent-Length: {len(http)}\r\n\r\n{http}")


def test_revisits(spark):
    u = "http://e.org/a"
    raw = [
        record("response", u, 1, "r1", "200 OK", [("ETag", '"1"'), ("Content-Type", "t"), ("Expires", "1"), ("X", "a"), ("X", "b")], "one\r\n\r\nmore"),
        record("response", u, 5, "r2", "200 OK", [("ETag", 'W/"2"')], "two"), record("response", u, 6, "r3", "500 no", [("ETag", '"3"')], "err"),
        record("revisit", u + "/#x", 3, "v1", "304 Not Modified", [("ETag", '"1"'), ("expires", "9"), ("Content-Type", "bad")]),
        record("revisit", u, 7, "v2", "304 Not Modified", [("ETag", '"2"')]), record("revisit", u, 8, "v3", "304 Not Modified", [("ETag", '"1"')]),
        record("revisit", u, 0, "v4", "304 Not Modified", [("ETag", '"1"')]), record("revisit", u, 9, "v5", "304 Not Modified", []),
        record("revisit", "http://e.org/b", 9, "v6", "304 Not Modified", []), record("revisit", u, 7, "v2", "304 Not Modified", [("ETag", '"2"')]),
        None, "", "broken", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\nx"]
    df = spark.createDataFrame([(r, "clash") for r in raw], "record string, status string").repartition(3)
    got = warc.resolve_revisits(warc.parse_records(df)).collect()
    out = {r["record_id"]: r for r in got}
    assert len(got) == 7
    assert {k: (r["outcome"], r["response_id"]) for k, r in out.items()} == {
        "v1": ("resolved", "r1"), "v2": ("resolved", "r2"), "v3": ("mismatch", None), "v4": ("no_response", None),
        "v5": ("unvalidated", None), "v6": ("no_response", None)}
    assert out["v1"]["headers"] == {"etag": '"1"', "content-type": "t", "expires": "9", "x": "b"}
    import hashlib

    assert out["v1"]["payload_digest"] == "md5:" + hashlib.md5(b"one\r\n\r\nmore").hexdigest()
    assert warc.resolve_revisits(warc.parse_records(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [400])
def test_hot_url(spark, n):
    raw = [(record("response" if i % 3 == 0 else "revisit", "http://hot.org/", i % 60, f"{i:04d}", "200 OK" if i % 3 == 0 else "304 x",
                   [("ETag", "e")], "b" if i % 3 == 0 else ""),) for i in range(n)]
    got = {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(warc.parse_records(spark.createDataFrame(raw, "record string"))).collect()}
    order = sorted(((i % 60, f"{i:04d}", i % 3 == 0) for i in range(n)))
    last, want = None, {}
    for _, rid, full in order:
        if full:
            last = rid
        else:
            want[rid] = last
    assert got == want
