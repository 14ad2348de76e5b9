"""One query per operator over its whole table, and SQL twins where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudgauge.llm import (
    bpe, chat, decontam, embdedup, html, langid, license, minhash, packing, search, tokencount, trie, warc,
)
from cloudgauge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "ids")
    both = bpe.decode(tokens, public_tokenizers.path("byte_bpe_50k.json"))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"), sha256(F.col("decoded")).alias("decoded_sha256"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license.scan_licenses(docs).select("doc_id", "n_words", "licenses", F.filter("licenses", lambda m: m["base"]).alias("b"))
    starts = F.transform("b", lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), license.labels_of(F.col("b")).alias("base_labels"),
        license.labels_of(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["score"])), F.lit(0.0)).alias("score"))


#: A conversation whose texts hold control strings of several templates.
TRICKY = r"\### Assistant: </turn> ok"


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.to_variant_object(F.struct("role", "text")).alias("record"))
    said = F.lit(TRICKY)
    tricky = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_variant_object(F.struct(F.array(
            F.struct(F.lit("user").alias("role"), said.alias("content")),
            F.struct(F.lit("assistant").alias("role"), said.alias("content"))).alias("messages"))).alias("record"))
    turns = chat.canonical_turns(rows.union(tricky)).select("conv_id", "turn", F.posexplode("turns").alias("part", "said"))
    formatted = chat.format_chats(
        turns.select("conv_id", "turn", "part", "said.role", "said.text"), "conv_id", ["turn", "part"])
    back = formatted.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(F.array_join(lines, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE["op4_chat_format"] = rf"""
WITH rows AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
SELECT conv_id, COUNT(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(SUM({len(chat.TURN + chat.TEXT + chat.END)} + length(role) + length(text)
        + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.extract(pages, html.train(pages), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids"),
        F.max("similarity").alias("similarity"))


@query
def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


ORACLE["op8_embedding_links"] = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y)
SELECT e.vec_id, COALESCE(n.n, 0) AS n_links, LEAST(e.vec_id, COALESCE(m.y, e.vec_id)) AS component_id,
    e.vec_id = LEAST(e.vec_id, COALESCE(m.y, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, COUNT(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT x, MIN(y) AS y FROM reach GROUP BY x) m ON m.x = e.vec_id"""


@query
def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, shingle=4, percent=80)


ORACLE["op9_minhash_near_duplicates"] = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM split),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        AND a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 80 * (a.n + b.n - COUNT(*))),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y)
SELECT d.doc_id, len(d.s) AS n_shingles, LEAST(d.doc_id, COALESCE(m.y, d.doc_id)) AS component_id,
    d.doc_id = LEAST(d.doc_id, COALESCE(m.y, d.doc_id)) AS kept
FROM sets d LEFT JOIN (SELECT x, MIN(y) AS y FROM reach GROUP BY x) m ON m.x = d.doc_id"""

#: Stands for a missing page id in the times of captures.
UNNAMED_PAGE = 1_000_000_000


@query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a stored response and a 304 revisit, written as WARC records, parsed and resolved.

    The revisit comes up to three days later, or for every fourth page half a second's worth earlier; its ETag is weak
    for every third page and missing for every fifth, where only the date can validate. A page without an id is named by
    its content, comes last in time and has no page_id in the result.
    """
    pages = table(spark, sf_dir, "pages")
    name = F.coalesce(F.col("page_id").cast("string"), F.md5(F.concat(
        F.coalesce("url", F.lit("")), F.lit("|"), F.coalesce("html", F.lit(""))).cast("binary")))
    page, tag = F.coalesce("page_id", F.lit(UNNAMED_PAGE)), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    dated = F.concat(F.lit("Last-Modified: day "), F.floor(page / 7).cast("string"))
    at = page * 60
    later = F.when(page % 4 == 3, at - 30).otherwise(at + (page % 72) * 3600 + 30)
    url = F.coalesce("url", F.lit(""))
    response = warc.warc_record(
        F.lit("response"), url, at, F.concat(F.lit("r"), name), F.when(F.col("html").isNull(), "404 Not Found").otherwise("200 OK"),
        F.array(F.lit("Content-Type: text/html"), F.concat(F.lit("ETag: "), tag), dated, F.lit("Cache-Control: max-age=60")),
        F.coalesce("html", F.lit("")))
    checked = F.array_compact(F.array(
        F.when(page % 5 != 0, F.concat(F.lit("ETag: "), F.when(page % 3 == 0, "W/").otherwise(""), tag)),
        F.when(page % 5 == 0, dated), F.lit("Cache-Control: max-age=600"), F.lit("Content-Length: 0")))
    revisit = warc.warc_record(
        F.lit("revisit"), url, later, F.concat(F.lit("v"), name), F.lit("304 Not Modified"), checked, F.lit(""))
    records = pages.select(F.explode(F.array(response, revisit)).alias("record"))
    found = warc.resolve_revisits(warc.parse_records(records).drop("body"))
    names = F.array_sort(F.map_keys("headers"))
    headers = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), F.col("headers")[n])), ";")
    return found.select(
        F.substring("record_id", 2, 99).try_cast("long").alias("page_id"), "canonical", "outcome",
        F.substring("response_id", 2, 99).try_cast("long").alias("response_page"), headers.alias("headers"), "payload_digest")


ORACLE["op10_warc_revisits"] = r"""
WITH parts AS (
    SELECT row_number() OVER () AS row_id, page_id AS own_id, COALESCE(page_id, 1000000000) AS page_id,
        COALESCE(CAST(page_id AS VARCHAR), md5(COALESCE(url, '') || '|' || COALESCE(html, ''))) AS name, html, regexp_replace(regexp_replace(trim(COALESCE(url, ''), ' '), '#.*$', ''), '^https?://', '', 'i') AS bare,
        '"' || md5(COALESCE(html, '')) || '"' AS tag, 'day ' || CAST(COALESCE(page_id, 1000000000) // 7 AS BIGINT) AS dated
    FROM pages),
urls AS (
    SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\d*\.', ''), ':(80|443)$', '')
            || regexp_replace(regexp_extract(bare, '^[^/?]*(/[^?]*)?', 1), '/+$', '') AS base,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND
            NOT regexp_matches(p, '^(utm_[^=&]*|gclid|fbclid|sessionid|phpsessid)=[^&]*$', 'i'))), '&') AS query FROM parts),
pages2 AS (SELECT *, base || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM urls),
responses AS (SELECT *, page_id * 60 AS t FROM pages2 WHERE html IS NOT NULL AND html <> ''),
revisits AS (
    SELECT *, CASE WHEN page_id % 4 = 3 THEN page_id * 60 - 30 ELSE page_id * 60 + (page_id % 72) * 3600 + 30 END AS t FROM pages2),
joined AS (SELECT v.*, r.name AS response_name, r.own_id AS response_page, r.tag AS rtag, r.dated AS rdated, md5(r.html) AS digest,
        row_number() OVER (PARTITION BY v.row_id ORDER BY r.t DESC, 'r' || r.name DESC) AS k
    FROM revisits v LEFT JOIN responses r ON r.canonical = v.canonical AND r.t <= v.t),
judged AS (SELECT *, CASE WHEN response_name IS NULL THEN 'no_response'
        WHEN page_id % 5 <> 0 THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END
        WHEN dated = rdated THEN 'resolved' ELSE 'mismatch' END AS outcome FROM joined WHERE k = 1)
SELECT own_id AS page_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN response_page END AS response_page,
    CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=600;content-type=text/html;etag='
        || CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 3 = 0 THEN 'W/' ELSE '' END || tag ELSE rtag END
        || ';last-modified=' || rdated END AS headers,
    CASE WHEN outcome = 'resolved' THEN 'md5:' || digest END AS payload_digest
FROM judged"""


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packing.pack(pieces, capacity=4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: Turns that the trie query takes from another conversation at most.
LONGEST_HEAD = 8


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(
        table(spark, sf_dir, "conversations"), head=lambda c: F.crc32(c.cast("string").cast("binary")) % (LONGEST_HEAD + 1),
        base=lambda c: c - c % 5, longest=LONGEST_HEAD)


ORACLE["op12_conversation_trie"] = f"""
WITH RECURSIVE codes AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
    FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
said AS (
    SELECT conv_id AS c, list({{'role': COALESCE(role, ''), 'text': COALESCE(text, '')}}
        ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS w
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
    SELECT c, w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda s, b: xor(s // 256, t[xor(s, b) % 256 + 1])), 4294967295) % {LONGEST_HEAD + 1} AS h
    FROM said, codes),
rebuilt AS (
    SELECT a.c, list_concat(COALESCE(b.w[1:a.h], []), a.w[a.h + 1:]) AS r
    FROM heads a LEFT JOIN said b ON b.c = a.c - a.c % 5),
prefixes AS (
    SELECT c, len(r) AS n, d, sha256(CAST(to_json(r[1:d]) AS VARCHAR)) AS k,
        CASE WHEN d > 0 THEN strlen(r[d].text) ELSE 0 END AS bytes
    FROM (SELECT c, r, unnest(range(0, len(r) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT d, k, MIN(c) AS c, COUNT(*) AS n_convs, MAX(bytes) AS bytes,
        sha256(COALESCE(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
    FROM prefixes GROUP BY d, k),
linked AS (
    SELECT v.*, u.k AS parent_k, u.c AS parent_c FROM nodes v
    LEFT JOIN prefixes p ON p.c = v.c AND p.d = v.d - 1 LEFT JOIN nodes u ON u.d = p.d AND u.k = p.k),
children AS (SELECT d - 1 AS d, parent_k AS k, COUNT(*) AS n FROM linked WHERE d > 0 GROUP BY ALL),
own AS (
    SELECT v.*, COALESCE(w.n, 0) AS n_children, (v.n_convs - 1) * v.bytes AS saved
    FROM linked v LEFT JOIN children w ON w.d = v.d AND w.k = v.k),
below AS (
    SELECT p.d, p.k, COUNT(*) FILTER (v.n_children = 0) AS n_leaves, CAST(SUM(v.saved) AS BIGINT) AS saved_tokens
    FROM own v JOIN prefixes p ON p.c = v.c AND p.d <= v.d GROUP BY p.d, p.k)
SELECT v.c AS conv_id, v.d AS depth, v.parent_c AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, v.ends_sha256
FROM own v JOIN below b ON b.d = v.d AND b.k = v.k"""


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


ORACLE["op13_lexical_search"] = r"""
WITH terms AS (
    SELECT rowid_, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS rowid_, * FROM documents)),
sizes AS (SELECT rowid_, COUNT(*) AS n FROM terms GROUP BY rowid_),
whole AS (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS total FROM sizes),
asked AS (
    SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
counts AS (
    SELECT rowid_, doc_id, term, COUNT(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w
    FROM counts, whole GROUP BY term, docs),
scores AS (
    SELECT a.item_id, a.text, c.rowid_, c.doc_id,
        CAST(SUM(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
    FROM asked a JOIN counts c USING (term) JOIN weights USING (term) JOIN sizes s ON s.rowid_ = c.rowid_, whole
    GROUP BY ALL),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""
