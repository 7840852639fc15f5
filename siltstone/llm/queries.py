"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .chat import format_chats, read_back
from .common import table
from .decontam import contamination
from .exact_dedup import exact_dedup
from .html_extract import extract
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .packing import pack
from .quality import fit, score
from .suffix_dedup import repeated_spans


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", "n_links", "class_id", F.sha2("text", 256).alias("kept_sha256"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    hostile = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    return read_back(format_chats(chats, public_tokenizers.path("byte_bpe_50k.json")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    counts = [F.size(F.filter(base, _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html": op2_html,
    "op3_minhash": op3_minhash,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chat": op6_chat,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
}

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_line_dedup": """
        WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM s),
             f AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS first FROM l WHERE line <> '' GROUP BY line),
             m AS (SELECT line AS x, length(line) AS n, first FROM f),
             q AS MATERIALIZED (SELECT a.x, b.x AS y, a.first AS fx, b.first AS fy, a.n, b.n AS n2 FROM m a JOIN m b ON a.n = b.n
                                WHERE a.x < b.x AND levenshtein(a.x, b.x) <= 4 -- bytes; the exact test on characters follows
                                UNION ALL SELECT a.x, b.x, a.first, b.first, a.n, b.n FROM m a JOIN m b ON a.n = b.n + 1
                                WHERE levenshtein(a.x, b.x) <= 4),
             p AS (SELECT x, y, fx, fy FROM q
                   WHERE CASE WHEN n = n2 THEN len(list_filter(range(1, n + 1), lambda i: x[i] <> y[i])) = 1
                              ELSE len(list_filter(range(0, n), lambda i: x[1:i] || x[i + 2:] = y)) > 0 END),
             k AS (SELECT line, min(other) AS best, count(*) AS n_links
                   FROM (SELECT x AS line, fy AS other FROM p UNION ALL SELECT y, fx FROM p) GROUP BY line),
             c AS (SELECT doc_id, line_no, line, line = '' OR least(first, coalesce(best, first)) = {'d': doc_id, 'n': line_no} AS kept,
                          coalesce(n_links, 0) AS n_links, least(first, coalesce(best, first)).d AS class_doc
                   FROM l LEFT JOIN f USING (line) LEFT JOIN k USING (line))
        SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (line <> '' AND kept) AS n_kept,
               coalesce(sum(n_links) FILTER (line <> ''), 0)::BIGINT AS n_links, coalesce(min(class_doc) FILTER (line <> ''), doc_id) AS class_id,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (kept), '')) AS kept_sha256
        FROM c GROUP BY doc_id""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
             b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
             v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
                   FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
             h AS (SELECT doc_id, i, q.n, item_id
                   FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v)) q
                   JOIN v ON q.n = v.n AND array_to_string(q.w[q.i : q.i + q.n - 1], ' ') = v.win),
             n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
             t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
                   FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             g AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k
                   FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
             r AS (SELECT g.doc_id, i FROM g JOIN (SELECT k, min({'d': doc_id, 'i': i}) AS first FROM g GROUP BY k HAVING count(*) > 1) USING (k)
                   WHERE {'d': doc_id, 'i': i} > first),
             n AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 100, true) AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
             m AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM n),
             s AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM m GROUP BY doc_id, span),
             t AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM s),
             x AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last,
                          string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS kept FROM t JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN x USING (doc_id)""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
