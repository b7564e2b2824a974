"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, jaccard_join, language_id, mixing, secrets, substring_dedup, token_store, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def definition(name: str) -> str:
    """A public tokenizer's JSON, from the folder in CORDON_TOKENIZERS or the installed package."""
    folder = os.environ.get("CORDON_TOKENIZERS")
    if folder:
        return Path(folder, name).read_text(encoding="utf-8")
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.Mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5).taken()
    return out.select(F.col("_key").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents")).select(F.col("_key").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), window=35, digests=True)
    return out.select(F.col("_key").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_id.LanguageModel.fit(docs, where=fold != 2)
    out = language_id.identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_components(table(spark, sf_dir, "documents"), n=3, percent=90).select(F.col("_key").alias("doc_id"), "n_shingles", "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents")).withColumnRenamed("_key", "doc_id")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(table(spark, sf_dir, "documents"), definition("word_bpe_49k.json"), end_id=1)
    return token_store.read_back(spark, path)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), definition("byte_bpe_50k.json"), digests=True)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_exact_dedup, op3_nearest_vectors, op4_substring_dedup, op5_url_filter, op6_language_id, op7_jaccard_join, op8_secret_scan, op9_token_store, op10_bpe)}

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM h WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
        s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM p WHERE i + 34 <= len(w)),
        r AS (SELECT doc_id, i FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
        x AS (SELECT DISTINCT doc_id, i + unnest(range(0, 35)) AS i FROM r),
        k AS (SELECT p.doc_id, p.i, p.w[p.i] AS word, x.i IS NOT NULL AS gone FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.i = x.i),
        g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op5_url_filter": r"""
        WITH RECURSIVE p AS (
          SELECT page_id, html,
            translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages),
        tags AS (SELECT host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM p WHERE host <> ''),
        hrefs AS (SELECT host, path, CASE
            WHEN regexp_matches(t, '(?is)^<link.*\brel\s*=\s*["'']?(?:[\w-]+\s+)*canonical\b') THEN regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
            WHEN regexp_matches(t, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?is)\bcontent\s*=\s*["'']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1) END AS h FROM tags),
        full_ AS (SELECT host, path, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN h WHEN h LIKE '//%' THEN 'http:' || h WHEN h LIKE '/%' THEN 'http://' || host || h
            ELSE 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || h END AS u FROM hrefs WHERE h IS NOT NULL AND h <> ''),
        links AS (SELECT host || CASE WHEN path = '' THEN '/' ELSE path END AS a, lower(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1)) || CASE WHEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END AS b
            FROM full_ WHERE regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1) <> ''),
        e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS n, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.n),
        rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        names AS (SELECT DISTINCT host, path, host || CASE WHEN path = '' THEN '/' ELSE path END AS n FROM p UNION SELECT split_part(n, '/', 1), substr(n, strpos(n, '/')), n FROM reach),
        fits AS (SELECT n, host, path, rh || rp AS rule, v FROM names JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) = 1),
        caught AS (SELECT DISTINCT reach.n FROM reach JOIN fits ON fits.n = reach.r WHERE v = 'block')
        SELECT page_id, p.host, p.path, fits.rule, coalesce(fits.v, CASE WHEN p.host <> '' AND p.host || CASE WHEN p.path = '' THEN '/' ELSE p.path END IN (SELECT n FROM caught) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN fits ON fits.host = p.host AND fits.path = p.path""",
    "op7_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        reach AS (SELECT doc_id AS n, doc_id AS r FROM d UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.n)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT n, min(r) AS component_id FROM reach GROUP BY n) m ON m.n = d.doc_id""",
}
