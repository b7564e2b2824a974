"""Named queries over the driver's tables, with SQL of the same meaning where SQL has one.

`source` plays the tenant of a document, `label` that of a vector, `benchmark` the questions, `events`
the stages of queries. Counts are bigint, doubles are rounded to six places, ids break ties.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_sql, schema, tenancy
from .functions import analyzer, scalar
from .operators import backfill, chunking, fusion, ingest, metrics, textsearch, vector
from .snapshot import Store
from .sources import embedding, files, synthetic

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places)


def _claim(tenant: str) -> str:
    return tenancy.claims_of(tenant)


# tenancy


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE source = 'src3' GROUP BY lang")
def policy_scoped_count(spark, d):
    return tenancy.policy_filter(_t(spark, d, "documents"), _claim("src3"), "source").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT CAST(0 AS BIGINT) AS unset, CAST(0 AS BIGINT) AS keyless")
def policy_fails_closed(spark, d):
    docs = _t(spark, d, "documents")
    seen = [tenancy.policy_filter(docs, c, "source").agg(F.count("*").alias(n)) for c, n in ((None, "unset"), ("{}", "keyless"))]
    return seen[0].join(seen[1], how="cross")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (3, 23) AND source = 'src3'")
def policy_point_lookup(spark, d):
    return tenancy.policy_filter(_t(spark, d, "documents"), _claim("src3"), "source").where(F.col("doc_id").isin(3, 23)).select("doc_id", "lang", "n_chars")


@query("SELECT DISTINCT source AS tenant FROM documents")
def distinct_tenants(spark, d):
    return _t(spark, d, "documents").select(F.col("source").alias("tenant")).distinct().orderBy("tenant")


@query("SELECT source AS tenant, count(*) AS n FROM documents GROUP BY source")
def count_by_tenant(spark, d):
    return _t(spark, d, "documents").groupBy(F.col("source").alias("tenant")).agg(F.count("*").alias("n"))


@query("SELECT source AS tenant, lang AS category, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def corpus_inventory(spark, d):
    return files.inventory(_t(spark, d, "documents").select(F.col("source").alias("tenant"), F.col("lang").alias("category")))


@query("SELECT source, lang, 'missing' AS side FROM (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT source, lang, 'unexpected' FROM (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0 EXCEPT SELECT DISTINCT source, lang FROM documents WHERE doc_id % 2 = 0)")
def policy_set_difference(spark, d):
    pairs = lambda n: _t(spark, d, "documents").where(F.col("doc_id") % n == 0).select("source", "lang").distinct()
    return tenancy.policy_differences(pairs(3), pairs(2))


# vectors

_COS = "1 - list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


def _vectors(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("tenant_id"))


def _query_vectors(spark, d) -> DataFrame:
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("qid"), "tenant_id", "embedding")


def _first_vector(spark, d) -> list[float]:
    return _t(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


@query(f"SELECT e.vec_id AS id, round({_COS.format('e.embedding', 'q.embedding')}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 2 ORDER BY {_COS.format('e.embedding', 'q.embedding')}, e.vec_id LIMIT 5")
def vector_topk_tenant(spark, d):
    own = tenancy.policy_filter(_vectors(spark, d), _claim("2"))
    return vector.top_k(own, _first_vector(spark, d), 5).withColumn("distance", _r("distance"))


@query(f"WITH p AS (SELECT q.vec_id AS qid, e.vec_id AS id, {_COS.format('e.embedding', 'q.embedding')} AS dist FROM embeddings e JOIN embeddings q ON q.label = e.label AND q.vec_id % 20 = 0) SELECT qid, id, round(dist, 6) + 0 AS distance, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM p QUALIFY rank <= 5")
def vector_topk_each(spark, d):
    out = vector.top_k_each(_vectors(spark, d), _query_vectors(spark, d), 5)
    return out.select("qid", "id", (_r("distance") + 0).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH p AS (SELECT e.label, row_number() OVER (ORDER BY {_COS.format('e.embedding', 'q.embedding')}, e.vec_id) AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) SELECT CAST(ef AS BIGINT) AS ef, (SELECT least(5, count(*)) FROM p WHERE r <= ef AND label = 5) AS rows_returned FROM (VALUES (10), (40), (100)) v(ef)")
def vector_filter_after_limit(spark, d):
    q, rows, out = _first_vector(spark, d), _vectors(spark, d), []
    for ef in (10, 40, 100):
        out.append(vector.probe_after_filter(rows, q, "5", 5, ef).agg(F.lit(ef).cast("long").alias("ef"), F.count("*").alias("rows_returned")))
    return out[0].union(out[1]).union(out[2])


@query(f"WITH p AS (SELECT e.label, row_number() OVER (ORDER BY {_COS.format('e.embedding', 'q.embedding')}, e.vec_id) AS r FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), n AS (SELECT ef, (SELECT least(5, count(*)) FROM p WHERE r <= ef AND label = 5) AS rows_returned FROM (VALUES (10), (40), (100)) v(ef)) SELECT max(rows_returned) > min(rows_returned) AS recovered, min(rows_returned) AS least, max(rows_returned) AS most FROM n")
def vector_recall_verdict(spark, d):
    return metrics.recall_recovers(vector_filter_after_limit(spark, d).withColumn("used_index", F.lit(True)))


@query("SELECT vec_id AS id, len(embedding) AS dim, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm FROM embeddings")
def vector_norms(spark, d):
    return _vectors(spark, d).select("id", F.size("embedding").cast("long").alias("dim"), _r(scalar.dot(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query()
def synthetic_vectors(spark, d):
    return synthetic.skewed_chunks(spark, {"small": 111, "large": 889}, 16)


# chunks and text


@query("SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, md5(substring(text, i * 512 + 1, 512)) AS content_md5, length(substring(text, i * 512 + 1, 512)) AS n_chars FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 511) // 512))) AS i FROM documents)")
def chunks_fixed_chars(spark, d):
    out = chunking.char_chunks(_t(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"), F.length("content").cast("long").alias("n_chars"))


@query("SELECT count(*) FILTER (length(text) > 512) AS documents_split, CAST(sum(greatest(1, (length(text) + 511) // 512)) AS BIGINT) AS chunks FROM documents")
def split_tally(spark, d):
    n = chunking.char_chunks(_t(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("documents_split"), F.sum("n").alias("chunks"))


_SENTENCES = r"list_filter(string_split(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(f"SELECT doc_id, greatest(1, len({_SENTENCES.format('text')})) AS n, md5(coalesce({_SENTENCES.format('text')}[1], '')) AS first_md5 FROM documents")
def sentence_split(spark, d):
    s = scalar.sentences(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.get(s, F.lit(0))).alias("first_md5"))


@query(r"SELECT doc_id, count(*) AS lines, count(*) FILTER (NOT regexp_matches(l, '^\s') AND trim(l) <> '' AND l = upper(l) AND regexp_matches(l, '\p{L}')) AS headings, count(*) FILTER (regexp_matches(l, '^\s+\S')) AS table_rows FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def line_classes(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(scalar.is_heading(F.col("l"))).alias("headings"), F.count_if(scalar.is_table_row(F.col("l"))).alias("table_rows"))


@query(r"SELECT conv_id, turn, trim(regexp_extract(l, '^([A-Za-z][A-Za-z0-9 /]{0,40}):\s+(\S.*)$', 1)) AS key, md5(regexp_replace(regexp_extract(l, '(?s)^([A-Za-z][A-Za-z0-9 /]{0,40}):\s+(\S.*)$', 2), '\s+$', '')) AS value_md5 FROM (SELECT conv_id, turn, unnest(string_split('Role ' || role || ': ' || text, chr(10))) AS l FROM conversations) WHERE regexp_matches(l, '(?s)^[A-Za-z][A-Za-z0-9 /]{0,40}:\s+\S.*$')")
def metadata_pairs(spark, d):
    lines = F.split(F.concat(F.lit("Role "), F.col("role"), F.lit(": "), F.col("text")), "\n")
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.explode(lines).alias("line"))
    return rows.select("conv_id", "turn", scalar.metadata_pair(F.col("line")).alias("p")).where("p is not null").select("conv_id", "turn", "p.key", F.md5("p.value").alias("value_md5"))


@query("SELECT conv_id, string_agg('T' || turn || ': ' || role, ' | ' ORDER BY turn) AS suffix FROM conversations GROUP BY conv_id")
def metadata_suffixes(spark, d):
    line = F.concat(F.lit("T"), F.col("turn").cast("string"), F.lit(": "), F.col("role"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])
    return _t(spark, d, "conversations").groupBy("conv_id").agg(lines.alias("l")).select("conv_id", scalar.metadata_suffix(scalar.metadata_map(F.col("l"))).alias("suffix"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN source || chr(10) || chr(10) || text ELSE source || ' > ' || lang || chr(10) || chr(10) || text END) AS embedded_md5 FROM documents")
def path_prefixes(spark, d):
    path = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array("source")).otherwise(F.array("source", "lang"))
    return _t(spark, d, "documents").select("doc_id", F.md5(scalar.with_path(F.col("text"), path)).alias("embedded_md5"))


@query("SELECT source || '/' || lang || '/doc' || doc_id || '#' || (doc_id % 4 + 1) AS chunk, source || '/' || lang || '/doc' || doc_id || '.txt' AS path, source AS slug, lang AS category, 'doc' || doc_id AS stem, doc_id % 4 + 1 AS ordinal FROM documents")
def chunk_names(spark, d):
    name = scalar.chunk_name(F.col("source"), F.col("lang"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("doc_id") % 4)
    rows = _t(spark, d, "documents").select(name.alias("chunk")).withColumn("p", scalar.chunk_name_parts(F.col("chunk")))
    return rows.select("chunk", "p.path", "p.slug", "p.category", "p.stem", F.col("p.ordinal").cast("long").alias("ordinal"))


@query(chunk_sql.PARSE)
def parse_structure(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", chunking.parsed(F.col("text")).alias("p"))
    blocks = F.flatten(F.transform("p.sections", lambda s: s["blocks"]))
    tables = F.size(F.filter(blocks, lambda b: b["kind"] == "table"))
    return rows.select("doc_id", "p.title", *(n.cast("long").alias(c) for c, n in (("n_metadata", F.size("p.metadata")), ("n_sections", F.size("p.sections")), ("n_tables", tables), ("n_blocks", F.size(blocks)))))


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"), F.array_join("section_path", " > ").alias("section_path"), F.col("token_count").cast("long").alias("token_count"))


@query(chunk_sql.BY_SECTIONS)
def chunks_by_sections(spark, d):
    return _chunk_rows(chunking.chunked(_t(spark, d, "documents").select("doc_id", "text")))


@query(chunk_sql.BY_SENTENCES)
def chunks_by_sentences(spark, d):
    return _chunk_rows(chunking.chunked(_t(spark, d, "documents").select("doc_id", "text"), strategy=chunking.sentence_chunks))


@query(chunk_sql.VARIANTS)
def search_text_variants(spark, d):
    out = chunking.search_texts(_t(spark, d, "documents").select("doc_id", "text"))
    return out.groupBy("strategy").agg(F.count("*").alias("chunks"), F.sum(F.length("search_text")).alias("chars"))


def _search_texts(docs: DataFrame) -> DataFrame:
    """strategy, document, chunk_index, search_text; texts of rows that share a document's id are put together, as in an index by id."""
    several = docs.groupBy(F.col("document").alias("_d")).agg(F.count("*").alias("_n")).where("_n > 1").select("_d").checkpoint()
    if several.isEmpty():
        return chunking.search_texts(docs)
    same = F.col("document").eqNullSafe(F.col("_d"))
    once, often = (chunking.search_texts(docs.join(several, same, how)) for how in ("left_anti", "left_semi"))
    joined = often.groupBy("strategy", "document", "chunk_index").agg(F.array_join(F.collect_list("search_text"), "\n").alias("search_text"))
    return once.select(*joined.columns).unionByName(joined)


@query(chunk_sql.STRATEGY_SCORES)
def strategy_scores(spark, d):
    docs, truth = _t(spark, d, "documents").select(F.col("doc_id").alias("document"), "text"), _truth(spark, d).checkpoint()
    near = _search_texts(textsearch.of_documents(docs, truth.select("id").distinct()))
    terms = (analyzer.plain_terms(F.col(c)) for c in ("search_text", "text"))
    out = metrics.strategy_scores(_search_texts(docs), _questions(spark, d), truth, *terms, chunking.STRATEGIES, near)
    return out.select(F.col("strategy").cast("long").alias("strategy"), "n", *(_r(c).alias(c) for c in ("hit_1", "hit_5", "mrr")))


@query()
def synthetic_corpus(spark, d):
    return synthetic.corpus(spark)


@query("SELECT CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS BIGINT) AS tokens, round(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+'))) / 1000.0 * 0.00013, 6) AS usd FROM documents")
def embedding_cost(spark, d):
    return embedding.embedding_cost(_t(spark, d, "documents"), 0.00013, F.regexp_count("text", F.lit("[A-Za-z0-9]+"))).withColumn("usd", _r("usd"))


# full-text search

_TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_INDEX = f"i AS (SELECT doc_id, source, term, count(*) AS tf FROM (SELECT doc_id, source, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY ALL)"
_ASKED = f"q AS (SELECT item_id AS qid, len(list_distinct({_TERMS.format('text')})) AS n, unnest(list_distinct({_TERMS.format('text')})) AS term FROM benchmark)"
_SCORES = f"{_INDEX}, {_ASKED}, s AS (SELECT qid, doc_id AS id, round(sum(list_sum(list_transform(range(1, tf + 1), lambda j: 0.1::DOUBLE / (j * j))) / 1.64493406685 / n), 6) AS score FROM q JOIN i USING (term) GROUP BY ALL)"


def _asked_terms(spark, d, terms: Column) -> DataFrame:
    return _questions(spark, d).select(F.explode(terms).alias("term"))


def _index(spark, d) -> DataFrame:
    """Postings of the terms that any question asks for."""
    terms = analyzer.plain_terms(F.col("text"))
    return textsearch.inverted_index(_t(spark, d, "documents"), "doc_id", terms, only=_asked_terms(spark, d, terms))


def _questions(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def _hits(spark, d) -> DataFrame:
    return textsearch.search(_index(spark, d), _questions(spark, d), analyzer.plain_terms(F.col("text")))


@query(f"WITH {_INDEX}, {_ASKED} SELECT qid, count(DISTINCT doc_id) AS documents FROM q JOIN i USING (term) GROUP BY qid")
def text_match_any(spark, d):
    return _hits(spark, d).groupBy("qid").agg(F.count("*").alias("documents"))


@query(f"WITH {_SCORES} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5")
def text_rank_top5(spark, d):
    return textsearch.ranked(_hits(spark, d), 5).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query()
def text_rank_stemmed(spark, d):
    index = textsearch.inverted_index(_t(spark, d, "documents"), "doc_id", analyzer.english_terms("text"), only=_asked_terms(spark, d, analyzer.query_terms("text")))
    return textsearch.ranked(textsearch.search(index, _questions(spark, d), analyzer.query_terms("text")), 5)


_TRUTH = "w AS (SELECT item_id AS qid, doc_id AS id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"


def _truth(spark, d) -> DataFrame:
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("phrase"))
    # The phrases of all questions against all documents.
    return textsearch.holding(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), items)


def _scores(spark, d) -> DataFrame:
    qs = _questions(spark, d).select(F.col("id").alias("qid"), F.format_string("kind%d", F.col("id") % 3).alias("kind"))
    return metrics.retrieval_scores(textsearch.ranked(_hits(spark, d)), _truth(spark, d), qs)


_METRICS = f"WITH {_SCORES}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s), {_TRUTH}, g AS (SELECT q.item_id AS qid, 'kind' || (q.item_id % 3) AS kind, coalesce(bool_or(r.rank <= 1), false) AS hit_1, coalesce(bool_or(r.rank <= 5), false) AS hit_5, coalesce(count(*) FILTER (r.rank <= 5) * 1.0 / nullif((SELECT count(*) FROM w w2 WHERE w2.qid = q.item_id), 0), 0) AS recall_5, coalesce(1.0 / min(r.rank), 0) AS mrr FROM benchmark q LEFT JOIN (r SEMI JOIN w ON r.qid = w.qid AND r.id = w.id) r ON r.qid = q.item_id GROUP BY q.item_id)"


@query(_METRICS + " SELECT kind, count(*) AS n, round(avg(hit_1::INT), 6) AS hit_1, round(avg(hit_5::INT), 6) AS hit_5, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr FROM g GROUP BY GROUPING SETS ((kind), ())")
def retrieval_metrics(spark, d):
    mean = lambda c: _r(F.avg(F.col(c).cast("double"))).alias(c)
    return metrics.by_category(_scores(spark, d), "kind", F.count("*").alias("n"), mean("hit_1"), mean("hit_5"), mean("recall_5"), mean("mrr"))


@query(_METRICS + " SELECT qid, round(mrr, 3) AS mrr FROM g WHERE round(mrr, 3) < 1")
def weak_results(spark, d):
    return _scores(spark, d).select("qid", F.round("mrr", 3).alias("mrr")).where("mrr < 1")


@query(_METRICS + " SELECT (SELECT count(*) FROM g) AS traps, (SELECT count(DISTINCT qid) FROM r) AS answered")
def trap_tally(spark, d):
    return metrics.trap_tally(_questions(spark, d).select(F.col("id").alias("qid")), textsearch.ranked(_hits(spark, d), 1))


@query("SELECT item_id AS qid, doc_id AS id FROM benchmark JOIN documents ON source IN ('src' || item_id % 20, 'src' || (item_id + 1) % 20, 'src' || (item_id + 2) % 20, 'src' || (item_id + 3) % 20, 'src' || (item_id + 5) % 20, 'src' || (item_id + 8) % 20, 'src' || (item_id + 13) % 20) AND contains(documents.text, benchmark.text)")
def derived_truth(spark, d):
    named = F.transform(F.array(*(F.lit(k) for k in (0, 1, 2, 3, 5, 8, 13))), lambda k: F.concat(F.lit("src"), ((F.col("item_id") + k) % 20).cast("string")))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array("text").alias("phrases"), named.alias("documents"))
    return metrics.derived_truth(asked, _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("document")))


# metrics on rows


@query("SELECT round(avg(quality), 6) AS faithfulness, round(avg(1 - toxic), 6) AS citation_accuracy, count(*) AS n FROM labels")
def faithfulness_and_citations(spark, d):
    return _t(spark, d, "labels").agg(_r(metrics.mean_of(F.col("quality") == 1)).alias("faithfulness"), _r(metrics.mean_of(F.col("toxic") == 0)).alias("citation_accuracy"), F.count("*").alias("n"))


@query("SELECT round(coalesce(count(*) FILTER (quality = 0 AND toxic = 1) * 1.0 / nullif(count(*) FILTER (quality = 0), 0), 0), 6) AS correct_refusal_rate, round(coalesce(count(*) FILTER (quality = 1 AND toxic = 1) * 1.0 / nullif(count(*) FILTER (quality = 1), 0), 0), 6) AS false_refusal_rate, count(*) FILTER (quality = 0) AS n_should_refuse, count(*) FILTER (quality = 1) AS n_should_answer FROM labels")
def refusal_correctness(spark, d):
    rows = _t(spark, d, "labels").select(F.when(F.col("quality") == 0, "refuse").otherwise("answer").alias("expected_behaviour"), (F.col("toxic") == 1).alias("system_refused"))
    return metrics.refusal_correctness(rows).withColumns({c: _r(c) for c in ("correct_refusal_rate", "false_refusal_rate")})


_STAGES = "v AS (SELECT event_type AS stage, value AS v FROM events UNION ALL SELECT NULL, sum(value) FROM events GROUP BY user_id)"


@query(f"WITH {_STAGES}, a AS (SELECT stage, list_sort(list(v)) AS a FROM v GROUP BY stage) SELECT stage, len(a) AS n, round(a[CAST(round_even(0.5 * (len(a) - 1), 0) AS BIGINT) + 1], 4) AS p50, round(a[CAST(round_even(0.95 * (len(a) - 1), 0) AS BIGINT) + 1], 4) AS p95 FROM a")
def latency_percentiles(spark, d):
    rows = _t(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return metrics.stage_percentiles(rows, "user_id").select("stage", F.col("n").cast("long").alias("n"), _r("p50", 4).alias("p50"), _r("p95", 4).alias("p95"))


@query("WITH a AS (SELECT event_type AS stage, list_sort(list(value)) AS a FROM events GROUP BY event_type) SELECT stage, len(a) AS n, a[CAST(round_even(0.5 * (len(a) - 1), 0) AS BIGINT) + 1] AS p50, a[CAST(round_even(0.95 * (len(a) - 1), 0) AS BIGINT) + 1] AS p95 FROM a")
def latency_percentiles_at_scale(spark, d):
    return metrics.ranked_percentiles(_t(spark, d, "events").withColumnRenamed("event_type", "stage"), "stage", "value")


@query("WITH t AS (SELECT value FROM events ORDER BY event_id LIMIT 330 OFFSET 0), k AS (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY event_id) AS i FROM events) WHERE i > 30 AND i <= 330), a AS (SELECT list_sort(list(value)) AS a FROM k) SELECT count(*) AS n, round_even(median(value), 1) AS median, round_even((SELECT a[least(CAST(floor(len(a) * 0.95) AS BIGINT), len(a) - 1) + 1] FROM a), 1) AS p95, round_even(avg(value), 1) AS mean, round_even(min(value), 1) AS min, round_even(max(value), 1) AS max FROM k")
def latency_sample(spark, d):
    return metrics.latency_sample(_t(spark, d, "events"), "event_id", "value")


@query("SELECT round(avg(l_extendedprice + l_discount + l_tax), 4) AS usd_per_query, round(median(l_extendedprice + l_discount + l_tax), 4) AS median_usd_per_query FROM lineitem")
def query_cost(spark, d):
    out = metrics.cost_per_query(_t(spark, d, "lineitem"), "l_extendedprice", "l_discount", "l_tax")
    return out.select(_r("usd_per_query", 4).alias("usd_per_query"), _r("median_usd_per_query", 4).alias("median_usd_per_query"))


@query("SELECT l_returnflag AS m, l_linestatus AS ef, min(l_orderkey) AS first, count(*) AS n FROM lineitem GROUP BY ALL")
def grid_groups(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("m"), F.col("l_linestatus").alias("ef"), "l_orderkey")
    return metrics.first_seen_groups(rows, "l_orderkey", "m", "ef").groupBy("m", "ef", "first").agg(F.count("*").alias("n")).orderBy("first")


# tables and their changes


@query("SELECT doc_id AS id FROM documents WHERE source = 'src3' AND doc_id % 3 = 0 AND doc_id > 100 ORDER BY doc_id LIMIT 20")
def keyset_page(spark, d):
    rows = tenancy.policy_filter(_t(spark, d, "documents"), _claim("src3"), "source").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, 1).alias("second"))
    return backfill.keyset_page(rows, 100, 20, "second").select("id")


@query("SELECT o_custkey AS k, CAST(count(*) FILTER (o_orderkey % 2 = 0) + count(*) FILTER (o_orderkey % 2 = 1) AS BIGINT) AS done, CASE WHEN count(*) FILTER (o_orderkey % 2 = 1) > 0 THEN 'new' ELSE 'old' END AS status FROM orders GROUP BY o_custkey")
def upsert_accumulate(spark, d):
    part = lambda odd, status: _t(spark, d, "orders").where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("done")).withColumn("status", F.lit(status))
    return ingest.upsert(part(0, "old"), part(1, "new"), "k", {"done": "o.done + n.done"})


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS origin FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def insert_ignore(spark, d):
    part = lambda n, origin: _t(spark, d, "customer").where(F.col("c_custkey") % n == 0).select(F.col("c_custkey").alias("k"), F.lit(origin).alias("origin"))
    return ingest.insert_ignore(part(3, "old"), part(5, "new"), "k")


@query("SELECT CAST(label AS VARCHAR) AS tenant_id, vec_id AS id, CASE WHEN label % 2 = 1 THEN 'v2' ELSE 'v1' END AS embed_model, CAST(CASE WHEN label % 2 = 1 THEN len(embedding) // 2 ELSE len(embedding) END AS INTEGER) AS embed_dim, round(list_sum(CASE WHEN label % 2 = 1 THEN embedding[:len(embedding) // 2] ELSE embedding END::DOUBLE[]), 4) + 0 AS total FROM embeddings")
def cutover_switch(spark, d):
    n = F.size("embedding")
    second = F.slice("embedding", F.lit(1), F.floor(n / 2).cast("int"))
    rows = _vectors(spark, d).withColumns({"document_id": F.lit(""), "embed_model": F.lit("v1"), "embed_dim": n, "embedding_v2": second, "embed_model_v2": F.lit("v2"), "embed_dim_v2": F.size(second)})
    flags = rows.select("tenant_id").distinct().where(F.col("tenant_id").cast("int") % 2 == 1).withColumn("active_model", F.lit("v2"))
    total = F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y)
    return backfill.active_embeddings(rows, flags).select("tenant_id", "id", "embed_model", "embed_dim", (_r(total, 4) + 0).alias("total"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS embed_model FROM documents WHERE doc_id % 7 = 0 OR lang <> 'en'")
def model_mismatches(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("embed_model"), F.lit(3).alias("embed_dim"))
    return embedding.mismatched(rows, "en", 3).select("id", "embed_model")


@query("SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS referenced, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS orphans FROM customer")
def foreign_keys(spark, d):
    c, o = _t(spark, d, "customer").select(F.col("c_custkey").alias("document_id")), _t(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    missing = schema.orphans(c, o).agg(F.count("*").alias("orphans"))
    return missing.join(c.agg(F.count("*").alias("_n")), how="cross").select((F.col("_n") - F.col("orphans")).alias("referenced"), "orphans")


@query("SELECT item_id AS qid, 'doc' || (item_id * 37) AS id FROM benchmark WHERE item_id * 37 NOT IN (SELECT doc_id FROM documents)")
def golden_integrity(spark, d):
    expected = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("doc"), (F.col("item_id") * 37).cast("string")).alias("id"))
    return metrics.unknown_expected(expected, _t(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id")))


@query("SELECT doc_id, upper(source) AS slug FROM documents")
def tenant_slugs(spark, d):
    docs = _t(spark, d, "documents")
    slugs = docs.select(F.col("source").alias("tenant_id"), F.upper("source").alias("slug")).distinct()
    return tenancy.with_slug(docs.select("doc_id", F.col("source").alias("tenant_id")), slugs).select("doc_id", "slug")


# the store: documents of two tenants, even and odd, chunked by windows of characters

_DIM = 8
_TENANT = "CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END"
_WINDOWS = f"w AS (SELECT {_TENANT} AS tenant_id, doc_id, i, substring(text, i * 512 + 1, 512) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 511) // 512))) AS i FROM documents))"


def _filled_store(spark, d) -> tuple[Store, Callable[..., None]]:
    """A store below the shared folder with the documents loaded, and a function that ingests a tenant's."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    store = Store(spark, f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}")
    texts = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text", "source")
    tenant = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd")
    store.load("documents", texts.select("id", tenant.alias("tenant_id"), F.col("source").alias("title"), F.lit("").alias("storage_key"), F.lit("text/plain").alias("content_type")))

    def add(tenant: str, ids: list[str] | None = None, word: str = "") -> ingest.IngestResult:
        def chunk(docs: DataFrame) -> DataFrame:
            rows = chunking.char_chunks(docs.join(texts.select("id", "text"), "id").select("id", "text"))
            return rows.withColumns({"content": F.concat(F.lit(word), "content"), "page_from": F.lit(None).cast("int"), "page_to": F.lit(None).cast("int"), "token_count": F.lit(1)})

        return ingest.ingest(store, tenant, ids, chunk, lambda rows: embedding.embed(rows, embedding.HashProvider(_DIM), "m1", _DIM), _DIM)

    return store, add


def _contents(chunks: DataFrame) -> DataFrame:
    return chunks.select("tenant_id", F.col("document_id").cast("long").alias("doc_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("content_md5"))


@query(f"WITH {_WINDOWS} SELECT tenant_id, doc_id, i AS chunk_index, md5(CASE WHEN doc_id % 20 = 0 THEN 'new ' ELSE '' END || content) AS content_md5 FROM w")
def store_ingest(spark, d):
    """Both tenants' documents, then some of the first tenant's anew."""
    store, add = _filled_store(spark, d)
    add("even")
    add("odd")
    again = [r[0] for r in store.read("documents", tenant="even").where("cast(id as long) % 20 = 0").select("id").collect()]  # what is asked for
    add("even", again, "new ")
    return _contents(store.read("chunks"))


@query(f"WITH {_WINDOWS} SELECT tenant_id, doc_id, i AS chunk_index, md5(content) AS content_md5 FROM w WHERE tenant_id = 'even' AND doc_id % 14 <> 0 AND doc_id <> 2")
def store_deletion(spark, d):
    """Documents deleted with their chunks, one document's chunks deleted by its tenant, the other tenant offboarded."""
    store, add = _filled_store(spark, d)
    add("even")
    add("odd")
    ingest.delete_documents(store, [r[0] for r in store.read("documents").where("cast(id as long) % 14 = 0").select("id").collect()])
    ingest.delete_document_chunks(store, "even", "2")
    ingest.delete_document_chunks(store, "even", "1")  # not this tenant's
    ingest.offboard_tenant(store, "odd")
    return _contents(store.read("chunks"))


@query(f"WITH {_WINDOWS} SELECT tenant_id, CASE tenant_id WHEN 'even' THEN 'm2' ELSE 'm1' END AS embed_model, count(*) AS chunks, count(*) AS done, 'complete' AS status FROM w GROUP BY tenant_id")
def store_backfill(spark, d):
    """Second vectors for both tenants to the end; both are flipped and one is rolled back; then all active vectors."""
    store, add = _filled_store(spark, d)
    for tenant in ("even", "odd"):
        add(tenant)
    batch = max(100, store.read("chunks").count() // 4)
    backfill.run_backfill(store, ["even", "odd"], embedding.HashProvider(_DIM), "m2", _DIM, batch)
    for tenant in ("even", "odd"):
        backfill.flip_to_v2(store, tenant)
    backfill.rollback_to_v1(store, "odd")
    active = backfill.active_embeddings(store.read("chunks"), store.read("cutover")).groupBy("tenant_id", "embed_model").agg(F.count("*").alias("chunks"))
    return active.join(store.read("progress"), "tenant_id").select("tenant_id", "embed_model", "chunks", F.col("chunks_done").cast("long").alias("done"), "status")


@query("SELECT * FROM (VALUES ('0001_load', 1), ('0002_drop', 2)) t(filename, number) CROSS JOIN (SELECT count(*) AS documents FROM documents WHERE doc_id % 2 = 1)")
def store_migrations(spark, d):
    """Two steps, applied once each: one adds nothing, one drops a tenant; then nothing is left to do."""
    store, _ = _filled_store(spark, d)
    steps = {"0002_drop": lambda s: {"documents": {"even": None}}, "0001_load": lambda s: None}
    names = store.migrate(steps, ("documents", "chunks"))
    if names != ["0001_load", "0002_drop"] or store.migrate(steps):
        raise AssertionError(names)
    rows = store.ledger().select("filename", F.substring("filename", 1, 4).cast("int").alias("number"))
    return rows.join(store.read("documents").agg(F.count("*").alias("documents")), how="cross")


@query("SELECT count(*) AS lines_left, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 0)")
def cascade_survivors(spark, d):
    gone = _t(spark, d, "orders").where("o_custkey % 4 = 0").select("o_orderkey")
    return ingest.cascade(_t(spark, d, "lineitem"), gone, "l_orderkey", "o_orderkey").agg(F.count("*").alias("lines_left"), F.sum("l_quantity").cast("double").alias("quantity"))


# beyond the reference: what it only announces


@query(f"WITH {_SCORES}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s), b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS rank FROM s), u AS (SELECT qid, id, 1.0 / (60 + rank) AS x FROM r UNION ALL SELECT qid, id, 1.0 / (60 + rank) FROM b), g AS (SELECT qid, id, sum(x) AS x FROM u GROUP BY qid, id) SELECT qid, id, round(x, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9) DESC, id) AS rank FROM g QUALIFY rank <= 5")
def reciprocal_rank_fusion(spark, d):
    hits = _hits(spark, d)
    by_id = hits.select("qid", "id", F.row_number().over(fusion.Window.partitionBy("qid").orderBy("id")).alias("rank"))
    out = fusion.fused([textsearch.ranked(hits), by_id])
    return out.where("rank <= 5").select("qid", "id", _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY t, role) AS number FROM f")
def citation_numbers(spark, d):
    out = fusion.citation_numbers(_t(spark, d, "conversations"), "conv_id", "role", "turn")
    return out.select("conv_id", "role", F.col("number").cast("long").alias("number"))
