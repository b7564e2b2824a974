"""Retrieval, citation, refusal, latency and cost metrics as aggregates.

Each comes as columns to aggregate with, or as a DataFrame for the two-step ones. Overall values are
over questions, not means of means: categories and the total come from one pass with grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalar import floor_rank
from .selection import at_ranks, middle, nearest_rank


def hit_at(rank: Column, expected: Column, k: int) -> Column:
    """Whether an expected id is among the first k."""
    return F.coalesce(F.bool_or((rank <= k) & expected), F.lit(False))


def reciprocal_rank(rank: Column, expected: Column) -> Column:
    """1 over the rank of the first expected id; 0 without one."""
    return F.coalesce(1 / F.min(F.when(expected, rank)), F.lit(0.0))


def retrieval_scores(ranked: DataFrame, expected: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """questions with hit_k and recall_k for each k, and mrr.

    ranked: qid, id, rank; expected: qid, id; questions: qid and whatever else, each of them in the result. Recall
    counts distinct ids and is 0 for a question that expects nothing.
    """
    want = expected.select("qid", "id").distinct()
    seen = ranked.join(want.withColumn("_hit", F.lit(True)), ["qid", "id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    scores = seen.groupBy("qid").agg(*(hit_at(F.col("rank"), F.col("_hit"), k).alias(f"hit_{k}") for k in ks), *(F.count_distinct(F.when((F.col("rank") <= k) & F.col("_hit"), F.col("id"))).alias(f"_got_{k}") for k in ks), reciprocal_rank(F.col("rank"), F.col("_hit")).alias("mrr"))
    out = questions.join(scores, "qid", "left").join(want.groupBy("qid").agg(F.count("*").alias("_want")), "qid", "left")
    recall = {f"recall_{k}": F.coalesce(F.try_divide(F.col(f"_got_{k}"), F.col("_want")), F.lit(0.0)) for k in ks}
    hits = {f"hit_{k}": F.coalesce(f"hit_{k}", F.lit(False)) for k in ks}
    return out.withColumns(recall | hits | {"mrr": F.coalesce("mrr", F.lit(0.0))}).drop("_want", *(f"_got_{k}" for k in ks))


def strategy_scores(texts: DataFrame, questions: DataFrame, expected: DataFrame, text_terms: Column, question_terms: Column, strategies: Sequence | None = None, near: DataFrame | None = None) -> DataFrame:
    """strategy, n, hit_1, hit_5, mrr: how well each way to index the documents finds the expected ones.

    texts: strategy, document, chunk_index (these three tell them apart), search_text; questions: id, text; expected: qid, id (a document).
    All strategies are searched at once; a chunk counts as its document. Strategies are those named, or else those that texts have,
    for which texts are made once more. near: as texts, those of the expected documents (see textsearch.best_ranks).
    """
    from . import textsearch

    kind = StructType([StructField("strategy", texts.schema["strategy"].dataType)])
    kinds = texts.select("strategy").distinct() if strategies is None else texts.sparkSession.createDataFrame([(s,) for s in strategies], kind)
    rows = lambda x: x.select(F.col("strategy").alias("tenant"), "document", F.col("chunk_index").alias("part"), textsearch.term_list(x, text_terms).alias("terms"))
    ranks = textsearch.best_ranks(rows(texts), questions.select(F.col("id").alias("qid"), question_terms.alias("terms")), expected, near if near is None else rows(near))
    asked = questions.select(F.col("id").alias("qid")).crossJoin(F.broadcast(kinds))  # a few strategies
    found = asked.join(ranks.withColumnRenamed("tenant", "strategy"), ["strategy", "qid"], "left")
    hits = {f"hit_{k}": F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double") for k in (1, 5)}
    return found.groupBy("strategy").agg(F.count("*").alias("n"), *(F.avg(c).alias(name) for name, c in hits.items()), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def by_category(scores: DataFrame, category: str, *values: Column) -> DataFrame:
    """Aggregates per category and, with a null category, over all questions."""
    return scores.groupingSets([[F.col(category)], []], F.col(category)).agg(*values)


def mean_of(flag: Column) -> Column:
    """Share of true; 0 for no rows. Serves faithfulness (claims supported) and citation accuracy (citations that hold)."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def refusal_correctness(rows: DataFrame, expected: str = "expected_behaviour", refused: str = "system_refused") -> DataFrame:
    """One row: correct_refusal_rate, false_refusal_rate, n_should_refuse, n_should_answer; raises when it runs over no rows."""
    should, other, did = F.col(expected) == "refuse", F.col(expected) == "answer", F.col(refused)
    n, m = F.count_if(should), F.count_if(other)
    rate = lambda cond, of: F.coalesce(F.try_divide(F.count_if(cond & did), of), F.lit(0.0))
    out = rows.agg(rate(should, n).alias("correct_refusal_rate"), rate(other, m).alias("false_refusal_rate"), n.alias("n_should_refuse"), m.alias("n_should_answer"), F.count("*").alias("_n"))
    return _not_empty(out)


def _not_empty(out: DataFrame) -> DataFrame:
    """Fails while it runs if _n is 0."""
    first, *rest = [c for c in out.columns if c != "_n"]
    return out.select(F.when(F.col("_n") > 0, F.col(first)).otherwise(F.raise_error(F.lit("no rows to measure"))).alias(first), *rest)


def stage_percentiles(stages: DataFrame, query: str = "query_id", stage: str = "stage", ms: str = "ms", ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """stage, n, p50, p95: of each stage over the queries that have it, and with a null stage of their sums, end to end."""
    ends = stages.groupBy(query).agg(F.sum(ms).alias("_v")).select(F.lit(None).cast("string").alias(stage), "_v")
    return ranked_percentiles(stages.select(F.col(stage), F.col(ms).alias("_v")).unionByName(ends), stage, "_v", ps)


def ranked_percentiles(rows: DataFrame, group: str, value: str, ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """group, n, p50, p95: values at the nearest ranks, exactly, for groups of any size (see selection)."""
    return at_ranks(rows, group, value, {f"p{round(p * 100)}": nearest_rank(p) for p in ps})


def cost_per_query(rows: DataFrame, *parts: str) -> DataFrame:
    """One row: usd_per_query, the mean of the parts' sums, and median_usd_per_query; raises when it runs over no rows."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    sums = rows.select(total.alias("_v"))
    half = at_ranks(sums, None, "_v", {"a": middle(True), "b": middle(False)}).agg(F.first((F.col("a") + F.col("b")) / 2).alias("median_usd_per_query"))
    mean = sums.agg(F.avg("_v").alias("usd_per_query"), F.count("*").alias("_n"))
    return _not_empty(mean.join(half, how="cross"))  # a row each


def latency_sample(rows: DataFrame, order: str, ms: str, warm_up: int = 30, keep: int = 300) -> DataFrame:
    """One row over the samples after the warm-up, in order: n, median, p95 (floor form), mean, min, max, to one place."""
    from pyspark.sql.window import Window

    # A benchmark's samples are few (warm_up + keep), so one ordered window holds them.
    top = rows.orderBy(order).limit(warm_up + keep)
    kept = top.withColumn("_i", F.row_number().over(Window.orderBy(order))).where(F.col("_i") > warm_up)
    a = F.array_sort(F.collect_list(ms))
    out = kept.agg(F.count("*").alias("n"), F.median(ms).alias("median"), floor_rank(a, 0.95).alias("p95"), F.avg(ms).alias("mean"), F.min(ms).alias("min"), F.max(ms).alias("max"))
    return out.select("n", *(F.bround(c, 1).alias(c) for c in out.columns[1:]))


def throughput(rows: int, seconds: float) -> float:
    """Rows a second; 0 if no time passed."""
    return rows / seconds if seconds > 0 else 0.0


def first_seen_groups(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """rows with `first`, the least order of their group, sorted so that groups come in the order of their first rows."""
    least = rows.groupBy(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys))).agg(F.min(order).alias("first"))
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    return rows.join(least, same).select(*rows.columns, "first").orderBy("first", *keys, order)


def unknown_expected(expected: DataFrame, known: DataFrame) -> DataFrame:
    """qid, id: expected ids that the corpus lacks; none, if a question set is sound."""
    return expected.select("qid", "id").distinct().join(known.select("id"), "id", "left_anti").select("qid", "id")


def recall_recovers(probes: DataFrame, returned: str = "rows_returned", used_index: str = "used_index") -> DataFrame:
    """One row: recovered - more candidates returned more rows, all of them through the index."""
    return probes.agg(((F.max(returned) > F.min(returned)) & F.every(used_index)).alias("recovered"), F.min(returned).alias("least"), F.max(returned).alias("most"))


def trap_tally(traps: DataFrame, top: DataFrame) -> DataFrame:
    """One row: traps, answered - traps whose own tenant has a first match (top: qid, id)."""
    seen = traps.select("qid").join(top.select("qid", "id"), "qid", "left")
    return seen.agg(F.count("*").alias("traps"), F.count_if(F.col("id").isNotNull()).alias("answered"))


def derived_truth(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, id: chunks of a question's documents whose text holds one of its phrases.

    questions: qid, documents (array), phrases (array); chunks: document, id, content. Questions without any are left out.
    """
    asked = questions.select("qid", "phrases", F.explode("documents").alias("document"))
    return asked.join(chunks, "document").where(F.exists("phrases", lambda p: F.contains(F.col("content"), p))).select("qid", "id").distinct()
