"""Places in rankings that hold almost every text for almost every question."""

import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from cordon import queries
from cordon.operators import chunking, textsearch


def shuffled(spark):
    """Rows that the stages so far have written to shuffles."""
    gate = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_scores_shuffle_no_hits(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{some(5)} q{i % 7} {some(3)}") for i in range(30)]
    docs = [(i, f"Title\n{some(40)} {rng.choice(items)[1] if i % 5 == 0 else ''} {some(20)}.") for i in range(300)] + [(300, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    before = shuffled(spark)
    out = queries.strategy_scores(spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(con.sql(queries.ORACLE_SQL["strategy_scores"]).select(", ".join(out.columns)).fetchall())
    assert 0 < got[0][4] < 1
    assert shuffled(spark) - before < 10_000 < 30 * 300 * 5  # questions, documents, strategies


def test_ranks_by_brute_force(spark):
    rng = random.Random(2)
    texts = [(t, d, p, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]) for t in (1, 2) for d in [*range(40), None] for p in range(2 if d is not None else 1)]
    asked = [(1, ["a", "b", "b"]), (2, ["c"]), (2, ["a", "d", None]), (3, ["z"]), (4, None), (None, ["a"])]
    expected = [(q, d) for q in (1, 2, 3, 4) for d in (17, 30, 31)] + [(1, None), (9, 5)]

    def rank(tenant, q):
        scores = []
        for t, d, p, terms in texts:
            tf, parts = Counter(terms), [set(x or []) - {None} for i, x in asked if i == q]
            s = sum(0.1 * sum(1 / j**2 for j in range(1, tf[x] + 1)) / 1.64493406685 / len(part) for part in parts for x in part)
            if t == tenant and s > 0:
                scores.append((-round(s, 6), d is None, d or 0, p, d))
        return next((i for i, x in enumerate(sorted(scores, key=lambda x: x[:4]), 1) if x[4] in (17, 30, 31)), None)

    want = {(t, q): r for t in (1, 2) for q in (1, 2, 3, 4) if (r := rank(t, q))}
    assert len(want) == 4 and max(want.values()) > 1
    frame = spark.createDataFrame(texts, "tenant int, document long, part int, terms array<string>").repartition(3)
    named = frame.withColumn("document", F.format_string("%03d", "document")).where("document <> 'null'")
    qs, ex = spark.createDataFrame(asked, "qid long, terms array<string>"), spark.createDataFrame(expected, "qid long, id long")
    for near in (None, frame.where("document in (17, 30, 31)")):
        assert {(r["tenant"], r["qid"]): r["rank"] for r in textsearch.best_ranks(frame, qs, ex, near).collect()} == want
    ids = ex.where("id is not null").withColumn("id", F.format_string("%03d", "id"))
    assert {(r["tenant"], r["qid"]) for r in textsearch.best_ranks(named, qs, ids).collect()} == set(want)


def test_rows_of_one_document_are_one_text(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "bb cc"), (2, "dd"), (None, "ee"), (None, "ff")], "document long, text string")
    got = queries._search_texts(docs).where("strategy = 1").collect()
    assert sorted((str(r["document"]), sorted(r["search_text"].split())) for r in got) == [("1", ["aa", "bb", "bb", "cc"]), ("2", ["dd"]), ("None", ["ee", "ff"])]


def test_phrases_of_any_form(spark):
    rows = spark.createDataFrame([(1, "a bb\nc d"), (2, "xa bb c"), (3, None), (4, "")], "id long, text string")
    asked = spark.createDataFrame([(1, "a bb c"), (2, "a"), (3, ""), (4, None), (5, "a bb\nc"), (6, "b\nc d"), (7, "a  c")], "qid long, phrase string")
    want = {(q, i) for q, phrase in [tuple(r) for r in asked.collect()] for i, t in [tuple(r) for r in rows.collect()] if None not in (phrase, t) and phrase in t}
    assert {tuple(r) for r in textsearch.holding(rows, asked).collect()} == want


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([(0, "aa bb")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.strategy_scores(spark, str(tmp_path)).collect())) == [(s, 1, 0.0, 0.0, 0.0) for s in chunking.STRATEGIES]
