"""Queries take their whole tables and texts."""

import hashlib

from cordon import queries

from .test_queries import SF, con  # noqa: F401


def test_all_questions_stemmed(spark, con):  # noqa: F811
    items = {i for (i,) in con.sql("SELECT item_id FROM benchmark").fetchall()}
    assert {r["qid"] for r in queries.text_rank_stemmed(spark, SF).collect()} == items and len(items) > 10


def test_truth_by_the_whole_text(spark, tmp_path):
    item = "x" * 60 + " the rest of the item"
    spark.createDataFrame([(0, item), (30, "other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, f"a {item} b"), (2, "x" * 60 + " another rest"), (3, "other words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(0, 1), (30, 3)}
    assert {(r["qid"], r["id"]) for r in queries._truth(spark, str(tmp_path)).collect()} == want


def test_metadata_of_all_lines_and_turns(spark, tmp_path):
    rows = [(1, t, "user", f"turn {t}\nColour: red {t}\nno pair") for t in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r["turn"], r["key"], r["value_md5"]) for r in queries.metadata_pairs(spark, str(tmp_path)).collect())
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert got == sorted(p for t in range(12) for p in ((t, "Colour", md5(f"red {t}")), (t, "Role user", md5(f"turn {t}"))))
    suffix = queries.metadata_suffixes(spark, str(tmp_path)).first()["suffix"]
    assert suffix == " | ".join(f"T{t}: user" for t in range(12))
