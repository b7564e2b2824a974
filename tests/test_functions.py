import pytest
from pyspark.sql import functions as F

from cordon.functions import analyzer, scalar


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_stems():
    want = {"running": "run", "flies": "fli", "generously": "generous", "national": "nation", "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "dying": "die", "happy": "happi", "agreed": "agre", "succeeds": "succeed", "caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "knightly": "knight", "communication": "communic", "arsenal": "arsenal", "controlling": "control", "by": "by", "say": "say", "surcharges": "surcharg"}
    assert {w: analyzer.stem(w) for w in want} == want


def test_terms():
    assert analyzer.terms("The cats, and a cat's ROOF") == {"cat": [2, 5], "roof": [6]}
    assert analyzer.terms(None) == {} == analyzer.terms("the")


def test_sentences(spark):
    f = lambda t: one(spark, scalar.sentences(F.lit(t)))[0]
    assert f(" One.  Two! Three") == ["One.", "Two!", "Three"] and f("") == [""] and f("a.b c") == ["a.b c"]


def test_windows_and_paths(spark):
    f = lambda t, n: one(spark, scalar.char_windows(F.lit(t), n))[0]
    assert f("", 4) == [""] and f("abcd", 4) == ["abcd"] and f("abcde", 4) == ["abcd", "e"] and f("éü🙂ab", 2) == ["éü", "🙂a", "b"]
    path = lambda *p: one(spark, scalar.with_path(F.lit("x"), F.array(*map(F.lit, p)).cast("array<string>")))[0]
    assert path() == "x" and path("A", "B") == "A > B\n\nx"


def test_percentiles(spark):
    a = F.array(*(F.lit(float(i)) for i in range(1, 301)))
    assert tuple(one(spark, scalar.nearest_rank(a, 0.95), scalar.floor_rank(a, 0.95))) == (285.0, 286.0)
    half = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))
    assert one(spark, scalar.nearest_rank(half, 0.5))[0] == 3.0  # 1.5 rounds to the even 2
    assert one(spark, scalar.nearest_rank(F.array().cast("array<double>"), 0.5))[0] is None


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    assert one(spark, scalar.cosine_distance(v(1, 0), v(0, 2)))[0] == 1.0
    assert one(spark, scalar.cosine_distance(v(0, 0), v(0, 2)))[0] is None
    assert one(spark, scalar.cosine_distance(v(1), v(0, 2)))[0] is None


def test_claims(spark):
    f = lambda c: one(spark, scalar.claim_tenant(F.lit(c).cast("string")))[0]
    assert f('{"tenant_id": "a"}') == "a" and f("{}") is None and f(None) is None
    for bad in ("", "nonsense"):
        with pytest.raises(Exception, match="MALFORMED|parse|JSON"):
            f(bad)


def test_metadata(spark):
    lines = F.array(*map(F.lit, ["A: 1", "no pair", "B:  2", "A: 3"]))
    assert one(spark, scalar.metadata_map(lines))[0] == {"A": "3", "B": "2"}
    assert one(spark, scalar.metadata_suffix(scalar.metadata_map(lines)))[0] == "A: 3 | B: 2"
