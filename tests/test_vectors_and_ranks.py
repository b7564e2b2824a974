import math
import random

import numpy as np
import pytest

from cordon.operators import metrics, vector
from cordon.operators.selection import at_ranks, nearest_rank


def test_ranks(spark):
    random.seed(1)
    rows = [("a", random.lognormvariate(0, 8) * random.choice([-1, 1])) for _ in range(5000)] + [(None, float(i % 7)) for i in range(500)] + [("one", 3.0), ("none", None)]
    rows += [("odd", x) for x in (math.inf, -math.inf, math.nan, 1.0, 1e308, -1e308, None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: tuple(r)[1:] for r in at_ranks(frame, "g", "v", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95), "first": lambda n: n * 0, "last": lambda n: n - 1}).collect()}
    for g in ("a", None, "one", "odd"):
        v = sorted((x for k, x in rows if k == g and x is not None), key=lambda x: (math.isnan(x), 0 if math.isnan(x) else x))
        n = len(v)
        assert str(got[g]) == str((n, v[round(0.5 * (n - 1))], v[round(0.95 * (n - 1))], v[0], v[-1]))
    assert set(got) == {"a", None, "one", "odd"} and at_ranks(frame.limit(0), None, "v", {"m": nearest_rank(0.5)}).count() == 0


def test_median_cost(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (4.0, 4.0), (0.5, 0.5), (10.0, 0.0)], "a double, b double")
    assert tuple(metrics.cost_per_query(frame, "a", "b").first()) == (5.5, 5.5)
    with pytest.raises(Exception, match="no rows"):
        metrics.cost_per_query(frame.limit(0), "a", "b").collect()


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
@pytest.mark.parametrize("k", [1, 5])
def test_top_k_each(spark, broadcast, k):
    rng = np.random.default_rng(0)
    vec = lambda: rng.integers(-2, 3, 4).astype(float).tolist()
    rows = [(i, "t" if i % 3 else "u", vec()) for i in range(300)] + [(900, "t", None), (901, "t", [0.0] * 4), (902, "t", [1.0]), (903, None, [1.0] * 4), (904, "t", [None, 1.0, 1.0, 1.0])]
    queries = [(i, "t" if i % 2 else "u", vec()) for i in range(20)] + [(50, "t", [0.0] * 4), (51, "t", None), (52, "zz", [1.0] * 4), (53, "t", [1.0, 2.0])]
    want = []
    for q, t, v in queries:
        found = []
        for i, u, w in rows:
            if u == t:
                d = None
                if v and w and len(v) == len(w) and None not in w and any(w) and any(v):
                    d = 1 - np.dot(v, w) / (math.sqrt(np.dot(v, v)) * math.sqrt(np.dot(w, w)))
                found.append((d is None, round(d or 0, 9), i))
        want += [(q, i, None if none else d + 0, rank + 1) for rank, (none, d, i) in enumerate(sorted(found)[:k])]
    r, q = spark.createDataFrame(rows, "id long, tenant_id string, embedding array<double>").repartition(3), spark.createDataFrame(queries, "qid long, tenant_id string, embedding array<double>")
    out = vector.top_k_each(r, q, k, broadcast=broadcast)
    got = [(x["qid"], x["id"], None if x["distance"] is None else round(x["distance"], 9) + 0, x["rank"]) for x in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert vector.top_k_each(r.limit(0), q, k, broadcast=broadcast).count() == 0 == vector.top_k_each(r, q.limit(0), k, broadcast=broadcast).count()
