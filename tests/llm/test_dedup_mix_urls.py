import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cordon.llm import components, exact_dedup, mixing, url_filter


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_classes(docs, odd):
    random.seed(3)
    texts = odd + [random.choice(["one  two", "one two", "unique %d"]) .replace("%d", str(i)) for i in range(300)]
    got = {r["_key"]: r for r in exact_dedup.classes(docs(texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())


def test_tiny_filter_and_repeated_rows(docs):
    texts = [f"t{i % 40}" for i in range(400)]
    frame = docs(texts + ["t0"], ids=[*range(400), 0])
    rows = exact_dedup.classes(frame, filter_bits=1).collect()
    assert sum(r["kept"] for r in rows) == 40 and {r["keep_id"] for r in rows} == set(range(40))
    assert sum(r["kept"] for r in rows if r["_key"] == 0) == 1
    out = exact_dedup.dedup(frame, filter_bits=1)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(40)) and out.columns == frame.columns


def test_null_ids_and_empty(docs, odd):
    frame = docs(["a", "a", "b"], ids=[None, 5, None])
    rows = exact_dedup.classes(frame).collect()
    assert sorted((r["keep_id"] is None, r["keep_id"] or 0, r["kept"]) for r in rows) == [(False, 5, False), (False, 5, True), (True, 0, True)]
    assert sorted(r["text"] for r in exact_dedup.dedup(frame).collect()) == ["a", "b"]
    assert exact_dedup.classes(frame.limit(0)).count() == 0 == exact_dedup.dedup(frame.limit(0)).count()
    got = exact_dedup.dedup(docs(odd)).collect()
    assert len(got) == 5  # two are empty, one is blanks, three are equal


def test_native_plan(docs):
    plan = exact_dedup.classes(docs(["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_targets():
    assert mixing.targets([100, 100, 100], (3, 1, 2)) == pytest.approx([200, 250 / 3, 500 / 3])
    assert sum(mixing.targets([10, 1000, 3, 0], (3, 1, 2, 3))) == pytest.approx(1.5 * 1013)
    assert mixing.targets([], ()) == [] and mixing.targets([0], (3,)) == [0]


def test_mix(docs, odd):
    random.seed(5)
    texts = odd + [" ".join(["w"] * random.choice([1, 5, 40, 700])) for _ in range(250)] + [" ".join(["long"] * 30_000)]
    source = [random.choice(["b", "é", "a", None, "B"]) for _ in texts]
    frame = docs(texts, source=source)
    mix = mixing.Mix(frame, block_words=64, shard_words=1024, bucket_rows=20)
    rows = mix.taken().collect()
    size = [len(norm(t).split()) for t in texts]
    by = defaultdict(int)
    for s, n in zip(source, size):
        by[s] += n
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, mixing.targets([by[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))])))
    taken = defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        i = r["_key"]
        assert (r["_size"], r["source_size"]) == (size[i], by[source[i]]) and r["target"] == pytest.approx(want[source[i]]) and 0 <= r["taken"] <= 2 * size[i]
        taken[source[i]] += r["taken"]
    assert {s: round(want[s]) for s in want} == taken
    again = {r["_key"]: r["taken"] for r in mixing.Mix(frame.repartition(5), block_words=64, shard_words=1024, bucket_rows=20).taken().collect()}
    assert again == {r["_key"]: r["taken"] for r in rows}
    places = mix.place()
    blocks = places.select("shard", "_sid", "_seq").distinct().groupBy("shard").count().collect()
    assert sum(r["count"] for r in blocks) == sum(mix.quota) and len(blocks) == 2**mix.depth and max(r["count"] for r in blocks) - min(r["count"] for r in blocks) <= 1
    assert places.groupBy("_rid", "epoch", "block").count().where("count > 1").count() == 0
    out = mixing.mixed(frame, block_words=64, shard_words=1024, bucket_rows=20).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(taken.values())
    assert mixing.Mix(frame.limit(0)).taken().count() == 0 == mixing.mixed(frame.limit(0)).count()


def test_mix_repeated_rows(docs):
    frame = docs(["a b c", "a b c", "d e", "d e"], ids=[1, 1, 2, None], source=["x", "x", "y", "y"])
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in mixing.Mix(frame).taken().collect()) == 15


def test_halves():
    import numpy as np

    rng = np.random.default_rng(1)
    for quota in ([5, 0, 7], [1], [0, 0], [3_000_000_000, 10, 5_000_000_000]):
        q = np.array(quota, np.int64)
        left = mixing._halves(q, int(q.sum()) // 2, rng)
        assert left.sum() == q.sum() // 2 and (left >= 0).all() and (left <= q).all()


def test_draws_beyond_the_range_of_numpy():
    """Means and variances of the hypergeometric law, below and above 10**9 blocks alike."""
    import numpy as np

    rng = np.random.default_rng(3)
    for good, bad, n in ((300, 700, 400), (3 * 10**9, 10**9, 10**7), (40, 5 * 10**11, 10**11), (5 * 10**11, 40, 10**11), (2 * 10**9, 1, 10**9)):
        total = good + bad
        mean, var = n * good / total, n * good / total * bad / total * (total - n) / (total - 1)
        x = np.array([mixing._drawn(good, bad, n, rng) for _ in range(300)], float) - mean
        assert abs(x.mean()) < 4.5 * (var / 300) ** 0.5 + 1e-9 and 0.7 * var < x.var() < 1.35 * var + 1e-9
    assert mixing._drawn(5, 0, 3, rng) == 3 and mixing._drawn(0, 5, 3, rng) == 0 and mixing._drawn(10**10, 10**10, 0, rng) == 0
    # The inversion itself against exact probabilities, on a population that both can do.
    small = np.bincount([int(mixing._inverted(6, 9, 7, rng)) for _ in range(4000)], minlength=7)
    from math import comb

    exact = np.array([comb(6, k) * comb(9, 7 - k) / comb(15, 7) for k in range(7)])
    assert ((small - 4000 * exact) ** 2 / (4000 * exact)).sum() < 25


def test_mix_orders_equal_ids_by_text(docs):
    texts = [" ".join(["w"] * (i % 9 + 1)) + f" x{i}" for i in range(120)]
    frame = docs(texts, ids=[1] * 60 + [None] * 60, source=["a", "b"] * 60)
    runs = lambda f: sorted((r["text"]) for r in mixing.mixed(f, block_words=16, shard_words=64, bucket_rows=10).collect())
    assert runs(frame) == runs(frame.repartition(7))


def test_components(spark):
    random.seed(2)
    for n, links in ((40, 30), (200, 190), (60, 0)):
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(links)] + [(1, 1), (None, 2)] + [(i, i + 1) for i in range(n, n + 50)]
        root = {}

        def find(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] and None not in e for e in edges)}


def test_urls(spark):
    page = lambda *tags: "<html><head>" + "".join(tags) + "</head></html>"
    canon, refresh = '<link data-x="1" rel="canonical" href="{}">', "<META HTTP-EQUIV=refresh content='0; URL={}'>"
    rows = [
        (1, "http://A.Example.ORG/es/1?x#y", None),
        (2, "https://alias.net/x", page(canon.format("http://example.org/en/12?q=1"))),
        (3, "https://second.net/y", page(refresh.format("//alias.net/x"))),
        (4, "https://good.org/z", page(canon.format("http://example.org/en/12"))),
        (5, "https://lone.net", ""),
        (6, None, "<p>"),
        (7, "no scheme", page(canon.format("http://example.org/en/12"))),
        (8, "https://x.com/fr/1", None),
        (9, "https://x.com/de/1", None),
        (10, "https://notorg/1", None),
        (11, "http://second.net/a/b", page(canon.format("../y"), refresh.format("/y"))),
        (11, "http://second.net/a/b", page(canon.format("../y"), refresh.format("/y"))),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    out = url_filter.judge(frame)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("alias.net", "/x", None, "block"), 3: ("second.net", "/y", None, "block"), 4: ("good.org", "/z", "org/", "allow"),
        5: ("lone.net", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("x.com", "/fr/1", "com/fr/", "allow"), 9: ("x.com", "/de/1", "com/de/", "block"), 10: ("notorg", "/1", None, "allow"),
        11: ("second.net", "/a/b", None, "block"),
    }
    assert url_filter.judge(frame.limit(0)).count() == 0
    assert "Python" not in url_filter.judge(frame).select(F.col("verdict"))._jdf.queryExecution().toString()


def test_urls_with_clashing_columns(spark):
    to = "<meta http-equiv=refresh content='0; url=http://example.org/en/1'>"
    names = ["_caught", "_verdict", "_rule", "_host", "_path", "_name", "_key", "verdict", "Host", "c_0"]
    frame = spark.createDataFrame([(1, "http://r.net/x", to, *names), (2, None, None, *names)], ["page_id", "url", "html", *names])
    out = url_filter.judge(frame)
    assert out.columns == ["page_id", "url", "html", "_caught", "_verdict", "_rule", "_host", "_path", "_name", "_key", "c_0", "host", "path", "rule", "verdict"]
    rows = sorted(out.collect())
    assert [(r["page_id"], r["verdict"], r["host"]) for r in rows] == [(1, "block", "r.net"), (2, "allow", "")] and all(r[n] == n for r in rows for n in names if n not in ("verdict", "Host"))


def test_giant_component(spark):
    """A hub with most of the links, and chains that hang on it."""
    links = [(0, i) for i in range(1, 3000)] + [(i, 10_000 + i) for i in range(1, 500)] + [(20_000, 20_001)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert len(got) == 3000 + 499 + 2 and {got[x] for x in got if x < 20_000} == {0} and got[20_001] == 20_000


def test_urls_that_differ_in_the_query(spark):
    to = "<meta http-equiv=refresh content='0; url={}'>"
    rows = [
        (1, "http://r.net/out?u=1", to.format("http://example.org/en/1x")),
        (2, "http://r.net/out?u=2#a?u=1", to.format("http://clean.net/a")),
        (3, "http://clean.net/a", None),
        (4, "http://r.net/out", None),
        (5, "https://r.net/out?u=1#part", None),
        (6, "http://r.net?u=3", to.format("http://example.org/en/1x?/fr/")),
        (7, "http://r.net/?u=3", None),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(frame).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block"}
