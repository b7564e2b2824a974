import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cordon.llm import ann, fm_index, jaccard_join, substring_dedup

WORDS = [f"w{i}" for i in range(60)]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_removed(texts, window):
    words = [split(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeated_texts():
    random.seed(8)
    text = lambda n: " ".join(random.choices(WORDS, k=n))
    passage, line = text(50), text(20)
    texts = [text(random.randint(0, 80)) for _ in range(40)]
    texts += [f"{text(9)}\n{passage}\t{text(5)}" for _ in range(6)] + [f"{text(random.randint(20, 40))} {line} {text(30)}" for _ in range(60)]
    texts += [texts[3] + " tail", "x y " * 60, "a " * 100, text(40)] + [text(45)] * 5
    return texts + [None, "", " \n ", text(3000) + " " + passage]


@pytest.mark.parametrize("split_above", [4096, 5])
def test_substring_dedup(docs, split_above):
    texts = repeated_texts()
    want = brute_removed(texts, 35)
    frame = docs(texts)
    rows = {r["_key"]: r for r in substring_dedup.without_repeats(frame, split_above=split_above, shard_words=2000).collect()}
    assert [(rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept"]) for i in range(len(texts))] == want
    sums = {r["_key"]: r["kept"] for r in substring_dedup.without_repeats(frame, digests=True).collect()}
    assert all(sums[i] == hashlib.sha256(w[2].encode()).hexdigest() for i, w in enumerate(want))


def test_substring_dedup_edges(docs):
    text = " ".join(map(str, range(50)))
    rows = substring_dedup.without_repeats(docs([text, text, "short"], ids=[7, 7, None])).collect()
    assert sorted((r["_key"] or 0, r["n_removed"]) for r in rows) == [(0, 0), (7, 50), (7, 50)]
    assert substring_dedup.without_repeats(docs(["a"]).limit(0)).count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 4, rng.integers(1, 60)) for _ in range(40)]
    weights = rng.integers(1, 4, 40)
    other = [rng.integers(1, 6, 50) for _ in range(10)]
    for depth in (2, 5, 9):
        count = Counter()
        for t, w in zip(texts, weights.tolist()):
            for i in range(len(t) - depth + 1):
                count[tuple(t[i : i + depth])] += w
        index = fm_index.FmIndex(texts, weights, depth)
        for t, found in zip(texts + other, index.matches(texts + other)):
            assert found.tolist() == [count[tuple(t[i : i + depth])] for i in range(len(t) - depth + 1)]


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = split((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in by[g] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts():
    random.seed(12)
    texts = []
    for size in (3, 4, 8, 11, 12, 13, 19, 30, 47, 80, 200):
        for _ in range(4):
            base = random.choices(WORDS, k=size)
            texts.append(" ".join(base))
            for _ in range(6):
                w = list(base)
                for _ in range(random.randint(0, max(1, size // 25))):
                    k = random.randrange(len(w))
                    w[k : k + random.randint(0, 1)] = random.choices(WORDS, k=random.randint(0, 2))
                texts.append(" ".join(w).upper() if random.random() < 0.2 else "\n".join(w))
    return texts + [None, "", "one", "ONE", "one two", " ", texts[5], texts[5]]


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(docs, n, percent):
    texts = near_texts()
    want = brute_components(texts, n, percent)
    rows = {r["_key"]: r for r in jaccard_join.near_components(docs(texts), n, percent).collect()}
    got = [(rows[i]["n_shingles"], rows[i]["component_id"]) for i in range(len(texts))]
    assert got == want and sum(c != i for i, (_, c) in enumerate(want)) > 30


def test_keys_find_all_links():
    """Any two sets that link share a key, whatever their sizes and empty fragments."""
    rng = np.random.default_rng(3)
    for percent in (90, 80):
        for _ in range(400):
            common = rng.integers(0, 1 << 63, rng.integers(4, 120), dtype=np.uint64)
            most = len(common) * (100 - percent) // percent
            a = int(rng.integers(0, most + 1))
            x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (a, most - a))
            if len(np.intersect1d(x, y)) * 100 >= percent * len(np.union1d(x, y)) and len(x) != len(common) + a + 1:
                if np.array_equal(x, y):
                    continue
                kx, ky = ({side: (need, keys) for side, need, keys in jaccard_join.keys_of(s, percent)} for s in (x, y))
                shared = [(len(np.intersect1d(kx[s][1], ky[s][1])), min(kx[s][0], ky[s][0])) for s in kx if s in ky]
                assert any(n >= max(1, need) for n, need in shared)


def test_jaccard_edges(docs):
    rows = jaccard_join.near_components(docs(["a b c d", "A b\tc d", "x", None], ids=[None, 9, 4, 4])).collect()
    assert sorted((r["_key"] or 0, r["n_shingles"], r["component_id"]) for r in rows) == [(0, 2, 9), (4, 0, 4), (4, 1, 4), (9, 2, 9)]
    assert jaccard_join.near_components(docs(["a"]).limit(0)).count() == 0


def brute_nearest(x, ids, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            score = (x * q).sum(1)
            order = sorted(((-s, j) for s, j in zip(score, ids) if j != i))[:k]
            out[i] = [(j, -s) for s, j in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 32))
    x = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.standard_normal((3000, 32))) * rng.uniform(0.5, 2, (3000, 1))
    x[100:900] = x[100]  # one vector has many copies
    x = x.astype(np.float32).astype(np.float64)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(5000, None, ""), (5020, [0.0] * 32, ""), (5040, [float("nan")] * 32, ""), (5060, [1.0] * 3, ""), (5080, [None] + [1.0] * 31, ""), (None, x[0].tolist(), "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = defaultdict(list)
    for r in ann.neighbours(frame, cell=256).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest(x, range(3000), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for i, found in got.items():
        assert [s for _, s in found] == pytest.approx([float((x[i] * x[j]).sum()) for j, _ in found], abs=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert [j for j, _ in got[120]] == [j for j, _ in want[120]]


LENGTHS = {"constant": (0.0, False), "log-normal 0.5": (0.5, False), "log-normal 1": (1.0, False), "clustered, log-normal 1": (1.0, True)}


@pytest.mark.parametrize("kind", LENGTHS)
def test_recall_of_differing_lengths(spark, kind):
    sigma, clustered = LENGTHS[kind]
    rng = np.random.default_rng(11)
    x = rng.standard_normal((6000, 32))
    if clustered:
        x = 0.4 * x + rng.standard_normal((30, 32))[rng.integers(0, 30, 6000)]
    x *= (np.exp(sigma * rng.standard_normal(6000)) / np.linalg.norm(x, axis=1))[:, None]
    x = x.astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(set)
    for r in ann.neighbours(frame, lists=48, portion=100).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = brute_nearest(x, range(6000), 20)
    assert all(len(v) == 20 for v in got.values()) and len(got) == 300
    assert sum(len(got[i] & {j for j, _ in want[i]}) for i in want) / sum(map(len, want.values())) >= 0.95


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8)).astype(np.float32).astype(np.float64)
    x[60] = x[20]  # an equal vector of another id
    ids = [*range(200)]
    ids[30] = ids[31] = 20  # three rows have the id 20
    ids[40] = None
    x[31] = x[30]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    got = defaultdict(list)
    for r in ann.neighbours(frame).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    want = defaultdict(list)
    for a in range(200):
        if ids[a] is not None and ids[a] % 20 == 0:
            best = sorted((-float((x[a] * x[b]).sum()), ids[b]) for b in range(200) if b != a and ids[b] is not None)[:20]
            want[ids[a]] += [(k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(best)]
    assert len(got[20]) == 60 and {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}


def test_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.neighbours(frame).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
    assert ann.neighbours(frame.limit(0)).count() == 0 == ann.neighbours(frame.where("vec_id = 0").select("vec_id", F.array(F.lit(0.0), F.lit(0.0)).alias("embedding"))).count()
