import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from cordon.llm import mixing
from cordon.llm.queries import definition
from cordon.llm.store import written

from .test_joins import brute_components


def test_stages_against_brute_force(spark, docs, odd):
    from tokenizers import Tokenizer

    random.seed(4)
    en, de = "the of and to in is was for that with".split(), "der die und das ist nicht mit von auf ein".split()
    texts, lang = list(odd), ["en"] * len(odd)
    for i in range(120):
        pool = (en, de)[i % 2]
        texts.append(" ".join(random.choice(pool) + random.choice(["", "x", "e", "er"]) for _ in range(random.randint(30, 90))))
        lang.append(("en", "de")[i % 2])
    texts += [texts[20], texts[20] + " more", "12 34", texts[21].replace(" ", "\n")]
    lang += ["en"] * 4
    source = [random.choice("abc") for _ in texts]
    frame = docs(texts, lang=lang, source=source)
    cols = frame.columns
    left = {i: t for i, t in enumerate(texts)}
    now = frame
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, ""), "test")
        rows = now.collect()
        if name != "tokens":
            assert now.columns == cols and [f.dataType for f in now.schema] == [f.dataType for f in frame.schema]
        if name == "language":
            left = {i: t for i, t in left.items() if t and re.search(r"[^\W\d_]", t)}
        elif name == "exact":
            first = {}
            for i in sorted(left):
                first.setdefault(re.sub(r"\s+", " ", left[i]), i)
            left = {i: left[i] for i in first.values()}
        elif name == "near":
            ids = sorted(left)
            comp = brute_components([left[i] for i in ids], 5, 80)
            left = {i: left[i] for k, i in enumerate(ids) if comp[k][1] == k}
        if name in ("language", "exact", "near"):
            assert {r["doc_id"]: r["text"] for r in rows} == left and len(rows) == len(left)
        elif name == "mix":
            size, by = {i: len(t.split()) for i, t in left.items()}, defaultdict(int)
            for i in left:
                by[source[i]] += size[i]
            want = dict(zip(sorted(by), mixing.targets([by[s] for s in sorted(by)], [(3, 1, 2)[k % 3] for k in range(len(by))])))
            got, of = Counter(), Counter()
            for r in rows:
                got[r["source"]] += len(r["text"].split())
                of[r["doc_id"]] += len(r["text"].split())
                assert r["n_chars"] == len(r["text"])
            assert got == {s: round(w) for s, w in want.items()} and all(n <= 2 * size[i] for i, n in of.items())
            mixed = sorted((r["doc_id"], r["text"]) for r in rows)
        else:
            lib = Tokenizer.from_str(definition("byte_bpe_50k.json"))
            assert sorted((r["doc_id"], r["ids"], r["n_tokens"]) for r in rows) == sorted((i, x, len(x)) for i, t in mixed for x in [lib.encode(t).ids])


def test_run(spark, tmp_path, docs):
    docs(["hello there you", "hello there you", "123"]).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {0}
    docs(["x"]).limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_near_tells_rows_apart(spark, docs, tmp_path):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "an unrelated text that stands under the same number as another"
    more = a + " thirteen"
    frame = docs([a, more, b, a + " again", b + " too", b + " anyway", "alone"], ids=[2, 4, 4, None, None, None, 9])
    frame.write.parquet(f"{tmp_path}/d")
    for docs_ in (frame, spark.read.parquet(f"{tmp_path}/d")):
        left = sorted((r["doc_id"] or -1, r["text"]) for r in corpus_pipeline.near(spark, docs_, "").collect())
        assert left == sorted([(2, a), (4, b), (9, "alone")])
    # Two nulls and a number that is repeated: one of each group stays, whatever its number.
    frame = docs([b + " too", b, a, a, "x y"], ids=[None, None, 7, 7, 7])
    left = sorted(r["text"] for r in corpus_pipeline.near(spark, frame, "").collect())
    assert len(left) == 3 and left[-1] == "x y" and left[1] == a and left[0] in (b + " too", b)


def test_stages_with_repeated_and_null_ids(spark, docs):
    texts = ["the cat sat on the mat " * 3, "the dog lay by the door " * 3, "the cat sat on the mat " * 3, None, "", "der hund und die katze " * 4]
    frame = docs(texts, ids=[None, 1, 1, 1, None, None], lang=["en", "en", "en", None, None, "de"], source=["a", "b", None, "a", "b", None])
    now = frame
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, ""), "test")
        n = now.count()
        assert n == {"language": 4, "exact": 3, "near": 3}.get(name, n) and n >= 3
    assert now.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
