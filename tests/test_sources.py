"""Sources, sinks, settings, plans, streams and the smaller operators."""

import ast
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cordon.operators import chunking, fusion, metrics
from cordon.plans import inspect
from cordon.settings import Settings
from cordon.sources import embedding, files, reports
from cordon.streaming import incremental


def test_corpus_tree(spark, tmp_path):
    for name, text in {"acme/faq/a b.txt": "A\n\nx\n", "acme/rates/r.txt": "", "globex/faq/z.txt": "Zed"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "acme/faq/note.md").write_text("not a document")
    tree = files.corpus(spark, str(tmp_path))
    assert sorted(map(tuple, tree.collect())) == [("acme/faq/a b.txt", "acme", "faq", "a b", "A\n\nx\n"), ("acme/rates/r.txt", "acme", "rates", "r", ""), ("globex/faq/z.txt", "globex", "faq", "z", "Zed")]
    total = {(r["tenant"], r["category"]): r["n"] for r in files.inventory(tree).collect()}
    assert total[(None, None)] == 3 and total[("acme", None)] == 2 and total[("acme", "faq")] == 1
    keys = spark.createDataFrame([("acme/faq/a b.txt",), (f"{tmp_path}/globex/faq/z.txt",), ("missing.txt",)], "storage_key string")
    assert {r["storage_key"]: r["text"] for r in files.document_text(spark, str(tmp_path), keys).collect()} == {"acme/faq/a b.txt": "A\n\nx\n", f"{tmp_path}/globex/faq/z.txt": "Zed", "missing.txt": None}


def test_snapshots_of_a_tree(spark, tmp_path):
    tree = spark.createDataFrame([("a.txt", "old")], "relpath string, text string")
    files.save_snapshot(tree, f"{tmp_path}/s", "v1")
    files.save_snapshot(tree.withColumn("text", F.lit("new")), f"{tmp_path}/s", "v2")
    assert [files.read_snapshot(spark, f"{tmp_path}/s", v).first()["text"] for v in ("v1", "v2")] == ["old", "new"]
    with pytest.raises(Exception, match="exist"):
        files.save_snapshot(tree, f"{tmp_path}/s", "v1")


def test_json_lines(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "q1", "expected_chunks": ["a#1"], "extra": 1}\n\n{"id": "q2"}\n')
    got = files.json_lines(spark, str(tmp_path / "g.jsonl")).orderBy("id").select("id", "expected_chunks", "note").collect()
    assert [tuple(r) for r in got] == [("q1", ["a#1"], None), ("q2", None, None)]


def test_http_provider():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers["Authorization"], body["model"]))
            data = [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]
            answer = json.dumps({"data": data[::-1]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = embedding.HttpProvider(f"http://127.0.0.1:{server.server_port}/v1/", "secret", "m")
        assert provider(["a", "bbb", ""]) == [[1.0], [3.0], [0.0]] and seen == [("/v1/embeddings", "Bearer secret", "m")]
    finally:
        server.shutdown()


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# EMBED_DIM=1\nEMBED_DIM = 7\nEMBED_MODEL='m'\nUNKNOWN=x\nno value\n")
    monkeypatch.setenv("EMBED_BATCH_SIZE", "5")
    s = Settings.load(str(tmp_path / ".env"))
    assert (s.embed_dim, s.embed_model, s.embed_batch_size, s.embed_max_concurrency) == (7, "m", 5, 4)
    monkeypatch.setenv("EMBED_DIM", "9")
    assert Settings.load(str(tmp_path / ".env")).embed_dim == 9 and Settings.load(None).embed_model == Settings().embed_model


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, None), ("c\nd", 0.1234567, [1])], "name string, x double, more array<int>")
    reports.write_json(spark, f"{tmp_path}/r.json", {"rows": df, "n": 2})
    assert json.loads((tmp_path / "r.json").read_text()) == {"rows": [{"name": "a|b", "x": 1.5, "more": None}, {"name": "c\nd", "x": 0.1234567, "more": [1]}], "n": 2}
    reports.write_markdown(spark, f"{tmp_path}/r.md", "Title", {"Note": "Words.", "Table": df.select("name", "x")})
    assert (tmp_path / "r.md").read_text() == "# Title\n\n## Note\n\nWords.\n\n## Table\n\n| name | x |\n|---|---|\n| a\\|b | 1.5 |\n| c d | 0.123457 |\n"
    with pytest.raises(reports.TooLarge):
        reports.rows_of(df, 1)


def test_plans(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").where("id > 3")
    assert "Scan parquet" in inspect.leaf(df) and inspect.count_nodes(df, "Exchange") == 0 and "GreaterThan(id,3)" in inspect.scans(df)[0]["pushed"]
    with inspect.settings(spark, spark__sql__shuffle__partitions="3") as s:
        assert s.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_streams(spark, tmp_path):
    form = "id long, text string"
    path, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for ids in ([1, 2], [3]):
        spark.createDataFrame([(i, f"T{i}\n\nbody {i}") for i in ids], form).write.mode("append").parquet(path)
        incremental.chunk_stream(incremental.document_stream(spark, path, form), out, check).awaitTermination()
    assert sorted(r["content"] for r in spark.read.parquet(out).collect()) == ["body 1", "body 2", "body 3"]
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a", 2.0), ("2024-01-01 00:04:00", "a", 4.0), ("2024-01-01 00:06:00", "a", 9.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r["n"], r["mean"], r["most"]) for r in incremental.windowed_latency(events).orderBy("window").collect()] == [(2, 3.0, 4.0), (1, 9.0, 9.0)]


def test_refusals_and_states(spark):
    scores = spark.createDataFrame([(1, 0.2), (1, 0.6), (2, 0.1)], "qid int, score double")
    questions = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    assert {r["qid"]: r["refused"] for r in fusion.refusals(scores, questions, 0.5).collect()} == {1: False, 2: True, 3: True}
    rows = [(True, 1, True, False, True), (False, 1, True, True, False), (True, 0, None, None, None), (False, 0, True, False, False), (False, 2, False, False, False), (False, 2, True, None, None)]
    df = spark.createDataFrame(rows, "refused boolean, n int, ok boolean, busy boolean, bad boolean")
    got = [r[0] for r in df.coalesce(1).select(fusion.answer_state(F.col("refused"), F.col("n"), F.col("ok"), F.col("busy"), F.col("bad"))).collect()]
    assert got == ["failed", "streaming", "refused", "unsupported", "unsupported", "answered"]


def test_groups_guards_and_rates(spark):
    rows = spark.createDataFrame([(5, "b", "x"), (1, "a", None), (3, "b", "x"), (2, "a", None), (9, "c", "y")], "i int, k string, l string")
    assert [(r["k"], r["i"], r["first"]) for r in metrics.first_seen_groups(rows, "i", "k", "l").collect()] == [("a", 1, 1), ("a", 2, 1), ("b", 3, 3), ("b", 5, 3), ("c", 9, 9)]
    one = spark.createDataFrame([("d1", "x", 0), ("d2", "y", 0)], "document_id string, content string, chunk_index int")
    assert sorted(map(tuple, chunking.single_chunks(one).collect())) == [("d1", "x", 0), ("d2", "y", 0)]
    with pytest.raises(Exception, match="more than one chunk: d1"):
        chunking.single_chunks(one.union(one.limit(1).withColumn("document_id", F.lit("d1")))).collect()
    assert metrics.throughput(10, 2.0) == 5.0 and metrics.throughput(10, 0) == 0.0


def test_import_boundaries():
    """Functions know no operators, operators no queries; the rest knows nothing of cordon.llm."""
    root = Path(__file__).parent.parent / "cordon"

    def imported(path: Path) -> set[str]:
        package, out = ["cordon", *path.relative_to(root).parts[:-1]], set()
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Import):
                out |= {a.name for a in node.names}
            elif isinstance(node, ast.ImportFrom):
                base = ".".join(package[: len(package) - node.level + 1]) if node.level else ""
                name = ".".join(x for x in (base, node.module) if x)
                out |= {name, *(f"{name}.{a.name}" for a in node.names)}
        return {x for x in out if x.startswith("cordon")}

    for path in root.rglob("*.py"):
        part = path.relative_to(root).parts[0]
        found = imported(path)
        if part != "llm":
            assert not any(x.startswith("cordon.llm") for x in found), path
        if part == "functions":
            assert all(x.startswith("cordon.functions") for x in found), path
        if part in ("functions", "operators", "sources", "plans"):
            assert not any(x.startswith(("cordon.queries", "cordon.cli")) for x in found), path
