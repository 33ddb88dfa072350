"""Fetching from a local server, JSON files, the stream and the job runner."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quarry.operators import index, search
from quarry.plans import jobs
from quarry.sources import http
from quarry.sources import records as R
from quarry.streaming import ingest


@pytest.fixture
def server():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append(self.path)
            code = 503 if self.path == "/busy" and calls.count("/busy") < 3 else 404 if self.path == "/gone" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write("<h1>é</h1>".encode())

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", calls
    s.shutdown()


LIMITS = {"min_interval": 0.01, "jitter": (0.0, 0.01), "backoff": 0.01}


def test_fetcher(server):
    base, calls = server
    f = http.Fetcher(**LIMITS)
    assert f.get(base + "/a") == "<h1>é</h1>" and f.get(base + "/gone") is None and calls.count("/gone") == 1
    assert f.get(base + "/busy") == "<h1>é</h1>" and calls.count("/busy") == 3
    assert f.get(None) is None and f.get("http://127.0.0.1:9/x") is None


def test_fetch(spark, server):
    base, _ = server
    frontier = spark.createDataFrame([(base + "/a", "1"), (base + "/gone", "2")], "url string, id string")
    got = http.fetch(frontier, sub_pages=False, **LIMITS).collect()
    assert [(r["url"], r["html"], r["reviews_html"]) for r in got] == [(base + "/a", "<h1>é</h1>", None)]


RECORDS = [{"id": f"tt000000{i}", "title": t, "summaries": [t, "more words"], "genres": ["drama"], "stars": ["ann bee"]} for i, t in enumerate(["star wars", "star trek", "war and peace", "quiet town"])]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("a", None, ["x"])], "id string, title string, stars array<string>")
    R.write_json(df, str(tmp_path / "j"))
    assert R.read_json(spark, str(tmp_path / "j"), "id string, title string, stars array<string>").collect() == df.collect()
    assert R.read_json(spark, str(tmp_path / "none")).count() == 0
    assert len(R.empty_record(spark).columns) == 18
    (tmp_path / "t.json").write_text(json.dumps({"d1": {"title": ["a", "b"], "stars": []}}))
    assert sorted(tuple(r) for r in R.read_tokens_json(spark, str(tmp_path / "t.json")).collect()) == [("d1", "stars", []), ("d1", "title", ["a", "b"])]


def test_jobs(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([*RECORDS, {"id": ""}, 3]))
    target = str(tmp_path / "index")
    assert jobs.build(spark, str(tmp_path / "r.json"), target) and not jobs.build(spark, str(tmp_path / "r.json"), target)
    tables = R.read_index(spark, target)
    assert [r["doc_id"] for r in jobs.run_query(spark, tables, "title:2 star treek").orderBy("rank").collect()][:1] == ["tt0000001"]
    got = jobs.grade(spark, tables, [("star trek", ["tt0000001"]), ("peace", ["tt0000002", "tt0000009"])])
    assert got["mrr"] == 1.0 and got["precision_at_5"] == pytest.approx(0.2) and got["recall_at_5"] == pytest.approx(0.75) and got["n_queries"] == 2


def test_grading(spark, tmp_path):
    source = str(tmp_path / "r.json")
    (tmp_path / "r.json").write_text(json.dumps(RECORDS))
    said = []
    judged = [("star trek", ["tt0000001"]), ("quiet", ["tt0000003"])]
    assert jobs.grade_all(spark, source, str(tmp_path / "w"), judged, min_count=4, say=said.append)
    assert said[-1] == "PASS" and sum(x.startswith("ok") for x in said) == 5 and not jobs.preprocess(spark, source, str(tmp_path / "w/tokens"))
    assert not jobs.grade_all(spark, source, str(tmp_path / "w"), [("star", ["none"])], min_count=5, say=said.append)
    assert said[-1] == "FAIL" and any("4 records, 5 expected" in x for x in said) and any("neither" in x for x in said)
    assert not jobs.grade_all(spark, str(tmp_path / "none.json"), str(tmp_path / "v"), [], say=said.append)  # each stage fails on its own


def test_commands(spark, tmp_path, capsys):
    source, target = str(tmp_path / "r.json"), str(tmp_path / "i")
    (tmp_path / "r.json").write_text(json.dumps(RECORDS))
    (tmp_path / "judged.json").write_text(json.dumps([["star trek", ["tt0000001"]]]))
    assert jobs.main(["build", source, target]) == 0 and jobs.main(["preprocess", source, str(tmp_path / "t")]) == 0
    assert jobs.main(["search", target, "star trek", "--k", "2"]) == 0 and "tt0000001" in capsys.readouterr().out
    assert jobs.main(["validate", source]) == 1 and "Missing fields" in capsys.readouterr().out
    assert jobs.main(["grade", source, str(tmp_path / "w"), "--judged", str(tmp_path / "judged.json"), "--min-count", "1"]) == 0
    with pytest.raises(SystemExit):
        jobs.main(["nothing"])


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i, r in enumerate(RECORDS):
        (source / f"{i}.json").write_text(json.dumps(r | {"seq": i}) + "\n")
    ingest.start(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    posted = index.postings(got)
    assert got.count() == 36 and {r["term"] for r in posted.collect()} >= {"star", "war", "peace", "quiet"}
    assert search.K1 == 1.2
