import json

import pytest

from skarn.operators import lineage
from skarn.streaming import spool

JOBS = "job_name string, inputs array<struct<namespace: string, name: string>>, outputs array<struct<namespace: string, name: string>>"


def event(i, job="j", **more):
    return {"eventType": "START", "eventTime": "2024-01-01T00:00:00.000Z", "run": {"runId": str(i)}, "job": {"namespace": "n", "name": job}, **more}


def test_ranges_meet_every_line_once(tmp_path):
    path = str(tmp_path / "s")
    lines = [b"x" * (i * 7 % 23) for i in range(60)]
    with open(path, "wb") as f:
        f.write(b"\n".join(lines) + b"\nhalf")
    for block in (1, 5, 16, 1000):
        r = spool.SpoolReader(path, block)
        end = r.latestOffset()
        assert end["bytes"] == sum(map(len, lines)) + len(lines)
        got = [v for p in r.partitions(r.initialOffset(), end) for _, v in r.read(p)]
        assert got == [x.decode() for x in lines]
        assert r.partitions(end, end) == []
        assert [p.start for p in r.partitions({"file": end["file"] + 1, "bytes": 9}, end)][0] == 0
    assert spool.complete_until(str(tmp_path / "none")) == 0


def test_forward_resumes_where_a_post_failed(spark, tmp_path):
    path, jobs = str(tmp_path / "s.jsonl"), spark.createDataFrame([("j", [("d", "in")], []), ("j", None, None)], JOBS)
    for i in range(3):
        assert lineage.append_event(path, event(i, note=[1, "é"]))
    with open(path, "a") as f:
        f.write("not json\n")
    lineage.append_event(path, event(3, "k"))
    sent, down = [], [True]

    def post(e):
        if len(sent) == 2 and down[0]:
            raise RuntimeError("refused")
        sent.append(json.loads(e))

    def run():
        spool.forward(spool.tail(spark, path), jobs, post, str(tmp_path / "c"), str(tmp_path / "bad")).awaitTermination()

    with pytest.raises(Exception, match="refused"):
        run()
    down[0] = False
    run()
    assert [e["run"]["runId"] for e in sent] == ["0", "1", "2", "3"]
    assert sent[0]["inputs"] == [{"namespace": "d", "name": "in"}] and sent[0]["note"] == [1, "é"] and "outputs" not in sent[0] and "inputs" not in sent[3]
    with open(path, "a") as f:
        f.write(json.dumps(event(4, inputs=[{"namespace": "o", "name": "own"}])))
    run()
    assert len(sent) == 4  # the line isn't complete yet
    with open(path, "a") as f:
        f.write("\n")
    run()
    assert sent[4]["inputs"] == [{"namespace": "o", "name": "own"}]
    assert spark.read.json(str(tmp_path / "bad")).select("value").collect() == [("not json",)]


def test_events_and_pairs(spark):
    got = []
    assert lineage.run_traced(["true"], "n", "ok", got.append) == 0 and lineage.run_traced(["false"], "n", "bad", got.append) == 1 and lineage.run_traced(["/none/x"], "n", "gone", got.append) == 127
    assert [e["eventType"] for e in got] == ["START", "COMPLETE", "START", "FAIL", "START", "FAIL"] and "errorMessage" in got[3]["run"]["facets"]
    lines = spark.createDataFrame([(json.dumps(e),) for e in got] + [("{",), (None,)], "value string")
    typed = lineage.events_frame(lines)
    assert typed.filter("corrupt IS NOT NULL").count() == 1
    pairs = {r["job_name"]: r["state"] for r in lineage.pair_runs(typed.filter("run IS NOT NULL")).collect()}
    assert pairs == {"ok": "COMPLETE", "bad": "FAIL", "gone": "FAIL"}


def test_enrich(spark):
    runs = spark.createDataFrame([("1", "a", None, ["own"]), ("2", "a", [], None), ("3", "zzz", None, None)], "run_id string, job_name string, inputs array<string>, outputs array<string>")
    jobs = spark.createDataFrame([("a", ["i"], ["o"])], "job_name string, inputs array<string>, outputs array<string>")
    got = {r["run_id"]: (r["inputs"], r["outputs"]) for r in lineage.enrich(runs, jobs).collect()}
    assert got == {"1": (["i"], ["own"]), "2": (["i"], ["o"]), "3": (None, None)}


def test_pairs_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", "START", "2024-01-01 00:00:00"), ("1", "FAIL", "2024-01-01 01:00:00"), ("2", "START", "2024-01-01 00:00:00")], "run_id string, eventType string, at string").selectExpr("run_id", "eventType", "timestamp(at) AS at")
    rows.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = spool.paired_runs(stream).writeStream.format("memory").queryName("paired").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "k")).start()
    q.awaitTermination()
    assert [(r["run_id"], r["state"]) for r in spark.table("paired").collect()] == [("1", "FAIL")]
