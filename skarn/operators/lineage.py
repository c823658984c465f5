"""Lineage events: construction, enrichment by declarations, pairing of starts and ends."""

from __future__ import annotations

import datetime
import json
import subprocess
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of a RunEvent; facets stay JSON texts, since their content is free.
RUN_EVENT = (
    "eventType string, eventTime string, producer string, schemaURL string, run struct<runId: string, facets: string>, job struct<namespace: string, name: string>, "
    "inputs array<struct<namespace: string, name: string>>, outputs array<struct<namespace: string, name: string>>"
)
SCHEMA_URL = "https://openlineage.io/spec/2-0-2/OpenLineage.json"


def run_event(kind: str, run_id: str, namespace: str, job: str, at: datetime.datetime, facets: Mapping | None = None, inputs: Sequence = (), outputs: Sequence = (), producer: str = "skarn") -> dict:
    """One event; its time comes from a single timestamp with milliseconds."""
    stamp = at.astimezone(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    return {"eventType": kind, "eventTime": stamp, "producer": producer, "schemaURL": SCHEMA_URL, "run": {"runId": run_id, "facets": dict(facets or {})}, "job": {"namespace": namespace, "name": job}, "inputs": list(inputs), "outputs": list(outputs)}


def run_traced(command: Sequence[str], namespace: str, job: str, emit: Callable[[dict], None], host: str = "", now: Callable[[], datetime.datetime] | None = None) -> int:
    """Run a command between a START and a COMPLETE or FAIL event; its exit code, 127 if it can't start."""
    clock = now or (lambda: datetime.datetime.now(datetime.UTC))
    run_id, began = str(uuid.uuid4()), time.monotonic()
    emit(run_event("START", run_id, namespace, job, clock()))
    try:
        code = subprocess.run(list(command), check=False).returncode
    except OSError:
        code = 127
    facets: dict = {"process": {"hostname": host, "command": " ".join(command), "exitCode": code, "durationSeconds": round(time.monotonic() - began, 3)}}
    if code:
        facets["errorMessage"] = {"message": f"exit code {code}", "programmingLanguage": "shell"}
    emit(run_event("FAIL" if code else "COMPLETE", run_id, namespace, job, clock(), facets))
    return code


def append_event(path: str, event: dict) -> bool:
    """Append an event as one line by a single write; never raises, False if it failed."""
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(event, ensure_ascii=False) + "\n")
        return True
    except OSError:
        return False


def events_frame(events: DataFrame) -> DataFrame:
    """RunEvents (JSON in column value) as typed columns; unparsable lines keep their text in `corrupt`."""
    parsed = F.from_json("value", RUN_EVENT, {"mode": "PERMISSIVE"})
    out = events.withColumn("e", parsed).withColumn("bad", F.col("e").isNull() | F.col("e.run.runId").isNull() | F.col("e.job.name").isNull())
    return out.select(*(F.when(~F.col("bad"), F.col(f"e.{c}")).alias(c) for c in ("eventType", "eventTime", "producer", "run", "job", "inputs", "outputs")), F.when(F.col("bad"), F.col("value")).alias("corrupt"))


def enrich(runs: DataFrame, jobs: DataFrame, name: str = "job_name") -> DataFrame:
    """Inputs and outputs of a run, each from its job's declaration only where missing or empty.

    Jobs join by name alone; a job declared twice counts by its last row by order of its inputs.
    """
    declared = jobs.groupBy(F.col(name).alias("__job")).agg(F.max(F.struct("inputs", "outputs")).alias("__d"))
    out = runs.join(F.broadcast(declared) if _few(declared) else declared, runs[name] == F.col("__job"), "left")
    for c in ("inputs", "outputs"):
        out = out.withColumn(c, F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"__d.{c}", F.col(c))))
    return out.drop("__job", "__d")


def _few(jobs: DataFrame, most: int = 100_000) -> bool:
    """Whether declarations, a static register, are few enough to broadcast."""
    return jobs.limit(most + 1).count() <= most


def pair_runs(events: DataFrame) -> DataFrame:
    """START with COMPLETE or FAIL of the same run: state and duration; a run without an end is 'open'."""
    t = F.to_timestamp("eventTime")
    runs = events.groupBy(F.col("run.runId").alias("run_id"), F.col("job.name").alias("job_name")).agg(F.min(F.when(F.col("eventType") == "START", t)).alias("started"), F.max(F.when(F.col("eventType") != "START", t)).alias("ended"), F.max(F.when(F.col("eventType") != "START", F.col("eventType"))).alias("state"))
    return runs.withColumn("state", F.coalesce("state", F.lit("open"))).withColumn("seconds", (F.unix_micros("ended") - F.unix_micros("started")) / 1_000_000)
