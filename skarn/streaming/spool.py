"""Streaming lineage: a source that tails a JSONL spool by byte offsets, and a forwarder that posts in order.

The built-in file source ignores what is appended to a file it has seen. This one's offset is the end
of the last complete line, so a line that is still being written waits; ranges are cut at line ends
and read by executors, so a long backlog is read in parallel.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from skarn.plans.scratch import file_system

FORMAT = "jsonl_spool"
SCHEMA = "offset long, value string"
BLOCK = 64 << 20


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end)."""

    path: str
    start: int
    end: int


def complete_until(path: str, block: int = 1 << 16) -> int:
    """Number of bytes up to and with the last newline; 0 without a file or a complete line."""
    try:
        with open(path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at > 0:
                a = max(0, at - block)
                f.seek(a)
                hit = f.read(at - a).rfind(b"\n")
                if hit >= 0:
                    return a + hit + 1
                at = a
    except FileNotFoundError:
        pass
    return 0


def _identity(path: str) -> int:
    try:
        return os.stat(path).st_ino
    except FileNotFoundError:
        return 0


class SpoolReader(DataSourceStreamReader):
    """Offsets are {file, bytes}. A file that was replaced or cut is read from its beginning."""

    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def initialOffset(self) -> dict:
        return {"file": 0, "bytes": 0}

    def latestOffset(self) -> dict:
        return {"file": _identity(self.path), "bytes": complete_until(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        a = start["bytes"] if start["file"] in (0, end["file"]) and start["bytes"] <= end["bytes"] else 0
        return [Range(self.path, x, min(x + self.block, end["bytes"])) for x in range(a, end["bytes"], self.block)]

    def read(self, part: Range) -> Iterator[tuple[int, str]]:
        with open(part.path, "rb") as f:
            # The byte before tells whether a line begins here; one that began before is another range's.
            f.seek(max(0, part.start - 1))
            if part.start and f.read(1) != b"\n":
                f.readline()
            while (at := f.tell()) < part.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield at, line[:-1].decode("utf-8", errors="replace")

    def commit(self, end: dict) -> None:
        pass


class SpoolSource(DataSource):
    """Format 'jsonl_spool'; options path, and block, the bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> SpoolReader:
        return SpoolReader(self.options["path"], int(self.options.get("block", BLOCK)))


def tail(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """A stream of (offset, value) of the complete lines of a spool."""
    spark.dataSource.register(SpoolSource)
    return spark.readStream.format(FORMAT).option("path", path).option("block", str(block)).load()


@F.pandas_udf(T.StringType())
def _filled(value: pd.Series, inputs: pd.Series, outputs: pd.Series) -> pd.Series:
    """The event with the declared datasets where it has none; null for a text that isn't a JSON object.

    Python, since an event's other fields are free and must stay as they came.
    """
    out = []
    for text, *declared in zip(value, inputs, outputs, strict=True):
        try:
            event = json.loads(text)
        except (TypeError, ValueError):
            event = None
        if isinstance(event, dict):
            for key, found in zip(("inputs", "outputs"), declared, strict=True):
                if found and not event.get(key):
                    event[key] = json.loads(found)
            out.append(json.dumps(event, ensure_ascii=False))
        else:
            out.append(None)
    return pd.Series(out, dtype=object)


def enriched_lines(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """(offset, value, event): the event as JSON with its job's declared inputs and outputs where it has none.

    Jobs join by name alone; a job declared twice counts once. event is null for a line that isn't a JSON object.
    """
    side = jobs.groupBy(F.col("job_name").alias("__job")).agg(*(F.max(F.when(F.size(c) > 0, F.to_json(c))).alias(f"__{c}") for c in ("inputs", "outputs")))
    side = F.broadcast(side) if jobs.limit(100_001).count() <= 100_000 else side
    rows = lines.join(side, F.get_json_object("value", "$.job.name") == F.col("__job"), "left")
    return rows.select("offset", "value", _filled("value", "__inputs", "__outputs").alias("event"))


def http_post(url: str, timeout: float = 10.0) -> Callable[[str], None]:
    """A function that posts an event; only 200 and 201 are success, anything else is an error."""
    import urllib.request

    def post(event: str) -> None:
        request = urllib.request.Request(url, data=event.encode(), headers={"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            if answer.status not in (200, 201):
                raise RuntimeError(f"status {answer.status}")

    return post


def _saved(spark: SparkSession, path: str) -> dict | None:
    """What _save() wrote last, wherever the checkpoint lies; None if nothing."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _save(spark: SparkSession, path: str, value: dict) -> None:
    """Replace the file in one step."""
    from skarn.sources.tables import replace_file

    replace_file(spark, path, json.dumps(value))


def forward(lines: DataFrame, jobs: DataFrame, post: Callable[[str], None], checkpoint: str, corrupt: str | None = None, interval: str | None = None) -> StreamingQuery:
    """D: post the enriched events in the order of the spool; at least once, blocking at the first failure.

    The offset of a batch is committed after all its posts; after a failure the batch comes again
    from the event that failed, whose place is kept beside the checkpoint. Lines that can't be parsed
    go to the folder `corrupt` and count as passed. Without an interval it ends when all is forwarded.
    """
    spark = lines.sparkSession
    place = f"{checkpoint}/posted.json"

    def go(batch: DataFrame, number: int) -> None:
        saved = _saved(spark, place)
        done = saved["offset"] if saved and saved["batch"] == number else -1
        rows = enriched_lines(batch, jobs)
        if corrupt:
            rows.filter("event IS NULL").select("offset", "value").write.mode("overwrite").json(f"{corrupt}/batch={number}")
        for r in rows.filter((F.col("event").isNotNull()) & (F.col("offset") > done)).select("offset", "event").orderBy("offset").toLocalIterator():
            post(r["event"])
            _save(spark, place, {"batch": number, "offset": r["offset"]})

    writer = lines.writeStream.foreachBatch(go).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def paired_runs(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """START with its COMPLETE or FAIL as a stream: (run_id, started, ended, state), once both are there.

    events: (run_id, eventType, at timestamp). Both sides are watermarked and the end must come within
    `delay` of the start, so state is bounded; repeated events of a run give repeated pairs unless
    dropped by dropDuplicatesWithinWatermark before.
    """
    marked = events.withWatermark("at", delay)
    a = marked.filter("eventType = 'START'").select(F.col("run_id").alias("run"), F.col("at").alias("started"))
    b = marked.filter("eventType IN ('COMPLETE', 'FAIL')").select("run_id", F.col("at").alias("ended"), F.col("eventType").alias("state"))
    on = (F.col("run") == F.col("run_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {delay}"))
    return a.join(b, on).select("run_id", "started", "ended", "state")
