"""Versioned parquet tables for the index: append, delete by key, compaction, graph files, sidecars.

There is no table format here, and a directory that is read can't be overwritten. A table is a folder
of numbered versions; a version is written whole and then named in one small file, whose replacement
is the commit. Readers of an older version are not disturbed.
"""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.plans.scratch import file_system

CURRENT = "CURRENT"


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, or replace it in one step: a reader sees the old or the new text."""
    folder, name = path.rsplit("/", 1)
    fs, tmp = file_system(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(tmp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(tmp), fs.makeQualified(file_system(spark, path)[1]), option)


def current_version(spark: SparkSession, path: str) -> int | None:
    """Number of the committed version; None if there is no table.

    A crash may have left the commit half done. Versions are written whole before they are named, and
    their success mark is the last thing written, so without the file the newest marked one counts.
    """
    fs, p = file_system(spark, f"{path}/{CURRENT}")
    if fs.exists(p):
        return int(spark.read.text(f"{path}/{CURRENT}").first()[0])
    done = [n for n in _versions(spark, path) if fs.exists(file_system(spark, f"{path}/v{n}/_SUCCESS")[1])]
    return max(done, default=None)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions there are, committed or not."""
    fs, p = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]


def open_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed version; None if the table isn't there yet."""
    n = current_version(spark, path)
    return None if n is None else spark.read.parquet(f"{path}/v{n}")


def commit(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), files: int | None = None) -> DataFrame:
    """Write df as the next version and make it current. files: rewrite into so many (compaction).

    The new number is above all that exist, so nothing that is there is written over; the rename replaces
    the old name in one step.
    """
    spark = df.sparkSession
    n = max(_versions(spark, path), default=0) + 1
    out = df.coalesce(files) if files else df
    (out.write.partitionBy(*partition_by) if partition_by else out.write).parquet(f"{path}/v{n}")
    replace_file(spark, f"{path}/{CURRENT}", f"{n}\n")
    return spark.read.parquet(f"{path}/v{n}")


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Append to the table, which the first write creates."""
    old = open_table(df.sparkSession, path)
    return commit(df if old is None else old.unionByName(df, allowMissingColumns=True), path, partition_by)


def delete_keys(spark: SparkSession, path: str, keys: DataFrame, column: str = "key", partition_by: tuple[str, ...] = ()) -> DataFrame | None:
    """The table without the rows of these keys."""
    old = open_table(spark, path)
    return None if old is None else commit(old.join(keys.select(column).distinct(), column, "left_anti"), path, partition_by)


def rebuild(spark: SparkSession, path: str, postings: str, files: int = 1, id_: str = "id", text: str = "contextualized") -> DataFrame | None:
    """Compact the table and write the postings of its texts, clustered by term, as the full-text index."""
    from skarn.operators.retrieval import postings as build

    old = open_table(spark, path)
    if old is None:
        return None
    new = commit(old, path, files=files)
    commit(build(new, id_, text).repartition(F.col("term")).sortWithinPartitions("term", "id"), postings)
    return new


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as one JSON file, gzipped if its name says so: what readers of the artefact load whole."""
    rows = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in nodes.orderBy("id").toLocalIterator()]
    out: dict[str, list] = {}
    for r in edges.orderBy("src", F.desc("conf"), "dst").toLocalIterator():
        out.setdefault(r["src"], []).append([r["dst"], r["conf"]])
    data = json.dumps({"nodes": rows, "out": out}, ensure_ascii=False).encode()
    with open(path, "wb") as f:
        f.write(gzip.compress(data) if path.endswith(".gz") else data)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (src, dst, conf) of a graph file; swapping src and dst gives the reverse index."""
    with open(path, "rb") as f:
        raw = f.read()
    g = json.loads(gzip.decompress(raw) if path.endswith(".gz") else raw)
    edges = [(s, t, float(c)) for s, targets in (g.get("out") or {}).items() for t, c in targets]
    spec = "id string, name string, qname string, fqn string, repo string, path string, lang string, kind string, start_line int, end_line int, fan_in long, centrality double"
    names = [c.split()[0] for c in spec.split(", ")]
    return spark.createDataFrame([tuple(n.get(c) for c in names) for n in g.get("nodes") or []], spec), spark.createDataFrame(edges, "src string, dst string, conf double")


def write_sidecar(files: DataFrame, repos: Mapping[str, Mapping[str, str]], path: str) -> None:
    """repo_source, repo_ref, web_base of repositories, last_commit and status of (key, last_commit, status) as JSON."""
    out: dict[str, dict] = {k: {r: v.get(k, "") for r, v in repos.items()} for k in ("repo_source", "repo_ref", "web_base")}
    out |= {"last_commit": {}, "status": {}}
    for r in files.toLocalIterator():
        for c in ("last_commit", "status"):
            if r[c]:
                out[c][r["key"]] = r[c]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False)
