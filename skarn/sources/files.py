"""Files of repositories as rows: walks, supported code, history, datastore statistics."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions import columns as C

#: Language of a file by its extension; any other is 'text'.
LANGUAGES = {
    "php": "php", "js": "js", "ts": "ts", "py": "python", "ncl": "ncl", "sh": "shell", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json",
    "xml": "xml", "jinja2": "jinja", "j2": "jinja", "conf": "conf", "ini": "ini", "toml": "toml", "md": "markdown", "map": "mapfile",
}
#: Languages with a code graph.
SUPPORTED = ("php", "ts", "js", "python")
MOST_BYTES = 2_000_000
WALKED = "repo string, path string, lang string, text string, sha string, key string"


def extension(path: Column) -> Column:
    """Lower-case extension of the last segment without its dot; '' without one or for a dot file."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def language(path: Column) -> Column:
    """Language of a path."""
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit("text"))


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, length, content) of all files; only columns that are asked for are read."""
    base = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    # The reader gives encoded URIs: the part after the folder, decoded without turning '+' into a blank.
    after = F.element_at(F.split("path", f"^[a-z]+:/+{base.lstrip('/').replace('.', '[.]')}/"), -1)
    return files.select(F.url_decode(F.replace(after, F.lit("+"), F.lit("%2B"))).alias("path"), "length", "content")


def _decoded(rows: DataFrame, repo: str) -> DataFrame:
    """Text and hash of the contents; binary and blank files are left out."""
    out = rows.filter(~C.is_binary("content")).select(F.lit(repo).alias("repo"), "path", language(F.col("path")).alias("lang"), C.decode_lenient("content").alias("text"), C.content_hash("content").alias("sha"))
    return out.filter("text IS NOT NULL").withColumn("key", F.concat("repo", F.lit("/"), "path"))


def walk(spark: SparkSession, base: str, manifest: Mapping, repos: Sequence[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(repo, path, lang, text, sha, key) of the files a manifest asks for.

    Order of the filters: excluded directory or glob, extension, size, NUL among the first 1024
    bytes. The manifest has repos, include_ext, exclude_dirs, exclude_globs, exclude_per_repo;
    repositories that aren't there are left out.
    """
    kinds = [e.lower().lstrip(".") for e in manifest.get("include_ext") or []]
    out = spark.createDataFrame([], WALKED)
    for repo in manifest.get("repos") or []:
        root = os.path.join(base, repo)
        if (repos and repo not in repos) or not os.path.isdir(root):
            continue
        globs = [*(manifest.get("exclude_globs") or []), *((manifest.get("exclude_per_repo") or {}).get(repo) or [])]
        rows = _listed(spark, root).filter(~C.excluded("path", manifest.get("exclude_dirs") or [], globs))
        rows = rows.filter(extension(F.col("path")).isin(kinds) & (F.col("length") <= most_bytes))
        out = out.unionByName(_decoded(rows, repo))
    return out


def _path_glob(pattern: str) -> str:
    """A glob below a folder as a regex: * stays within a segment, ** spans any number of them."""
    parts, segments = [], pattern.split("/")
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "**":
            parts.append(".*" if last else "(?:[^/]+/)*")
        else:
            body = C.glob_regex(s)[5:-1].replace(".*", "[^/]*")
            parts.append(body if last else body + "/")
    return "^" + "".join(parts) + "$"


def walk_docs(spark: SparkSession, base: str, manifest: Mapping, most_bytes: int = MOST_BYTES) -> DataFrame:
    """As walk(), for the ordered globs of the manifest's section docs; `glob` is the first that matches."""
    spec = manifest.get("docs") or {}
    repo = spec.get("repo") or ""
    root = os.path.join(base, repo)
    schema = WALKED + ", glob int"
    if not spec or not os.path.isdir(root):
        return spark.createDataFrame([], schema)
    first = F.lit(None).cast("int")
    for i, g in reversed(list(enumerate(spec.get("include_globs") or []))):
        first = F.when(F.col("path").rlike(_path_glob(g)), i).otherwise(first)
    rows = _listed(spark, root).withColumn("glob", first).filter(F.col("glob").isNotNull() & (F.col("length") <= most_bytes))
    found = _decoded(rows, repo).withColumn("glob", first)
    return found.select(*(c.split()[0] for c in schema.split(", ")))


def first_files(files: DataFrame, n: int | None) -> DataFrame:
    """At most n files, the first by key; all without n."""
    return files if n is None else files.orderBy("key").limit(max(0, n))


def supported(files: DataFrame) -> DataFrame:
    """Files of the languages of the code graph, neither blank nor minified."""
    return files.filter(F.col("lang").isin(*SUPPORTED) & (F.trim("text") != "") & ~C.minified("path", "text"))


def git_log(spark: SparkSession, repo_dir: str) -> DataFrame:
    """(seq, path, date) of a repository's history, newest first; none if it isn't a repository."""
    said = subprocess.run(["git", "-C", repo_dir, "log", "--no-renames", "--name-only", "--format=%x00%cs"], capture_output=True, check=False)
    rows, day = [], ""
    for line in said.stdout.decode("utf-8", errors="replace").splitlines():
        if line.startswith("\0"):
            day = line[1:].strip()
        elif line.strip() and day:
            rows.append((len(rows), line.strip(), day))
    return spark.createDataFrame(rows, "seq int, path string, date string")


def last_commits(log: DataFrame) -> DataFrame:
    """(path, last_commit): the first date of each path in a newest-first log."""
    return log.groupBy("path").agg(F.min_by("date", "seq").alias("last_commit"))


def status_map(pipelines: DataFrame) -> DataFrame:
    """(key, status) by repo/script of a register with (seq, repo, script, status); the last entry wins."""
    rows = pipelines.filter("repo <> '' AND script <> '' AND status <> ''").withColumn("key", F.concat("repo", F.lit("/"), "script"))
    last = Window.partitionBy("key").orderBy(F.desc("seq"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select("key", "status")


def datastore(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of a mount's files; contents are not read."""
    return _listed(spark, root).select("path", "length")


def folder_sizes(files: DataFrame, level: int, top: int | None = 100) -> DataFrame:
    """(folder, files, bytes) of the folders at a level, largest first."""
    parts = F.split("path", "/")
    rows = files.filter(F.size(parts) > level).groupBy(F.array_join(F.slice(parts, 1, level), "/").alias("folder"))
    out = rows.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("bytes"), "folder")
    return out if top is None else out.limit(top)


def extension_counts(files: DataFrame, top: int = 30) -> DataFrame:
    """(ext, files) of all files; extensions are one to eight letters or digits, '' stands for none. A top-k report."""
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    return files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "ext").limit(top)
