"""Registers, contracts, inventories and settings as DataFrames. Files are small: the driver parses them."""

from __future__ import annotations

import glob
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVENTORY = "system string, database string, table string, row_estimate long, data_bytes long, index_bytes long, total_bytes long, extra string"
CATALOGUE = "contract string, object string, system string, database string"
JOBS = "job_name string, inputs array<struct<namespace: string, name: string>>, outputs array<struct<namespace: string, name: string>>"


def load_yaml(path: str):
    """A YAML document; only plain data is built."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _fit(value, kind: T.DataType):
    """A YAML value in the shape of a column; scalars become text where text is asked for."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return str(value)
    if isinstance(kind, T.ArrayType):
        return [_fit(v, kind.elementType) for v in (value if isinstance(value, (list, tuple)) else [value])]
    if isinstance(kind, T.StructType):
        return tuple(_fit(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, Mapping) else None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    return value


def register(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The entries of one list of a YAML register; absent fields are null, entries that aren't mappings are left out."""
    doc = load_yaml(path)
    spec = T.StructType.fromDDL(schema)
    entries = (doc or {}).get(key) or [] if isinstance(doc, Mapping) else []
    return spark.createDataFrame([_fit(e, spec) for e in entries if isinstance(e, Mapping)], spec)


def load_contracts(folder: str) -> list[dict]:
    """The parsed contracts *.odcs.yaml of a folder by name, without templates."""
    paths = sorted(glob.glob(os.path.join(folder, "*.odcs.yaml")))
    return [load_yaml(p) for p in paths if "_template" not in os.path.basename(p)]


def catalogue(spark: SparkSession, contracts: Sequence[Mapping], year: int) -> DataFrame:
    """(contract, object, system, database) of every object; '{AAAA}' in a database is the year.

    An object's physicalDatabase property wins over the first server's database. The row with
    object null is the contract itself, for lookups of objects it doesn't name.
    """
    fill = lambda db: str(db or "").replace("{AAAA}", str(year))
    rows = []
    for c in contracts:
        cid, server = str(c.get("id", "")).split(":")[-1], (c.get("servers") or [{}])[0]
        rows.append((cid, None, server.get("type"), fill(server.get("database"))))
        for o in c.get("schema") or []:
            own = [p.get("value") for p in o.get("customProperties") or [] if p.get("property") == "physicalDatabase"]
            rows.append((cid, o.get("physicalName") or o.get("name"), server.get("type"), fill(own[-1] if own else server.get("database"))))
    return spark.createDataFrame(rows, CATALOGUE)


def database_of(objects: DataFrame, contract: str, name: str) -> str:
    """Database of an object; the contract's own for an unknown object, an error for an unknown contract."""
    rows = objects.filter((F.col("contract") == contract) & (F.col("object").isNull() | (F.col("object") == name))).orderBy(F.desc_nulls_last("object")).take(1)
    if not rows:
        raise LookupError(f"unknown contract: {contract} / {name}")
    return rows[0]["database"]


def declared_columns(spark: SparkSession, contracts: Sequence[Mapping]) -> DataFrame:
    """Q09: (object, column, type) that contracts declare; the physical type wins over the logical one."""
    rows = [(o.get("physicalName") or o.get("name"), p.get("physicalName") or p.get("name"), str(p.get("physicalType") or p.get("logicalType") or "")) for c in contracts for o in c.get("schema") or [] for p in o.get("properties") or []]
    return spark.createDataFrame(rows, "object string, column string, type string")


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """(job_name, inputs, outputs) declared in a register of jobs."""
    return register(spark, path, "jobs", JOBS)


def inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    """A volumetry inventory with its header line."""
    return spark.read.csv(path, schema=INVENTORY, header=True)


def ini_settings(path: str) -> dict[str, dict[str, str]]:
    """Sections of an INI file; lines that begin with ';' or '#' are comments, outer quotes go."""
    out: dict[str, dict[str, str]] = {}
    section = None
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if line.startswith("[") and line.endswith("]"):
                section = out.setdefault(line[1:-1].strip(), {})
            elif line and line[0] not in ";#" and "=" in line and section is not None:
                key, value = line.split("=", 1)
                section[key.strip()] = value.strip().strip('"')
    return out


# ---------------------------------------------------------------- catalogues of databases

TABLES_SQL = (
    "SELECT table_schema AS db, table_name AS tbl, COALESCE(table_rows, 0) AS n, COALESCE(data_length, 0) AS data_bytes, COALESCE(index_length, 0) AS index_bytes "
    "FROM information_schema.tables WHERE table_schema NOT IN ('information_schema', 'performance_schema', 'mysql', 'sys')"
)
HYPER_SQL = (
    "SELECT h.hypertable_name AS tbl, h.num_chunks AS chunks, h.compression_enabled AS compressed, hypertable_size(format('%I.%I', h.hypertable_schema, h.hypertable_name)::regclass) AS total_bytes, "
    "hypertable_approximate_row_count_safe AS n FROM timescaledb_information.hypertables h, LATERAL (SELECT approximate_row_count(format('%I.%I', h.hypertable_schema, h.hypertable_name)::regclass) AS hypertable_approximate_row_count_safe) c"
)
PLAIN_SQL = "SELECT relname AS tbl, n_live_tup AS n, pg_total_relation_size(relid) AS total_bytes, pg_indexes_size(relid) AS index_bytes FROM pg_stat_user_tables"


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A remote query; it needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def tables_inventory(rows: DataFrame, system: str) -> DataFrame:
    """Rows of TABLES_SQL (db, tbl, n, data_bytes, index_bytes) as an inventory; nulls count as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(F.lit(system).alias("system"), F.col("db").alias("database"), F.col("tbl").alias("table"), zero("n").alias("row_estimate"), zero("data_bytes").alias("data_bytes"), zero("index_bytes").alias("index_bytes"), (zero("data_bytes") + zero("index_bytes")).alias("total_bytes"), F.lit("").alias("extra"))


def hyper_inventory(hyper: DataFrame, plain: DataFrame, database: str, system: str = "timescaledb") -> DataFrame:
    """Hypertables with chunks and compression, then plain tables that are neither chunks nor hypertables."""
    from skarn.operators.inventory import hypertables_and_plain

    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    head = [F.lit(system).alias("system"), F.lit(database).alias("database"), F.col("tbl").alias("table"), zero("n").alias("row_estimate")]
    extra: Column = F.concat(F.lit("hypertable, "), F.col("chunks").cast("string"), F.lit(" chunks"), F.when(F.col("compressed"), ", compressed").otherwise(""))
    h = hyper.select(*head, zero("total_bytes").alias("data_bytes"), F.lit(0).cast("long").alias("index_bytes"), zero("total_bytes").alias("total_bytes"), extra.alias("extra"))
    p = plain.select(*head, (zero("total_bytes") - zero("index_bytes")).alias("data_bytes"), zero("index_bytes").alias("index_bytes"), zero("total_bytes").alias("total_bytes"), F.lit("").alias("extra"))
    return hypertables_and_plain(h, p)


def actual_columns(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """(object, column, type) of tables of the session's catalogue, by object name."""
    rows = [(name, c.name, c.dataType) for name, t in tables.items() if spark.catalog.tableExists(t) for c in spark.catalog.listColumns(t)]
    return spark.createDataFrame(rows, "object string, column string, type string")
