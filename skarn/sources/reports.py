"""Reports: aggregates are computed by Spark, the driver only writes what a person reads."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators import inventory

COLUMNS = ("system", "database", "table", "row_estimate", "data_bytes", "index_bytes", "total_bytes", "extra")


def write_inventory_csv(stats: DataFrame, path: str) -> None:
    """An inventory with the fixed header of eight columns, in one file below `path`."""
    stats.select(*COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True)


def _gib(n: int | None) -> str:
    return f"{(n or 0) / (1 << 30):.2f} GiB"


def volumetry_markdown(stats: DataFrame, statuses: Iterable[tuple[str, str | None]], date: str, top: int = 20) -> str:
    """Status of each system, totals by database and in all, and the largest tables.

    statuses: (system, error or None) of each collection.
    """
    tables = {r["system"]: r["n"] for r in stats.groupBy("system").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a system
    totals = inventory.volume_rollup(stats).filter("level IN (0, 3)").select("system", "database", "level", "bytes").collect()  # one row a database
    out = [f"# Volumetry {date}", ""]
    out += [f"- **{s}**: {'ok' if e is None else f'failed: {e}'} ({tables.get(s, 0)} tables)" for s, e in statuses]
    out += ["", "## Totals by database", "", "| Database | Volume |", "|---|---|"]
    own = sorted((r for r in totals if r["level"] == 0), key=lambda r: (-(r["bytes"] or 0), r["system"], r["database"]))
    out += [f"| {r['system']}/{r['database']} | {_gib(r['bytes'])} |" for r in own]
    out += ["", f"**Total: {_gib(sum(r['bytes'] or 0 for r in own))}**", "", f"## Largest {top} tables", "", "| Table | Rows | Volume | Notes |", "|---|---|---|---|"]
    out += [f"| {r['database']}.{r['table']} | {r['row_estimate']:,} | {_gib(r['total_bytes'])} | {r['extra'] or ''} |" for r in inventory.largest(stats, top).collect()]
    return "\n".join([*out, ""])


def reconcile_markdown(parts: Mapping[str, DataFrame]) -> str:
    """Counts, then the names of ghosts and orphans, which come through in batches."""
    n = {r["kind"]: r["n"] for r in inventory.reconcile_counts(dict(parts)).collect()}
    out = ["# Tables in code and in databases", "", *(f"- {k}: **{n[k]}**" for k in ("matched", "ghosts", "orphans"))]
    for kind in ("ghosts", "orphans"):
        out += ["", f"## {kind.capitalize()}", *(f"- {r['name']}" for r in parts[kind].select("name").orderBy("name").toLocalIterator())]
    return "\n".join([*out, ""])


FIELDS = ("subjects", "data", "legal_basis", "retention", "contract", "note")


def register_markdown(treatments: DataFrame, flagged: DataFrame) -> str:
    """Treatments (id, purpose, subjects, data, legal_basis, retention, contract, note, tables), dead tables marked.

    flagged: (name) of the tables that hold personal data; a table of a treatment that isn't among
    them is dead. Absent fields are shown as '-', an absent note not at all.
    """
    names = F.broadcast(flagged.select(F.col("name").alias("t")).distinct().withColumn("live", F.lit(True)))  # a register kept by hand
    marked = treatments.select("id", F.posexplode("tables").alias("pos", "t")).join(names, "t", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "t", F.col("live").isNull().alias("dead")))).alias("marked"))
    rows = treatments.join(marked, "id", "left").orderBy("id").collect()
    n = len({m["t"] for r in rows for m in r["marked"] or []})
    out = ["# Register of treatments of personal data", "", f"**{len(rows)} treatments**, **{n} tables**", ""]
    for r in rows:
        out += [f"## {r['purpose']}", "", f"- **id**: `{r['id']}`"]
        out += [f"- **{f.replace('_', ' ')}**: {' '.join(str(r[f]).split()) if r[f] else '-'}" for f in FIELDS if r[f] or f != "note"]
        out += ["- **tables**:", *(f"    - `{m['t']}`{' (dead or not flagged)' if m['dead'] else ''}" for m in r["marked"] or []), ""]
    return "\n".join(out)


def write_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
