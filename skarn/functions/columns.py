"""Scalar functions as column expressions; the P numbers are those of the survey."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flagged(c: ColumnOrName) -> Column:
    """True only for true; null is false."""
    return F.coalesce(_c(c).cast("boolean"), F.lit(False))


def search_filter(repos: Sequence[str] | None = None, lang: str | None = None) -> Column | None:
    """Repo in (...) and lang = ...; None without a clause. Values are literals, so nothing needs escaping."""
    clauses = ([F.col("repo").isin(list(repos))] if repos else []) + ([F.col("lang") == lang] if lang else [])
    return None if not clauses else clauses[0] if len(clauses) == 1 else clauses[0] & clauses[1]


def glob_regex(pattern: str) -> str:
    """A file glob as a whole-string Java regex; * and ? cross '/'."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(ch) or re.escape(ch))
        i += 1
    return f"(?s)^{''.join(out)}$"


def excluded(path: ColumnOrName, dirs: Sequence[str], globs: Sequence[str] = ()) -> Column:
    """A directory of the path is in dirs, or a glob matches the path or its last segment."""
    parts = F.split(_c(path), "/")
    out = F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, dirs))) if dirs else F.lit(False)
    for g in globs:
        out = out | _c(path).rlike(glob_regex(g)) | F.element_at(parts, -1).rlike(glob_regex(g))
    return out


def is_binary(content: ColumnOrName) -> Column:
    """A NUL among the first 1024 bytes."""
    return F.call_function("position", F.lit(b"\0"), F.substring(_c(content), 1, 1024)) > 0


def minified(path: ColumnOrName, text: ColumnOrName) -> Column:
    """By name, by directory, or by a line over 2000 characters among the first 50."""
    low = F.lower(_c(path))
    return low.rlike(r"\.min\.|-min\.|\.bundle\.") | low.rlike(r"(^|/)(vendor|dist|node_modules)(/|$)") | F.exists(F.slice(F.split(_c(text), "\n"), 1, 50), lambda x: F.length(x) > 2000)


_TOKENS = {"{AAAA}": r"\d{4}", "{YYYY}": r"\d{4}", "{MM}": r"\d{2}", "{1-3}": "[1-3]", "{1|2|3}": "[1-3]", "{dd}": r"\d{2}", "{XX}": "[0-9A-Z]{2}"}


def template_regex(name: str) -> str:
    """A naming template as an anchored regex."""
    parts = re.split("(" + "|".join(map(re.escape, _TOKENS)) + ")", name)
    return "^" + "".join(_TOKENS.get(p) or re.escape(p) for p in parts) + "$"


def decade(day: ColumnOrName) -> Column:
    """Third of the month: 1 to 10, 11 to 20, 21 to the end."""
    return F.least(F.floor((F.dayofmonth(_c(day)) - 1) / 10) + 1, F.lit(3)).cast("int")


def concrete_name(template: ColumnOrName, today: ColumnOrName) -> Column:
    """The physical table of a template on a day; a suffix ' (...)' goes, unknown tokens stay."""
    base = F.split(_c(template), r" \(").getItem(0)
    base = F.replace(base, F.lit("{MM}"), F.date_format(_c(today), "MM"))
    base = F.replace(base, F.lit("{AAAA}"), F.date_format(_c(today), "yyyy"))
    return F.replace(base, F.lit("d{1|2|3}"), F.concat(F.lit("d"), decade(today).cast("string")))


def concrete_or_null(template: ColumnOrName, today: ColumnOrName) -> Column:
    """As concrete_name, null where a token is left: the object can't be tested."""
    out = concrete_name(template, today)
    return F.when(~out.rlike(r"[{}]"), out)


def months_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """First days of the months that cover [start, end]."""
    return F.sequence(F.trunc(_c(start), "MM"), F.trunc(_c(end), "MM"), F.expr("interval 1 month"))


def month_names(prefix: str, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Names PREFIX_yyyy_MM of those months."""
    return F.transform(months_between(start, end), lambda m: F.concat(F.lit(prefix + "_"), F.date_format(m, "yyyy_MM")))


def threshold_seconds(text: ColumnOrName) -> Column:
    """P10: seconds of 'Nh' or 'Nd'; anything else is an error."""
    t = F.trim(_c(text))
    n = F.regexp_extract(t, r"^(\d+)\s*[hd]$", 1)
    unit = F.when(t.endswith("h"), 3600).otherwise(86400)
    return F.when(n != "", n.cast("long") * unit).otherwise(F.raise_error(F.concat(F.lit("invalid threshold: "), F.coalesce(t, F.lit("null")))).cast("long"))


def lag_text(seconds: ColumnOrName) -> Column:
    """P11: 'Xj Yh' from one day on, 'HhMM' below, 'ahead' for a time to come."""
    s = _c(seconds).cast("long")
    day = F.concat((s / 86400).cast("long").cast("string"), F.lit("j "), ((s % 86400) / 3600).cast("long").cast("string"), F.lit("h"))
    hour = F.concat((s / 3600).cast("long").cast("string"), F.lit("h"), F.lpad(((s % 3600) / 60).cast("long").cast("string"), 2, "0"))
    return F.when(s < 0, F.lit("ahead")).when(s >= 86400, day).otherwise(hour)


def as_timestamp(c: ColumnOrName) -> Column:
    """A date becomes its midnight."""
    return _c(c).cast("timestamp")


def qualified(system: ColumnOrName, database: ColumnOrName, table: ColumnOrName) -> Column:
    """System://database/table; a leading 'public.' of the table goes, so that inventories agree."""
    return F.concat(_c(system), F.lit("://"), _c(database), F.lit("/"), F.regexp_replace(_c(table), "^public[.]", ""))


_FAMILIES = {
    "int": ("int", "integer", "smallint", "mediumint", "tinyint", "bigint", "long", "short", "byte"),
    "float": ("float", "double", "real", "decimal", "numeric", "number"),
    "text": ("char", "varchar", "text", "tinytext", "mediumtext", "longtext", "string", "enum", "set"),
    "time": ("timestamp", "timestamptz", "datetime", "date", "time"),
    "bool": ("bool", "boolean", "bit"),
    "binary": ("binary", "varbinary", "blob", "longblob", "bytea"),
    "geo": ("point", "geometry", "geography"),
}


def type_family(type_name: ColumnOrName) -> Column:
    """Family of a SQL type by its leading letters; '?type' in lower case if unknown."""
    t = F.regexp_extract(F.lower(_c(type_name)), "^([a-z]+)", 1)
    pairs = [F.lit(x) for family, names in _FAMILIES.items() for name in names for x in (name, family)]
    return F.coalesce(F.element_at(F.create_map(*pairs), t), F.concat(F.lit("?"), F.lower(_c(type_name))))


def gib(n_bytes: ColumnOrName) -> Column:
    """Bytes as GiB with 2 decimals."""
    return F.round(_c(n_bytes) / float(1 << 30), 2)


_LICENCES = {0: "open", 1: "commercial", 2: "non-commercial", 3: "never"}


def licence_label(code: ColumnOrName) -> Column:
    """Label of a licence code; null and unknown codes are named so."""
    pairs = [F.lit(x) for k, v in _LICENCES.items() for x in (k, v)]
    return F.when(_c(code).isNull(), F.lit("none")).otherwise(F.coalesce(F.element_at(F.create_map(*pairs), _c(code).cast("int")), F.lit("unknown")))


def exposable(code: ColumnOrName) -> Column:
    """Shown at all; a null licence is not."""
    return F.coalesce(_c(code) != 3, F.lit(False))


def exportable(code: ColumnOrName, commercial: bool) -> Column:
    """Exported for commercial (up to 1) or other use (up to 2)."""
    return F.coalesce((_c(code) >= 0) & (_c(code) <= (1 if commercial else 2)), F.lit(False))


def content_hash(content: ColumnOrName) -> Column:
    """Sha-256 of raw bytes."""
    return F.sha2(_c(content).cast("binary"), 256)


@F.pandas_udf(T.StringType())
def decode_lenient(content: pd.Series) -> pd.Series:
    """Utf-8 with replacement characters for bad bytes; blank texts become null."""
    text = content.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="replace"))
    return text.where(text.map(lambda t: bool(t and t.strip())), None)


def structural_context(repo: ColumnOrName, path: ColumnOrName, symbol: ColumnOrName, start: ColumnOrName, end: ColumnOrName, total: ColumnOrName) -> Column:
    """P20: one bracketed line that says where a chunk is; an empty symbol is left out."""
    within = F.when(F.coalesce(_c(symbol), F.lit("")) != "", F.concat(F.lit("in "), _c(symbol)))
    lines = F.concat(F.lit("lines "), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"), F.lit("/"), _c(total).cast("string"))
    return F.concat(F.lit("["), F.concat_ws(" | ", F.concat(F.lit("repo "), _c(repo)), F.concat(F.lit("file "), _c(path)), within, lines), F.lit("]"))


def with_context(context: ColumnOrName, text: ColumnOrName, most: int = 600) -> Column:
    """The trimmed context, at most 600 characters, a blank line, the text; the text alone without context."""
    c = F.substring(F.trim(F.coalesce(_c(context), F.lit(""))), 1, most)
    return F.when(c == "", _c(text)).otherwise(F.concat(c, F.lit("\n\n"), _c(text)))


def clip(text: ColumnOrName, most: int = 8000) -> Column:
    """What an embedder is given at most."""
    return F.substring(_c(text), 1, most)


def age_years(last_commit: ColumnOrName, today: ColumnOrName) -> Column:
    """Days since a date by 365.25; null for a bad or missing date."""
    return F.datediff(_c(today), F.try_to_date(F.substring(_c(last_commit), 1, 10), "yyyy-MM-dd")) / 365.25


def rank_penalty(status: ColumnOrName, last_commit: ColumnOrName, today: ColumnOrName) -> Column:
    """P25: places a result loses by its status and age; negative ones are won."""
    s, y = F.lower(F.coalesce(_c(status), F.lit(""))), age_years(last_commit, today)
    by_status = F.when(s == "mort", 100.0).when(s == "douteux", 2.0).when(s == "actif", -1.0).otherwise(0.0)
    return by_status + F.when(y < 1, -1.0).when(y > 3, 2.0).when(y > 2, 1.0).otherwise(0.0)


def display_flag(status: ColumnOrName, last_commit: ColumnOrName, today: ColumnOrName) -> Column:
    """The status, and ~Na for code older than two years."""
    y = age_years(last_commit, today)
    return F.concat_ws(" ", F.when(F.coalesce(_c(status), F.lit("")) != "", _c(status)), F.when(y > 2, F.concat(F.lit("~"), F.floor(y).cast("string"), F.lit("a"))))


def web_base(remote: ColumnOrName) -> Column:
    """Web address of a git remote in ssh or http form; '' for any other."""
    r = F.regexp_replace(F.trim(_c(remote)), r"(\.git)?/?$", "")
    ssh = r"^(?:ssh://)?git@([^:/]+)(?::\d+/|[:/])(.+)$"
    web = r"^https?://(?:[^@/]+@)?([^/]+)/(.+)$"
    out = F.when(r.rlike(ssh), F.concat(F.lit("https://"), F.regexp_extract(r, ssh, 1), F.lit("/"), F.regexp_extract(r, ssh, 2)))
    out = out.when(r.rlike(web), F.concat(F.lit("https://"), F.regexp_extract(r, web, 1), F.lit("/"), F.regexp_extract(r, web, 2)))
    return F.coalesce(out, F.lit(""))


def permalink(base: ColumnOrName, ref: ColumnOrName, path: ColumnOrName, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Link to lines of a file at a revision; '' if base or revision is unknown."""
    a, b = _c(start).cast("string"), _c(end).cast("string")
    hub = _c(base).contains("github")
    tail = F.when(hub, F.concat(F.lit("#L"), a, F.lit("-L"), b)).otherwise(F.concat(F.lit("#L"), a, F.lit("-"), b))
    middle = F.when(hub, F.lit("/blob/")).otherwise(F.lit("/-/blob/"))
    known = (F.coalesce(_c(base), F.lit("")) != "") & (F.coalesce(_c(ref), F.lit("")) != "")
    return F.when(known, F.concat(_c(base), middle, _c(ref), F.lit("/"), _c(path), tail)).otherwise(F.lit(""))


def source_class(remote: ColumnOrName, classes: Mapping[str, str], default: str = "other") -> Column:
    """The class of the first substring that the remote contains."""
    out = None
    for needle, name in classes.items():
        out = F.when(_c(remote).contains(needle), name) if out is None else out.when(_c(remote).contains(needle), name)
    return F.lit(default) if out is None else out.otherwise(default)


def tier(conf: ColumnOrName) -> Column:
    """Certain from 0.80, probable from 0.50, else incertain."""
    return F.when(_c(conf) >= 0.80, "certain").when(_c(conf) >= 0.50, "probable").otherwise("incertain")


def subsystem(repo: ColumnOrName, path: ColumnOrName) -> Column:
    """Repo and first segment of the path."""
    first = F.split_part(_c(path), F.lit("/"), F.lit(1))
    return F.when(first != "", F.concat(_c(repo), F.lit("/"), first)).otherwise(_c(repo))


def node_id(repo: ColumnOrName, path: ColumnOrName, line: ColumnOrName, qname: ColumnOrName) -> Column:
    """repo/path:line:qname."""
    return F.concat(_c(repo), F.lit("/"), _c(path), F.lit(":"), _c(line).cast("string"), F.lit(":"), _c(qname))


def full_name(ns: ColumnOrName, qname: ColumnOrName) -> Column:
    r"""ns\qname, or qname without a namespace."""
    return F.when(F.coalesce(_c(ns), F.lit("")) != "", F.concat(_c(ns), F.lit("\\"), _c(qname))).otherwise(_c(qname))


def entry_label(*columns: ColumnOrName) -> Column:
    """The first of the columns that isn't empty, '?' if none is."""
    return F.coalesce(*(F.nullif(_c(c).cast("string"), F.lit("")) for c in columns), F.lit("?"))


def dedup_key(*columns: ColumnOrName) -> Column:
    """md5 of the values; nulls count as empty, so positions stay apart."""
    return F.md5(F.concat_ws("|", *(F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))


#: (from, to) -> factor and offset
UNITS: dict[tuple[str, str], tuple[float, float]] = {
    ("K", "C"): (1.0, -273.15), ("C", "K"): (1.0, 273.15), ("Pa", "hPa"): (0.01, 0.0), ("hPa", "Pa"): (100.0, 0.0), ("m/s", "km/h"): (3.6, 0.0), ("km/h", "m/s"): (1 / 3.6, 0.0),
    ("m", "cm"): (100.0, 0.0), ("cm", "m"): (0.01, 0.0), ("m", "mm"): (1000.0, 0.0), ("J/cm2", "Wh/m2"): (10000 / 3600, 0.0), ("J/m2", "Wh/m2"): (1 / 3600, 0.0), ("s", "min"): (1 / 60, 0.0),
}


def convert(c: ColumnOrName, unit: str, to: str) -> Column:
    """A value in another unit; an unknown pair is an error."""
    if unit == to:
        return _c(c)
    factor, offset = UNITS[unit, to]
    return _c(c) * factor + offset


def haversine_km(lat1: ColumnOrName, lon1: ColumnOrName, lat2: ColumnOrName, lon2: ColumnOrName) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def packed(c: ColumnOrName, sep: str = "@") -> Column:
    """The non-empty trimmed parts of a packed field; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(_c(c), F.lit("")), re.escape(sep)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def json_fields(c: ColumnOrName, schema: str) -> Column:
    """Fields of a JSON text; null for a text that isn't such an object."""
    return F.when(F.try_parse_json(_c(c)).isNotNull() & F.trim(_c(c)).startswith("{"), F.from_json(_c(c), schema, {"mode": "PERMISSIVE"}))


def recent(ts: ColumnOrName, now: ColumnOrName, minutes: int = 120) -> Column:
    """Within the last minutes before now."""
    return (_c(ts) > _c(now) - F.expr(f"interval {int(minutes)} minutes")) & (_c(ts) <= _c(now))


def age_minutes(ts: ColumnOrName, now: ColumnOrName) -> Column:
    """Whole minutes between ts and now."""
    return F.floor((F.unix_micros(_c(now)) - F.unix_micros(_c(ts))) / 60_000_000).cast("int")


def retained(ts: ColumnOrName, now: ColumnOrName, days: int | None) -> Column:
    """Still within the retention; without days everything is."""
    return F.lit(True) if days is None else _c(ts) >= _c(now) - F.expr(f"interval {int(days)} days")
