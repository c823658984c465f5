import gzip
import json
import os
import subprocess

import pytest

from skarn.operators import retrieval
from skarn.sources import files, registers, reports, tables

CONTRACT = """
id: urn:contract:obs
servers: [{type: mysql, database: "base_{AAAA}"}]
schema:
  - name: hourly
    physicalName: obs_{AAAA}
    properties: [{name: t, physicalType: double}, {name: at, logicalType: date}]
  - name: other
    customProperties: [{property: physicalDatabase, value: "x_{AAAA}"}]
"""


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_registers(spark, tmp_path):
    p = str(tmp_path / "r.yaml")
    write(p, "tables:\n  - {name: a, personal_data: true, tags: [x, 1]}\n  - {name: 7}\n  - loose\n")
    got = registers.register(spark, p, "tables", "name string, personal_data boolean, tags array<string>").collect()
    assert [tuple(r) for r in got] == [("a", True, ["x", "1"]), ("7", None, None)]
    assert registers.register(spark, p, "absent", "name string").isEmpty()
    write(p, "")
    assert registers.register(spark, p, "tables", "name string").isEmpty()


def test_contracts(spark, tmp_path):
    write(str(tmp_path / "c/obs.odcs.yaml"), CONTRACT)
    write(str(tmp_path / "c/_template.odcs.yaml"), "id: nothing")
    contracts = registers.load_contracts(str(tmp_path / "c"))
    cat = registers.catalogue(spark, contracts, 2024)
    assert registers.database_of(cat, "obs", "other") == "x_2024"
    assert registers.database_of(cat, "obs", "unknown") == registers.database_of(cat, "obs", "obs_{AAAA}") == "base_2024"
    with pytest.raises(LookupError):
        registers.database_of(cat, "none", "other")
    assert sorted(tuple(r) for r in registers.declared_columns(spark, contracts).collect()) == [("obs_{AAAA}", "at", "date"), ("obs_{AAAA}", "t", "double")]


def test_settings_and_inventory(spark, tmp_path):
    write(str(tmp_path / "s.ini"), '; c\nloose = 1\n[ a ]\n# c\nhost = "h=x"\nport=3\nno separator\n[b]\n')
    assert registers.ini_settings(str(tmp_path / "s.ini")) == {"a": {"host": "h=x", "port": "3"}, "b": {}}
    raw = spark.createDataFrame([("d", "t", None, 5, 2), ("d", "u", 3, None, 1)], "db string, tbl string, n long, data_bytes long, index_bytes long")
    inv = registers.tables_inventory(raw, "mariadb")
    reports.write_inventory_csv(inv, str(tmp_path / "csv"))
    back = registers.inventory_csv(spark, str(tmp_path / "csv"))
    assert sorted((r["table"], r["row_estimate"], r["total_bytes"]) for r in back.collect()) == [("t", 0, 7), ("u", 3, 1)]
    text = reports.volumetry_markdown(inv, [("mariadb", None), ("timescaledb", "no driver")], "20240101", 1)
    assert "mariadb**: ok (2 tables)" in text and "failed: no driver (0 tables)" in text and text.count("| d.") == 1
    hyper = spark.createDataFrame([("h", 10, 2, True, 100)], "tbl string, n long, chunks int, compressed boolean, total_bytes long")
    plain = spark.createDataFrame([("h", 1, 9, 1), ("_hyper_1", 1, 9, 1), ("p", 4, 9, 2)], "tbl string, n long, total_bytes long, index_bytes long")
    got = registers.hyper_inventory(hyper, plain, "db").collect()
    assert [(r["table"], r["data_bytes"], r["extra"]) for r in got] == [("h", 100, "hypertable, 2 chunks, compressed"), ("p", 7, "")]


def test_walk(spark, tmp_path):
    base = str(tmp_path)
    for path, data in {
        "one/a.py": "x = 1\n", "one/sub dir/b+c.py": "y\n", "one/vendor/v.py": "z", "one/skip_me.py": "z", "one/big.py": "x" * 50, "one/bin.py": b"a\0b", "one/blank.py": "  \n",
        "one/n.txt": "n", "one/bad.md": b"caf\xe9", "two/q.js": "q", "two/private/x.js": "q",
    }.items():
        write(os.path.join(base, path), data)
    manifest = {"repos": ["one", "two", "gone"], "include_ext": [".py", ".JS", ".md"], "exclude_dirs": ["vendor"], "exclude_globs": ["skip_*"], "exclude_per_repo": {"two": ["private/*"]}}
    rows = {r["key"]: r for r in files.walk(spark, base, manifest, most_bytes=40).collect()}
    assert sorted(rows) == ["one/a.py", "one/bad.md", "one/sub dir/b+c.py", "two/q.js"]
    assert rows["one/bad.md"]["text"] == "caf�" and rows["one/a.py"]["lang"] == "python"
    assert {r["key"] for r in files.walk(spark, base, manifest, ["two"]).collect()} == {"two/q.js"}
    docs = {"docs": {"repo": "one", "include_globs": ["*.md", "**/*.py", "*.py"]}}
    assert {r["path"]: r["glob"] for r in files.walk_docs(spark, base, docs, 40).collect()} == {"a.py": 1, "bad.md": 0, "sub dir/b+c.py": 1, "skip_me.py": 1, "vendor/v.py": 1}
    assert files.walk_docs(spark, base, {}).isEmpty()
    store = files.datastore(spark, os.path.join(base, "one"))
    assert files.folder_sizes(store, 1).filter("folder = 'vendor'").first()["files"] == 1
    assert files.extension_counts(store).first()["ext"] == "py"
    code = spark.createDataFrame([("a.js", "js", "x"), ("a.min.js", "js", "x"), ("b.js", "js", " "), ("c.sh", "shell", "x"), ("d.js", "js", "y" * 2001)], "path string, lang string, text string")
    assert [r["path"] for r in files.supported(code).collect()] == ["a.js"]


def test_history(spark, tmp_path):
    repo = str(tmp_path / "g")
    write(repo + "/a.py", "1")
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": os.devnull}
    git = lambda *a, day: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, env=env | {"GIT_COMMITTER_DATE": f"{day}T00:00:00Z", "GIT_AUTHOR_DATE": f"{day}T00:00:00Z"})
    for i, day in enumerate(("2020-01-01", "2021-01-01")):
        write(repo + "/a.py", str(i))
        write(repo + f"/f{i}.py", "f")
        if not i:
            git("init", "-q", day=day)
        git("add", "-A", day=day)
        git("commit", "-qm", "c", day=day)
    got = {r["path"]: r["last_commit"] for r in files.last_commits(files.git_log(spark, repo)).collect()}
    assert got == {"a.py": "2021-01-01", "f0.py": "2020-01-01", "f1.py": "2021-01-01"}
    assert files.git_log(spark, str(tmp_path / "none")).isEmpty()
    reg = spark.createDataFrame([(0, "r", "s", "mort"), (1, "r", "s", "actif"), (2, "r", None, "x"), (3, "r", "t", "")], "seq int, repo string, script string, status string")
    assert [tuple(r) for r in files.status_map(reg).collect()] == [("r/s", "actif")]


def test_versioned_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.open_table(spark, path) is None and tables.delete_keys(spark, path, spark.range(1).selectExpr("'a' AS key")) is None
    rows = spark.createDataFrame([("1", "a", "r", "apple pie"), ("2", "b", "r", "pear pie"), ("3", "c", "s", None)], "id string, key string, repo string, contextualized string")
    tables.append(rows.filter("key <> 'c'"), path, ("repo",))
    tables.append(rows.filter("key = 'c'"), path, ("repo",))
    assert tables.open_table(spark, path).count() == 3
    tables.delete_keys(spark, path, rows.filter("key = 'a'").select("key"))
    assert sorted(r["key"] for r in tables.open_table(spark, path).collect()) == ["b", "c"]
    new = tables.rebuild(spark, path, str(tmp_path / "p"))
    assert new.count() == 2 and len([f for f in os.listdir(f"{path}/v{tables.current_version(spark, path)}") if f.endswith(".parquet")]) == 1
    assert sorted(r["term"] for r in tables.open_table(spark, str(tmp_path / "p")).collect()) == ["pear", "pie"]


def test_upsert_is_resumable(spark, tmp_path):
    old = spark.createDataFrame([("r/a", "r", "1", "v"), ("r/gone", "r", "1", "v"), ("s/x", "s", "1", "v")], "key string, repo string, sha string, embed_ver string")
    walked = spark.createDataFrame([("r/a", "r", "2"), ("r/new", "r", "1")], "key string, repo string, sha string")
    todo, drop = retrieval.changes(walked, old, "v")
    assert sorted(r["key"] for r in todo.collect()) == ["r/a", "r/new"] and sorted(r["key"] for r in drop.collect()) == ["r/a", "r/gone"]
    new = retrieval.upsert(old, todo.selectExpr("key", "repo", "sha", "'v' AS embed_ver"), drop)
    again = retrieval.changes(walked, new, "v")
    assert sorted(r["key"] for r in new.collect()) == ["r/a", "r/new", "s/x"] and again[0].isEmpty() and again[1].isEmpty()


@pytest.mark.parametrize("name", ["g.json", "g.json.gz"])
def test_graph_file(spark, tmp_path, name):
    path = str(tmp_path / name)
    nodes = spark.createDataFrame([("a", "a", 1), ("b", "b", 2)], "id string, name string, start_line int")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.35)], "src string, dst string, conf double")
    tables.write_graph(nodes, edges, path)
    assert (gzip.open if name.endswith("gz") else open)(path).read(1) in (b"{", "{")
    n, e = tables.read_graph(spark, path)
    assert sorted((r["id"], r["start_line"]) for r in n.collect()) == [("a", 1), ("b", 2)]
    assert sorted(tuple(r) for r in e.collect()) == [("a", "b", 0.9), ("b", "a", 0.35)]


def test_sidecar_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("r/a", "2024-01-01", None), ("r/b", None, "mort")], "key string, last_commit string, status string")
    tables.write_sidecar(rows, {"r": {"repo_source": "hub"}}, str(tmp_path / "m.json"))
    assert json.load(open(tmp_path / "m.json")) == {"repo_source": {"r": "hub"}, "repo_ref": {"r": ""}, "web_base": {"r": ""}, "last_commit": {"r/a": "2024-01-01"}, "status": {"r/b": "mort"}}
    t = spark.createDataFrame([("t1", "Accounts", "members", None, "to confirm", "3 years", "c", None, ["users", "old"])], "id string, purpose string, subjects string, data string, legal_basis string, retention string, contract string, note string, tables array<string>")
    text = reports.register_markdown(t, spark.createDataFrame([("users",)], "name string"))
    assert "**1 treatments**, **2 tables**" in text and "- `users`\n" in text and "`old` (dead or not flagged)" in text and "note" not in text and "**data**: -" in text
    from skarn.operators import inventory

    parts = inventory.reconcile(spark.createDataFrame([("s://d/t",), ("s://d/u",)], "name string"), inventory.patterns(spark, ["s://d/t", "s://d/ghost"]))
    text = reports.reconcile_markdown(parts)
    assert "matched: **1**" in text and "- s://d/ghost" in text and "- s://d/u" in text


def test_a_crash_at_any_point_of_a_commit_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda a, b: spark.range(a, b).withColumnRenamed("id", "key")
    tables.append(frame(0, 10), path)
    os.remove(f"{path}/CURRENT")  # the name is gone
    assert tables.current_version(spark, path) == 1 and tables.open_table(spark, path).count() == 10
    tables.append(frame(10, 11), path)
    assert tables.open_table(spark, path).count() == 11
    os.makedirs(f"{path}/v3")  # a version that was being written
    write(f"{path}/v3/part.parquet.tmp", "x")
    assert tables.current_version(spark, path) == 2
    tables.delete_keys(spark, path, frame(0, 5))
    assert tables.current_version(spark, path) == 4 and tables.open_table(spark, path).count() == 6
    os.remove(f"{path}/CURRENT")
    assert tables.current_version(spark, path) == 4
