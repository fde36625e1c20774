"""S1 tree listing, S2 inventory schema, S4 / S5 history round trip."""

import os

import pytest
from pyspark.sql import functions as F

from treeline.sources import inventory as INV
from treeline.sources import trees as TR


def _tree(root, files):
    for rel, text in files.items():
        full = os.path.join(root, *rel.split("/"))
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as fh:
            fh.write(text)


def test_scan_trees_keeps_and_prunes(spark, tmp_path):
    _tree(str(tmp_path / "alpha"), {
        "notes.md": "", "core/engine.py": "import json\n\nvalue = 1", "checks/test_engine.py":
        "def test_value():\n    assert True", "venv/x.py": "", "core/__init__.py": "", ".env": "A=2",
        "node_modules/y/z.js": "", "alpha.egg-info/top.txt": "", "manual/.DS_Store": ""})
    _tree(str(tmp_path / "beta"), {"run.py": "print(2)"})
    rows = TR.scan_trees(spark, str(tmp_path)).collect()
    got = {(r["repo_id"], r["relative_path"]) for r in rows}
    assert got == {("alpha", "notes.md"), ("alpha", "core/engine.py"), ("alpha", "checks/test_engine.py"),
                   ("alpha", "core/__init__.py"), ("alpha", "manual/.DS_Store"), ("beta", "run.py")}
    by = {r["relative_path"]: r for r in rows}
    assert by["core/engine.py"]["content"].startswith("import json")
    assert by["notes.md"]["content"] is None           # only .py text is read
    # walk order: root files first, then top-level directories in order
    a = sorted((r["file_seq"], r["relative_path"]) for r in rows if r["repo_id"] == "alpha")
    assert [p for _, p in a][0] == "notes.md"


def test_scan_trees_links_line_ends_and_unreadable_files(spark, tmp_path):
    _tree(str(tmp_path / "t"), {"src/a.py": "x = 1"})
    (tmp_path / "t/src/w.py").write_bytes(b"a = 1\r\nb = 2\rc = 3\n")
    os.symlink(str(tmp_path / "nowhere.py"), str(tmp_path / "t/src/gone.py"))
    os.symlink(str(tmp_path / "nowhere.py"), str(tmp_path / "t/gone.py"))
    os.symlink(str(tmp_path / "t/src"), str(tmp_path / "t/linked"))
    rows = {r.relative_path: r for r in TR.scan_trees(spark, str(tmp_path)).collect()}
    assert set(rows) == {"gone.py", "src/a.py", "src/w.py", "src/gone.py"}   # no link is walked
    assert rows["src/gone.py"].content is None and rows["src/gone.py"].size == 0
    assert rows["src/w.py"].content == "a = 1\nb = 2\nc = 3\n"
    with pytest.raises(ValueError):
        TR.scan_trees(spark, "hdfs://host/trees")


def test_inventory_text_of_binary_content(spark):
    df = spark.createDataFrame([("r", 1, "a.py", 3, "x='\ufffd'\r\n".encode()), ("r", 2, "b.py", 3, b"y=\xff1")],
                               "repo_id string, file_seq bigint, relative_path string, size bigint, content binary")
    got = {r.relative_path: (r.content, r.text_ok) for r in INV.validate_inventory(df).collect()}
    assert got == {"a.py": ("x='\ufffd'\n", True), "b.py": ("y=1", False)}


def test_inventory_schema_and_history_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, "a.py", 3, b"x=1")],
                               "repo_id string, file_seq int, relative_path string, size int, content binary")
    v = INV.validate_inventory(df)
    assert dict(v.dtypes) == {"repo_id": "string", "file_seq": "bigint", "relative_path": "string",
                              "size": "bigint", "content": "string", "text_ok": "boolean"}
    assert v.collect()[0]["content"] == "x=1"
    path = str(tmp_path / "hist")
    assert INV.read_history(spark, path).count() == 0             # absent -> empty
    h = spark.createDataFrame([("r", 1, "move", "a.py", "src/a.py", True, False, "ok", "low")],
                              "repo_id string, seq bigint, action string, source string, target string, "
                              "success boolean, skipped boolean, message string, risk string") \
        .withColumn("executed_at", F.localtimestamp())
    INV.append_history(h, path)
    INV.append_history(h.withColumn("seq", F.lit(2).cast("bigint")), path)
    assert sorted(r["seq"] for r in INV.read_history(spark, path).collect()) == [1, 2]


def test_write_proposals_formats(spark, tmp_path):
    import json

    from conftest import SF_SMALL
    from treeline.plans import entrypoints as EP
    from treeline.sources import fixtures as fx
    p = EP.propose(fx.raw_files(spark, SF_SMALL))
    n = p.proposals.count()
    INV.write_proposals(p.proposals, str(tmp_path / "j"), "json")
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert len(lines) == n
    assert all(set(x["proposal"]) == {"action", "source", "target", "reason", "risk", "details"} for x in lines)
    assert any(x["proposal"]["target"] is None for x in lines)       # nulls are written
    INV.write_proposals(p.proposals, str(tmp_path / "t"), "text")
    texts = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert len(texts) == n
    import re
    numbers = {}
    for t in texts:
        repo, rest = t.split("\t", 1)
        numbers.setdefault(repo, []).append(int(re.match(r"\[(\d+)\] ", rest).group(1)))
    for repo, ns in numbers.items():        # 1..k per repository, each once
        assert sorted(ns) == list(range(1, len(ns) + 1)), repo


def test_text_sink_spreads_one_repository(spark, tmp_path):
    from conftest import SF_SMALL
    from treeline.plans.catalog import tables_for
    p = tables_for(spark, SF_SMALL).proposals
    repo = p.groupBy("repo_id").count().orderBy("count", ascending=False).first()["repo_id"]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        INV.write_proposals(p.filter(p.repo_id == repo), str(tmp_path / "t"), "text")
    finally:
        spark.conf.set(key, before)
    files = [f.read_text().splitlines() for f in (tmp_path / "t").glob("part-*")]
    assert sum(bool(lines) for lines in files) > 1


def test_proposals_query_goes_through_the_sink(spark, monkeypatch):
    from conftest import SF_SMALL
    from treeline.plans.catalog import QUERIES
    written = []
    sink = INV.write_proposals
    monkeypatch.setattr(INV, "write_proposals", lambda *a, **k: (written.append(a[1]), sink(*a, **k)))
    assert QUERIES["S3_write_proposals"](spark, SF_SMALL).count() > 0 and len(written) == 1


def test_read_reference_history(spark, tmp_path):
    import json
    entries = [
        {"timestamp": "2024-05-01T10:00:00.123456", "action": "move", "source": "a.py",
         "target": "src/a.py", "success": True, "skipped": False, "message": "Moved a.py -> src/a.py",
         "risk": "low"},
        {"timestamp": "2024-05-01T10:05:00", "action": "ROLLBACK", "source": "src/a.py",
         "target": "a.py", "success": True, "skipped": False, "message": "Rolled back", "risk": "high"},
    ]
    (tmp_path / "repoX.json").write_text(json.dumps(entries, indent=2))
    h = INV.read_reference_history(spark, str(tmp_path / "*.json")).orderBy("seq").collect()
    assert [(r["repo_id"], r["seq"], r["action"], r["target"]) for r in h] == [
        ("repoX", 1, "move", "src/a.py"), ("repoX", 2, "ROLLBACK", "a.py")]
    assert h[0]["executed_at"].microsecond == 123456


def test_bad_utf8_keeps_imports_but_no_statements(spark, tmp_path):
    from pyspark.sql import functions as F

    from treeline.operators import files as FL
    root = tmp_path / "trees" / "r"
    root.mkdir(parents=True)
    (root / "good.py").write_bytes(b"import os\n")
    (root / "bad.py").write_bytes(b"import os\n# caf\xe9\n")
    raw = TR.scan_trees(spark, str(tmp_path / "trees"))
    files = {r["relative_path"]: r for r in FL.build_files(raw).collect()}
    assert files["bad.py"]["imports"] == ["os"] and files["bad.py"]["stmts"] == []
    assert files["good.py"]["imports"] == ["os"] and len(files["good.py"]["stmts"]) == 1
    # the same through a binary inventory column
    df = spark.createDataFrame([("r", 1, "bad.py", 12, b"import os\n# caf\xe9\n")],
                               "repo_id string, file_seq bigint, relative_path string, size bigint, "
                               "content binary")
    v = INV.validate_inventory(df).collect()[0]
    assert v["text_ok"] is False and v["content"] == "import os\n# caf\n"
    f = FL.build_files(INV.validate_inventory(df)).collect()[0]
    assert f["imports"] == ["os"] and f["stmts"] == []


def test_scan_trees_does_not_depend_on_partitions(spark, tmp_path):
    _tree(str(tmp_path / "repoA"), {"README.md": "", "src/app.py": "import os\n", "src/pkg/m.py": "x = 1\n",
                                    "venv/s.py": "", "docs/a.md": "", "build/x.py": ""})
    _tree(str(tmp_path / "repoB"), {"main.py": "print(1)", "lib/u.py": "import sys\n"})
    cols = ["repo_id", "file_seq", "relative_path", "size", "content", "text_ok"]
    a = sorted(tuple(r) for r in TR.scan_trees(spark, str(tmp_path), num_partitions=1).select(*cols).collect())
    b = sorted(tuple(r) for r in TR.scan_trees(spark, str(tmp_path), num_partitions=3)
               .select(*cols).collect())
    assert a == b and len(a) == 6
