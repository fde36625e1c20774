"""Physical-plan properties the design relies on (checked with explain)."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from conftest import SF_SMALL
from treeline.operators import ordering as OR
from treeline.operators import proposals as PR
from treeline.plans.context import Tables


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_first_k_limits_before_the_shuffle(spark):
    df = spark.range(0, 10_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    text = plan(OR.first_k(df, ["g"], [F.col("v")], 3))
    head, _, tail = text.partition("Exchange")
    assert "WindowGroupLimit" in head and "WindowGroupLimit" in tail   # final + partial
    assert OR.first_k(df, ["g"], [F.col("v")], 3).count() == 9


def test_number_within_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 5000).alias("v"))
    n = OR.number_within(df, ["g"], [F.col("v")], slices=7)
    rows = n.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"),
                              F.countDistinct("n").alias("k"), F.count("*").alias("c")).collect()
    for r in rows:
        assert (r["lo"], r["hi"], r["k"]) == (1, r["c"], r["c"])
    from pyspark.sql import Window
    check = n.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("v")))
    assert check.filter(F.col("n") != F.col("want")).count() == 0


def test_scans_prune_and_push_down(spark):
    t = Tables(spark, SF_SMALL)
    q = t.files.filter(F.col("extension") == ".py").select("repo_id", "relative_path", "stmts")
    text = plan(q)
    assert "PushedFilters: [IsNotNull(extension), EqualTo(extension,.py)]" in text
    assert "content_sample" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_rules_stay_in_codegen_without_python(spark):
    t = Tables(spark, SF_SMALL)
    text = plan(PR.all_proposals(t.files, t.types))
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text and "MapInPandas" not in text
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # static plan shows the codegen stages
    try:
        text = plan(PR.all_proposals(t.files, t.types))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "codegen id" in text


def test_first_k_beyond_the_partial_limit(spark):
    """A large k numbers the rows instead of sorting a group in one task; same rows."""
    from treeline.operators.ordering import first_k
    df = spark.range(4000).selectExpr("id % 2 AS g", "id")
    got = {(r.g, r.rn, r.id) for r in first_k(df, ["g"], ["id"], 1500).collect()}
    assert got == {(i % 2, i // 2 + 1, i) for i in range(3000)}
    # rows are numbered within range slices; only the slices' counts are summed per group
    plan = first_k(df, ["g"], ["id"], 1500)._jdf.queryExecution().optimizedPlan().toString()
    numbered = [x for x in plan.splitlines() if "row_number()" in x and "windowspecdefinition(" in x]
    assert numbered and all("windowspecdefinition(_slice#" in x for x in numbered)


def _shuffled_scans(df, table: str) -> list[bool]:
    """For every scan of ``table`` in the plan: whether it is shuffled before it is joined."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(x) if c.isalpha() or c == "*"), 0) for x in lines]
    out = []
    for k, line in enumerate(lines):
        if table in line and "FileScan" in line:
            assert "Bucketed: true" in line
            at, shuffled = depth[k], False
            for up in range(k - 1, -1, -1):
                if depth[up] < at:
                    at = depth[up]
                    if "Join" in lines[up]:
                        break
                    shuffled |= "Exchange" in lines[up]
            out.append(shuffled)
    return out


def test_existence_lookups_leave_the_inventory_in_place(spark):
    from treeline.operators import imports as IM
    from treeline.operators import moves as MV
    t = Tables(spark, SF_SMALL)
    name = t.paths._jdf.queryExecution().analyzed().toString().split("treeline_paths_")[1][:32]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        warnings = IM.import_warnings(t.moves, t.files, t.paths)
        checked = MV.validate_moves(MV.with_decisions(t.moves, t.decisions), t.paths)
        for df in (warnings, checked):
            scans = _shuffled_scans(df, name)
            assert scans == [False], scans       # one lookup, no exchange below its join
        # the statements were exploded once, into a table; the parsed files are not read again
        text = warnings._jdf.queryExecution().executedPlan().toString()
        assert "Generate posexplode" not in text and "moved-statements" in text
        on_raw = IM.import_warnings(t.moves, t.files, t.raw)
        for a, b in ((warnings, on_raw), (checked, MV.validate_moves(
                MV.with_decisions(t.moves, t.decisions), t.raw))):
            assert a.count() == b.count() > 0
            assert a.exceptAll(b.select(*a.columns)).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_path_index_spreads_a_large_repository(spark):
    """A repository with a third of all rows fills every bucket alike; directories stand once."""
    from treeline.sources.inventory import path_index
    raw = spark.range(6000).selectExpr(
        "IF(id % 3 = 0, 'big', concat('r', id)) AS repo_id", "id AS file_seq",
        "concat('src/d', id % 7, '/f', id, '.py') AS relative_path", "id AS size")
    index = path_index(raw)
    per = {r.b: r["count"] for r in index.filter("repo_id = 'big'").groupBy(
        F.input_file_name().alias("b")).count().collect()}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(per) == n and max(per.values()) < 2 * 2008 / n
    big = index.filter("repo_id = 'big'")
    assert big.count() == 2000 + 7 + 1 and big.filter("is_dir").count() == 8
    assert big.filter("is_dir AND is_file").count() == 0


def test_proposals_read_the_files_once_for_rows(spark):
    """One scan emits moves, trash and root flags; the duplicate groups read names and paths only."""
    t = Tables(spark, SF_SMALL)
    wide = [x for x in plan(PR.all_proposals(t.files, t.types)).splitlines() if x.startswith("ReadSchema")]
    on_files = [x for x in wide if "file_seq" in x or "name:string" in x]
    assert len([x for x in on_files if "category" in x]) == 1
    assert len(on_files) == 3
    # the rules one by one give the same rows
    typed = PR.with_repo_type(t.files, t.types)
    moves = PR.per_file_proposals(typed).drop("_keep_move")
    whole = moves.unionByName(PR.root_python_flags(typed)).unionByName(PR.duplicate_groups(t.files, t.types))
    whole = PR.suppress_redundant_flags(PR.gate_moves(whole, t.types)).select(*PR.PROPOSAL_COLUMNS)
    got = PR.all_proposals(t.files, t.types)
    assert got.count() == whole.count() > 0 and got.exceptAll(whole).count() == 0


def test_patterns_are_tested_on_distinct_names(spark):
    """One scan and one explosion of the inventory, whatever the number of patterns."""
    from treeline.functions import constants as K
    from treeline.functions import rules as R
    from treeline.operators import files as FL
    t = Tables(spark, SF_SMALL)
    patterns = [*K.IGNORE_FILE_PATTERNS, *K.IGNORE_DIR_GLOBS]
    hits = FL.glob_hits(t.raw, t.paths, patterns)
    text = plan(hits)
    assert text.count("explode(array_distinct(split(relative_path") == 1
    segments = t.raw.select("repo_id", "relative_path", F.explode(
        F.array_distinct(F.split("relative_path", "/"))).alias("segment")).cache()
    want = None
    for p in patterns:
        one = segments.filter(R.glob_match(F.col("segment"), p)).withColumn("pattern", F.lit(p))
        want = one if want is None else want.unionByName(one)
    assert hits.count() == want.count() > 0 and hits.exceptAll(want).count() == 0
    segments.unpersist()
