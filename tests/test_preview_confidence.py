"""Tree drawing against a plain-Python renderer; confidence scorecard."""

import random


from treeline.operators import confidence as CF
from treeline.operators import preview as PV


def draw(paths):
    """Independent rendering of the drawing rules (nested dicts)."""
    root = {}
    kinds = {}
    for p in sorted(paths, key=lambda s: s.split("/")):
        node, parts = root, p.split("/")
        for i, part in enumerate(parts):
            key = "/".join(parts[: i + 1])
            if key not in kinds:
                kinds[key] = i == len(parts) - 1
                node[part] = {}
            if kinds[key]:
                break
            node = node[part]
    lines = []

    def walk(node, prefix, base):
        kids = sorted(node, key=lambda n: (kinds["/".join(base + [n])], n))
        for i, name in enumerate(kids):
            last = i == len(kids) - 1
            is_file = kinds["/".join(base + [name])]
            lines.append(prefix + ("└── " if last else "├── ") + name + ("" if is_file else "/"))
            if not is_file:
                walk(node[name], prefix + ("    " if last else "│   "), base + [name])
    walk(root, "", [])
    return lines


def _spark_draw(spark, paths):
    df = spark.createDataFrame([("r", "before", p) for p in paths], "repo_id string, side string, path string")
    keys = ["repo_id", "side"]
    lines = PV.tree_lines(PV.tree_nodes(df, keys), keys).orderBy("line_no").collect()
    return [r["text"] for r in lines]


def test_tree_example(spark):
    paths = ["a.py", "src/b.py", "src/c/d.py", "tests/x.py"]
    assert _spark_draw(spark, paths) == [
        "├── src/", "│   ├── c/", "│   │   └── d.py", "│   └── b.py", "├── tests/", "│   └── x.py",
        "└── a.py"]


def test_tree_random_against_python(spark):
    rng = random.Random(7)
    names = ["a", "b", "src", "x.py", "y.md", "z"]
    for _ in range(4):
        paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
                        for _ in range(rng.randint(3, 25))})
        assert _spark_draw(spark, paths) == draw(paths), paths


def test_confidence_scorecard(spark):
    types = spark.createDataFrame([("p", "python_dominant"), ("n", "non_python"), ("m", "mixed")],
                                  "repo_id string, repo_type string")
    summary = spark.createDataFrame([("p", 1), ("n", 0), ("m", 0)], "repo_id string, test_files bigint")
    props = spark.createDataFrame(
        [("p", "move", "high")] * 4 + [("p", "move", "medium")] * 6 + [("p", "move", "low")] * 12
        + [("m", "move", "low")] * 2,
        "repo_id string, action string, risk string")
    warn = spark.createDataFrame([("p", 5), ("n", 0), ("m", 0)], "repo_id string, import_warnings_count bigint")
    c = {r["repo_id"]: r for r in CF.confidence(types, summary, props, warn).collect()}
    p = c["p"]
    # 100 - 60 (3 capped highs) - 15 (medium > 5) - 30 (warnings capped) + 5 - 15 (> 20 moves) = -15
    assert p["score"] == -15 and p["confidence_level"] == "LOW"
    assert p["risk_factors"] == ["Large number of changes (22 moves)", "4 high-risk moves",
                                 "6 medium-risk moves", "5 potential import breakage(s)"]
    assert p["positive_factors"] == ["Python-dominant repository",
                                     "Tests detected (easier to validate changes)",
                                     "Dry-run mode (simulation only)"]
    n = c["n"]
    assert n["score"] == 75 and n["confidence_level"] == "HIGH"
    assert n["positive_factors"] == ["No structural changes proposed", "Dry-run mode (simulation only)"]
    m = c["m"]
    assert m["score"] == 100 + 5 - 10 and m["positive_factors"] == [
        "mixed repository", "Small number of changes (2 moves)", "All moves are low-risk (2 moves)",
        "No import breakage warnings", "Dry-run mode (simulation only)"]
    assert m["risk_factors"] == ["No tests detected (harder to validate)"]
    assert m["interpretation"] == "Interpretation: Changes appear safe to apply."


def test_tree_of_deep_paths_and_paths_below_files(spark):
    """Running state over many slices: a depth of 40, files with paths below them, one large group."""
    from treeline.operators import preview as PV
    deep = "/".join(f"d{k}" for k in range(39))
    paths = [("a", p) for p in (f"{deep}/x.py", f"{deep}/y.py", "d0/d1/z.py", "d0/other/z.py", "top.py",
                                "f", "f/below", "f/below/more.py", "f-g/h", "fa", "f!/h")]
    paths += [("b", f"p{k % 9}/q{k % 5}/r{k}") for k in range(900)]
    nodes = PV.tree_nodes(spark.createDataFrame(paths, "repo_id string, path string").repartition(3), ["repo_id"])
    rows = nodes.collect()
    assert len({(r.repo_id, r.node) for r in rows}) == len(rows)

    def draw(listed):
        """The tree by plain recursion."""
        tops = {p for p in listed if not any(p.startswith(q + "/") for q in listed)}
        tree = {}
        for p in sorted(tops):
            at = tree
            *dirs, name = p.split("/")
            for d in dirs:
                at = at.setdefault(d, {})
            at[name] = None
        lines = []

        def walk(at, prefix):
            entries = sorted(at.items(), key=lambda e: (e[1] is None, e[0]))
            for i, (name, below) in enumerate(entries):
                last = i == len(entries) - 1
                lines.append(prefix + (PV.ELBOW if last else PV.TEE) + name + ("" if below is None else "/"))
                if below is not None:
                    walk(below, prefix + (PV.SPACE if last else PV.PIPE))
        walk(tree, "")
        return lines

    for few in (False, True):
        got = {}
        for r in PV.tree_lines(nodes, ["repo_id"], few).orderBy("line_no").collect():
            got.setdefault(r.repo_id, []).append((r.line_no, r.text))
        for repo in ("a", "b"):
            want = draw([p for r, p in paths if r == repo])
            assert got[repo] == list(enumerate(want, 1))


def test_tree_plans_explode_no_ancestors(spark):
    from conftest import SF_SMALL
    from treeline.plans.context import Tables
    from treeline.operators import preview as PV
    t = Tables(spark, SF_SMALL)
    keys = ["repo_id", "side"]
    nodes = PV.tree_nodes(PV.affected_paths(t.proposals), keys)
    text = PV.tree_lines(nodes, keys)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text             # nodes come out of one explosion, written once
    diff = PV.tree_diff(t.proposals)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in diff and len(diff.splitlines()) < 150
