"""The batch job's commands end to end on a small folder of trees."""

import os

from treeline.plans.job import run


def _tree(root, files):
    for rel, text in files.items():
        full = os.path.join(root, *rel.split("/"))
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as fh:
            fh.write(text)


def test_job_commands(spark, tmp_path):
    trees = str(tmp_path / "trees")
    _tree(os.path.join(trees, "r1"), {
        "setup.py": "", "requirements.txt": "", "app.py": "import os\nimport sys\nimport json\n",
        "helpers.py": "import helpers2\n", "notes.md": "", "lib/test_x.py": "def test_a():\n    pass\n",
        "data.csv": "", "a/README.md": "", "b/README.md": "", "pkg/mod1.py": "import numpy\n",
        "pkg/mod2.py": "x = 1\n", "tools/run_x.py": "print(1)\n"})
    out = str(tmp_path / "out")
    run(spark, ["analyze", "--trees", trees, "--out", out + "/a"])
    run(spark, ["propose", "--trees", trees, "--out", out + "/p"])
    props = spark.read.parquet(out + "/p/proposals")
    assert props.filter("action = 'move'").count() > 0
    assert spark.read.text(out + "/p/proposals_json").count() == props.count()
    run(spark, ["preview", "--trees", trees, "--out", out + "/v"])
    assert spark.read.parquet(out + "/v/confidence").count() == 1
    hist = str(tmp_path / "history")
    run(spark, ["apply", "--trees", trees, "--out", out + "/x", "--history", hist, "--execute", "--yes"])
    done = spark.read.parquet(out + "/x/apply_results").filter("success").count()
    assert done > 0
    run(spark, ["rollback", "--history", hist, "--disk", out + "/x/inventory", "--undo-last", "100",
                "--execute", "--out", out + "/r"])
    assert spark.read.parquet(out + "/r/rollback_results").filter("success").count() == done
    run(spark, ["history", "--history", hist, "--out", out + "/h"])
    applied = spark.read.parquet(out + "/x/apply_results").count()      # failures are logged too
    view = spark.read.parquet(out + "/h/history_view")
    assert view.count() == min(20, applied + done)
    assert view.filter("action = 'ROLLBACK'").count() == min(done, 20)
