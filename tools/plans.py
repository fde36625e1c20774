"""Write PLANS.md: condensed physical plans of the headline operators.

python tools/plans.py [sf_dir]   (default /root/testdata/sf0.01)
"""
from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from treeline.operators import facts as FA  # noqa: E402
from treeline.operators import imports as IM  # noqa: E402
from treeline.operators import moves as MV  # noqa: E402
from treeline.operators import preview as PV  # noqa: E402
from treeline.operators import proposals as PR  # noqa: E402
from treeline.operators import repo as RP  # noqa: E402
from treeline.operators import files as FL  # noqa: E402
from treeline.plans.context import Tables  # noqa: E402
from treeline.session import get_spark  # noqa: E402


def condensed(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n")[0]
    facts = []
    for block in re.split(r"\n\(\d+\) ", text)[1:]:
        head = block.splitlines()[0].strip()
        for key in ("PushedFilters", "ReadSchema", "Join type", "Partition", "Aggregate Attributes"):
            for line in block.splitlines():
                if line.startswith(key) and len(line) < 400:
                    facts.append(f"{head}: {line}")
    return tree + "\n\n" + "\n".join(dict.fromkeys(facts))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    t = Tables(spark, sf)
    approved = MV.with_decisions(t.moves, t.decisions)
    items = [
        ("describe (F1 + P1 + P3 parse + P2 + J1 + P4)", FL.build_files(t.raw)),
        ("repository types (A4-A6)", RP.repo_types(t.files, t.raw)),
        ("all proposals (U1)", PR.all_proposals(t.files, t.types)),
        ("duplicate groups (A8, first-k examples)", PR.duplicate_groups(t.files, t.types)),
        ("import statements (P3 table)", FA.statements(t.files)),
        ("import warnings (J7)", IM.import_warnings(t.moves, t.files, t.raw)),
        ("tree preview (T3)", PV.tree_diff(t.proposals)),
        ("dry-run validation (J10)", MV.validate_moves(approved, t.raw)),
    ]
    out = ["# PLANS", "",
           f"Physical plans (`explain(\"formatted\")`, before AQE re-planning) at `{sf}`, "
           "condensed to the operator tree and the scan / join / exchange facts. "
           "Regenerate with `python tools/plans.py`.", "",
           "At this size every dimension side is under `spark.sql.autoBroadcastJoinThreshold`, so "
           "joins plan as broadcasts. At scale, the same plans become shuffle (sort-merge) joins on "
           "`(repo_id, ...)`, because the threshold is checked against the estimated size and again "
           "at run time by AQE. No `broadcast()` hint is forced anywhere.", ""]
    for title, df in items:
        out += [f"## {title}", "", "```", condensed(df), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
