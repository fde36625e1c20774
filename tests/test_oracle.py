"""Every registered query against its DuckDB oracle on the smallest tables.

The same check the driver runs at sf0.01; queries without an oracle
(sequential jobs) must still run and return rows.
"""

import os
import sys


from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))


def test_all_queries_match_oracle(spark):
    from compare import compare
    from treeline.plans.catalog import QUERIES
    res = compare(spark, SF_SMALL, list(QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if v != "ok" and not v.startswith("rows-only")}
    assert not bad, bad
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    rows_only = set(QUERIES) - set(E.oracle_sql())
    assert rows_only == {"G1_apply_moves", "G1_new_inventory", "G2_rollback",
                         "G2_new_inventory"}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert {"repo_id", "action", "source", "target", "reason", "risk"} <= set(df.columns)
