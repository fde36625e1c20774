"""A10 documents in chunks and A8 members, against documents built in plain Python."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from treeline.functions import constants as K
from treeline.operators import proposals as PR
from treeline.operators import reports as RE
from treeline.operators import repo as RP
from treeline.plans.context import Tables


def documents(chunks):
    texts = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.repo_id, r.chunk_no)):
        assert r.n_bytes == len(r.text.encode())
        texts.setdefault(r.repo_id, []).append(r)
    for rows in texts.values():
        assert rows[0].chunk_no == 0 and len({r.chunk_no for r in rows}) == len(rows)
    return {k: "".join(r.text for r in rows) for k, rows in texts.items()}


def plain(t):
    """The single-folder tool's documents: proposals in order, every path of a duplicate group."""
    files, props = t.files.collect(), t.proposals.collect()
    out = {r.repo_id: {"total_proposals": 0, "proposals": [], "summary": {"by_action": {}, "by_risk": {}}}
           for r in t.raw.select("repo_id").distinct().collect()}
    groups = {}
    for f in sorted(files, key=lambda f: f.file_seq):
        if f.name not in K.DUPLICATE_EXEMPT:
            groups.setdefault((f.repo_id, f.name.lower()), []).append(f.relative_path)
    for p in sorted(props, key=lambda p: (p.repo_id, p.phase, p.ord)):
        doc = out[p.repo_id]
        details = {k: v for k, v in p.details.asDict().items() if v is not None}
        if p.phase == 2:
            details["all_duplicates"] = groups[p.repo_id, p.source.split("/")[-1].lower()]
            assert details["total_count"] == len(details["all_duplicates"])
        doc["total_proposals"] += 1
        doc["proposals"].append({"action": p.action, "source": p.source, "target": p.target,
                                 "reason": p.reason, "risk": p.risk, "details": details})
        for key in ("action", "risk"):
            by = doc["summary"][f"by_{key}"]
            by[p[key]] = by.get(p[key], 0) + 1
    return out


def test_documents_in_chunks(spark):
    t = Tables(spark, SF_SMALL)
    members = PR.all_duplicates(t.files, t.proposals)
    # a repository without files or proposals has a document, too
    repos = RP.repo_ids(t.raw).unionByName(spark.createDataFrame([("nothing",)], "repo_id string"))
    want = plain(t) | {"nothing": {"total_proposals": 0, "proposals": [],
                                   "summary": {"by_action": {}, "by_risk": {}}}}
    for size in (RE.CHUNK_BYTES, 300):
        chunks = RE.document_chunks(t.proposals, members, repos, size).persist()
        got = documents(chunks)
        assert {k: json.loads(v) for k, v in got.items()} == want
        longest = max(len(json.dumps(p)) for d in want.values() for p in d["proposals"]) + 200
        assert chunks.agg(F.max("n_bytes")).first()[0] < size + longest
        assert (chunks.count() > len(want)) == (size == 300)
        chunks.unpersist()


def test_a_group_with_a_third_of_the_files_is_cut(spark):
    """Members of one large group are numbered over many slices, in file order."""
    t = Tables(spark, SF_SMALL)
    extra = spark.range(3000).selectExpr("'huge' AS repo_id", "id * 7 AS file_seq", "'util.py' AS name",
                                         "concat('d\"', id, '/util.py') AS relative_path")
    props = PR.duplicate_groups(extra, spark.createDataFrame([("huge", "python_dominant")],
                                                             "repo_id string, repo_type string"))
    m = PR.all_duplicates(extra, props)
    rows = m.orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 3001)) and {r.ord for r in rows} == {0}
    assert [r.file_seq for r in rows] == [7 * k for k in range(3000)]
    text = documents(RE.document_chunks(props, m, props.select("repo_id"), 10_000))["huge"]
    doc = json.loads(text)
    assert doc["proposals"][0]["details"]["all_duplicates"] == [f'd"{k}/util.py' for k in range(3000)]
    assert t.files is not None
