"""The five stages of the pipeline replayed in plain Python and DuckDB."""

import duckdb
import pandas as pd
import pytest
from brute import SF_SMALL, classes, contained, links, tokens

import corpus_pipeline
from treeline.llm import toxicity
from treeline.llm.common import table, tokenizer_json
from treeline.llm.sql import ORACLE


def _key(r):
    return (r.doc_id is not None, r.doc_id or 0, r.text or "")


@pytest.fixture(scope="module")
def trace(spark):
    """(name, rows in, rows out) of every stage, and the rows of ``run``."""
    seen = []

    def watched(name, stage):
        def call(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            if name != "token_files":
                out = corpus_pipeline.write_table(out, f"watched-{name}")
            seen.append((name, docs.collect(), out))
            return out
        return name, call

    stages = corpus_pipeline.STAGES
    corpus_pipeline.STAGES = [watched(*s) for s in stages]
    try:
        result = corpus_pipeline.run(spark, SF_SMALL).collect()
    finally:
        corpus_pipeline.STAGES = stages
    return {name: (rows, result if name == "token_files" else out.collect())
            for name, rows, out in seen}


def test_order_and_columns(spark, trace):
    assert list(trace) == ["toxicity", "ngram_jaccard", "decontaminate", "mixing", "token_files"]
    columns = table(spark, SF_SMALL, "documents").columns
    names = list(trace)
    for name, following in zip(names, names[1:]):
        out = trace[name][1]
        assert out and list(out[0].asDict()) == columns
        assert sorted(map(str, out)) == sorted(map(str, trace[following][0]))


def test_toxic_documents_go(spark, trace):
    """What the fitted model rejects goes; sf0.001 may have none, so sf0.01 is looked at too."""
    larger = "/root/testdata/sf0.01"
    docs = table(spark, larger, "documents")
    more = (docs.collect(), corpus_pipeline.reject_toxic(spark, docs, larger).collect())
    rejected = 0
    for sf_dir, (rows, out) in ((SF_SMALL, trace["toxicity"]), (larger, more)):
        docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        model = toxicity.fit(docs, toxicity.severity_grades(docs, labels))
        bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.p_toxic >= toxicity.REJECT}
        rejected += len(bad)
        assert sorted(out, key=_key) == sorted((r for r in rows if r.doc_id not in bad), key=_key)
    assert rejected


def test_one_document_of_each_class_stays(trace):
    rows, out = trace["ngram_jaccard"]
    rows = sorted(rows, key=_key)
    label = classes(links([r.text for r in rows]))
    assert sorted(out, key=_key) == [r for k, r in enumerate(rows) if label[k] == k]
    assert len(out) < len(rows)


def test_documents_with_benchmark_items_go(spark, trace):
    rows, out = trace["decontaminate"]
    items = [r.text for r in table(spark, SF_SMALL, "benchmark").collect()]
    bad = {j for j, _ in contained(items, [r.text for r in rows])}
    assert bad and sorted(out, key=_key) == sorted((r for k, r in enumerate(rows) if k not in bad),
                                                   key=_key)


def test_documents_are_drawn_as_the_sql_draws_them(trace):
    rows, out = trace["mixing"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in rows]))
    want = [r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE['op3_mixing']})").fetchall()]
    assert sorted(r.doc_id for r in out) == sorted(want)
    assert {tuple(r) for r in out} <= {tuple(r) for r in rows}


def test_token_files_hold_what_was_drawn(trace):
    from tokenizers import Tokenizer
    rows, out = trace["token_files"]
    rows = sorted(rows, key=_key)
    want = tokens(Tokenizer.from_str(tokenizer_json()), [r.text for r in rows])
    got = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_nulls_repeated_rows_and_no_rows(spark):
    """The stages on awkward documents and on none: the columns stay, nothing crashes."""
    from brute import nasty, nothing
    for make in (nasty, nothing):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            docs = corpus_pipeline.write_table(stage(spark, docs, SF_SMALL), f"edge-{name}")
            assert docs.columns == make(spark).columns
        out = corpus_pipeline.token_files(spark, docs, SF_SMALL)
        assert out.count() == docs.count()
