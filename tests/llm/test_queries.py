"""Registered queries against SQL, and against plain Python where SQL cannot express them."""

import os

import duckdb
import pytest
from brute import SF_SMALL, aligned, classes, contained, links, tokens

from treeline.llm.catalog import QUERIES
from treeline.llm.common import table, tokenizer_json
from treeline.llm.sql import ORACLE

TABLES = ("documents", "benchmark", "labels", "pages", "conversations")


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    def plain(x):
        return round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF_SMALL)
    want = duck(SF_SMALL).sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == \
        canonical(want.fetchall(), want.columns)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF_SMALL, "documents").select("doc_id", "text").orderBy("doc_id").collect()


def test_decontaminate_equals_brute_force(spark, docs):
    items = table(spark, SF_SMALL, "benchmark").collect()
    want = {(docs[j].doc_id, items[i].item_id): share for (j, i), share in
            contained([r.text for r in items], [r.text for r in docs]).items()}
    got = {(r.doc_id, r.item_id): r.containment
           for r in QUERIES["op2_decontaminate"](spark, SF_SMALL).collect()}
    assert got == want and want


def test_jaccard_join_equals_brute_force(spark, docs):
    near = links([r.text for r in docs])
    label = classes(near)
    want = {d.doc_id: (docs[label[k]].doc_id, len(near[k])) for k, d in enumerate(docs)}
    got = {r.doc_id: (r.class_id, r.n_links)
           for r in QUERIES["op10_ngram_jaccard"](spark, SF_SMALL).collect()}
    assert got == want and any(n for _, n in want.values())


def test_token_files_equal_the_library(spark, docs):
    from tokenizers import Tokenizer
    want = tokens(Tokenizer.from_str(tokenizer_json()), [r.text for r in docs])
    got = QUERIES["op7_token_files"](spark, SF_SMALL).orderBy("doc_id").collect()
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_alignment_equals_brute_force(spark, docs):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    want = aligned([r.text for r in docs], Tokenizer.from_str(tokenizer_json()),
                   SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")))
    got = QUERIES["op11_token_alignment"](spark, SF_SMALL).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in docs]
    assert [tuple(r)[1:] for r in got] == want


def test_toxicity_on_held_out_labels(spark):
    from treeline.llm import toxicity
    sf = SF_SMALL.replace("0.001", "0.1")
    texts, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    train, held = labels.filter("doc_id % 5 <> 0"), labels.filter("doc_id % 5 = 0")
    model = toxicity.fit(texts, toxicity.severity_grades(texts, train))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    rows = toxicity.score(texts, model).join(held, "doc_id").collect()
    hit = sum(r.toxic == 1 and r.p_toxic >= 0.5 for r in rows)
    false = sum(r.toxic == 0 and r.p_toxic >= 0.5 for r in rows)
    assert hit >= 0.95 * sum(r.toxic for r in rows) and false <= 0.01 * len(rows)
    assert all(0 <= r.severity <= 2 for r in rows)
    assert {r.doc_id for r in rows if r.grade >= 1} >= {r.doc_id for r in rows if r.grade == 2}


def test_quality_on_held_out_labels(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    label = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = QUERIES["op13_quality_votes"](spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    low, high = ([r.score for r in held if label[r.doc_id] == q] for q in (0, 1))
    beaten = sum((h > x) + 0.5 * (h == x) for x in low for h in high)
    assert beaten >= 0.97 * len(low) * len(high)
    assert sum(x < 0.5 for x in low) >= 0.9 * len(low)
    assert sum(h >= 0.5 for h in high) >= 0.99 * len(high)
