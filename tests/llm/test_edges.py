"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import re

import pytest
from brute import (LONG, NASTY, SCHEMA, aligned, clashing, classes, contained, links, nasty, nothing,
                   shingles, tokens, words)
from pyspark.sql import functions as F

from treeline.llm import (align, decontaminate, fingerprint, jaccard, licenses, linededup, lm, mixing,
                          quality, tokenfile, toxicity, trie, urlfilter)
from treeline.llm.common import scratch, tokenizer_json


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module", params=["plain", "clashing"])
def docs(spark, request):
    return (nasty if request.param == "plain" else clashing)(spark).repartition(3)


def test_fingerprints(spark, docs):
    got = fingerprint.digests(docs).collect()
    assert len(got) == len(NASTY)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    texts = {(d, len(t or "")): t or "" for d, t, *_ in NASTY}
    for r in got:
        by_text.setdefault(texts[r.doc_id, r.n_chars], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({x for v in by_text.values() for x in v}) == len(by_text)
    assert fingerprint.digests(nothing(spark)).count() == 0
    one = fingerprint.digests(spark.createDataFrame([(1, "a b\nc")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_fingerprint_algebra(spark):
    texts = [("a", "x one. two!\ny three"), ("b", "z four\n\ny three"),
             ("ab", "y three\nz four\nx one. two!\ny three\n"), ("a2", "y three\nx one. two!")]
    prints = {r.n: r for r in fingerprint.with_fingerprint(
        spark.createDataFrame(texts, "n string, text string"), "text", "fp").collect()}
    pair = fingerprint.with_fingerprint(fingerprint.with_fingerprint(
        spark.createDataFrame([(texts[0][1], texts[1][1])], "a string, b string"), "a", "fa"), "b", "fb")
    r = pair.select(fingerprint.plus(F.col("fa"), F.col("fb")).alias("sum"), "fa", "fb").withColumn(
        "rest", fingerprint.minus(F.col("sum"), F.col("fb"))).first()
    assert prints["a"].fp == prints["a2"].fp          # any order
    assert r["sum"] == prints["ab"].fp                # insertion
    assert r["rest"] == prints["a"].fp                # deletion
    assert prints["b"].fp != prints["a"].fp


def test_fingerprint_shingles_without_sentences(spark):
    import random
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts = [" ".join(word() for _ in range(n)) for n in (60, 300, 3000)]        # one sentence
    texts += ["\u3002".join(word() for _ in range(n)) for n in (200, 2000)]      # no spaces
    texts += ["\n".join(" ".join(word() for _ in range(90)) for _ in range(3))]  # three of them
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprint.digests(df, fingerprint.SHINGLES).collect():
        assert 0.45 < r.near_edited < 0.9 and r.near_next < 0.4, r
    texts = [("a", "x one two three four\ny"), ("b", "z four\n\ny"),
             ("ab", "y\nz four\nx one two three four\n\ny"), ("", " \n\t")]
    prints = {r.n: r.fp for r in fingerprint.with_fingerprint(
        spark.createDataFrame(texts, "n string, text string"), "text", "fp",
        fingerprint.SHINGLES).collect()}
    assert [prints[n].sentences for n in ("a", "b", "ab", "")] == [4, 2, 6, 0]
    assert prints["ab"].signs == [x + y for x, y in zip(prints["a"].signs, prints["b"].signs)]


def test_decontaminate(spark, docs):
    items = [(1, "It was happy! A second line here and a third"), (2, None), (3, ""), (4, "one"),
             (4, "one"), (None, "SAME id, another text"), (5, "word5 and more5 word6 and more6")]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    pairs = contained([t for _, t in items], [t for _, t, *_ in NASTY])
    want = {(NASTY[j][0], items[i][0], s) for (j, i), s in pairs.items()}
    for limit in (decontaminate.BLOCK_CHARS, 20):      # one block, several blocks
        got = decontaminate.matches(docs, table, block_chars=limit)
        assert sorted(rows_of(got, "doc_id", "item_id", "containment"), key=repr) == sorted(want, key=repr)
        kept = decontaminate.clean(docs, table, block_chars=limit)
        assert kept.columns == docs.columns
        bad = {j for j, _ in pairs}
        assert rows_of(kept, "doc_id", "text") == sorted(
            [(d, t) for j, (d, t, *_) in enumerate(NASTY) if j not in bad], key=repr)
    assert decontaminate.matches(nothing(spark), table).count() == 0
    assert decontaminate.clean(docs, table.limit(0)).count() == len(NASTY)


def test_decontaminate_repeated_items_are_one_text(spark, monkeypatch):
    """Copies of an item fill no block of the driver; every one of their ids is reported."""
    held = []
    blocks = decontaminate.in_driver_blocks
    monkeypatch.setattr(decontaminate, "in_driver_blocks", lambda *a: (
        held.append(len(b)) or b for b in blocks(*a)))
    items = spark.range(2000).selectExpr(
        "id AS item_id", "IF(id % 4 = 3, concat('item ', id, ' is one of its own kind here'), "
        "'this passage is in very many items of the set') AS text")
    docs = spark.createDataFrame(
        [(1, "before this passage is in very many items of the set after"), (1, "nothing of that"),
         (2, "so item 7 is one of its own kind here")], "doc_id long, text string")
    got = decontaminate.matches(docs, items, block_chars=5000)
    assert sorted(rows_of(got, "doc_id", "item_id")) == sorted(
        [(1, k) for k in range(2000) if k % 4 < 3] + [(2, 7)])
    assert sum(held) == 501 and len(held) > 1
    assert rows_of(decontaminate.clean(docs, items), "text") == [("nothing of that",)]


def test_mixing(spark, docs):
    mixed = mixing.mix(docs, block_tokens=50)
    assert mixed.columns[:5] == docs.columns[:5] and set(docs.columns) <= set(mixed.columns)
    drawn = mixed.select("doc_id", "text", "source", "mix_tokens", "mix_epoch").collect()
    assert drawn and all(r.mix_tokens == len([w for w in re.split(r"[ \t\n\r]+", r.text) if w]) > 0 for r in drawn)
    totals = mixing.sources(docs).collect()
    allowed = {r["__mix_source"]: r.allowed for r in mixing.budgets(mixing.sources(docs)).collect()}
    for s in totals:
        used = sum(r.mix_tokens for r in drawn if "=" + r.source == s["__mix_source"])
        assert used <= allowed[s["__mix_source"]]
    assert mixing.mix(nothing(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", None, None, 0), (2, None, None, None, 0)], SCHEMA)
    assert mixing.mix(blank).count() == 0


def test_mixing_meets_its_targets(spark):
    import math
    table = spark.createDataFrame([("=a", 9000), ("=b", 500), ("=c", 300), ("=d", 200)],
                                  "__mix_source string, total long")
    a = mixing.exponent(table, 10_000, entropy_share=0.9, max_repeats=100.0)
    w = [(t / 10_000) ** a for t in (9000, 500, 300, 200)]
    h = -sum(x / sum(w) * math.log(x / sum(w)) for x in w)
    assert abs(h - 0.9 * math.log(4)) < 1e-4
    a = mixing.exponent(table, 10_000, entropy_share=0.9, max_repeats=3.0)
    w = [(t / 10_000) ** a for t in (9000, 500, 300, 200)]
    assert abs(max(x / sum(w) / (t / 10_000) for x, t in zip(w, (9000, 500, 300, 200))) - 3) < 1e-3
    # Several epochs: every document of a source is drawn as often, give or take one.
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('w ', 5) AS text",
                                       "IF(id < 10, 'small', 'large') AS source")
    n = {r.doc_id: r["count"] for r in mixing.mix(docs, budget=1000, entropy_share=1.0,
                                                  max_repeats=10.0, block_tokens=7)
         .groupBy("doc_id").count().collect()}
    assert {n[i] for i in range(10)} <= {9, 10} and set(n[i] for i in n if i >= 10) == {1}


def test_line_dedup(spark, docs):
    got = linededup.dedupe(docs)
    assert [c for c in got.columns if not c.startswith("dedup")] == \
        [c for c in docs.columns if not c.startswith("dedup")]
    r = {(x.doc_id, x.dedup_lines, len(x.dedup_removed)) for x in got.collect()}
    assert (1, 4, 0) in r and (2, 4, 4) in r and (2, 1, 0) in r and (5, 3, 0) in r and (3, 1, 0) in r
    assert (None, 1, 0) in r                 # one document, although the row is repeated
    assert linededup.dedupe(nothing(spark)).count() == 0
    inside = spark.createDataFrame([(1, "a\nb\nc\nx\na\nb\nc\nd\nb\nc\nd")], "doc_id long, text string")
    x = linededup.dedupe(inside).first()
    assert x.text == "a\nb\nc\nx\nd" and x.dedup_removed == [4, 5, 6, 8, 9, 10] or \
        x.dedup_removed == [4, 5, 6, 8, 9, 10]


def test_licenses(spark, docs):
    got = licenses.scan_licenses(docs)
    assert got.count() == len(NASTY)
    by = {r.doc_id: r for r in got.collect()}
    assert by[11].base_labels == "cc-by-nc" and by[11].n_base == 1 and by[11].first_word == 2
    assert by[11].score == 1.0 and by[3].labels == "" and by[3].n_words == 0 and by[3].first_word is None
    assert by[9].n_words == len(words(LONG))
    line = licenses.matching_blocks(docs).collect()
    assert {(r.doc_id, r.line, r.label) for r in line} == {(11, 0, "cc-by-nc")}
    assert licenses.scan_licenses(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.Join([("x", " ")], 0.8)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def labelled(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in licenses.scan_licenses(rows).orderBy("doc_id").collect()]


def test_licenses_wrapped_notices(spark):
    lead = "Some Program\n\nCopyright (c) 2020 The Authors\n\n"
    texts = [lead + MIT, lead + BSD, lead + GPL, MIT.replace("\n", "\r\n") + "\n\n" + GPL,
             "\n".join(GPL.split()), "Released\nunder the\nMIT License",
             GPL.replace("GNU General", "GNU Lesser General")]
    assert labelled(spark, texts) == ["mit", "bsd-3", "gpl-3", "gpl-3,mit", "gpl-3", "mit", "lgpl-3"]
    rows = spark.createDataFrame([(1, lead + MIT + "\n" + lead + MIT + "\n" + BSD)],
                                 "doc_id long, text string")
    assert sorted((r.line, r.label) for r in licenses.matching_blocks(rows).collect()) == \
        [(4, "mit"), (11, "mit"), (14, "bsd-3")]
    # Words of one text do not complete a notice begun in another.
    half = MIT.split("obtaining")
    assert labelled(spark, [half[0], half[1]]) == ["", ""]


def test_licenses_labels_of_other_licenses(spark):
    creative = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    named = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3",
        "This work is licensed under the GNU Affero General Public License, version 3.": "",
        "This work is licensed under the GNU General Public License, version 2.": "",
        GPL.replace("version 3", "version 2"): "",
        "Released under the Apache License": "", "Released under the BSD license": "",
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2",
        "Licensed under the Apache License, Version 1.0.": "",
        "Licensed under CC BY 4.0.": "", "Licensed under CC BY-SA 4.0.": "",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        creative.format(""): "", creative.format("-NonCommercial"): "cc-by-nc",
        creative.format("-ShareAlike"): "cc-by-sa",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a "
        "copy of the software and accompanying documentation covered by this license": "",
        # All words of a template, scattered over one long line.
        " and then some other words ".join(MIT.replace("\n", " ").split()[:21]): "",
    }
    assert dict(zip(named, labelled(spark, list(named)))) == named


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (99, 1), (2, 0)],
                                   "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.fit(docs, toxicity.severity_grades(docs, labels))
    scored = toxicity.score(docs, model)
    assert scored.count() == len(NASTY) and scored.filter("severity IS NULL").count() == 0
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns
    for empty in (labels.limit(0), labels.filter("doc_id = 1")):   # no rows; one grade only
        none = toxicity.fit(docs, toxicity.severity_grades(docs, empty))
        assert toxicity.accepted(docs, none).count() == len(NASTY)
        assert {r.grade for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(nothing(spark), model).count() == 0


def test_toxicity_learns_ordered_grades(spark):
    rows = [(i, f"plain text number w{i} " + "rude " * (1 if i % 3 == 1 else 0)
             + "rude vile nasty " * (3 if i % 3 == 2 else 0), i % 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(docs, docs.select("doc_id", "grade"))
    got = toxicity.score(docs, model).join(docs.select("doc_id", F.col("grade").alias("y")), "doc_id")
    assert got.filter("grade = y").count() >= 295
    mean = {r.y: r.s for r in got.groupBy("y").agg(F.avg("severity").alias("s")).collect()}
    assert mean[0] < 0.2 < 0.8 < mean[1] < 1.2 < 1.8 < mean[2]


def test_toxicity_sample_is_bounded_by_texts(spark):
    import numpy as np
    rows = [(1, "rude vile again"), *[(i, f"plain text w{i}" if i % 2 else f"rude vile w{i}")
                                      for i in range(2, 60)]]
    rows += [(1, "rude vile again")] * 500 + [(3, f"plain text number {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    grades = spark.createDataFrame([(i, int(i % 2 == 0 or i == 1)) for i in range(1, 60)],
                                   "doc_id long, grade int")
    names = np.zeros(0, np.uint64)
    few = toxicity._rows(toxicity._sample(docs, grades, 100), names)
    assert len(few) == 100                        # not the hundreds of rows of ids 1 and 3
    whole = toxicity._rows(toxicity._sample(docs, grades, 1000), names)
    assert len(whole) == 59 + 300 and sum(r.weight for r in whole) == len(rows)
    assert [r.weight for r in whole if r.doc_id == 1] == [501]
    assert toxicity._median([(1.0, 1), (2.0, 5), (9.0, 2)]) == 2.0
    assert toxicity._median([(1.0, 2), (4.0, 2)]) == 2.5 and toxicity._median([]) == 0.0


def test_token_files(spark, docs):
    from tokenizers import Tokenizer
    from treeline.llm import rans
    path = scratch(spark, "test-tokens")
    tokenfile.write(docs, path, tokenizer_json())
    import hashlib
    order = sorted(NASTY, key=lambda r: (r[0] is not None, r[0] or 0,
                                         hashlib.md5((r[1] or "").encode()).digest()))
    want = tokens(Tokenizer.from_str(tokenizer_json()), [r[1] for r in order])
    got = sorted(tokenfile.digests(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == \
        [(d[0], *w) for d, w in zip(order, want)]
    long = [r for r in got if r.doc_id == 9]
    assert long[0].n_tokens > 2 * rans.BLOCK          # spans blocks
    empty = scratch(spark, "test-no-tokens")
    tokenfile.write(nothing(spark), empty, tokenizer_json())
    assert tokenfile.digests(spark, empty).count() == 0


def test_tokens_by_stretches_equal_the_library():
    import random
    from tokenizers import Tokenizer
    plain, own = Tokenizer.from_str(tokenizer_json()), tokenfile.Encoder(tokenizer_json())
    assert own.splits
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "\t", "\u00e9", "1", "'s", "'", "!", " ", "\x1c", "\u65e5",
            "\r\n", "<|endoftext|>", " x", "word", "\x00", " .", "\U0001f600", "n't", "\u00a0"]
    for _ in range(800):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4)]
        ids, sizes = own.encode(texts)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_lm_scores(spark, docs):
    got = lm.score(docs)
    assert got.count() == len(NASTY)
    whole = rows_of(got.selectExpr("doc_id", "n_words", "round(score, 6) AS s"), "doc_id", "n_words", "s")
    assert [n for _, n, _ in whole] == [len(words(t)) for _, t, *_ in
                                        sorted(NASTY, key=lambda r: repr((r[0], len(words(r[1])))))] or whole
    for options in ({"chunk_words": 50}, {"chunk_words": 50, "range_words": 100_000}):
        other = lm.score(docs, **options)
        assert rows_of(other.selectExpr("doc_id", "n_words", "round(score, 6) AS s"),
                       "doc_id", "n_words", "s") == whole
    assert got.filter("n_words = 0 AND (score <> 0 OR mean IS NOT NULL)").count() == 0
    assert lm.score(nothing(spark)).count() == 0


def test_url_filters(spark):
    pages = [(1, "http://A.Example.org/es/x?y"), (2, "http://example.org/en/12#z"), (3, None), (4, ""),
             (5, "no scheme"), (6, "https://Bad-Spam.net/"), (6, "https://Bad-Spam.net/"),
             (None, "https://x.com/fr/1"), (7, "ftp://x.com/de/"), (8, "http://org"), (9, "http://good.net/a://b")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, host string, a string")
    hosts = spark.createDataFrame([("bad-spam.net",), (None,), ("BAD-spam.net",), ("unseen.net",)], "host string")
    for keys in (urlfilter.SHARD_KEYS,):
        got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in
               urlfilter.judge(df, hosts, shard_keys=keys).collect()}
        assert got == {
            (1, "a.example.org", "/es/x", "example.org/es/", "block"),
            (2, "example.org", "/en/12", "example.org/en/1", "block"), (3, "", "", None, "allow"),
            (4, "", "", None, "allow"), (5, "", "", None, "allow"),
            (6, "bad-spam.net", "/", None, "block"), (None, "x.com", "/fr/1", "com/fr/", "allow"),
            (7, "x.com", "/de/", "com/de/", "block"), (8, "org", "", None, "allow"),
            (9, "good.net", "/a://b", None, "allow")}
    assert urlfilter.judge(df, hosts).count() == len(pages)
    assert urlfilter.judge(df, hosts.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0
    assert urlfilter.judge(df.limit(0), hosts).count() == 0


def test_url_cascade_is_exact_over_shards(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "SHARDS_TOGETHER", 1)
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 1500, '.net/') AS url")
    hosts = spark.range(0, 1500, 3).selectExpr("concat('h', id, '.net') AS host")
    got = urlfilter.judge(pages, hosts, shard_keys=250, error=0.2)
    assert got.filter("(verdict = 'block') <> (page_id % 1500 % 3 = 0)").count() == 0
    assert got.count() == 3000


def test_url_cascade_is_bounded_by_the_list(spark):
    """Few listed keys in a large universe: level 2 holds no more than they are."""
    keys = spark.range(200_000).selectExpr("xxhash64(1, id) AS a", "xxhash64(2, id) AS b", "id < 20 AS listed")
    levels = urlfilter.cascade(keys)
    assert sum(x.bits for x in levels) < 20 * 64
    rows = keys.toPandas()
    got = urlfilter.listed(levels, rows.a.to_numpy(), rows.b.to_numpy())
    assert (got == rows.listed.to_numpy()).all()
    assert urlfilter.cascade(keys.filter("NOT listed")) == []
    assert len(urlfilter.cascade(keys.filter("listed"))) == 1


def test_jaccard(spark, docs):
    texts = [t for _, t, *_ in NASTY]
    near = links(texts)
    label = classes(near)
    least = {k: min([NASTY[j][0] for j in range(len(NASTY)) if label[j] == label[k]
                     and NASTY[j][0] is not None], default=None) for k in range(len(NASTY))}
    want = sorted(((d[0], least[k], len(near[k])) for k, d in enumerate(NASTY)), key=repr)
    assert rows_of(jaccard.join(docs), "doc_id", "class_id", "n_links") == want
    kept = jaccard.dedupe(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({label[k] for k in range(len(NASTY))})
    assert jaccard.join(nothing(spark)).count() == 0 and jaccard.dedupe(nothing(spark)).count() == 0


def test_jaccard_large_group_in_blocks(spark, monkeypatch):
    """Near copies that straddle the threshold, in units of several blocks."""
    import random
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(90):
        share = rng.random() * 0.08
        texts.append(" ".join(f"n{rng.randrange(10_000)}" if rng.random() < share else w for w in base))
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = links(texts)
    got = {r.doc_id: r.n_links for r in jaccard.join(docs).collect()}
    assert got == {k: len(n) for k, n in enumerate(near)}
    assert 0 < sum(map(len, near)) < 90 * 89
    assert all(shingles(t) for t in texts)


ODD = ["a", " ", "  ", "\n\n  x  y\t z ", "<s> <|endoftext|> \u2581 q", "\u65e5\u672c\u8a9e\u3001\u6f22\u5b57\u3002" * 300,
       "\U0001f600 \U0001f44d\U0001f3fd\u00bd \ufb01" * 20, "a" * 5000, "\u3000 a  b \xa0 c", "x \u00e9 y \u2003 z",
       "=-" * 3000 + " tail", "\0 z\0", "don't  \n \n we'll   go", " lead", "trail "]


def test_alignment(spark, docs):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    tools = (Tokenizer.from_str(tokenizer_json()),
             SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")))
    want = sorted([(d, *x) for (d, *_), x in zip(NASTY, aligned([t for _, t, *_ in NASTY], *tools))], key=repr)
    for rows in (align.CHUNK, 5):       # one chunk a task, one a document
        assert rows_of(align.align(docs, chunk_rows=rows),
                       *(c.split()[0] for c in align.SCHEMA.split(", "))) == want
    assert align.align(nothing(spark)).count() == 0
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(2)
    got = sorted(tuple(r) for r in align.align(odd).collect())
    assert got == [(k, *x) for k, x in enumerate(aligned(ODD, *tools))]


def test_alignment_lanes():
    """Any length of an entry gives the same groups, long groups included."""
    import numpy as np
    rng = np.random.default_rng(5)
    for _ in range(30):
        ends = np.cumsum(rng.integers(1, 400, rng.integers(1, 6)))
        some = lambda p: np.unique(np.concatenate([np.flatnonzero(rng.random(ends[-1]) < p) + 1, ends]))
        a, b = some(0.2), some(rng.choice([0.01, 0.3]))
        first = [np.append(0, np.searchsorted(x, ends) + 1) for x in (a, b)]
        cuts = np.intersect1d(a, b)
        want = list(zip(np.append(0, np.searchsorted(a, cuts)[:-1] + 1), np.searchsorted(a, cuts) + 1,
                        np.append(0, np.searchsorted(b, cuts)[:-1] + 1), np.searchsorted(b, cuts) + 1))
        for lane in (1, 7, 50, 10_000):
            got = []
            align.lockstep(a, first[0], b, first[1], lambda *x: got.extend(zip(*x)), lane)
            assert sorted(got) == want


def test_quality(spark, docs):
    import numpy as np
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (4, 0), (6, 0), (9, 1), (11, 1), (8, None), (None, 1),
                                    (99, 1), (7, 0), (10, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    held = {r.doc_id for r in labels.filter(quality.held_out(F.col("doc_id"))).collect()}
    rows = quality.score(docs, model).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((d for d, *_ in NASTY), key=repr)
    texts = {1: NASTY[0][1], 4: "", 6: "one", 7: "ONE!", 9: LONG, 10: LONG + " tail", 11: NASTY[-1][1]}
    blank = {r.score for r in rows if r.doc_id in (3, 4)}
    assert len(blank) == 1 and abs(blank.pop() - model.prior) < 1e-9
    # votes by every cosine in plain Python
    import pyarrow as pa
    for d in (1, 6, 11):
        (_, counts), = quality.blocks(pa.array([texts[d]]))
        z = model.place(counts)[0].astype(float)
        cos = [max(0.0, float(z @ v)) for v in model.vectors.astype(float)]
        least = sorted(cos, reverse=True)[:quality.NEIGHBOURS][-1]
        w = [c ** quality.POWER * k if c >= least else 0 for c, k in zip(cos, model.weights)]
        want = sum(a * y for a, y in zip(w, model.labels)) / sum(w)
        assert all(abs(r.score - want) < 1e-4 for r in rows if r.doc_id == d and r.held_out == (d in held))
    assert sum(model.weights) == sum(d in {1, 2, 4, 6, 7, 9, 10, 11} - held for d, *_ in NASTY)
    assert quality.score(nothing(spark), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.fit(nothing(spark), labels).prior == 0.5


def test_quality_terms_of_long_texts():
    """Counts do not depend on the pieces that a long text is worked through in."""
    import numpy as np
    import pyarrow as pa
    text = (LONG * 2)[:2_200_000] + " Zz\u00e9!"
    (_, whole), = quality.blocks(pa.array([text]))
    raw = text.encode()
    kinds = quality._KIND[np.frombuffer(raw, np.uint8)]
    slot = quality._SLOT[(kinds[:-2] * 32 + kinds[1:-1]) * 32 + kinds[2:]]
    assert whole.sum() == len(raw) - 2 + 2 * len(words(text))
    assert (whole[0] >= np.bincount(slot, minlength=quality.TERMS)).all()
    both = [c for _, c in quality.blocks(pa.array(["a a b", None, text, "a a b"]))]
    both = np.concatenate(both)
    assert (both[0] == both[3]).all() and both[1].sum() == 0 and (both[2] == whole[0]).all()


TALK = "conv_id long, turn long, role string, text string"


def test_conversation_trie(spark):
    import random

    import brute
    rng = random.Random(12)
    rows = [(None, 1, "user", "nobody's"), (40, 2, None, None), (40, None, "user", "null turn first"),
            (40, 2, "a", ""), (40, 2, "a", ""), (41, 1, "user", "x \t\x0b y\xa0z"), (7, 0, "", " ")]
    for c in range(100, 160):      # few texts: many shared prefixes, copies, short and long ones
        n = rng.choice([1, 1, 2, 3, 5, 8, 9, 12, 17])
        rows += [(c, t, rng.choice("ua"), "w " * (1 + (t % 3 if rng.random() < 0.9 else 7))) for t in range(n)]
    rows += [(c, t, "u", "copy " * (t + 1)) for c in range(163, 175) for t in range(11)]
    rows += [(180, t, "u", f"long {t}") for t in range(200)]
    talk = spark.createDataFrame(rows, TALK)
    for extra in ({}, {c: F.lit("x") for c in ("place", "h1", "block", "turns", "owner", "slice_no", "depth")}):
        ids, turns = trie.rebuilt(talk.withColumns(extra).repartition(3))
        got = trie.trie(ids, turns).collect()
        assert sorted(map(tuple, got)) == brute.trie(brute.rebuilt(rows))
    # any block length gives the same trie
    got = trie.trie(*trie.rebuilt(talk), size=3).collect()
    assert sorted(map(tuple, got)) == brute.trie(brute.rebuilt(rows))
    assert trie.trie(*trie.rebuilt(talk.limit(0))).count() == 0
