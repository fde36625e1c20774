import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import LOWER, WORD

from treeline.llm import decontaminate, jaccard, licenses, lm, rans, urlfilter
from treeline.llm import words as W
from treeline.llm.common import tokenizer_json


@pytest.mark.parametrize("piece", [7, 50, 1 << 18])
def test_words_and_shingles_match_the_pattern(piece, monkeypatch):
    monkeypatch.setattr(W, "PIECE", piece)
    rng = random.Random(piece)
    seen, seen_shingles = {}, {}
    for _ in range(60):
        texts = [rng.choice([None, "", "".join(rng.choice("abC d\u00e9\n.\u65e5 9 ")
                                               for _ in range(rng.choice([1, 5, 50, 300])))])
                 for _ in range(rng.randint(0, 8))]
        h, c, cut, at = W.words(*W.text_bytes(pa.array(texts, pa.string())), (2,), places=True)
        own = [WORD.findall((t or "").translate(LOWER)) for t in texts]
        assert c.tolist() == [len(w) for w in own]
        flat = [w for x in own for w in x]
        assert all(seen.setdefault(w, x) == x for w, x in zip(flat, h.tolist()))
        data = "".join(t or "" for t in texts).translate(LOWER).encode()
        assert all(data[a:a + len(w.encode())] == w.encode() for a, w in zip(at.tolist(), flat))
        assert [x != 0 for x in cut[0].tolist()] == [len(w.encode()) >= 2 for w in flat]
        s, m = W.shingles(h, c, 5)
        parts = [tuple(w[i:i + 5]) for w in own if w for i in range(max(1, len(w) - 4))]
        assert m.sum() == len(parts)
        assert all(seen_shingles.setdefault(p, x) == x for p, x in zip(parts, s.tolist()))
    for d in (seen, seen_shingles):
        assert len(set(d.values())) == len(d)


def test_minima_cover_every_contained_item():
    for q in range(1, 200):
        missing = q - math.ceil(0.8 * q - 1e-9)
        assert decontaminate.minima(decontaminate.size_partition(q), 0.8) > missing


def test_prefix_is_shortened_to_the_target_recall():
    p = jaccard.prefix_length(0.8)
    assert jaccard.recall(0.8, p) >= jaccard.TARGET_RECALL > jaccard.recall(0.8, p + 1)
    with pytest.raises(ValueError):
        jaccard.prefix_length(0.1, trees=2)


def test_pairs_by_matrices_equal_pairs_by_sets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.random() * 0.3, rng.integers(0, 1 << 60, 300)
                               .astype(np.uint64), base)) for _ in range(40)]
    own = np.triu(np.ones((40, 40), bool), 1)
    got = jaccard._links(sets, own, 0.8)
    for i in range(40):
        for j in range(i + 1, 40):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            assert got[i, j] == (both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9)


def test_each_pair_belongs_to_one_trie():
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 3, (30, 6)).astype(np.int64)
    side, met = np.zeros(30, int), np.zeros((30, 30), int)
    for t in range(6):
        for value in range(3):
            some = np.flatnonzero(labels[:, t] == value)
            own = jaccard._own_pairs(labels[some], t, side[some], True)
            met[np.ix_(some, some)] += own
    share = (labels[:, None, :] == labels[None, :, :]).any(axis=2)
    assert (met == np.triu(share, 1)).all()


def test_range_coder_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 300_000) % 50_257
    freq = rans.Table.scaled(np.bincount(ids, minlength=50_257))
    assert freq.sum() == 1 << rans.BITS and ((freq > 0) == (np.bincount(ids, minlength=50_257) > 0)).all()
    table = rans.Table(freq)
    blocks = [ids[:n] for n in (0, 1, 31, 32, 33, 8192, 8193, 65_536, 65_536, 40_000)]
    data = rans.encode(blocks, table)
    for block, back in zip(blocks, rans.decode(data, table)):
        assert np.array_equal(block, back)
    entropy = -np.sum(np.bincount(ids) / len(ids) * np.log2(np.maximum(np.bincount(ids), 1) / len(ids)))
    assert 8 * len(data[7]) / 65_536 < entropy + 1
    spoilt = data[5][:-3] + bytes([data[5][-3] ^ 1]) + data[5][-2:]
    with pytest.raises(ValueError):
        rans.decode([spoilt], table)
    one = rans.Table(rans.Table.scaled(np.array([0, 7])))
    assert (rans.decode(rans.encode([np.ones(500, int)], one), one)[0] == 1).all()


def test_crc_of_joined_strings():
    for a, b in ((b"abc", b"defgh"), (b"", b"x"), (b"x", b""), (bytes(999), bytes(range(256)) * 99)):
        assert rans.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_license_join_equals_counting():
    rng = random.Random(2)
    pool = [w for _, t in licenses.TEMPLATES for w in WORD.findall(t.lower())] + ["noise", "x"]
    join = licenses.Join(licenses.TEMPLATES, 0.8, {})
    for _ in range(400):
        if rng.random() < 0.7:
            block = WORD.findall(rng.choice(licenses.TEMPLATES)[1].lower())
            block = [w for w in block if rng.random() < 0.88] + rng.choices(pool, k=3)
        else:
            block = rng.choices(pool, k=rng.randint(1, 30))
        got = dict(join.matches(licenses._word_hashes(" ".join(block))))
        for t, (_, text) in enumerate(licenses.TEMPLATES):
            wanted = set(WORD.findall(text.lower()))
            shared = len(wanted & set(block))
            assert got.get(t) == (shared if shared >= math.ceil(0.8 * len(wanted) - 1e-9) else None)


def test_license_notices_equal_counting_in_every_run_of_words():
    rng = random.Random(5)
    pool = [w for _, t in licenses.TEMPLATES for w in WORD.findall(t.lower())] + ["noise", "x"] * 20
    join = licenses.Join(licenses.TEMPLATES, 0.8, {})
    for _ in range(60):
        texts = []
        for _ in range(3):
            text = rng.choices(pool, k=rng.randint(0, 40))
            for _ in range(rng.randint(0, 3)):
                text += WORD.findall(rng.choice(licenses.TEMPLATES)[1].lower())
                text += rng.choices(pool, k=rng.randint(0, 9))
            texts.append([w for w in text if rng.random() < 0.93])
        got = {}
        ends = np.cumsum([len(t) for t in texts])
        for a, t, n in join.notices(licenses._word_hashes(" ".join(sum(texts, []))), ends):
            k = int(np.searchsorted(ends, a, side="right")), t
            got[k] = max(got.get(k, 0), n)
        want = {}
        for r, text in enumerate(texts):
            for t, (_, body) in enumerate(licenses.TEMPLATES):
                body = WORD.findall(body.lower())
                size, need = math.ceil(1.5 * len(body)), math.ceil(0.8 * len(set(body)) - 1e-9)
                n = max((len(set(body) & set(text[i:i + size])) for i in range(len(text))), default=0)
                if n >= need:
                    want[r, t] = n
        assert got == want


def test_bloom_levels_decide_in_order():
    rng = np.random.default_rng(3)
    keys = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    inside, outside = np.arange(500), np.arange(500, 5000)
    levels, a, b = [], inside, outside
    while len(a):
        level = urlfilter.Level(len(a), 0.2, len(levels) + 1)
        at = level.positions(*keys[:, a]).reshape(-1)
        np.bitwise_or.at(level.words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        levels.append(level)
        a, b = b[level.knows(*keys[:, b])], a
    assert len(levels) > 2
    assert np.array_equal(np.flatnonzero(urlfilter.listed(levels, *keys)), inside)


def test_packed_integers():
    v = np.sort(np.random.default_rng(4).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert np.array_equal(lm.unpack_sorted(lm.pack_sorted(v)), v)
    assert np.array_equal(lm.unpack(lm.pack(v.astype(np.uint32)), np.uint32), v.astype(np.uint32))
    assert len(lm.unpack(lm.pack(v[:0]), np.uint64)) == 0


def test_estimated_recall_is_the_share_that_meets():
    rng = np.random.default_rng(8)
    sims = np.sort(0.8 + 0.2 * rng.random(200_000))
    chance = {p: 1 - (1 - sims ** p) ** 24 for p in (4, 8)}
    met = rng.random(len(sims)) < chance[8]
    found = np.bincount(((sims[met] - 0.8) / 0.2 * jaccard.BINS).astype(int), minlength=jaccard.BINS)
    for p in (4, 8):
        assert abs(jaccard.estimated_recall(found, 0.8, 8, p) - chance[p].mean()) < 1e-3
    # few or no links never show that enough is found
    for few in (np.zeros(jaccard.BINS), np.eye(jaccard.BINS)[-1] * 100):
        assert jaccard.estimated_recall(few, 0.8, 8, 8) < jaccard.TARGET_RECALL
    # many links that are all close do, at the first depth
    assert jaccard.estimated_recall(np.eye(jaccard.BINS)[-1] * 1e7, 0.8, 8, 8) > jaccard.TARGET_RECALL


@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_matched_prefixes_are_the_longest_shared(cut):
    rng = np.random.default_rng(9)
    values = rng.integers(0, 2, (300, 8)).astype("<u2")
    tree = np.sort(rng.integers(0, 3, 300)).astype(np.int32)
    order = sorted(range(300), key=lambda i: (tree[i], values[i].tobytes()))
    table = pa.table({"tree": pa.array(tree[order]), "path": pa.array([values[i].tobytes() for i in order], pa.binary()),
                      "key": pa.array([str(i).encode() for i in order], pa.binary()),
                      "chars": pa.array([1] * 300)})
    out = pa.Table.from_batches(jaccard._matched(8, 3)(iter(table.to_batches(max_chunksize=cut))))
    got = {int(k): m for k, m in zip(out.column("key").to_pylist(), out.column("matched").to_pylist())}
    for at, i in enumerate(order):
        same = [np.logical_and.accumulate(values[i] == values[j]).sum() for j in range(300)
                if j != i and tree[i] == tree[j]]
        want = 8 if at in (0, 299) else max(same, default=0)
        assert got.get(i, 0) == (want if want >= 3 else 0)


def test_a_pair_that_met_deeper_is_not_met_again():
    rng = np.random.default_rng(10)
    values = rng.integers(0, 2, (40, 5, 8)).astype("<u2")
    deep, flat = jaccard._labels(values, 3), jaccard._labels(values, 2)
    met = np.zeros((40, 40), int)
    for labels, before in ((deep, None), (flat, deep)):
        for t in range(5):
            for value in np.unique(labels[:, t]):
                some = np.flatnonzero(labels[:, t] == value)
                met[np.ix_(some, some)] += jaccard._own_pairs(
                    labels[some], t, np.zeros(len(some)), True, None if before is None else before[some])
    share = (flat[:, None, :] == flat[None, :, :]).any(axis=2)
    assert (met == np.triu(share, 1)).all()
    same = (values[:, None, :, :2] == values[None, :, :, :2]).all(axis=3).any(axis=2)
    assert (share == same).all()


class Counted:
    """A tokenizer that notes how many characters it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.chars = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.chars += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_known_words_beside_other_marks_are_not_encoded_again():
    from tokenizers import Tokenizer
    from treeline.llm import tokenfile
    plain, own = Tokenizer.from_str(tokenizer_json()), tokenfile.Encoder(tokenizer_json())
    rng = random.Random(8)
    names = ["".join(rng.choice("abcdeiou\xe9") for _ in range(7)) for _ in range(300)]
    own.encode(["x " + " ".join(names) + ", y. z! v;"])
    counted = [Counted(own.tokenizer), Counted(getattr(own, "pieces", own.tokenizer))]
    own.tokenizer, own.pieces = counted
    other = "x" + "".join(f" {n}{rng.choice(',.!;')}" for n in names)
    ids, _ = own.encode([other, other[:-1]])
    assert ids.tolist() == sum((plain.encode(t).ids for t in (other, other[:-1])), [])
    assert sum(c.chars for c in counted) == 0


def test_units_of_any_characters_equal_the_library(monkeypatch):
    import unicodedata
    from tokenizers import Tokenizer
    from treeline.llm import bpe
    for c in [*range(0xC0, 0x280), *range(0x400, 0x480)]:
        assert unicodedata.category(chr(c))[0] == "L" or c in (0xD7, 0xF7)
    for name, value in (("CACHED", 500), ("TOGETHER", 16), ("TEXT", 5)):   # memory pruned often
        monkeypatch.setattr(bpe, name, value)
    plain, own = Tokenizer.from_str(tokenizer_json()), bpe.Encoder(tokenizer_json())
    rng = random.Random(5)
    usual = [*" \n\t\r'a1.,_\x00\x1c\x85\xa0\xd7\xf7\xe9\u0416\u02b0\u0301\u180e\u2009\u200b\u201c\u3000\u65e5",
             "  ", "'ll", "'s", " word", "antidisestablishment", "\xe9t\xe9" * 25, "x" * 70]
    wide = [chr(c) for c in range(1, 0x3100)] + [*" ", "\n", ",", "a", "1", "'"] * 900
    for k in range(1500):
        bits = wide if k % 3 == 0 else usual
        texts = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(rng.randint(0, 5))]
        ids, sizes = own.encode(texts)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, []), texts


def test_units_in_slots_of_others_are_told_apart(monkeypatch):
    from treeline.llm import bpe
    monkeypatch.setattr(bpe._Memory, "_slots", lambda self, low, high: (low & np.uint64(3)).astype(np.int64))
    own, plain = bpe.Encoder(tokenizer_json()), bpe.Encoder(tokenizer_json())
    plain.splits = False
    texts = [" ".join(f"w{k}x{k % 7}" for k in range(n)) for n in (1, 200, 150)] * 2
    assert [x.tolist() for x in own.encode(texts)] == [x.tolist() for x in plain.encode(texts)]


def test_documents_cut_into_chunks(monkeypatch):
    from treeline.llm import tokenfile

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(tokenfile, "TaskContext", Task)
    monkeypatch.setattr(tokenfile, "CHUNK", 16)
    rng = random.Random(6)
    texts = [rng.choice([None, "", "a", "a b " * rng.randint(0, 30)]) for _ in range(60)] + ["a " * 15]
    ids = [None, *range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:a + 25], pa.int64()),
                                           pa.array(texts[a:a + 25], pa.string())], names=["doc_id", "text"])
               for a in (0, 25, 50)]
    rows = [r for b in tokenfile._chunks(tokenizer_json())(batches) for r in b.to_pylist()]
    assert [r["chunk"] for r in rows] == list(range(len(rows))) and {r["part"] for r in rows} == {3}
    assert [r["n"] for r in rows[:-1]] == [16] * (len(rows) - 1) and 0 < rows[-1]["n"] <= 16
    plain = tokenfile.Encoder(tokenizer_json())
    coded = [plain.encode([t])[0].tolist() + [tokenfile.END_ID] for t in texts]
    assert sum((np.frombuffer(r["ids"], np.uint16).tolist() for r in rows), []) == sum(coded, [])
    times = np.bincount(sum(coded, []))
    assert dict(zip(rows[-1]["used"], rows[-1]["times"])) == {k: n for k, n in enumerate(times) if n}
    assert not any(r["used"] for r in rows[:-1])       # once in the part
    held = [[] for _ in texts]
    for r in rows:
        own = np.frombuffer(r["ids"], np.uint16).tolist()
        assert sum(d["n"] for d in r["docs"]) == r["n"] == len(own)
        for d in r["docs"]:
            assert d["doc_id"] == ids[d["nth"]] and d["start"] == sum(map(len, coded[:d["nth"]]))
            held[d["nth"]] += own[d["at"]:d["at"] + d["n"]]
    assert held == coded
    assert list(tokenfile._chunks(tokenizer_json())(b.slice(0, 0) for b in batches)) == []
