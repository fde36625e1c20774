"""Plain Python versions of what the operators compute."""

import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF_SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Awkward documents: nulls in every column, empty, blank, short, long, repeated rows and ids.
LONG = " ".join(f"word{i % 977} and more{i % 31}" for i in range(60_000))
NASTY = [
    (1, "The cat sat on the mat. It was happy!\nA second line here\nand a third one\nand a fourth",
     "en", "a", 10),
    (2, "The cat sat on the mat. It was happy!\nA second line here\nand a third one\nand a fourth",
     "en", "a", 10),
    (2, "The cat sat on the mat. It was happy!\nA second line here\nand a third one\nand a fourth",
     "en", "a", 10),
    (2, "same id, another text", None, "b", None),
    (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t\n ", "en", "b", 5),
    (None, "no id at all, twice", "en", "a", 1), (None, "no id at all, twice", "en", "a", 1),
    (None, None, None, None, None), (6, "one", "xx", "c", 3), (7, "ONE!", "xx", "c", 4),
    (8, "\u00c9t\u00e9 \u65e5\u672c \U0001f600 na\u00efve\r\nx\u00a0y <|endoftext|> z", "fr", "c", 9),
    (9, LONG, "en", "a", len(LONG)), (10, LONG + " tail", "en", "b", len(LONG) + 5),
    (11, "licensed under CC BY-NC 4.0.\n  two  spaces ", "en", "b", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["item_id", "class_id", "key", "rows", "score", "grade", "part", "n", "start", "blocks",
         "mix_epoch", "dedup_lines", "unit", "component", "epochs", "rest", "sum", "before", "starts", "at", "fp", "total", "label",
         "row", "id", "keep_id", "__text", "__id", "__starts", "__lines", "__row", "__text_key",
         "__keep_id", "__mix_key", "__mix_blocks", "__mix_row", "__mix_source", "a.b"]


def nasty(spark):
    return spark.createDataFrame(NASTY, SCHEMA)


def clashing(spark):
    """The same documents with extra columns named like those the operators use."""
    from pyspark.sql import functions as F
    return nasty(spark).withColumns({c: F.lit("x") for c in EXTRA})


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def links(texts, threshold=0.8):
    """For each text the other texts at least that similar; exact copies are."""
    sets = [shingles(t) for t in texts]
    out = [set() for _ in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if (texts[i] or "") == (texts[j] or "") or \
                    (both and both >= threshold * (len(a) + len(b) - both) - 1e-9):
                out[i].add(j)
                out[j].add(i)
    return out


def classes(near):
    label = list(range(len(near)))
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            least = min([label[i], *(label[j] for j in others)])
            if least < label[i]:
                label[i], changed = least, True
    return label


def contained(items, texts, threshold=0.8):
    """(text, item) pairs with the share of the item's shingles that the text has."""
    out = {}
    for i, item in enumerate(items):
        q = shingles(item)
        for j, text in enumerate(texts):
            share = len(q & shingles(text)) / len(q) if q else 0
            if q and share >= threshold - 1e-9:
                out[j, i] = share
    return out


def tokens(tokenizer, texts):
    """(start, n, crc) per text, in order."""
    at, out = 0, []
    for t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def aligned(texts, tokenizer, pieces):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text."""
    import hashlib

    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    tokenizer.encode_special_tokens = True
    found = []
    for text in texts:
        spaced = " " + (text or "")
        a = tokenizer.encode(spaced, add_special_tokens=False)
        b = pieces.encode(text or "")
        in_a = [bytes(byte[c] for c in t) for t in a.tokens]
        in_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p)
                else p.replace("\u2581", " ").encode() for p in map(pieces.id_to_piece, b)]
        if not text or not b"".join(in_a) == b"".join(in_b) == spaced.encode():
            found.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(t) for t in x]).tolist() for x in (in_a, in_b))
        place_a, place_b = ({e: k + 1 for k, e in enumerate(x)} for x in (ends_a, ends_b))
        ids, i, j = a.ids, 0, 0
        own = []
        for cut in sorted(set(ends_a) & set(ends_b)):
            own.append((ids[i:place_a[cut]], b[j:place_b[cut]]))
            i, j = place_a[cut], place_b[cut]
        found.append((len(ids), len(b), own))
    count = {}
    for f in found:
        for pair in {(x, y) for g, h in (f[2] if f else []) for x in g for y in h}:
            count[pair] = count.get(pair, 0) + 1
    top = {}
    for (x, _), n in count.items():
        top[x] = max(n, top.get(x, 0))
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        linked = [(x, y) for g, h in f[2] for x in g for y in h]
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in f[2])
        out.append((f[0], f[1], len(f[2]), len(linked),
                    sum(count[p] == top[p[0]] for p in linked), sum(count[p] for p in linked),
                    hashlib.sha256(written.encode()).hexdigest()))
    return out


def rebuilt(rows):
    """conv_id -> rebuilt turns (role, text) of (conv_id, turn, role, text) rows."""
    import zlib

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[:h[c]] + v[h[c]:] for c, v in own.items()}


def trie(whole):
    """Rows of op12 of conv_id -> turns, node by node."""
    import hashlib

    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[:len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        ends = ",".join(map(str, sorted(c for c in held if len(whole[c]) == len(node))))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held),
                    len(children),
                    sum(not any(m[:len(n)] == n and len(m) > len(n) for m in below) for n in below),
                    sum((len(members[n]) - 1) * len(re.findall("[^\\x20\\x09-\\x0D]+", n[-1][1]))
                        for n in below if n),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)
