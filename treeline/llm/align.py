"""Cross-tokenizer alignment: token groups, links and cuts of two tokenizers.

Both tokenizers read the same bytes, a space and the text. A byte offset where a
token of A and a token of B both end is a *cut*; the tokens between two cuts
are a *group*, and every A token of a group is *linked* with every B token of it.

Lockstep merging: the tokens of a batch of documents lie one after the other in
two arrays of end offsets, and one NumPy state vector holds an (A, B) pair of
pointers for every document. A step advances all of them at once: the
pointer whose token ends first, or both where the ends meet, which emits a cut
and the links of the group that it closes. Finished entries are compacted away
after the step. A long document takes several entries, ``LANE`` bytes each, so the
number of steps has a bound and the vector stays wide: an entry finds the first cut
at or after its own start, and works on up to the first cut at or after the
next entry's start, so entries meet at cuts and nothing is emitted twice.

Corpus-wide counts (how many documents hold an id pair linked) are relational. A
task packs documents into chunks of about ``CHUNK`` different (document, pair)
rows and writes each pair of a chunk once, with the number of its documents:
that pre-aggregates frequent pairs before the shuffle. Spark sums the counts,
takes each A id's greatest, and joins both back to the chunks' pairs; each chunk
then reads its answers in order and adds them up per document.

Tokens come from stretches of the text between single spaces, each encoded once
per batch and remembered between batches: a byte-level pre-tokeniser starts anew at
such a space, and no piece of B has a space after another character (checked
when the model is loaded; otherwise texts are encoded whole). A document with a
stretch that either tokenizer does not give back byte for byte is encoded
whole by both libraries and judged by its joined bytes.

Defined results: texts that are null or empty, or whose joined A or B bytes
differ from space + text, have no tokens: zeros and the empty string. Each row
counts as a document of its own: repeated rows return (and count) as often as
they stand there, null ids included. Only doc_id and text are read, whatever other
columns there are. Without documents the result is empty. Groups of any length
are linked in full; pairs of a long group are counted from its distinct ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import KEPT, each_batch, groups, tokenizer_json
from treeline.llm.words import PIECE, slices, text_bytes
from treeline.session import write_table

LANE = 512
CHUNK = 1 << 19
CACHED = 150_000
SLICE = 2 * PIECE       # bytes of text merged at a time
JOINED = 8000           # stretches in one call of a library
LONG_GROUP = 1 << 12   # id pairs; longer groups are linked by distinct ids
PAIR_BITS = 32         # a pair is a * 2**32 + b

SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
          "count_sum long, groups_sha256 string")


def piece_model(path: str | None = None) -> bytes:
    """A sentencepiece model, read on the driver and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every id of a tokenizer, and their number."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.entries = entries

    def joined(self, ids) -> bytes:
        return b"".join([self.entries[i] for i in ids])


class ByteLevel:
    """A: byte-level BPE by the tokenizers library."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        alphabet = _byte_alphabet()
        entries = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            entries[i] = (bytes(alphabet[c] for c in token) if all(c in alphabet for c in token)
                          else token.encode())
        self.vocabulary = Vocabulary(entries)
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        self.splits = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                       and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                       and spec["model"].get("type") == "BPE")

    def __call__(self, spaced: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]


class Pieces:
    """B: sentencepiece; it puts the space before a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.vocabulary = Vocabulary([
            bytes([int(p[3:5], 16)]) if self.processor.is_byte(i)
            else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def __call__(self, spaced: list[str]) -> list[list[int]]:
        return self.processor.encode([s[1:] for s in spaced], num_threads=1) if spaced else []


class _Memory:
    """Ids of the stretches met so far, one after the other."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1, np.int64)

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        used, more = int(self.ends[-1]), len(ids)
        if used + more > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), used + more), np.int32)
            grown[:used] = self.ids[:used]
            self.ids = grown
        self.ids[used:used + more] = ids
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches ``which``, in order, and how many each has."""
        a = self.ends[which]
        size = self.ends[which + 1] - a
        shift = np.repeat(a - (np.cumsum(size) - size), size)
        return self.ids[shift + np.arange(int(size.sum()))], size


# Characters next to a space at which texts are cut: none of these bytes belongs to a white
# space character (which begin with C2, E1, E2 or E3 beyond ASCII).
_GRAPH = np.zeros(256, bool)
_GRAPH[0x21:0x7F] = True
_LEAD = _GRAPH.copy()
_LEAD[0xC3:0xE0] = True
_LEAD[0xE4:0xF5] = True


def _cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches start: every row, and single spaces between two other characters."""
    space = np.flatnonzero(buf == 0x20)
    space = space[(space > 1) & (space + 1 < len(buf))]
    before = _GRAPH[buf[space - 1]] | ((buf[space - 1] & 0xC0 == 0x80)
                                       & (buf[space - 2] >= 0xC3) & (buf[space - 2] < 0xE0))
    inside = space[before & _LEAD[buf[space + 1]]]
    marks = np.zeros(len(buf) + 1, bool)
    marks[inside] = True
    # next to a row's border there is no character of the same row
    marks[np.clip(starts - 1, 0, len(buf))] = False
    marks[starts] = True
    return np.flatnonzero(marks[:len(buf)])


class Coder:
    """Token ids of both tokenizers for whole texts."""

    def __init__(self, definition: str, model: bytes):
        self.a, self.b = ByteLevel(definition), Pieces(model)
        self.splits = self.a.splits and self.b.splits
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.memory = (_Memory(), _Memory())
        self.exact = np.zeros(0, bool)

    def _learn(self, stretches: list[str]) -> None:
        """Encode new stretches: many in a row as one text where they stay apart, else alone."""
        alone = []
        plain = []
        for s in stretches:
            joins = self.splits and "!" <= s[-1] <= "~" and "!" <= s[1:2] <= "~"
            (plain if joins else alone).append(s)
        for at in range(0, len(plain), JOINED):
            some = plain[at:at + JOINED]
            if not self._learn_joined(some):
                alone += some
        for at in range(0, len(alone), JOINED):
            some = alone[at:at + JOINED]
            coded = self.a(some), self.b(some)
            exact = [(raw := s.encode()) == self.a.vocabulary.joined(x)
                     and raw == self.b.vocabulary.joined(y) for s, x, y in zip(some, *coded)]
            self._keep(some, exact, *((np.fromiter(map(len, c), np.int64, len(c)),
                                       np.fromiter((i for ids in c for i in ids), np.int32))
                                      for c in coded))

    def _learn_joined(self, some: list[str]) -> bool:
        raw = [s.encode() for s in some]
        text, whole = "".join(some), b"".join(raw)
        bounds = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        found = []
        for tokenizer in (self.a, self.b):
            ids = np.array(tokenizer([text])[0], np.int32)
            ends = np.cumsum(tokenizer.vocabulary.size[ids])
            last = np.searchsorted(ends, bounds)
            if (ends[-1] != bounds[-1] or (ends[last] != bounds).any()
                    or tokenizer.vocabulary.joined(ids.tolist()) != whole):
                return False
            found.append((np.diff(last, prepend=-1), ids))
        self._keep(some, [True] * len(some), *found)
        return True

    def _keep(self, names: list[str], exact: list[bool], *coded: tuple[np.ndarray, np.ndarray]) -> None:
        first = len(self.known)
        self.known.update(zip(names, range(first, first + len(names))))
        self.exact = np.append(self.exact, exact).astype(bool)
        for memory, (sizes, ids) in zip(self.memory, coded):
            memory.add(sizes, ids)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, number per row, ids of B, number per row) of a text column; rows
        without tokens have none. Rows should add up to a few megabytes."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        n = len(texts)
        buf, offsets = text_bytes(pc.binary_join_element_wise(
            pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        filled = np.diff(offsets) > 1
        if not filled.any():
            none = np.zeros(0, np.int32)
            return none, np.zeros(n, np.int64), none, np.zeros(n, np.int64)
        starts = offsets[:-1]
        cuts = _cuts(buf, starts) if self.splits else starts
        parts = pa.LargeStringArray.from_buffers(
            len(cuts), pa.py_buffer(np.append(cuts, len(buf)).astype(np.int64)),
            pa.py_buffer(np.ascontiguousarray(buf))).dictionary_encode()
        if len(self.known) > CACHED:
            self.forget()
        names = parts.dictionary.to_pylist()
        self._learn([s for s in names if s not in self.known])
        slot = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        which = slot[parts.indices.to_numpy()]
        row = np.searchsorted(starts, cuts, side="right") - 1
        odd = np.zeros(n, bool)
        odd[row[~self.exact[which]]] = True
        odd &= filled
        use = filled[row] & ~odd[row]
        which, row = which[use], row[use]
        out = []
        whole = self._whole([texts[int(k)].as_py() for k in np.flatnonzero(odd)])
        for memory, own in zip(self.memory, whole):
            ids, size = memory.take(which)
            number = np.bincount(row, weights=size, minlength=n).astype(np.int64)
            if odd.any():
                ends, pieces, rest = np.cumsum(number), [], iter(own)
                for k in range(n):
                    if odd[k]:
                        pieces.append(np.array(next(rest), np.int32))
                        number[k] = len(pieces[-1])
                    else:
                        pieces.append(ids[ends[k] - number[k]:ends[k]])
                ids = np.concatenate(pieces)
            out += [ids, number]
        return tuple(out)

    def _whole(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both encodings of whole texts; none where either changes the bytes."""
        spaced = [" " + t for t in texts]
        pairs = []
        for s, x, y in zip(spaced, self.a(spaced), self.b(spaced)):
            same = s.encode() == self.a.vocabulary.joined(x) == self.b.vocabulary.joined(y)
            pairs.append((x, y) if same else ([], []))
        return [x for x, _ in pairs], [y for _, y in pairs]


@lru_cache(maxsize=1)
def _coder(definition: str, model: bytes) -> Coder:
    return Coder(definition, model)


KEPT.append(_coder.cache_clear)


def lockstep(a_end: np.ndarray, a_first: np.ndarray, b_end: np.ndarray, b_first: np.ndarray,
             emit: Callable[[np.ndarray, ...], None], lane: int = LANE) -> None:
    """Merge the token ends of all documents at once.

    ``a_end``, ``b_end``: end offsets, ascending over all documents (a document
    goes on from the end of the one before); ``a_first``, ``b_first``: where each
    document's tokens start, and one more. Both token rows of a document end at
    the same offset. Each step calls ``emit(a, a2, b, b2)`` for the groups
    ``a_end[a:a2]`` x ``b_end[b:b2]`` that it closes.
    """
    last = np.diff(a_first) > 0
    ends = a_end[a_first[1:][last] - 1]
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    # entries: every `lane` bytes of a document
    number = np.maximum(1, -(-(ends - begins) // lane))
    doc = np.repeat(np.arange(len(ends)), number)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    start = begins[doc] + nth * lane
    stop = np.minimum(start + lane, ends[doc])
    # the first tokens that end at or after the start (after it, for a document's first entry)
    a = np.searchsorted(a_end, start + (nth == 0))
    b = np.searchsorted(b_end, start + (nth == 0))
    group_a, group_b = a.copy(), b.copy()
    synced = nth == 0
    while len(a):
        ea, eb = a_end[a], b_end[b]
        cut = ea == eb
        closes = cut & synced
        a2 = a + (ea <= eb)
        b2 = b + (eb <= ea)
        if closes.any():
            emit(group_a[closes], a2[closes], group_b[closes], b2[closes])
        starts = cut & (synced | (ea >= start))
        group_a = np.where(starts, a2, group_a)
        group_b = np.where(starts, b2, group_b)
        synced = synced | starts
        done = starts & (ea >= stop)
        a, b = a2, b2
        if done.any():      # compaction
            going = ~done
            a, b, group_a, group_b = a[going], b[going], group_a[going], group_b[going]
            start, stop, synced = start[going], stop[going], synced[going]


class _Links:
    """What the steps emit: groups, and links as (document, pair, number)."""

    def __init__(self, a_ids, a_doc, b_ids, docs: int):
        self.a_ids, self.a_doc, self.b_ids = a_ids, a_doc, b_ids
        self.cuts: list[tuple[np.ndarray, ...]] = []
        self.links: list[tuple[np.ndarray, ...]] = []
        self.total = np.zeros(docs, np.int64)

    def emit(self, a, a2, b, b2) -> None:
        self.cuts.append((a, a2, b, b2))
        m, n = a2 - a, b2 - b
        np.add.at(self.total, self.a_doc[a], m * n)
        for k in np.flatnonzero(m * n > LONG_GROUP):
            self._long(a[k], a2[k], b[k], b2[k])
        short = m * n <= LONG_GROUP
        a, b, m, n = a[short], b[short], m[short], n[short]
        size = m * n
        i = np.repeat(np.arange(len(size)), size)
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at_a, at_b = a[i] + pos // n[i], b[i] + pos % n[i]
        self._keep(self.a_doc[at_a], self.a_ids[at_a], self.b_ids[at_b], np.ones(len(i), np.int64))

    def _long(self, a, a2, b, b2) -> None:
        x, nx = np.unique(self.a_ids[a:a2], return_counts=True)
        y, ny = np.unique(self.b_ids[b:b2], return_counts=True)
        width = max(1, (1 << 20) // len(y))
        for at in range(0, len(x), width):
            some, times = x[at:at + width], nx[at:at + width]
            self._keep(np.full(len(some) * len(y), self.a_doc[a]), np.repeat(some, len(y)),
                       np.tile(y, len(some)), np.repeat(times, len(y)) * np.tile(ny, len(some)))

    def _keep(self, doc, a, b, number) -> None:
        if len(doc):
            self.links.append((doc, (a.astype(np.int64) << PAIR_BITS) | b, number))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, number of links), each document and pair once."""
        if not self.links:
            none = np.zeros(0, np.int64)
            return none, none, none
        doc, pair, number = (np.concatenate(x) for x in zip(*self.links))
        names, code = np.unique(pair, return_inverse=True)
        key = doc * len(names) + code
        order = np.argsort(key, kind="stable")
        key, number = key[order], number[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return (key[new] // len(names), names[key[new] % len(names)], np.add.reduceat(number, new))


def _digits(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the decimal ids, each followed by its mark, and where each ends."""
    power = 10 ** np.arange(9, -1, -1)
    width = np.maximum(1, np.searchsorted(10 ** np.arange(10), ids, side="right"))
    most = int(width.max()) if len(ids) else 1
    text = np.empty((len(ids), most + 1), np.uint8)
    for k in range(most):  # right-aligned
        text[:, k] = 48 + ids // power[10 - most + k] % 10
    text[:, most] = mark
    shown = np.arange(most + 1)[None, :] >= (most - width)[:, None]
    return text[shown], np.cumsum(width + 1)


def _sums(a_ids, b_ids, cuts, docs: int, a_doc) -> tuple[np.ndarray, list[str]]:
    """Number of groups and SHA-256 of the written groups of every document."""
    digests = [""] * docs
    if not cuts:
        return np.zeros(docs, np.int64), digests
    a, a2, b, b2 = (np.concatenate(x) for x in zip(*cuts))
    order = np.argsort(a)
    a, a2, b, b2 = a[order], a2[order], b[order], b2[order]
    number = np.bincount(a_doc[a], minlength=docs)
    # In writing order an A token stands after the B tokens of all groups before.
    place_a = np.arange(len(a_ids)) + np.repeat(b, a2 - a)
    place_b = np.arange(len(b_ids)) + np.repeat(a2, b2 - b)
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a_ids, b_ids
    mark[place_a[a2 - 1]] = ord("|")
    mark[place_b[b2 - 1]] = ord(";")
    doc_end = np.cumsum(number)
    for x in _runs(number, a2, b2):
        i, j = x
        group_from, group_to = doc_end[i] - number[i], doc_end[j - 1]
        lo, hi = a[group_from] + b[group_from], a2[group_to - 1] + b2[group_to - 1]
        data, ends = _digits(ids[lo:hi], mark[lo:hi])
        for k in range(i, j):
            if number[k]:
                g, h = doc_end[k] - number[k], doc_end[k] - 1
                start = a[g] + b[g] - lo
                end = ends[a2[h] + b2[h] - lo - 1]
                begin = ends[start - 1] if start else 0
                digests[k] = hashlib.sha256(data[begin:end - 1]).hexdigest()
    return number, digests


def _runs(number, a2, b2, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` tokens, of those that have groups."""
    ends = np.append(0, a2 + b2)
    tokens = np.diff(ends[np.append(0, np.cumsum(number))])
    i, n = 0, len(number)
    while i < n:
        if not number[i]:
            i += 1
            continue
        j, held = i + 1, tokens[i]
        while j < n and held + tokens[j] <= limit:
            held += tokens[j]
            j += 1
        yield i, j
        i = j


def align_batch(coder: Coder, column, lane: int = LANE):
    """Alignment of a text column: (n_a, n_b, n_groups, n_links, digests, links), where links
    are (row, pair, number of links), each row and pair once."""
    docs = len(column)
    a_ids, n_a, b_ids, n_b = coder.encode(column)
    a_first, b_first = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    a_doc = np.repeat(np.arange(docs), n_a)
    found = _Links(a_ids, a_doc, b_ids, docs)
    lockstep(np.cumsum(coder.a.vocabulary.size[a_ids]), a_first,
             np.cumsum(coder.b.vocabulary.size[b_ids]), b_first, found.emit, lane)
    number, digests = _sums(a_ids, b_ids, found.cuts, docs, a_doc)
    return n_a, n_b, number, found.total, digests, found.distinct()


_HEAD = pa.struct([("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())),
                   ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())),
                   ("n_links", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())),
                   ("size", pa.list_(pa.int64())), ("at", pa.binary()), ("n", pa.binary())])
_LINKS = ("chunk long, pair long, docs long, head struct<doc_id array<long>, n_a array<long>, "
          "n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, "
          "size array<long>, at binary, n binary>")


class _Chunk:
    """Documents whose (document, pair) rows add up to about ``CHUNK``."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, doc_id, n_a, n_b, n_groups, n_links, sha, links) -> None:
        row, pair, number = links
        size = np.bincount(row, minlength=len(doc_id)) if len(row) else np.zeros(len(doc_id), np.int64)
        self.parts.append((doc_id, n_a, n_b, n_groups, n_links, sha, size, pair, number))
        self.rows += len(row) + len(doc_id)

    def batches(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The head, and each pair of the chunk once with the number of its documents."""
        *head, pair, number = ([x for p in column for x in (p if isinstance(p, list) else p.tolist())]
                               if k < 7 else np.concatenate(column)
                               for k, column in enumerate(zip(*self.parts)))
        names, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
        value = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "size"), head))
        value |= {"at": at.astype(np.int32).tobytes(), "n": number.astype(np.int64).tobytes()}
        yield _links_batch([chunk], [-1], [0], pa.array([value], _HEAD))
        for i in range(0, len(names), 50_000):
            some = names[i:i + 50_000]
            yield _links_batch(np.full(len(some), chunk), some, docs[i:i + 50_000],
                               pa.nulls(len(some), _HEAD))


def _links_batch(chunk, pair, docs, head) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int64()), pa.array(pair, pa.int64()), pa.array(docs, pa.int64()), head],
        names=["chunk", "pair", "docs", "head"])


def _link(definition: str, model, chunk_rows: int):
    """Documents -> chunk heads and chunk pairs."""
    def run(batches):
        coder = _coder(definition, model.value)
        chunk, held = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            _, offsets = text_bytes(column)
            for i, j in slices(offsets, SLICE):
                for a in range(i, j, 4096):
                    b = min(j, a + 4096)
                    held.add(ids.slice(a, b - a).to_pylist(),
                             *align_batch(coder, column.slice(a, b - a)))
                    if held.rows >= chunk_rows:
                        yield from held.batches(chunk)
                        chunk, held = chunk + 1, _Chunk()
        if held.parts:
            yield from held.batches(chunk)
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's answers, in the order of its pairs -> one row."""
    for table in groups(batches, "chunk"):
        yield pa.RecordBatch.from_arrays(
            [table.column("chunk")[:1].combine_chunks(),
             pa.array([table.column("count").to_numpy().astype(np.int64).tobytes()], pa.binary()),
             pa.array([table.column("best").to_numpy().astype(np.int8).tobytes()], pa.binary())],
            names=["chunk", "count", "best"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's head and its answers -> its documents."""
    for batch in batches:
        for r in range(batch.num_rows):
            head = batch.column("head")[r].as_py()
            count = np.frombuffer(batch.column("count")[r].as_py() or b"", np.int64)
            best = np.frombuffer(batch.column("best")[r].as_py() or b"", np.int8)
            at = np.frombuffer(head["at"], np.int32)
            number = np.frombuffer(head["n"], np.int64)
            n = len(head["doc_id"])
            row = np.repeat(np.arange(n), head["size"])
            total, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, row, count[at] * number)
            np.add.at(hits, row, best[at] * number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(head["doc_id"], pa.int64()), *(pa.array(head[c], pa.int64())
                 for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(hits), pa.array(total),
                 pa.array(head["sha"], pa.string())],
                names=[c.split()[0] for c in SCHEMA.split(", ")])


def align(docs: DataFrame, definition: str | None = None, model: bytes | None = None,
          chunk_rows: int = CHUNK) -> DataFrame:
    """Alignment of every document, see above."""
    definition, model = definition or tokenizer_json(), model or piece_model()
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a model file, not the data
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.col("text").cast("string").alias("text"))
    links = write_table(each_batch(source, _link(definition, shared, chunk_rows), _LINKS,
                                   keep=True), "align-links")
    pairs = links.filter("pair >= 0")
    a_id = F.shiftright("pair", PAIR_BITS)
    counts = write_table(pairs.groupBy("pair").agg(F.sum("docs").alias("count")), "align-counts")
    top = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("top"))
    known = counts.join(top, a_id == F.col("a")).select(
        "pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    answers = (pairs.select("chunk", "pair").join(known, "pair")
               .repartition("chunk").sortWithinPartitions("chunk", "pair"))
    packed = each_batch(answers, _pack, "chunk long, count binary, best binary")
    heads = links.filter("pair < 0").select("chunk", "head")
    # one row per chunk on both sides
    return each_batch(heads.join(packed, "chunk", "left"), _answer, SCHEMA)
