"""Token ids of texts by the tokenizers library, with a memory for repeated pieces.

Texts are worked on as one array of UTF-8 bytes. Byte-level pre-tokenisation cuts
a text where a letter, digit, mark or white space meets another kind; the bytes
alone show most of these places. Between two of them lies a *unit*, whose ids do
not depend on what stands around it, so a text's ids are those of its units, one
after the other. Each new unit is encoded by the library and remembered.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from treeline.llm.rans import ranges

CACHED = 1 << 21     # units kept, of eight ids on average; beyond, those not met twice are dropped
SHORT = 15           # bytes of a unit that is kept as two numbers
LONG = 64            # units beyond this many bytes are not kept
TOGETHER = 1 << 17   # units looked up at a time
TEXT = 1 << 13       # new units encoded as one text

_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _WHITE, _ODD, _TAIL = range(8)


def _kinds() -> np.ndarray:
    """Kind of each byte; of letters beyond ASCII those with first bytes that begin letters only."""
    kind = np.full(256, _ODD, np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = (_LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK)
    kind[[*range(9, 14)]] = _WHITE
    kind[[*range(28, 32)]] = _ODD
    kind[ord(" ")], kind[ord("'")] = _SPACE, _QUOTE
    kind[128:192] = _TAIL
    kind[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = _LETTER   # U+00C0 to U+027F, U+0400 to U+047F
    return kind


def _cuts() -> np.ndarray:
    """Whether a unit begins between two kinds: ``[8 * first + second]``."""
    cut = np.zeros((8, 8), bool)
    cut[_LETTER, [_DIGIT, _MARK, _QUOTE, _SPACE, _WHITE]] = True
    cut[_DIGIT, [_LETTER, _MARK, _QUOTE, _SPACE, _WHITE]] = True
    cut[_MARK, [_LETTER, _DIGIT, _SPACE, _WHITE]] = True     # marks and a quote are one piece
    cut[_QUOTE, [_DIGIT, _SPACE, _WHITE]] = True             # a quote may begin 's, 'll
    cut[_ODD, [_SPACE, _WHITE]] = True                       # unless that character is white
    cut[_WHITE, [_LETTER, _DIGIT, _MARK, _QUOTE]] = True     # after a single one only
    return cut.reshape(-1)


_KIND, _CUT = _kinds(), _cuts()
# White space beyond ASCII (and U+180E, which was one) as the number its bytes make.
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (
    0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _byte_chars() -> np.ndarray:
    """Code point by which a byte-level vocabulary writes each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    chars = np.zeros(256, np.uint32)
    chars[own] = own
    chars[other] = 256 + np.arange(len(other))
    return chars


def units(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of the bytes, and the places where units begin; ``begins``: where texts do."""
    kind = _KIND[data]
    tail = np.flatnonzero(kind == _TAIL)
    if len(tail):
        before = data[tail - 1]
        kind[tail] = np.where((before >= 0xC0) & (_KIND[before] == _LETTER), _LETTER, _ODD)
        # The two signs among the letters.
        sign = tail[(before == 0xC3) & ((data[tail] == 0x97) | (data[tail] == 0xB7))]
        kind[sign], kind[sign - 1] = _ODD, _ODD
    cut = np.zeros(len(data), bool)
    cut[1:] = _CUT[(kind[:-1] << 3) | kind[1:]]
    at = np.flatnonzero(cut)
    odd = at[kind[at - 1] == _ODD]
    if len(odd):
        b = [data[np.maximum(odd - k, 0)].astype(np.int64) for k in (1, 2, 3)]
        two = b[1] << 8 | b[0]
        cut[odd[(b[0] < 128) | np.isin(two, _WIDE) | np.isin(b[2] << 16 | two, _WIDE)]] = False
    cut[begins] = True
    white = at[kind[at - 1] == _WHITE]
    cut[white[~cut[white - 1]]] = False
    cut[begins] = True
    return kind, np.flatnonzero(cut)


class _Memory:
    """Ids of known units, one after the other; short units in a hash table of numbers."""

    def __init__(self, dtype):
        self.ids, self.used = np.zeros(1 << 12, dtype), 0
        self.first = np.zeros(1 << 10, np.int64)
        self.size = np.zeros(1 << 10, np.int32)
        self.low = np.zeros(1 << 10, np.uint64)
        self.high = np.zeros(1 << 10, np.uint64)
        self.met = np.zeros(1 << 10, bool)
        self.n = 0
        self.long: dict[bytes, int] = {}
        self._lay(12)

    def _lay(self, bits: int) -> None:
        """An empty table of ``2 ** bits`` places for the short units kept so far."""
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        self._place(np.flatnonzero(self.high[:self.n]).astype(np.int32))

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _MIX[0] ^ (high * _MIX[1])
        h ^= h >> np.uint64(32)
        return (h * _MIX[2] >> self.shift).astype(np.int64)

    def _place(self, index: np.ndarray) -> None:
        slot = self._slots(self.low[index], self.high[index])
        while len(index):
            free = self.table[slot] < 0
            self.table[slot[free]] = index[free]
            left = self.table[slot] != index
            index, slot = index[left], (slot[left] + 1) & self.last

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of short units, which are compared in full; -1 where not known."""
        slot = self._slots(low, high)
        index = self.table[slot]
        left = np.flatnonzero((index >= 0) & ((self.low[index] != low) | (self.high[index] != high)))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            some = self.table[slot[left]]
            index[left] = some
            left = left[(some >= 0) & ((self.low[some] != low[left]) | (self.high[some] != high[left]))]
        return index

    def keep(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, size: np.ndarray) -> int:
        """Add units (high 0: one that is not in the table); returns the place of the first."""
        a, b, end = self.n, self.n + len(size), self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used],
                                       np.zeros(max(end, 2 * self.used) - self.used, self.ids.dtype)])
        if b > len(self.low):
            more = max(b, 2 * a) - a
            for name in ("first", "size", "low", "high", "met"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old[:a], np.zeros(more, old.dtype)]))
        self.ids[self.used:end] = ids
        self.first[a:b] = self.used + np.cumsum(size) - size
        self.size[a:b], self.low[a:b], self.high[a:b], self.met[a:b] = size, low, high, False
        self.n, self.used = b, end
        if 2 * b > self.last:
            self._lay((2 * b).bit_length() + 1)
        else:
            self._place((a + np.flatnonzero(high)).astype(np.int32))
        return a

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the places one after the other, and how many each has."""
        size = self.size[index].astype(np.int64)
        return self.ids[ranges(self.first[index], size)], size

    def prune(self) -> None:
        """Drop what was not met again since the last time; all of it where that drops little."""
        again = np.flatnonzero(self.met[:self.n])
        if 2 * len(again) > self.n:
            again = again[:0]
        ids, size = self.take(again)
        low, high = self.low[again], self.high[again]
        place = np.full(self.n, -1)
        place[again] = np.arange(len(again))
        long = {k: int(place[v]) for k, v in self.long.items() if place[v] >= 0}
        self.__init__(self.ids.dtype)
        self.keep(low, high, ids, size)
        self.long = long


class Encoder:
    """Ids of texts. Tokenizers other than byte-level BPE without a normaliser, and texts
    that contain an added token, are encoded whole."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.splits = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                       and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                       and model.get("type") == "BPE"
                       and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix",
                                                          "end_of_word_suffix", "byte_fallback")))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() < 1 << 16 else np.uint32
        if self.splits:
            # The same model for single pieces that are already written byte by byte.
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.chars = _byte_chars()
            self.width = np.zeros(1 + max(self.tokenizer.get_vocab().values()), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self.width[i] = len(token)
        self.memory = _Memory(self.dtype)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [], []
        for a in range(0, len(texts), TEXT):
            coded = self.tokenizer.encode_batch_fast(texts[a:a + TEXT], add_special_tokens=False)
            ids += [np.array(e.ids, self.dtype) for e in coded]
            n += map(len, coded)
        return np.concatenate(ids), np.array(n, np.int64)

    def _new(self, data, kind, at, size) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at ``at``, and how many each has."""
        where = ranges(at, size)
        begin = np.cumsum(size) - size
        # A unit of one kind, but for a space before it, is a single piece.
        own = kind[where]
        inner = np.ones(len(own), bool)
        inner[begin] = False
        rough = (own == _ODD) | (own == _QUOTE)
        rough[1:] |= inner[1:] & (((own[1:] != own[:-1]) & (own[:-1] != _SPACE))
                                  | (own[1:] == _SPACE) | (own[1:] == _WHITE))
        rough = np.logical_or.reduceat(rough, begin)
        plain, rest = np.flatnonzero(~rough), np.flatnonzero(rough)
        n = np.zeros(len(at), np.int64)
        parts = []
        if len(plain):
            ids, n[plain] = self._pieces(data, at[plain], size[plain])
            parts.append(ids)
        if len(rest):
            ids, n[rest] = self._flat(_strings(data, at[rest], size[rest]))
            parts.append(ids)
        if len(parts) == 1:
            return parts[0], n
        out = np.empty(n.sum(), self.dtype)
        first = np.cumsum(n) - n
        for which, ids in zip((plain, rest), parts):
            out[ranges(first[which], n[which])] = ids
        return out, n

    def _pieces(self, data, at, size) -> tuple[np.ndarray, np.ndarray]:
        """The same for units that are single pieces: many as one text, told apart by the
        number of bytes that each id stands for."""
        chars = np.full(int(size.sum()) + len(size), ord(" "), np.uint32)
        chars[ranges(np.cumsum(size + 1) - size - 1, size)] = self.chars[data[ranges(at, size)]]
        ends = np.cumsum(size + 1)
        cut = [0, *ends[TEXT - 1:-1:TEXT].tolist(), len(chars)]
        ids = np.concatenate([
            np.array(self.pieces.encode_batch_fast([chars[a:b].tobytes().decode("utf-32-le")],
                                                   add_special_tokens=False)[0].ids, self.dtype)
            for a, b in zip(cut, cut[1:])])
        reach = np.cumsum(self.width[ids])
        want = np.cumsum(size)
        last = np.searchsorted(reach, want)
        if len(ids) and last[-1] == len(ids) - 1 and (reach[last] == want).all():
            return ids, np.diff(last, prepend=-1)
        return self._flat(_strings(data, at, size))  # a vocabulary without some byte

    def _look_up(self, data, kind, at, size) -> np.ndarray:
        """Places of the units in the memory, which learns the new ones."""
        memory = self.memory
        words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        low = words[at] & _KEEP[np.minimum(size, 8)]
        high = words[at + 8] & _KEEP[np.clip(size - 8, 0, 7)]
        high |= size.astype(np.uint64) << np.uint64(56)   # never 0
        long = np.flatnonzero(size > SHORT)
        index = memory.find(low, high)
        names = []
        if len(long):
            names = [data[a:a + n].tobytes() for a, n in zip(at[long].tolist(), size[long].tolist())]
            index[long] = [memory.long.get(k, -1) for k in names]
        memory.met[index[index >= 0]] = True
        new = np.flatnonzero((index < 0) & (size <= SHORT))
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            a, b = low[order], high[order]
            head = np.ones(len(order), bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            one = order[head]
            ids, n = self._new(data, kind, at[one], size[one])
            index[order] = memory.keep(low[one], high[one], ids, n) + np.cumsum(head) - 1
        new = {k: i for k, i, j in zip(names, long.tolist(), index[long].tolist()) if j < 0}
        if new:
            one = np.fromiter(new.values(), np.int64, len(new))
            ids, n = self._new(data, kind, at[one], size[one])
            none = np.zeros(len(one), np.uint64)
            first = memory.keep(none, none, ids, n)
            places = dict(zip(new, range(first, first + len(new))))
            memory.long |= {k: v for k, v in places.items() if len(k) <= LONG}
            index[long] = [places.get(k, j) for k, j in zip(names, index[long].tolist())]
        return index

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (a list or an Arrow array; null counts as empty) one after the
        other, and how many each has."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "").cast(pa.large_string())
        column.validate(full=True)  # UTF-8
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][:len(column) + 1]
        a, b = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
        raw = bytes(memoryview(column.buffers()[2])[a:b]) if b > a else b""
        if not self.splits or any(t.encode() in raw for t in self.added):
            texts = column.to_pylist()
            whole = np.array([not self.splits or any(t in x for t in self.added) for x in texts], bool)
            if whole.any():
                return self._some_whole(column, whole)
        begins = offsets[:-1] - a
        data = np.zeros(b - a + 24, np.uint8)
        data[:b - a] = np.frombuffer(raw, np.uint8)
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(len(column), np.int64)
        kind, at = units(data[:b - a], begins[begins < b - a])
        size = np.diff(at, append=b - a)
        ids, n = [], []
        for k in range(0, len(at), TOGETHER):
            if self.memory.n > CACHED or self.memory.used > 8 * CACHED:
                self.memory.prune()
            some = self._look_up(data, kind, at[k:k + TOGETHER], size[k:k + TOGETHER])
            taken = self.memory.take(some)
            ids.append(taken[0])
            n.append(taken[1])
        total = np.concatenate([[0], np.cumsum(np.concatenate(n))])
        cut = np.searchsorted(at, np.append(begins, b - a))
        return np.concatenate(ids), np.diff(total[cut])

    def _some_whole(self, column: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.zeros(len(column), np.int64)
        parts = {}
        for which, encode in ((whole, self._flat), (~whole, self.encode)):
            if which.any():
                parts[which is whole], sizes[which] = encode(
                    column.filter(pa.array(which)).to_pylist())
        first = np.cumsum(sizes) - sizes
        out = np.empty(sizes.sum(), self.dtype)
        for is_whole, ids in parts.items():
            which = whole if is_whole else ~whole
            out[ranges(first[which], sizes[which])] = ids
        return out, sizes


def _strings(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[str]:
    return [data[a:a + n].tobytes().decode() for a, n in zip(at.tolist(), size.tolist())]
