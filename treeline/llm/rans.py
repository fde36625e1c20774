"""Range asymmetric numeral system over token ids, with a static frequency table.

A block holds up to ``BLOCK`` ids, dealt round-robin to ``LANES`` interleaved
coders that write one common stream of 32-bit words. All blocks share one
frequency table of precision ``2 ** BITS``; otherwise they are independent.
Every ``CHECKPOINT`` ids the coder notes its lane states and its place in the
stream, so the parts of a block can be decoded side by side. Many blocks (or
checkpointed parts) are worked through at once as rows of one array.

Layout of a block (little-endian): magic, version, lanes, ids, ids per
checkpoint, number of checkpoints, number of words, CRC-32 of the ids as 32-bit
integers; then the checkpoints' word positions (u32), their states (u64 x
lanes), and the words (u32). The last ids are padded to whole lanes with the
commonest id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LANES = 32
BLOCK = 1 << 16
CHECKPOINT = 1 << 13
TOGETHER = 64          # blocks coded side by side

_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHIIIII")
_MAGIC, _VERSION = b"tlra", 1


class Table:
    """Frequencies of all ids, scaled to a sum of ``2 ** BITS``."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.pad = int(np.argmax(freq))
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @staticmethod
    def scaled(counts: np.ndarray) -> np.ndarray:
        """Integer frequencies with sum ``2 ** BITS``; every counted id keeps at least 1."""
        total, goal = int(counts.sum()), 1 << BITS
        if total == 0:
            counts, total = np.concatenate([[1], np.zeros(max(0, len(counts) - 1))]), 1
        if np.count_nonzero(counts) > goal:
            raise ValueError(f"more than {goal} different ids")
        exact = counts * (goal / total)
        freq = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
        excess = int(freq.sum()) - goal
        order = np.argsort(-freq, kind="stable")
        if excess < 0:
            freq[order[0]] -= excess
        for k in order:  # take what is over from the commonest ids, at most half of each
            if excess <= 0:
                break
            take = min(excess, int(freq[k]) // 2)
            freq[k] -= take
            excess -= take
        return freq


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them, one range after the other."""
    out = np.repeat(first - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def encode(blocks: list[np.ndarray], table: Table) -> list[bytes]:
    """One byte string per block of ids."""
    out: list[bytes | None] = [None] * len(blocks)
    by_size: dict[int, list[int]] = {}
    for k, ids in enumerate(blocks):
        by_size.setdefault(len(ids), []).append(k)
    for size, which in by_size.items():
        for a in range(0, len(which), TOGETHER):
            some = which[a:a + TOGETHER]
            for k, data in zip(some, _encode_equal([blocks[k] for k in some], size, table)):
                out[k] = data
    return out


def _encode_equal(blocks: list[np.ndarray], size: int, table: Table) -> list[bytes]:
    steps = -(-size // LANES)
    ids = np.full((steps, len(blocks), LANES), table.pad, np.uint32)
    for k, block in enumerate(blocks):
        ids[:size // LANES, k] = block[:size // LANES * LANES].reshape(-1, LANES)
        ids[size // LANES:, k, :size % LANES] = block[size // LANES * LANES:]
    x = np.full((len(blocks), LANES), _LOW, np.uint64)
    words = np.zeros((steps, len(blocks), LANES), np.uint32)
    full = np.zeros((steps, len(blocks), LANES), bool)
    per = CHECKPOINT // LANES
    states = []
    top, half, whole = np.uint64(63 - BITS), np.uint64(32), np.uint64(1 << BITS)
    for t in range(steps - 1, -1, -1):
        own = ids[t].astype(np.int64)
        f = table.freq[own]
        over = np.greater_equal(x, f << top, out=full[t])
        words[t] = x
        np.right_shift(x, half, out=x, where=over)
        # (x // f << BITS) + x % f + start
        q = x // f
        q *= whole - f
        x += q
        x += table.start[own]
        if t % per == 0:
            states.append(x.copy())
    states.reverse()
    out = []
    for k, block in enumerate(blocks):
        mask = full[:, k, :]
        place = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
        at = place[0:steps:per].astype("<u4")
        stream = words[:, k, :][mask].astype("<u4")
        state = np.array([s[k] for s in states], "<u8").reshape(-1)
        crc = zlib.crc32(np.ascontiguousarray(block, "<u4").tobytes())
        out.append(_HEAD.pack(_MAGIC, _VERSION, LANES, size, CHECKPOINT, len(at), len(stream), crc)
                   + at.tobytes() + state.tobytes() + stream.tobytes())
    return out


def decode(data: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of each block; raises where a checksum differs."""
    out = []
    for a in range(0, len(data), TOGETHER):
        out += _decode_some(data[a:a + TOGETHER], table)
    return out


def _decode_some(data: list[bytes], table: Table) -> list[np.ndarray]:
    heads, parts, streams, base = [], [], [], 0
    for k, raw in enumerate(data):
        magic, version, lanes, size, every, n_at, n_words, crc = _HEAD.unpack_from(raw)
        if magic != _MAGIC or version != _VERSION or lanes != LANES:
            raise ValueError("not a token block of this format")
        at = np.frombuffer(raw, "<u4", n_at, _HEAD.size)
        state = np.frombuffer(raw, "<u8", n_at * lanes, _HEAD.size + 4 * n_at)
        streams.append(np.frombuffer(raw, "<u4", n_words, _HEAD.size + 4 * n_at + 8 * n_at * lanes))
        steps, per = -(-size // lanes), every // lanes
        heads.append((size, crc, np.empty(steps * lanes, np.uint32)))
        for c in range(n_at):
            parts.append((min(per, steps - c * per), k, c * every, base + int(at[c]),
                          state[c * lanes:(c + 1) * lanes]))
        base += n_words
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    by_steps: dict[int, list] = {}
    for p in parts:
        by_steps.setdefault(p[0], []).append(p)
    mask, bits, half = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for steps, some in by_steps.items():
        x = np.array([p[4] for p in some], np.uint64)
        at = np.array([p[3] for p in some], np.int64)
        ids = np.empty((steps, len(some), LANES), np.uint32)
        for t in range(steps):
            slot = x & mask
            s = table.symbol[slot.astype(np.int64)]
            ids[t] = s
            s = s.astype(np.int64)
            x >>= bits
            x *= table.freq[s]
            x += slot
            x -= table.start[s]
            # Lanes below the least state take the next words, in their order.
            need = x < _LOW
            lanes = need.sum(axis=1)
            x[need] = (x[need] << half) | stream[ranges(at, lanes)]
            at += lanes
        for j, (_, k, first, _, _) in enumerate(some):
            heads[k][2][first:first + steps * LANES] = ids[:, j, :].reshape(-1)
    out = []
    for size, crc, ids in heads:
        ids = ids[:size]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("token block with a wrong checksum")
        out.append(ids)
    return out


def _gf2_times(matrix: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector >>= 1
        k += 1
    return total


_ZERO_BYTES: list[list[int]] = []


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from their CRCs.

    Appending 2^k zero bytes to a string changes its CRC by a linear map over
    GF(2); the maps for all k are kept.
    """
    k = 0
    while second_bytes >> k:
        if len(_ZERO_BYTES) == k:
            if k:
                m = _ZERO_BYTES[-1]
                _ZERO_BYTES.append([_gf2_times(m, c) for c in m])
            else:
                m = [0xEDB88320] + [1 << i for i in range(31)]   # one zero bit
                for _ in range(3):
                    m = [_gf2_times(m, c) for c in m]
                _ZERO_BYTES.append(m)
        if second_bytes >> k & 1:
            first = _gf2_times(_ZERO_BYTES[k], first)
        k += 1
    return first ^ second
