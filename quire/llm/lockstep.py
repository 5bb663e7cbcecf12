"""The transducer of quire.llm.bpe over many short pieces in lockstep: numpy arrays instead of one piece after the other.

The same steps: the tokens that end at each place, of which the one that fits behind the last token of the shorter
prefix is the last token there; then back from each piece's end.
"""

from __future__ import annotations

import numpy as np


class Table:
    """A map from int64 keys of 0 or more to int32 values by open addressing; a quarter full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys  # of several for one slot, the last
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            at = slots[open_] = (slots[open_] + 1) & self.mask
            there, want = self.keys[at], keys[open_]
            hit = there == want
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (there != -1)]
        return out


class Lockstep:
    """Pieces in, the tokens of each out."""

    def __init__(self, whole: dict[bytes, int], pair: dict[int, int], rank_of, left_of, right_of):
        """whole: tokens by their bytes; pair: rank by both tokens in one number; rank_of, left_of, right_of: by token."""
        self.rank_of, self.left_of, self.right_of = (np.array(x, np.int32) for x in (rank_of, left_of, right_of))
        self.pair = Table(np.fromiter(pair.keys(), np.int64, len(pair)), np.fromiter(pair.values(), np.int32, len(pair)))
        self.size_of = np.zeros(len(self.rank_of), np.int32)
        ids, sizes = np.fromiter(whole.values(), np.int32, len(whole)), np.fromiter(map(len, whole), np.int32, len(whole))
        self.size_of[ids] = sizes
        self.ids = list(range(len(self.rank_of)))
        # The tree of all tokens' bytes, level by level; node 0 is its root.
        flat, begin = np.frombuffer(b"".join(whole), np.uint8).astype(np.int64), np.cumsum(sizes) - sizes
        node, live, n, level = np.zeros(len(ids), np.int64), np.arange(len(ids)), 1, 0
        edges, token = [np.empty(0, np.int64)], {}
        while len(live):
            new, which = np.unique(node[live] << 8 | flat[begin[live] + level], return_inverse=True)
            edges.append(new)
            node[live] = n + which
            n, level = n + len(new), level + 1
            live = live[sizes[live] > level]
        self.token = np.full(n, -1, np.int32)
        self.token[node] = ids
        edges = np.concatenate(edges)
        self.tree = Table(edges, np.arange(1, n, dtype=np.int32))

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Merges.fits for tokens side by side; ranks count double, so that a half is a whole number."""
        ok, live, before = np.ones(len(x), bool), np.arange(len(x)), np.full(len(x), 1 << 40, np.int64)
        x, y = x.astype(np.int64), y.astype(np.int64)
        while len(live):
            across = self.pair(x << 32 | y)
            joined = (across >= 0) & (2 * across.astype(np.int64) < before)
            ok[live[joined]] = False
            r, q = self.rank_of[x], self.rank_of[y]
            on = np.flatnonzero(~joined & ((r >= 0) | (q >= 0)))
            live, x, y, r, q = live[on], x[on], y[on], r[on].astype(np.int64), q[on].astype(np.int64)
            left = r > q
            before = np.where(left, 2 * r, 2 * q + 1)
            x, y = np.where(left, self.right_of[x], x), np.where(left, y, self.left_of[y])
        return ok

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """pieces: none of them empty."""
        if not pieces:
            return []
        flat, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        # The tokens that begin at each place.
        at, node, length, met = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0, []
        while len(at):
            node = self.tree(node << 8 | flat[at + length]).astype(np.int64)
            at, node, length = at[node >= 0], node[node >= 0], length + 1
            token = self.token[node]
            some = np.flatnonzero(token >= 0)
            met.append((at[some], token[some], np.full(len(some), length, np.int32)))
            more = at + length < ends[piece[at]]
            at, node = at[more], node[more]
        begin, token, length = (np.concatenate(x) for x in zip(*met))
        # By the length of the prefix that they end.
        own = piece[begin]
        prefix = begin + length - (ends - sizes)[own]
        order = np.argsort(prefix.astype(np.uint16), kind="stable")
        begin, token, length, own = begin[order], token[order], length[order], own[order]
        steps = np.cumsum(np.bincount(prefix))
        # Prefixes of a piece lie behind each other, the empty one first: a place more than bytes for each piece.
        last = np.full(len(flat) + len(pieces), -2, np.int32)
        heads = ends - sizes + np.arange(len(pieces))
        last[heads] = -1
        before = begin + own
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            x, t = last[before[a:b]], token[a:b]
            ok = x == -1
            rest = np.flatnonzero(~ok)
            ok[rest] = self.fits(x[rest], t[rest])
            last[before[a:b][ok] + length[a:b][ok]] = t[ok]
        if (last == -2).any():
            raise ValueError("the merge list has no encoding for this input")
        # Back from the ends.
        ours, counts = np.zeros(len(last), bool), np.zeros(len(pieces), np.int64)
        live, place = np.arange(len(pieces)), heads + sizes
        while len(live):
            ours[place] = True
            counts[live] += 1
            place = place - self.size_of[last[place]]
            on = place > heads[live]
            live, place = live[on], place[on]
        ids = list(map(self.ids.__getitem__, last[ours].tolist()))  # one object a token: they are kept
        to = np.cumsum(counts).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *to], to)]
