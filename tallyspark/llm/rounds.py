"""Merge rounds of BPE over flat arrays: every segment of a block advances at once."""

from __future__ import annotations

import numpy as np

#: The rank of a pair that never merges.
NEVER = np.iinfo(np.int32).max


class Rounds:
    """Merge table: pair of symbols to rank and resulting symbol.

    Symbols are integers below width. In each round, every segment finds the best rank among its neighbouring pairs (a
    segmented minimum); its leftmost pairs of that rank are merged, as many as a queue by rank and place would take
    before a pair of the same rank or a better one arises; the arrays are compacted. Segments without a pair leave.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], width: int) -> None:
        self.width = width
        order = sorted(pairs)
        self.keys = np.array([a * width + b for a, b in order], np.int64)
        self.ranks = np.array([pairs[k][0] for k in order], np.int32)
        self.into = np.array([pairs[k][1] for k in order], np.int64)
        #: a direct-mapped table in front of the sorted keys
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[self._hash(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        self.hidden = np.zeros(1 << 20, bool)  # slots that hide further keys
        self.hidden[self._hash(self.keys)[self.keys[self.slot[self._hash(self.keys)]] != self.keys]] = True

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NEVER if it has none, and its place in into."""
        keys = left * self.width + right
        spot = self._hash(keys)
        at = self.slot[spot]
        hit = self.keys[at] == keys
        hit &= at >= 0
        rest = np.flatnonzero(self.hidden[spot] & ~hit)
        if len(rest):
            found = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            ok = self.keys[found] == keys[rest]
            at[rest[ok]] = found[ok]
            hit[rest[ok]] = True
        return np.where(hit, self.ranks[at], NEVER), at

    def run(self, seg: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """seg: ascending numbers of segments; sym: symbols. Gives both after the last merge, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, at = self._ranked(seg, sym)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            alive = best < NEVER
            if not alive.all():
                keep = np.repeat(alive, sizes)
                done.append((seg[~keep], sym[~keep]))
                seg, sym, rank, at, best, sizes = seg[keep], sym[keep], rank[keep], at[keep], best[alive], sizes[alive]
                if not len(sym):
                    break
            take = self._leftmost(np.flatnonzero(rank == np.repeat(best, sizes)), seg)
            take = self._before_better(take, seg, sym, rank, at)
            sym[take] = self.into[at[take]]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            fresh = np.zeros(len(sym), bool)  # pairs to look up again: those that a merged symbol begins or ends
            fresh[take] = True
            fresh = fresh[keep]
            seg, sym, rank, at = seg[keep], sym[keep], rank[keep], at[keep]
            fresh[:-1] |= fresh[1:]
            new = np.flatnonzero(fresh)
            self._update(new, seg, sym, rank, at)
        if not done:
            return seg, sym
        seg, sym = (np.concatenate([d[k] for d in done]) for k in range(2))
        order = np.argsort(seg, kind="stable")
        return seg[order], sym[order]

    def _ranked(self, seg: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, at = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int32)
        self._update(np.arange(len(sym)), seg, sym, rank, at)
        return rank, at

    def _update(self, new: np.ndarray, seg: np.ndarray, sym: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        if len(new) and new[-1] == len(sym) - 1:
            rank[-1] = NEVER
            new = new[:-1]
        found, places = self.look(sym[new], sym[new + 1])
        rank[new] = np.where(seg[new] == seg[new + 1], found, NEVER)
        at[new] = places

    @staticmethod
    def _leftmost(take: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Of runs of overlapping pairs, the first, third and so on."""
        if len(take) < 2:
            return take
        fresh = np.r_[True, (take[1:] != take[:-1] + 1) | (seg[take[1:]] != seg[take[:-1]])]
        if fresh.all():
            return take
        at = np.arange(len(take))
        return take[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]

    def _before_better(self, take: np.ndarray, seg: np.ndarray, sym: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each segment's pairs up to the first whose merge makes a pair of the same rank or a better one."""
        first = np.r_[True, seg[take[1:]] != seg[take[:-1]]]
        if first.all():
            return take
        new, own = self.into[at[take]], rank[take]
        before = np.maximum(take - 1, 0)
        left = np.where(np.r_[False, take[1:] == take[:-1] + 2] & ~first, np.r_[0, new[:-1]], sym[before])
        after = np.minimum(take + 2, len(sym) - 1)
        has_left, has_right = (take > 0) & (seg[before] == seg[take]), (take + 2 < len(sym)) & (seg[after] == seg[take])
        stop = (has_left & (self.look(left, new)[0] <= own)) | (has_right & (self.look(new, sym[after])[0] <= own))
        stops = np.cumsum(stop) - stop  # before this pair
        return take[stops == np.maximum.accumulate(np.where(first, stops, 0))]


class Remembered:
    """Ids by key, flat, for a bounded number of keys; learn() gives the ids of keys it hasn't seen."""

    def __init__(self, learn, most: int) -> None:
        self.learn, self.most = learn, most
        self._forget()

    def _forget(self) -> None:
        self.at: dict = {}
        self.ids, self.lens, self.starts, self.used = np.empty(1 << 20, np.uint32), np.empty(1 << 18, np.int32), np.empty(1 << 18, np.int64), 0

    def know(self, keys: set) -> None:
        missing = keys.difference(self.at)
        if not missing:
            return
        if len(self.at) + len(missing) > self.most and self.at:
            self._forget()
            missing = keys
        missing = list(missing)
        flat, lens = self.learn(missing)
        n, m = len(self.at), len(missing)
        for name, need in (("ids", self.used + len(flat)), ("lens", n + m), ("starts", n + m)):
            if need > len(a := getattr(self, name)):
                setattr(self, name, np.concatenate([a, np.empty(max(need - len(a), len(a) // 2), a.dtype)]))
        self.ids[self.used : self.used + len(flat)] = flat
        self.lens[n : n + m] = lens
        self.starts[n : n + m] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        self.at.update(zip(missing, range(n, n + m)))

    def joined(self, keys: list) -> np.ndarray:
        """Ids of known keys, one after another."""
        return self.spread(np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys)))

    def spread(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.uint32)
        lens = self.lens[at].astype(np.int64)
        ends = np.cumsum(lens)
        return self.ids[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(int(ends[-1]))]
