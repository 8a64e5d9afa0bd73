"""Count vectors of hashed shingles and the R-tree over them.  NumPy only.

A point has SPREAD groups and more for each shingle, so that two sets' other shingles rarely fall into one group and the sum of
the smaller counts is close to the true overlap.  It is kept sparse: the ascending groups of its shingles, a group once
for each.  Points of different resolution are compared at the coarser one.  Boxes hold counts of COARSE groups.
"""

from __future__ import annotations

import numpy as np

LEAF = 16
COARSE = 64  # groups of the points that the boxes hold
SPREAD = 64  # groups for each shingle, at least
LEAF_PAIRS = 64  # pairs of leaves whose points are compared at a time: LEAF * LEAF rows of COARSE counts for each
_DENSE = 1 << 22  # groups up to which counts are looked up in a table
_AT_ONCE = 1 << 20  # groups of other points that are compared with a point's at a time, about


def point_of(values: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits, ascending groups) of a set's ascending hashes: their leading bits."""
    bits = max((COARSE - 1).bit_length(), int(SPREAD * len(values) - 1).bit_length())
    return bits, (values >> np.uint64(64 - bits)).astype(np.int64)


def pack_point(bits: int, groups: np.ndarray) -> bytes:
    """Gaps between groups, byte plane by byte plane; planes of zeros at the end are left out."""
    gaps = np.diff(groups, prepend=0).astype("<u8")
    planes = max(1, -(-int(gaps.max()).bit_length() // 8))
    return bytes([bits, planes]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack_point(packed: bytes) -> tuple[int, np.ndarray]:
    bits, planes = packed[0], packed[1]
    raw = np.frombuffer(packed, np.uint8, offset=2).reshape(planes, -1)
    gaps = np.zeros(raw.shape[1], np.int64)
    for k in range(planes):
        gaps |= raw[k].astype(np.int64) << (8 * k)
    return bits, np.cumsum(gaps)


def may_reach(overlap, n_a, n_b, percent: int):
    """True unless the overlap bound rules out 100 * intersection >= percent * union."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


class CountVectorTree:
    """A packed R-tree over (size, counts of COARSE groups), bulk loaded by sort-tile order.

    A node's box has the least and the largest size and count in each group.  Two nodes are
    joined only if the sum over groups of the smaller of their largest counts, which no pair
    of their points can exceed as an overlap, still reaches the similarity asked for.
    """

    def __init__(self, points: list[tuple[int, np.ndarray]]):
        self.bits = np.array([b for b, _ in points], np.int64)
        self.groups = [g for _, g in points]
        self.size = np.array([len(g) for g in self.groups], np.int64)
        fine = (COARSE - 1).bit_length()
        coarse = np.array([np.bincount(g >> (b - fine), minlength=COARSE) for b, g in points], np.int32).reshape(len(points), COARSE)
        spread = coarse[:, np.argmax(coarse.var(0))] if len(coarse) else np.zeros(0)
        order = np.argsort(self.size, kind="stable")
        tile = LEAF * max(1, int(np.sqrt(max(1, len(order) // LEAF))))
        order = np.concatenate([s[np.argsort(spread[s], kind="stable")] for s in (order[i : i + tile] for i in range(0, len(order), tile))]) if len(order) else order
        self.order, self.coarse = order, coarse
        lo = np.arange(0, len(order), LEAF)
        hi = np.append(lo[1:], len(order))
        most = np.array([coarse[order[a:b]].max(0) for a, b in zip(lo, hi)]).reshape(-1, COARSE)
        small = np.array([self.size[order[a:b]].min() for a, b in zip(lo, hi)], np.int64)
        large = np.array([self.size[order[a:b]].max() for a, b in zip(lo, hi)], np.int64)
        # levels[0] holds the leaves; a node of level k + 1 has the LEAF nodes of level k below it
        self.levels = [(most, small, large)]
        while len(self.levels[-1][0]) > 1:
            m, s, g = self.levels[-1]
            cut = range(0, len(m), LEAF)
            self.levels.append((np.array([m[i : i + LEAF].max(0) for i in cut]), np.array([s[i : i + LEAF].min() for i in cut]), np.array([g[i : i + LEAF].max() for i in cut])))

    def _meet(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        most, small, large = self.levels[level]
        near = (100 * large[a] >= percent * small[b]) & (100 * large[b] >= percent * small[a])
        keep = np.flatnonzero(near)
        if len(keep):
            bound = np.minimum(most[a[keep]], most[b[keep]]).sum(1)
            # an overlap can't exceed a size either
            bound = np.minimum(bound, np.minimum(large[a[keep]], large[b[keep]]))
            keep = keep[may_reach(bound, small[a[keep]], small[b[keep]], percent)]
        return keep

    def pairs(self, percent: int, wanted=None, step: int = 1 << 11):
        """Yields (i, j) index arrays of pairs i < j that boxes and counts of COARSE groups leave; wanted(i, j) -> mask."""
        if len(self.size) < 2:
            return
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > step:
                stack += [(level, a[k : k + step], b[k : k + step]) for k in range(0, len(a), step)]
                continue
            keep = self._meet(level, a, b, percent)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                for k in range(0, len(a), LEAF_PAIRS):
                    i, j = self._leaf_pairs(a[k : k + LEAF_PAIRS], b[k : k + LEAF_PAIRS], percent)
                    if wanted is not None and len(i):
                        ok = wanted(i, j)
                        i, j = i[ok], j[ok]
                    if len(i):
                        yield i.astype(np.int32), j.astype(np.int32)
                continue
            x, y = self._below(a, b, len(self.levels[level - 1][0]))
            ok = x <= y
            stack.append((level - 1, x[ok], y[ok]))

    @staticmethod
    def _below(a: np.ndarray, b: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of what lies below the nodes a and b, of below in all."""
        x = (a[:, None] * LEAF + np.arange(LEAF)).clip(max=below)  # below marks what isn't there
        y = (b[:, None] * LEAF + np.arange(LEAF)).clip(max=below)
        x, y = np.broadcast_to(x[:, :, None], (len(a), LEAF, LEAF)).ravel(), np.broadcast_to(y[:, None, :], (len(a), LEAF, LEAF)).ravel()
        ok = (x < below) & (y < below)
        return x[ok], y[ok]

    def _leaf_pairs(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs i < j of points of the leaves a and b that sizes and counts of COARSE groups leave."""
        x, y = self._below(a, b, len(self.order))
        ok = x < y
        i, j = self.order[x[ok]], self.order[y[ok]]
        i, j = np.minimum(i, j), np.maximum(i, j)
        n, m = self.size[i], self.size[j]
        ok = (100 * n >= percent * m) & (100 * m >= percent * n)
        i, j, n, m = i[ok], j[ok], n[ok], m[ok]
        ok = may_reach(np.minimum(self.coarse[i], self.coarse[j]).sum(1), n, m, percent)
        return i[ok], j[ok]

    def overlap_bounds(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sum over all groups of the smaller count, of point i with each of others."""
        out = np.zeros(len(others), np.int64)
        for bits, at in self._portions(others):
            common = min(bits, int(self.bits[i]))
            own = self.groups[i] >> (self.bits[i] - common)
            parts = [self.groups[j] for j in others[at].tolist()]
            ends = np.cumsum([len(p) for p in parts])
            all_ = np.concatenate(parts) >> (bits - common)
            # how often a group came before in the same point
            place = np.arange(len(all_))
            first = np.ones(len(all_), bool)
            first[1:] = all_[1:] != all_[:-1]
            first[ends[:-1]] = True
            before = place - np.maximum.accumulate(np.where(first, place, 0))
            if 1 << common <= _DENSE:
                count = np.bincount(own, minlength=1 << common)[all_]
            else:
                groups, counts = np.unique(own, return_counts=True)
                near = np.minimum(np.searchsorted(groups, all_), len(groups) - 1)
                count = np.where(groups[near] == all_, counts[near], 0)
            out[at] = np.add.reduceat((before < count).astype(np.int64), np.concatenate([[0], ends[:-1]]))
        return out

    def _portions(self, others: np.ndarray):
        """Yields (bits, positions in others of points of that resolution) with about _AT_ONCE groups in all."""
        for bits in np.unique(self.bits[others]).tolist():
            at = np.flatnonzero(self.bits[others] == bits)
            upto = np.cumsum(self.size[others[at]])
            for part in np.split(at, np.flatnonzero(np.diff(upto // _AT_ONCE)) + 1):
                yield bits, part

    def survivors(self, percent: int, comp: np.ndarray, wanted=None, spanning: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of different components whose overlap bound reaches percent.

        With spanning, only those of a spanning forest over components: points are taken one by one, those of most
        candidates first; what a point's survivors connect isn't looked at again.  comp is the component of each point.
        """
        found = list(self.pairs(percent, wanted))
        none = np.zeros(0, np.int64)
        if not found:
            return none, none
        i, j = (np.concatenate(x) for x in zip(*found))
        del found
        source, target = np.concatenate([i, j]), np.concatenate([j, i])
        del i, j
        per = np.bincount(source, minlength=len(self.size))
        target = target[np.argsort(source, kind="stable")]
        del source
        ends = np.cumsum(per)
        comp, done, out = comp.copy(), np.zeros(len(self.size), bool), []
        for u in np.argsort(-per, kind="stable").tolist():
            if not per[u]:
                break
            done[u] = True
            near = target[ends[u] - per[u] : ends[u]]
            near = near[~done[near] & (comp[near] != comp[u])]
            if not len(near):
                continue
            bound = self.overlap_bounds(u, near)
            ok = may_reach(bound, self.size[u], self.size[near], percent)
            near, bound = near[ok], bound[ok]
            if spanning and len(near):
                # the likeliest of each component
                likeness = bound / (self.size[u] + self.size[near] - bound)
                best = np.lexsort((near, -likeness, comp[near]))
                best = best[np.unique(comp[near][best], return_index=True)[1]]
                near = near[best]
                comp[np.isin(comp, comp[near])] = comp[u]
            out.append((np.full(len(near), u), near))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none)
