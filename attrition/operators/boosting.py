"""Second-order boosting on binned features: the numpy kernels.

A tree is grown level by level from histograms of gradients and Hessians, one
sum for each (open node, feature, bin). ``grow`` asks a function for them, so the
same code serves one task that holds all rows and a cluster that sums them in a
job. Gradients are rounded to fixed point: sums are integers, exact and the same
in any order, hence a tree doesn't depend on how rows are dealt to tasks.

Split gain and leaf values follow the usual second-order objective: with sums G
and H of a node, the score is G^2 / (H + lambda), a split's gain is what its two
sides score more than the node, it needs a gain above ``gamma`` and a Hessian of
``min_child_weight`` on either side, and a leaf is -rate G / (H + lambda).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from attrition.config import Params

#: Rows of one block at most; its sums fit the 53 exact bits of a double.
BLOCK_ROWS = 1 << 16
NODE_COLUMNS = "round int, node int, feature int, bin int, cut double, left int, value double, gain double"


@dataclass
class Tree:
    """Nodes of one tree; a row goes to ``left`` where its bin of ``feature`` is at
    most ``bin`` (its value at most ``cut``), else to ``left + 1``."""

    feature: np.ndarray  # -1 at leaves
    bin: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def down(self, node: np.ndarray, bins: np.ndarray, among: Iterable[int] | None = None) -> np.ndarray:
        """Moves rows, in place, from the nodes ``among`` (all that are split, else) to their
        children; ``bins`` is features x rows. Children come after their parents, so all
        nodes in order lead to the leaves. Comparing whole columns costs less than looking
        each row's feature up."""
        kind = node.dtype.type
        for q in np.flatnonzero(self.feature >= 0).tolist() if among is None else among:
            further = (bins[int(self.feature[q])] > int(self.bin[q])) + kind(int(self.left[q]) - q)
            further *= node == kind(q)
            node += further
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        """Value of the leaf that each row falls into."""
        return self.value.take(self.down(roots(bins.shape[1], len(self.feature)), bins))

    def frame(self, round_: int) -> pd.DataFrame:
        n = np.arange(len(self.feature), dtype=np.int32)
        return pd.DataFrame({"round": np.full(len(n), round_, np.int32), "node": n, **self.__dict__})


def roots(n_rows: int, n_nodes: int) -> np.ndarray:
    """The root for each row, in the smallest type that numbers the nodes."""
    return np.zeros(n_rows, np.min_scalar_type(max(n_nodes - 1, 0)))


def trees_of(nodes: pd.DataFrame) -> list[Tree]:
    """Trees from their nodes' rows, in order of rounds."""
    nodes = nodes.sort_values(["round", "node"])
    kinds = {"feature": np.int32, "bin": np.int32, "cut": float, "left": np.int32, "value": float, "gain": float}
    return [Tree(**{c: part[c].to_numpy(t) for c, t in kinds.items()}) for _, part in nodes.groupby("round", sort=True)]


class Bins:
    """Cuts of each feature: a value's bin is the number of cuts below it."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = [np.unique(np.asarray(c, float)) for c in cuts]
        self.sizes = np.array([len(c) + 1 for c in self.cuts])
        self.first = np.append(0, np.cumsum(self.sizes)[:-1])
        self.total = int(self.sizes.sum())
        self.feature = np.repeat(np.arange(len(cuts)), self.sizes)

    def bin(self, x: np.ndarray) -> np.ndarray:
        """Bins (features x rows, one byte each) of rows x features; a missing value counts as 0."""
        x = np.nan_to_num(x, nan=0.0)
        return np.stack([np.searchsorted(c, x[:, f], side="left").astype(np.uint8) for f, c in enumerate(self.cuts)])


def scrambled(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sampled_rows(keys: np.ndarray, round_: int, p: Params) -> np.ndarray:
    """Which rows a round sees: by a hash of the row's key, wherever the row lies."""
    if p.row_share >= 1:
        return np.ones(len(keys), bool)
    salt = scrambled(np.array([(p.seed << 32) + round_ + 1], np.uint64))
    return scrambled(keys.view(np.uint64) ^ salt) < np.uint64(int(p.row_share * 2**64))


def sampled_features(n: int, round_: int, p: Params) -> np.ndarray:
    """Which features a round's tree may use."""
    rng = np.random.default_rng([p.seed, round_])
    return np.sort(rng.choice(n, max(1, int(p.column_share * n)), replace=False))


def fixed_point(n_rows: int, weight: float) -> float:
    """The power of two that gradients are multiplied with before rounding: sums of
    a block fit 53 bits, sums of all rows 63."""
    w = max(1.0, weight)
    return float(2.0 ** min(52 - np.ceil(np.log2(BLOCK_ROWS * w)), 62 - np.ceil(np.log2(max(n_rows, 1) * w))))


def gradients(margin: np.ndarray, y: np.ndarray, spw: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rounded gradient and Hessian of the weighted log loss, as whole doubles."""
    prob = 1 / (1 + np.exp(-margin))
    w = np.where(y > 0, spw, 1.0)
    return np.rint(w * (prob - y) * scale), np.rint(np.maximum(w * prob * (1 - prob), 1e-16) * scale)


def log_loss(margin: np.ndarray, y: np.ndarray) -> float:
    """Sum of the unweighted log losses of rows."""
    x = np.where(y > 0, -margin, margin)
    return float((np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))).sum())


def histogram(bins: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, table: Bins, features: np.ndarray, n_open: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a block for each open node (``slot`` is its place, -1: none) and bin of the features.
    One feature after the other, so that the places of its bins stay in the cache."""
    rows = np.flatnonzero(slot >= 0)
    place, g, h = slot[rows].astype(np.int64), g[rows], h[rows]
    G, H = np.zeros((n_open, table.total), np.int64), np.zeros((n_open, table.total), np.int64)
    for f in features:
        size, here = int(table.sizes[f]), slice(table.first[f], table.first[f] + table.sizes[f])
        at = place * size
        at += bins[f].take(rows)
        G[:, here] = np.bincount(at, g, n_open * size).reshape(n_open, size)
        H[:, here] = np.bincount(at, h, n_open * size).reshape(n_open, size)
    return G, H


class Packed:
    """Bins of a block (features x rows), of which features that occur in few combinations
    share one code: a sum for each code, folded to the features' bins, is one pass over the
    rows for all of them. Sums are whole numbers below 2^53, so folding is exact. Which
    features share a code is found on the block's own rows and changes no result."""

    CODES = 256  # of one group at most: a byte a row
    LOOKED_AT = 4096  # rows that pick the groups; all rows are counted after

    def __init__(self, bins: np.ndarray, table: Bins):
        self.table, self.groups = table, []
        few = bins[:, :: max(1, bins.shape[1] // self.LOOKED_AT)]
        left = list(range(len(bins)))
        while left:
            members, tried = [left.pop(0)], None
            for f in list(left):
                got = self._joint(few[members[0]] if tried is None else tried, few[f], int(table.sizes[f]))
                if got is not None:
                    tried = got[0]
                    members.append(f)
                    left.remove(f)
            codes, of = bins[members[0]], [np.arange(table.sizes[members[0]])]
            for i, f in enumerate(members[1:], 1):
                got = self._joint(codes, bins[f], int(table.sizes[f]))
                if got is None:  # more combinations in all rows than in those looked at
                    left[:0] = members[i:]
                    members = members[:i]
                    break
                codes, pairs = got
                of = [o[pairs // table.sizes[f]] for o in of] + [pairs % table.sizes[f]]
            n = len(of[0])
            fold = np.zeros((n, int(table.sizes[members].sum())))
            start = 0
            for f, o in zip(members, of, strict=True):
                fold[np.arange(n), start + o] = 1
                start += int(table.sizes[f])
            places = np.concatenate([np.arange(table.first[f], table.first[f] + table.sizes[f]) for f in members])
            self.groups.append((members, codes, n, places, fold))

    def _joint(self, codes: np.ndarray, more: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray] | None:
        """One code for each pair that occurs, and the pairs; None if there are too many."""
        pair = codes.astype(np.int64) * size + more
        there = np.bincount(pair) > 0
        pairs = np.flatnonzero(there)
        if len(pairs) > self.CODES:
            return None
        return (np.cumsum(there) - 1).astype(np.uint8).take(pair), pairs

    def histogram(self, slot: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, n_open: int) -> tuple[np.ndarray, np.ndarray]:
        """As the function ``histogram``, with sums of features beside the asked ones."""
        rows = np.flatnonzero(slot >= 0)
        place, g, h = slot.take(rows).astype(np.int64), g.take(rows), h.take(rows)
        G, H = (np.zeros((n_open, self.table.total), np.int64) for _ in range(2))
        asked = set(features.tolist())
        for members, codes, n, places, fold in self.groups:
            if asked.isdisjoint(members):
                continue
            at = place * n
            at += codes.take(rows)
            for to, v in ((G, g), (H, h)):
                sums = np.bincount(at, v, n_open * n).reshape(n_open, n)
                if len(members) == 1:
                    to[:, places[0] : places[0] + n] = sums
                else:
                    to[:, places] = sums @ fold
        return G, H


def best_splits(G: np.ndarray, H: np.ndarray, table: Bins, features: np.ndarray, p: Params, scale: float) -> Iterator[tuple]:
    """For each open node (gain, place of the split's bin, sums of node and left side); equal gains: the first place."""
    one = slice(table.first[features[0]], table.first[features[0]] + table.sizes[features[0]])
    node_g, node_h = G[:, one].sum(1), H[:, one].sum(1)
    left = []
    for v in (G, H):
        run = np.cumsum(v, axis=1)
        left.append(run - np.repeat(np.where(table.first > 0, run[:, table.first - 1], 0), table.sizes, axis=1))
    allowed = np.isin(table.feature, features)
    allowed[table.first + table.sizes - 1] = False
    score = lambda g, h: (g / scale) ** 2 / (h / scale + p.reg_lambda)
    lg, lh = left
    rg, rh = node_g[:, None] - lg, node_h[:, None] - lh
    least = p.min_child_weight * scale
    gain = score(lg, lh) + score(rg, rh) - score(node_g, node_h)[:, None]
    gain = np.where(allowed & (lh >= least) & (rh >= least), gain, -np.inf)
    best = gain.argmax(1)
    for i, b in enumerate(best):
        yield float(gain[i, b]), int(b), (int(node_g[i]), int(node_h[i])), (int(lg[i, b]), int(lh[i, b]))


def grow(histograms: Callable, table: Bins, features: np.ndarray, p: Params, scale: float) -> Tree:
    """A tree from ``histograms(tree, open_nodes)``, which sums over the rows at the
    open nodes of the tree so far."""
    return grow_by(lambda tree, open_: best_splits(*histograms(tree, open_), table, features, p, scale), table, p, scale)


def grow_by(splits: Callable, table: Bins, p: Params, scale: float) -> Tree:
    """A tree from ``splits(tree, open_nodes)``, which has for each open node what
    ``best_splits`` gives. A node whose Hessian isn't enough for two leaves
    can't be split and is never open (but for the root)."""
    nodes = [[-1, 0, 0.0, 0, 0.0, 0.0]]
    weigh = lambda g, h: -p.learning_rate * (g / scale) / (h / scale + p.reg_lambda)
    open_, depth = [0], 0

    def tree():
        f, b, c, left, value, gain = zip(*nodes, strict=True)
        return Tree(np.array(f, np.int32), np.array(b, np.int32), np.array(c, float), np.array(left, np.int32), np.array(value, float), np.array(gain, float))

    while open_ and depth < p.max_depth:
        further = []
        for node, (gain, at, (g, h), (lg, lh)) in zip(open_, splits(tree(), open_), strict=True):
            if node == 0:
                nodes[0][4] = weigh(g, h)
            if not gain > max(p.gamma, 1e-6):
                continue
            f = int(table.feature[at])
            b = int(at - table.first[f])
            left = len(nodes)
            nodes[node] = [f, b, float(table.cuts[f][b]), left, 0.0, gain]
            nodes += [[-1, 0, 0.0, 0, weigh(*s), 0.0] for s in ((lg, lh), (g - lg, h - lh))]
            further += [left + i for i, share in enumerate((lh, h - lh)) if share >= 2 * p.min_child_weight * scale]
        open_, depth = further, depth + 1
    return tree()


class Forest:
    """All trees for scoring. A value is binned once by the cuts that the trees have of its
    feature; then a tree's comparisons run over whole columns of bins."""

    def __init__(self, trees: list[Tree], n_features: int):
        join = lambda c: np.concatenate([getattr(t, c) for t in trees]) if trees else np.zeros(0)
        feature, cut = join("feature"), join("cut")
        self.cuts = [np.unique(cut[feature == f]) for f in range(n_features)]
        self.kind = np.min_scalar_type(max(map(len, self.cuts), default=0))
        self.trees = []
        for t in trees:
            bin_ = np.array([np.searchsorted(self.cuts[f], c) if f >= 0 else 0 for f, c in zip(t.feature.tolist(), t.cut.tolist(), strict=True)], np.int32)
            self.trees.append(Tree(t.feature, bin_, t.cut, t.left, t.value, t.gain))

    @property
    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.cuts) + sum(x.nbytes for t in self.trees for x in t.__dict__.values())

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves of rows x features; a missing value counts as 0."""
        x = np.where(np.isnan(x), 0.0, x)
        bins = np.stack([np.searchsorted(c, x[:, f], side="left").astype(self.kind) for f, c in enumerate(self.cuts)]) if self.cuts else np.zeros((0, len(x)), np.uint8)
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.values(bins)
        return out
