"""Decision trees on binned features: growing one level at a time, and walking many rows at once.

Small numpy helpers of the tasks that fit and score models (``keyed_models``). A row is a line of
small integers, the bins of its features. Splits come from histograms of gradients and weights
per (node, feature, bin), so the work of a level is one pass over its rows. Rows are added up
in blocks and nodes in groups, so that a fit needs some tens of bytes a row besides its bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
_LEAST_GAIN = 1e-12
_WALK = 1 << 14
#: rows that are added up at once, at least, and nodes whose histograms are held at once
_BLOCK, _NODES = 1 << 15, 1 << 11
#: steps that are looked up at once (2 ** 6 nodes are the bits of a number), rows from which on that pays
_TOP, _FEW = 6, 1024
#: factor and shift that take every power of two to another number of five or six bits
_BIT_HASH = {np.uint32: (np.uint32(0x077CB531), np.uint32(27)), np.uint64: (np.uint64(0x03F79D71B4CB0A89), np.uint64(58))}


def bin_edges(x: np.ndarray) -> np.ndarray:
    """(features, BINS - 1) upper edges of the bins, halfway between values at quantiles, then infinity."""
    out = np.full((x.shape[1], BINS - 1), np.inf)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        halves = (values[:-1] + values[1:]) / 2
        if len(values) > BINS:
            cuts = np.quantile(x[:, k], np.arange(1, BINS) / BINS, method="lower")
            at = np.unique(np.searchsorted(values, cuts))
            halves = halves[at[at < len(halves)]]
        out[k, : len(halves)] = halves
    return out


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of every value: the number of edges below it."""
    out = np.empty(x.shape, dtype=np.uint8)
    for k in range(x.shape[1]):
        out[:, k] = np.searchsorted(edges[k], x[:, k], side="left")
    return out


@dataclass
class Trees:
    """Trees behind each other. A node sends bins up to ``bin`` of ``feature`` to ``left``, others
    to ``left + 1``; a leaf has ``left`` below 0."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    made: tuple | None = None

    def tops(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where rows stand after ``_TOP`` steps in each tree: one of at most 64 nodes, one bit each.

        (trees, width, BINS) the nodes that a bin of a feature leaves possible, in 32 bits where they
        are enough; (trees, bits) the nodes by the hash of their bit; whether all of a tree are leaves.
        """
        node, tree = self.roots.astype(np.int64), np.arange(len(self.roots))
        low, high = np.zeros((len(node), width), dtype=np.uint8), np.full((len(node), width), BINS - 1, dtype=np.uint8)
        for _ in range(_TOP):
            inner = self.left[node] >= 0
            if not inner.any():
                break
            parent, k = node[inner], np.arange(int(inner.sum()))
            feature, cut = self.feature[parent], self.bin[parent]
            from_, to = low[inner], high[inner]
            to[k, feature] = np.minimum(to[k, feature], cut)
            from_[k, feature] = np.maximum(from_[k, feature], cut + 1)
            low, high = np.concatenate([low[~inner], low[inner], from_]), np.concatenate([high[~inner], to, high[inner]])
            node = np.concatenate([node[~inner], self.left[parent], self.left[parent] + 1])
            tree = np.concatenate([tree[~inner], tree[inner], tree[inner]])
        order = np.argsort(tree, kind="stable")
        node, tree, low, high = node[order], tree[order], low[order], high[order]
        starts = np.searchsorted(tree, np.arange(len(self.roots)))
        place = np.arange(len(tree)) - starts[tree]
        kind = np.uint32 if place.max() < 32 else np.uint64
        factor, shift = _BIT_HASH[kind]
        bit = kind(1) << place.astype(kind)
        masks, every = np.empty((len(starts), width, BINS), dtype=kind), np.arange(BINS, dtype=np.uint8)
        for first in range(0, len(starts), 32):
            mine = slice(starts[first], starts[first + 32] if first + 32 < len(starts) else len(tree))
            fits = (low[mine, :, None] <= every) & (every <= high[mine, :, None])
            masks[first : first + 32] = np.bitwise_or.reduceat(np.where(fits, bit[mine, None, None], kind(0)), starts[first : first + 32] - starts[first], axis=0)
        nodes = np.zeros((len(starts), 8 * masks.itemsize), dtype=np.int64)
        nodes[tree, (bit * factor) >> shift] = node
        return masks, nodes, np.logical_and.reduceat(self.left[node] < 0, starts)

    def sums(self, bins: np.ndarray) -> np.ndarray:
        """The sum of the leaf values that each row meets."""
        total = np.zeros(len(bins))
        if not len(self.roots):
            return total
        # a node is one number: its left child, its feature, its bin; a leaf is its own child
        inner = self.left >= 0
        own = np.arange(len(self.left), dtype=np.int64)
        code = (np.where(inner, self.left, own) << 16) | np.where(inner, self.feature.astype(np.int64) << 8, 0) | np.where(inner, self.bin, 255)
        masks, nodes, leaves = (None, None, None) if len(bins) < _FEW else self._tops(bins.shape[1])
        for first in range(0, len(bins), _WALK):
            some = np.ascontiguousarray(bins[first : first + _WALK])
            n, f = some.shape
            flat, line = some.ravel(), np.arange(n, dtype=np.int64) * f
            if masks is not None:
                # two features are looked up at once
                pairs = [(k, min(k + 1, f - 1), some[:, k].astype(np.int64) * BINS + some[:, min(k + 1, f - 1)]) for k in range(0, f, 2)]
                here, more = np.empty((2, n), dtype=masks.dtype)
                factor, shift = _BIT_HASH[masks.dtype.type]
            # few trees at a time: what is looked up stays in the cache
            several = max(1, _WALK // max(1, n))
            for k in range(0, len(self.roots), several):
                roots = self.roots[k : k + several].astype(np.int64)
                if masks is None:
                    met, ended = np.repeat(roots, n), False
                else:
                    met, ended = np.empty((len(roots), n), dtype=np.int64), leaves[k : k + several].all()
                    for t in range(len(roots)):
                        mask = masks[k + t]
                        for i, (a, b, at) in enumerate(pairs):
                            (mask[a][:, None] & mask[b]).ravel().take(at, out=more if i else here, mode="clip")
                            if i:
                                np.bitwise_and(here, more, out=here)
                        # one bit is left
                        np.multiply(here, factor, out=here)
                        np.right_shift(here, shift, out=here)
                        nodes[k + t].take(here.astype(np.int64), out=met[t], mode="clip")
                    met = met.ravel()
                if not ended:
                    open_ = None if masks is None else np.flatnonzero(inner.take(met))
                    rows = np.tile(line, len(roots))
                    at, rows = (met, rows) if open_ is None else (met[open_], rows[open_])
                    steps = 0
                    while len(at):
                        node = code.take(at)
                        at = node >> 16
                        at += flat.take(rows + ((node >> 8) & 255)) > (node & 255)
                        steps += 1
                        if steps % 3 == 0:
                            # walkers that met a leaf stop
                            on = np.flatnonzero(inner.take(at))
                            if open_ is None:
                                met = at
                            else:
                                met[open_] = at
                            open_ = on if open_ is None else open_[on]
                            at, rows = at[on], rows[on]
                # tree after tree, so that equal rows have equal sums whatever block they are in
                for some_values in self.value.take(met).reshape(len(roots), n):
                    total[first : first + n] += some_values
        return total

    def _tops(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``tops``, made once for all blocks."""
        if self.made is None or self.made[0].shape[1] != width:
            self.made = self.tops(width)
        return self.made


def join_trees(parts: list[Trees]) -> Trees:
    sizes = np.array([len(p.left) for p in parts])
    before = np.cumsum(sizes) - sizes
    return Trees(
        np.concatenate([p.feature for p in parts]), np.concatenate([p.bin for p in parts]),
        np.concatenate([np.where(p.left >= 0, p.left + b, -1) for p, b in zip(parts, before)]).astype(np.int32),
        np.concatenate([p.value for p in parts]), before.astype(np.int32),
    )


def _block_sums(columns: np.ndarray, rows: np.ndarray, slot: np.ndarray, gradient: np.ndarray, weight: np.ndarray, count: np.ndarray | None,
                nodes: int, tried: np.ndarray | None) -> np.ndarray:
    """(3, nodes, features, BINS) sums of gradient, weight and count; ``tried`` are the features of each node, None for all."""
    f, n = columns.shape
    flat, width = columns.reshape(-1), f if tried is None else tried.shape[1]
    sums = np.zeros((3, nodes, width, BINS))
    step = max(_BLOCK, 2 * nodes * BINS)
    for first in range(0, len(rows), step):
        at, node = rows[first : first + step], slot[first : first + step].astype(np.int64)
        g, h, c = gradient[at], weight[at], None if count is None else count[at].astype(float)
        # rows without a gradient add nothing
        some = np.flatnonzero(g) if 2 * np.count_nonzero(g) < len(g) else None
        base = node * BINS
        for k in range(width):
            code = columns[k].take(at).astype(np.int64) if tried is None else flat.take(tried[:, k].take(node) * n + at).astype(np.int64)
            code += base
            sums[0, :, k] += (np.bincount(code, g, nodes * BINS) if some is None else np.bincount(code[some], g[some], nodes * BINS)).reshape(nodes, BINS)
            sums[1, :, k] += np.bincount(code, h, nodes * BINS).reshape(nodes, BINS)
            sums[2, :, k] += np.bincount(code, c, nodes * BINS).reshape(nodes, BINS)
    return sums


def _node_sums(values: np.ndarray, rows: np.ndarray, slot: np.ndarray, nodes: int) -> np.ndarray:
    out, step = np.zeros(nodes), max(_BLOCK, nodes)
    for first in range(0, len(rows), step):
        out += np.bincount(slot[first : first + step], values[rows[first : first + step]], nodes)
    return out


def grow(bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray, count: np.ndarray | None, *, depth: int, leaf: int, l2: float = 0.0,
         draw: np.random.Generator | None = None, drawn: int = 0) -> tuple[Trees, np.ndarray, np.ndarray]:
    """One tree with leaf values gradient / (weight + l2); the value of each row; gain by feature.

    ``count`` is how often a row is there (None: once), at least ``leaf`` in every node; ``drawn``
    features are tried in a node where ``draw`` is given. Bins of which each feature lies together
    are not copied.
    """
    n, f = bins.shape
    columns = np.ascontiguousarray(bins.T)
    flat = columns.reshape(-1)
    rows = np.arange(n) if count is None else np.flatnonzero(count > 0)
    if count is not None and (count <= 1).all():
        count = None
    if n < 1 << 31:
        rows = rows.astype(np.int32)
    slot = np.zeros(len(rows), dtype=np.int32)
    feature, cut, left, value = [], [], [], []
    gains, row_value = np.zeros(f), np.zeros(n)
    nodes, made = 1, 1
    for level in range(depth + 1):
        g, h = (_node_sums(v, rows, slot, nodes) for v in (gradient, weight))
        out = g / np.maximum(h + l2, 1e-300)
        feature.append(np.zeros(nodes, dtype=np.int8))
        cut.append(np.zeros(nodes, dtype=np.uint8))
        left.append(np.full(nodes, -1, dtype=np.int32))
        value.append(out)
        if level == depth:
            break
        which, at, won = np.empty(nodes, dtype=np.int64), np.empty(nodes, dtype=np.int64), np.empty(nodes)
        bounds = [0, len(rows)]
        if nodes > _NODES:
            # the rows of a group of nodes lie together, in their old order
            order = np.argsort(slot, kind="stable")
            rows, slot = rows[order], slot[order]
            bounds = np.searchsorted(slot, [*range(0, nodes, _NODES), nodes])
        for first, lo, hi in zip(range(0, nodes, _NODES), bounds, bounds[1:]):
            few, mine = min(_NODES, nodes - first), slice(first, min(first + _NODES, nodes))
            tried = None
            if draw is not None and drawn < f:
                # only the features that are tried in a node are added up, in ascending order
                tried = np.sort(draw.random((few, f)).argsort(axis=1)[:, :drawn], axis=1)
            sums = _block_sums(columns, rows[lo:hi], slot[lo:hi] - first if first else slot[lo:hi], gradient, weight, count, few, tried).cumsum(axis=3)
            (gl, hl, cl), (gt, ht, ct) = ([s[:, :, :-1] for s in sums], [s[:, :, -1:] for s in sums])
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gl * gl / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt * gt / (ht + l2)
            gain[(cl < leaf) | (ct - cl < leaf) | ~np.isfinite(gain)] = -np.inf
            best_of = gain.reshape(few, -1)
            best = best_of.argmax(axis=1)
            won[mine] = best_of[np.arange(few), best]
            which[mine], at[mine] = best // (BINS - 1), best % (BINS - 1)
            if tried is not None:
                which[mine] = tried[np.arange(few), which[mine]]
        split = won > _LEAST_GAIN
        if not split.any():
            break
        number = np.cumsum(split) - 1
        feature[-1][split], cut[-1][split] = which[split], at[split]
        left[-1][split] = made + 2 * number[split]
        np.add.at(gains, which[split], won[split])
        moved = []
        for first in range(0, len(rows), 8 * _BLOCK):
            r, s = rows[first : first + 8 * _BLOCK], slot[first : first + 8 * _BLOCK]
            on = split[s]
            row_value[r[~on]] = out[s[~on]]
            r, s = r[on], s[on]
            moved.append((r, (2 * number[s] + (flat.take(which[s] * n + r) > at[s])).astype(np.int32)))
        rows, slot = (np.concatenate(x) for x in zip(*moved))
        nodes = 2 * int(split.sum())
        made += nodes
    row_value[rows] = out[slot]
    tree = Trees(*(np.concatenate(x) for x in (feature, cut, left, value)), np.zeros(1, dtype=np.int32))
    return tree, row_value, gains


def _drawn_counts(draw: np.random.Generator, n: int) -> np.ndarray:
    """How often each row is in a sample with replacement: the draws of one call, made in blocks."""
    out = np.empty(n, dtype=np.uint8)
    for first in range(0, n, 8 * _BLOCK):
        out[first : first + 8 * _BLOCK] = draw.poisson(1.0, min(8 * _BLOCK, n - first))
    return out


def forest(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, *, trees: int, depth: int, leaf: int, seed: int) -> tuple[Trees, np.ndarray]:
    """A forest whose tree values are probabilities over the number of trees; gain by feature."""
    bins = np.ascontiguousarray(bins.T).T
    parts, gains = [], np.zeros(bins.shape[1])
    drawn = max(1, int(np.sqrt(bins.shape[1])))
    for t in range(trees):
        draw = np.random.default_rng([seed, t])
        count = _drawn_counts(draw, len(y))
        w = weight * count
        tree, _, gained = grow(bins, w * y, w, count, depth=depth, leaf=leaf, draw=draw, drawn=drawn)
        total = gained.sum()
        gains += gained / total if total else 0.0
        tree.value = tree.value / trees
        parts.append(tree)
    return join_trees(parts), gains


def booster(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, *, rounds: int, depth: int, leaf: int, rate: float, l2: float) -> tuple[Trees, float, np.ndarray]:
    """Trees on the log-odds by Newton steps, the first log-odds, and gain by feature."""
    share = np.clip((weight * y).sum() / weight.sum(), 1e-9, 1 - 1e-9)
    start = float(np.log(share / (1 - share)))
    bins = np.ascontiguousarray(bins.T).T
    log_odds, parts, gains = np.full(len(y), start), [], np.zeros(bins.shape[1])
    p, gradient, curve = np.empty((3, len(y)))
    for _ in range(rounds):
        np.exp(np.negative(log_odds, out=p), out=p)
        np.divide(1, np.add(p, 1, out=p), out=p)
        np.multiply(weight, np.subtract(y, p, out=gradient), out=gradient)
        np.multiply(weight, p, out=curve)
        np.multiply(curve, np.subtract(1, p, out=p), out=curve)
        tree, value, gained = grow(bins, gradient, curve, None, depth=depth, leaf=leaf, l2=l2)
        tree.value = tree.value * rate
        log_odds += np.multiply(value, rate, out=value)
        gains += gained
        parts.append(tree)
    return join_trees(parts), start, gains
