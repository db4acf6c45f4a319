"""Boosted and bagged trees over binned rows in NumPy: the same splits as Spark's own fit, in a few long tasks.

Spark's fit takes a job for every level of every tree, and most of its time is not the sums of these levels. Here a task holds its
rows as one byte per feature and adds them up in NumPy. Where one task holds all rows, it grows all trees; where several do,
the driver adds up their sums of a level.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .draws import NodeSeeds, chosen, map_order, uniforms

EPSILON = 2.0**-52
INVALID = -1.7976931348623157e308
#: Rows that are added up at once.
PIECE = 20_000


@dataclass
class Rows:
    """Binned rows of one task, in the order of the partitions they come from; ``parts`` has (partition, rows)."""

    bins: np.ndarray  # features x rows, one byte each
    label: np.ndarray
    weight: np.ndarray
    parts: list[tuple[int, int]]


@dataclass
class Tree:
    """Nodes in preorder. ``left`` is -1 in a leaf; ``stats`` are the sums of the impurity without the number of rows."""

    prediction: np.ndarray
    impurity: np.ndarray
    stats: np.ndarray
    count: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray


class Variance:
    """Sums of weight, weight * y, weight * y * y and the number of rows."""

    size = 4

    @staticmethod
    def impurity(s: np.ndarray) -> np.ndarray:
        w, y, yy = s[..., 0], s[..., 1], s[..., 2]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(w == 0, 0.0, (yy - y * y / w) / w)

    @staticmethod
    def weight(s: np.ndarray) -> np.ndarray:
        return s[..., 0]

    @staticmethod
    def prediction(s: np.ndarray) -> float:
        return 0.0 if s[0] == 0 else s[1] / s[0]


class Gini:
    """Weight of either class and the number of rows."""

    size = 3

    @staticmethod
    def impurity(s: np.ndarray) -> np.ndarray:
        total = s[..., 0] + s[..., 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = s[..., 0] / total, s[..., 1] / total
            return np.where(total == 0, 0.0, 1.0 - a * a - b * b)

    @staticmethod
    def weight(s: np.ndarray) -> np.ndarray:
        return s[..., 0] + s[..., 1]

    @staticmethod
    def prediction(s: np.ndarray) -> float:
        return 1.0 if s[1] > s[0] else 0.0


@dataclass
class Best:
    """The best split of each node of a level; ``left`` and ``right`` are the sums on either side."""

    own: np.ndarray
    gain: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray


def best_splits(sums: np.ndarray, features: np.ndarray, splits: np.ndarray, own: np.ndarray | None, least: int, kind) -> Best:
    """``sums``: nodes x chosen features x bins x statistics. ``splits``: number of thresholds per feature.

    ``own`` has the sums of the nodes as their parents' splits left them; a root has none, and takes them from its first candidate.
    """
    nodes, wanted, width, size = sums.shape
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    at = np.arange(width)
    possible = at < splits[features][:, :, None]
    first = np.argmax(possible.any(axis=2), axis=1)
    here = np.arange(nodes)
    if own is None:
        own = np.where(possible.any(axis=(1, 2))[:, None], left[here, first, 0] + right[here, first, 0], total[here, 0, 0])
    else:
        own = np.where(possible.any(axis=(1, 2))[:, None], own, total[here, 0, 0])
    lw, rw = kind.weight(left), kind.weight(right)
    both = lw + rw
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = kind.impurity(own)[:, None, None] - lw / both * kind.impurity(left) - rw / both * kind.impurity(right)
    valid = possible & (left[..., -1] >= least) & (right[..., -1] >= least) & (gain >= 0)
    gain = np.where(valid, gain, INVALID).reshape(nodes, -1)
    place = np.argmax(gain, axis=1)
    slot, split = place // width, place % width
    return Best(own, gain[here, place], features[here, slot], split, left[here, slot, split], right[here, slot, split])


def level_sums(bins: np.ndarray, order: list[np.ndarray], features: np.ndarray, columns: list[np.ndarray | None], width: int) -> np.ndarray:
    """Sums of ``columns`` per node, chosen feature and bin. ``order`` has the rows of each node, ``bins`` is features x rows.

    A column that is None counts the rows. Rows are added in their order, in pieces that the processor's cache holds.
    """
    out = np.zeros((len(order), features.shape[1], width, len(columns)))
    for node, everyone in enumerate(order):
        for at in range(0, len(everyone), PIECE):
            rows = everyone[at:at + PIECE]
            picked = [None if c is None else c[rows] for c in columns]
            for slot, feature in enumerate(features[node]):
                b = bins[feature][rows].astype(np.intp)
                for k, c in enumerate(picked):
                    out[node, slot, :, k] += np.bincount(b, c, width)
    return out


class Growth:
    """A tree under way: its nodes by number (1 is the root, 2n and 2n + 1 are the children of n)."""

    def __init__(self, depth: int, kind):
        self.depth, self.kind = depth, kind
        self.split: dict[int, tuple[int, int, float]] = {}
        self.stats: dict[int, np.ndarray] = {}
        self.valid: dict[int, bool] = {}

    def put(self, number: int, best: Best, at: int) -> list[int]:
        """Record what was found for a node; returns the children that are to be split, the left one first."""
        self.stats[number] = best.own[at]
        self.valid[number] = best.gain[at] != INVALID
        if best.gain[at] <= 0:
            return []
        self.split[number] = int(best.feature[at]), int(best.bin[at]), float(best.gain[at])
        wanted = []
        for child, s in ((2 * number, best.left[at]), (2 * number + 1, best.right[at])):
            self.stats[child], self.valid[child] = s, True
            if child.bit_length() <= self.depth and abs(float(self.kind.impurity(s))) >= EPSILON:
                wanted.append(child)
        return wanted

    def leaf_values(self) -> dict[int, float]:
        return {n: self.kind.prediction(s) for n, s in self.stats.items() if n not in self.split}

    def pruned(self, thresholds: list[np.ndarray]) -> Tree:
        """In preorder; two leaves that predict the same are one."""
        merged = set()

        def is_leaf(n: int) -> bool:
            return n not in self.split or n in merged

        for n in sorted(self.split, reverse=True):
            if is_leaf(2 * n) and is_leaf(2 * n + 1) and self.kind.prediction(self.stats[2 * n]) == self.kind.prediction(self.stats[2 * n + 1]):
                merged.add(n)
        numbers, place, todo = [], {}, [1]
        while todo:
            n = todo.pop()
            place[n] = len(numbers)
            numbers.append(n)
            if not is_leaf(n):
                todo += [2 * n + 1, 2 * n]
        inner = [not is_leaf(n) for n in numbers]
        stats = np.array([self.stats[n] for n in numbers])
        impurity = self.kind.impurity(stats)
        return Tree(
            np.array([self.kind.prediction(s) for s in stats]), np.where([self.valid[n] for n in numbers], impurity, -1.0), stats[:, :-1],
            stats[:, -1].astype(np.int64), np.array([self.split[n][2] if i else -1.0 for n, i in zip(numbers, inner)]),
            np.array([place[2 * n] if i else -1 for n, i in zip(numbers, inner)], np.int32),
            np.array([place[2 * n + 1] if i else -1 for n, i in zip(numbers, inner)], np.int32),
            np.array([self.split[n][0] if i else -1 for n, i in zip(numbers, inner)], np.int32),
            np.array([thresholds[self.split[n][0]][self.split[n][1]] if i else np.nan for n, i in zip(numbers, inner)]))


def taken(parts: list[tuple[int, int]], seed: int, rate: float) -> np.ndarray:
    """Which rows a tree is grown on: every partition draws from a generator of its own."""
    if rate >= 1.0:
        return np.ones(sum(n for _, n in parts), bool)
    return np.concatenate([uniforms(seed + part + 1, n) < rate for part, n in parts] or [np.empty(0, bool)])


Splits = dict[int, tuple[int, int, float]]


class Descent:
    """The rows of every node of a tree, found from the splits above it."""

    def __init__(self, bins: np.ndarray, rows: np.ndarray):
        self.bins, self.order = bins, {1: rows}

    def rows_of(self, node: int, splits: Splits) -> np.ndarray:
        if node not in self.order:
            rows = self.rows_of(node // 2, splits)
            feature, split, _ = splits[node // 2]
            right = self.bins[feature][rows] > split
            del self.order[node // 2]
            self.order |= {node & ~1: rows[~right], node | 1: rows[right]}
        return self.order[node]


def steps(bins: np.ndarray, splits: Splits, values: dict[int, float]) -> np.ndarray:
    """What a tree predicts for all rows."""
    n = bins.shape[1]
    down, out = Descent(bins, np.arange(n, dtype=np.int32)), np.empty(n)
    for node, value in values.items():
        out[down.rows_of(node, splits)] = value
    return out


class Round:
    """A round of boosting over the rows of one task; ``known`` is what the trees so far predict, or None before the first one."""

    def __init__(self, rows: Rows, known: np.ndarray | None, inside: np.ndarray):
        y = 2.0 * rows.label - 1.0
        target = y if known is None else 4.0 * y / (1.0 + np.exp(2.0 * y * known))
        wy = rows.weight * target
        self.columns = [rows.weight, wy, wy * target, None]
        self.down = Descent(rows.bins, np.flatnonzero(inside).astype(np.int32))

    def sums(self, splits: Splits, stack: list[int], features: np.ndarray, width: int) -> np.ndarray:
        return level_sums(self.down.bins, [self.down.rows_of(n, splits) for n in stack], features, self.columns, width)


def grow(number_of_splits: np.ndarray, depth: int, least: int, wanted: int, seed: int, sums: Callable[[Splits, list[int], np.ndarray], np.ndarray]) -> Growth:
    """One regression tree; ``sums`` has the sums of the open nodes over all rows of the fit."""
    seeds, growth, stack, own = NodeSeeds(seed), Growth(depth, Variance), [1], None
    while stack:
        features = chosen([seeds.next() for _ in stack], len(number_of_splits), wanted)
        best = best_splits(sums(growth.split, stack, features), features, number_of_splits, own, least, Variance)
        below: list[int] = []
        for at, n in enumerate(stack):
            # Nodes wait on a stack, so the children that were put there last come first.
            for child in growth.put(n, best, at):
                below.insert(0, child)
        stack, own = below, np.array([growth.stats[n] for n in below])
    return growth


def moved(known: np.ndarray | None, step: np.ndarray, rate: float) -> np.ndarray:
    """Predictions with one more tree; the first one counts fully."""
    return step if known is None else known + step * rate


def boost(rows: Rows, thresholds: list[np.ndarray], *, rounds: int, depth: int, rate: float, subsample: float, least: int, wanted: int,
          seed: int) -> list[Tree]:
    """Gradient boosting of the logistic loss over the rows of one task."""
    splits = np.array([len(t) for t in thresholds])
    width, known, trees = int(splits.max(initial=0)) + 1, None, []
    for number in range(rounds):
        now = Round(rows, known, taken(rows.parts, seed + number, subsample))
        growth = grow(splits, depth, least, wanted, seed + number, lambda above, stack, features: now.sums(above, stack, features, width))
        known = moved(known, steps(rows.bins, growth.split, growth.leaf_values()), rate)
        trees.append(growth.pruned(thresholds))
    return trees


def many_sums(bins: np.ndarray, order: list[np.ndarray], features: np.ndarray, columns: list[np.ndarray], width: int) -> np.ndarray:
    """As ``level_sums``, for many small nodes: all of them at once for each place among the chosen features."""
    sizes = [len(rows) for rows in order]
    rows = np.concatenate(order).astype(np.int64)
    node = np.repeat(np.arange(len(order)), sizes)
    picked = [c[rows] for c in columns]
    out = np.empty((len(order), features.shape[1], width, len(columns)))
    flat, start = bins.reshape(-1), node * width
    for slot in range(features.shape[1]):
        code = start + flat[np.repeat(features[:, slot] * bins.shape[1], sizes) + rows]
        for k, c in enumerate(picked):
            out[:, slot, :, k] = np.bincount(code, c, len(order) * width).reshape(len(order), width)
    return out


#: Nodes with fewer rows on average are added up together.
SMALL = 2_000


def split_nodes(rows: Rows, count: np.ndarray, numbers: list[int], seeds: list[int], own: np.ndarray | None, above: Splits,
                number_of_splits: np.ndarray, least: int, wanted: int) -> Best:
    """Best splits of open nodes of a classification tree that has each row ``count`` times; ``above`` has the splits so far."""
    inside = np.flatnonzero(count).astype(np.int32)
    weight = count * rows.weight
    positive = rows.label == 1
    columns = [np.where(positive, 0.0, weight), np.where(positive, weight, 0.0), count.astype(float)]
    down = Descent(rows.bins, inside)
    order = [down.rows_of(n, above) for n in numbers]
    features = chosen(seeds, len(number_of_splits), wanted)
    width = int(number_of_splits.max(initial=0)) + 1
    small = sum(len(here) for here in order) < SMALL * len(order)
    sums = (many_sums if small else level_sums)(rows.bins, order, features, columns, width)
    return best_splits(sums, features, number_of_splits, own, least, Gini)


class Forest:
    """Trees that Spark grows together: nodes of all trees wait on one stack, and take their seeds in its order."""

    def __init__(self, trees: int, depth: int, seed: int, number_of_splits: np.ndarray, wanted: int, memory: int):
        self.growths = [Growth(depth, Gini) for _ in range(trees)]
        self.stack = [(tree, 1) for tree in range(trees)]  # the last one is the top
        self.seeds, self.splits, self.wanted, self.memory = NodeSeeds(seed), number_of_splits, wanted, memory

    def taken(self) -> dict[int, tuple[list[int], list[int]]]:
        """Numbers and seeds of the nodes that are split next, by tree: as many as fit in the memory that Spark allows itself."""
        found: dict[int, tuple[list[int], list[int]]] = {}
        used, close = 0, len(self.stack) * self.wanted * (int(self.splits.max(initial=0)) + 1) * 16 > self.memory
        while self.stack:
            seed = self.seeds.next()
            if close:
                size = int((self.splits[chosen([seed], len(self.splits), self.wanted)[0]] + 1).sum()) * 16
                if used and used + size > self.memory:
                    break
                used += size
            tree, number = self.stack.pop()
            numbers, seeds = found.setdefault(tree, ([], []))
            numbers.append(number)
            seeds.append(seed)
        return found

    def own(self, tree: int, numbers: list[int]) -> np.ndarray | None:
        return None if numbers[0] == 1 else np.array([self.growths[tree].stats[n] for n in numbers])

    def put(self, given: dict[int, tuple[list[int], list[int]]], best: dict[int, Best]) -> None:
        for tree in map_order(list(given)):
            for at, number in enumerate(given[tree][0]):
                self.stack += [(tree, child) for child in self.growths[tree].put(number, best[tree], at)]
