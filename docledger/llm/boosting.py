"""Gradient-boosted trees on dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """`edges` cut each feature into bins; a tree of depth D has 2^D - 1 splits and 2^D leaves."""

    edges: list[np.ndarray]
    features: np.ndarray  # trees x splits
    bins: np.ndarray  # go right if the bin of the feature is above
    leaves: np.ndarray
    base: float

    def codes(self, table: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, table[:, f]) for f, e in enumerate(self.edges)], axis=1)

    def log_odds(self, table: np.ndarray) -> np.ndarray:
        codes, row = self.codes(table), np.arange(len(table))
        total = np.full(len(table), self.base)
        for features, bins, leaves in zip(self.features, self.bins, self.leaves, strict=True):
            node = np.zeros(len(table), np.int64)
            for _ in range(len(leaves).bit_length() - 1):
                node = 2 * node + 1 + (codes[row, features[node]] > bins[node])
            total += leaves[node - len(features)]
        return total


def bin_edges(table: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts half way between neighbouring values, at quantiles where there are too many."""
    edges = []
    for column in table.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
            zero = column[column > 0].min(initial=np.inf)
            if column.min() <= 0 < zero < np.inf:  # nothing at all is a value of its own
                values = np.unique(np.append(values, [0.0, zero]))
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def boost(
    table: np.ndarray,
    label: np.ndarray,
    weight: np.ndarray,
    trees: int = 80,
    depth: int = 3,
    rate: float = 0.15,
    bins: int = 48,
    ridge: float = 1.0,
    least: float = 1.0,
) -> Trees:
    """Newton boosting of the logistic loss; splits go by histograms of bins.

    `weight` has mean 1. A leaf has at least the weight `least` of loss curvature.
    """
    edges = bin_edges(table, bins)
    width = max(len(e) for e in edges) + 1
    share = np.clip((weight * label).sum() / weight.sum(), 1e-4, 1 - 1e-4)
    model = Trees(edges, np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)), float(np.log(share / (1 - share))))
    codes = model.codes(table)
    n, count = codes.shape
    cell = codes + np.arange(count) * width
    total = np.full(n, model.base)
    splits, leaves = 2**depth - 1, 2**depth
    found_features, found_bins, found_leaves = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = weight * (chance - label), weight * chance * (1 - chance)
        features, cuts = np.zeros(splits, np.int64), np.full(splits, width, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (count * width) + cell).ravel()
            shape = (nodes, count, width)
            size = nodes * count * width
            g = np.bincount(place, np.repeat(slope, count), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(place, np.repeat(bend, count), size).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0.0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            features[first : first + nodes] = np.where(good, best // width, 0)
            cuts[first : first + nodes] = np.where(good, best % width, width)
            node = 2 * node + 1 + (codes[np.arange(n), features[node]] > cuts[node])
        leaf = node - splits
        g = np.bincount(leaf, slope, leaves)
        h = np.bincount(leaf, bend, leaves)
        step = -rate * g / (h + ridge)
        total += step[leaf]
        found_features.append(features)
        found_bins.append(cuts)
        found_leaves.append(step)
    model.features, model.bins, model.leaves = map(np.array, (found_features, found_bins, found_leaves))
    return model


@dataclass
class Isotonic:
    """A rising function from log odds to probabilities, straight between the blocks' centres."""

    at: np.ndarray
    chance: np.ndarray

    def __call__(self, log_odds: np.ndarray) -> np.ndarray:
        return np.interp(log_odds, self.at, self.chance).clip(0.0, 1.0)


def isotonic(log_odds: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Isotonic:
    """Pool adjacent violators: least squares under the condition that it never falls."""
    order = np.argsort(log_odds, kind="stable")
    at, first = np.unique(log_odds[order], return_index=True)
    heavy = np.add.reduceat(weight[order], first)
    mean = np.add.reduceat((weight * label)[order], first) / heavy
    blocks: list[list[float]] = []
    for x, w, y in zip(at.tolist(), heavy.tolist(), mean.tolist(), strict=True):
        blocks.append([x, w, y])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            x2, w2, y2 = blocks.pop()
            x1, w1, y1 = blocks.pop()
            both = w1 + w2
            blocks.append([(x1 * w1 + x2 * w2) / both, both, (y1 * w1 + y2 * w2) / both])
    return Isotonic(np.array([b[0] for b in blocks]), np.array([b[2] for b in blocks]))
