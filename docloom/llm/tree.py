"""A small decision tree, grown by Gini impurity on a labelled table that fits in memory."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

#: A labelled table for a tree holds at most this many rows.
MAX_ROWS = 10_000


@dataclass
class Node:
    label: str
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _impurity(labels: Counter) -> float:
    n = sum(labels.values())
    return n - sum(c * c for c in labels.values()) / n if n else 0.0


def grow(rows: list[list[float]], labels: list[str], depth: int = 8) -> Node:
    """The tree of a labelled table; at each node the split that leaves the least impurity, the first of equals."""
    if len(rows) > MAX_ROWS:
        raise ValueError(f"the labelled table may have {MAX_ROWS} rows")
    whole = Counter(labels)
    node = Node(max(sorted(whole), key=whole.get))
    if depth == 0 or len(whole) == 1:
        return node
    best = (_impurity(whole) - 1e-9, -1, 0.0)
    for f in range(len(rows[0])):
        order = sorted(range(len(rows)), key=lambda k: rows[k][f])
        left, right = Counter(), Counter(whole)
        for a, b in zip(order, order[1:]):
            left[labels[a]] += 1
            right[labels[a]] -= 1
            if rows[a][f] < rows[b][f]:
                left_right = _impurity(left) + _impurity(right)
                if left_right < best[0] - 1e-9:
                    best = (left_right, f, (rows[a][f] + rows[b][f]) / 2)
    if best[1] < 0:
        return node
    node.feature, node.limit = best[1], best[2]
    parts = [[k for k in range(len(rows)) if (rows[k][node.feature] > node.limit) == side] for side in (False, True)]
    node.low, node.high = (grow([rows[k] for k in p], [labels[k] for k in p], depth - 1) for p in parts)
    return node


def decide(node: Node, row: list[float]) -> str:
    while node.feature >= 0:
        node = node.high if row[node.feature] > node.limit else node.low
    return node.label
