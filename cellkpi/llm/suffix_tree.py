"""Internal nodes of suffix trees, from sorted suffixes and the common prefixes of neighbours."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Leaves are the nodes 0, 1, ... in suffix order, the root follows them, then the other internal nodes.

    ``depth`` is what all suffixes below a node share, ``parent`` the node above; the root is its own.
    A leaf has no depth of its own here (-1).
    """

    depth: np.ndarray
    parent: np.ndarray
    leaves: int

    def repeats(self, least: int) -> np.ndarray:
        """The internal nodes of at least that depth: what they spell occurs under two branches or more."""
        return np.flatnonzero(self.depth >= least)


def grow(lcp: np.ndarray) -> Tree:
    """The tree of suffixes of which each shares ``lcp`` units with its predecessor (the first none).

    Nodes on the rightmost path are open. A suffix that shares less than the deepest open node closes
    nodes up to where it branches off, at an open node or at a new one. Each node opens and closes once.
    """
    n = len(lcp)
    depth, parent = [-1] * n + [0], [n] * (n + 1)
    path = [n]
    for leaf, shared in enumerate([*lcp[1:].tolist(), 0] if n else []):
        child = leaf
        while depth[path[-1]] > shared:
            node = path.pop()
            parent[child] = node
            child = node
        if depth[path[-1]] < shared:
            path.append(len(depth))
            depth.append(shared)
            parent.append(n)
        parent[child] = path[-1]
    return Tree(np.array(depth, np.int64), np.array(parent, np.int64), n)


def loci(order: np.ndarray, lcp: np.ndarray) -> Callable[[int], np.ndarray]:
    """A function that gives, for falling depths of one or more, the locus of every suffix's prefix of that depth.

    The locus is the highest node at that depth or below it: suffixes share the prefix if they share the
    locus, and a prefix that occurs once has its leaf. From call to call loci climb towards the root.
    """
    tree = grow(lcp)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))

    def climb(depth: int) -> np.ndarray:
        moving = np.arange(len(at))
        while len(moving):
            above = tree.parent[at[moving]]
            deep = tree.depth[above] >= depth
            moving, above = moving[deep], above[deep]
            at[moving] = above
        return at

    return climb
