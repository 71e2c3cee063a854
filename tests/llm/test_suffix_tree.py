"""Suffix trees against plain comparison of all suffixes."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellkpi.llm import phrase_dedup, repeats, suffix_tree

WORDS = st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=8), min_size=1, max_size=25)


def tree_of(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    suffixes = [np.array(r, np.uint64).tobytes() for r in rows]
    return phrase_dedup.suffix_tree_order(np.zeros(len(rows), np.int64), suffixes)


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_deep_nodes_spell_the_branching_repeats(rows):
    order, lcp = tree_of(rows)
    tree = suffix_tree.grow(lcp)
    spelled = set()
    for node in tree.repeats(1):
        below = [leaf for leaf in range(tree.leaves) if node in path(tree, leaf)]
        texts = [rows[order[leaf]] for leaf in below]
        depth = tree.depth[node]
        assert len(below) > 1 and len({tuple(t[:depth]) for t in texts}) == 1
        spelled.add(tuple(texts[0][:depth]))
    # Brute force: prefixes of two suffixes at least that don't all go on with one word.
    wanted = set()
    for prefix in {tuple(r[:d]) for r in rows for d in range(1, len(r) + 1)}:
        nexts = [tuple(r[len(prefix) : len(prefix) + 1]) for r in rows if tuple(r[: len(prefix)]) == prefix]
        if len(nexts) > 1 and (len(set(nexts)) > 1 or nexts[0] == ()):
            wanted.add(prefix)
    assert spelled == wanted


def path(tree: suffix_tree.Tree, node: int) -> list[int]:
    found = []
    while node != tree.leaves:
        node = int(tree.parent[node])
        found.append(node)
    return found


@settings(max_examples=200, deadline=None)
@given(WORDS)
def test_loci_part_suffixes_as_their_prefixes_do(rows):
    order, lcp = tree_of(rows)
    climb, run = suffix_tree.loci(order, lcp), repeats.runs(order, lcp)
    for depth in range(8, 0, -1):
        node, plain = climb(depth), run(depth)
        fit = [i for i, r in enumerate(rows) if len(r) >= depth]
        for i in fit:
            for j in fit:
                same = rows[i][:depth] == rows[j][:depth]
                assert (node[i] == node[j]) == same == (plain[i] == plain[j])


def test_no_suffix_and_one():
    assert suffix_tree.grow(np.zeros(0, np.int64)).repeats(1).size == 0
    assert suffix_tree.loci(np.zeros(1, np.int64), np.zeros(1, np.int64))(3).tolist() == [0]
