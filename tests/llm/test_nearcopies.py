"""Near copies inside families of one template, against all pairs."""

import random

import numpy as np
import pytest

from lawmill.llm import nearcopies


def family(n, words, changed, seed):
    """Texts of one template with a share of places changed, and copies of some of them with a few more changes."""
    rng = random.Random(seed)
    template = [f"t{k}" for k in range(words)]
    texts = []
    for k in range(n):
        if k % 5 == 4:  # a near copy of an earlier one
            text = list(rng.choice(texts))
            share = 0.008
        else:
            text, share = list(template), changed
        for at in range(words):
            if rng.random() < share:
                text[at] = f"w{rng.randrange(10**6)}"
        texts.append(text)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def brute(texts):
    """All pairs of similarity 0.8 or more, as places, and the median similarity."""
    sets = [nearcopies.shingles(t) for t in texts]
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.argsort(code, kind="stable")
    shared = np.zeros((len(sets), len(sets)), np.int32)
    for group in np.split(owner[by], np.flatnonzero(np.diff(code[by])) + 1):
        if len(group) > 1:
            shared[np.ix_(group, group)] += 1
    size = np.array([len(s) for s in sets])
    union = size[:, None] + size[None, :] - shared
    upper = np.triu_indices(len(sets), 1)
    return np.argwhere(np.triu(5 * shared >= 4 * union, 1)), float(np.median((shared / union)[upper]))


@pytest.mark.parametrize("n, words, changed, blocks", [(300, 200, 0.018, None), (1500, 120, 0.016, None), (4000, 60, 0.014, None), (300, 200, 0.018, 9000)])
def test_template_families(spark, monkeypatch, n, words, changed, blocks):
    if blocks:
        monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", blocks)
    texts = family(n, words, changed, n)
    pairs, median = brute(texts)
    assert 0.65 <= median <= 0.78 and len(pairs) > n / 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copy_groups(docs).collect()}
    found = sum(group[a] == group[b] for a, b in pairs.tolist())
    assert found >= 0.95 * len(pairs), (found, len(pairs))
    # and no group but what those pairs make
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        if (low == root).all():
            break
        root = low
    assert all(root[d] == root[c] for d, c in group.items())
    assert np.mean([root[d] == c for d, c in group.items()]) >= 0.95


def test_blocks_against_sets():
    rng = random.Random(4)
    base = [rng.randrange(1 << 60) for _ in range(60)]
    sets = [np.unique(np.array(rng.sample(base, rng.randrange(40, 60)) + [rng.randrange(1 << 60) for _ in range(rng.randrange(5))], np.uint64)) for _ in range(90)]
    root = np.array([rng.randrange(70) for _ in sets])
    for first in (0, 1, 30, 90):
        found = nearcopies.block_links(sets, root, first)
        others = range(first, 90) if first < 90 else range(90)
        want = {(x, y) for x in range(first) for y in others if root[x] != root[y] and 5 * len(np.intersect1d(sets[x], sets[y])) >= 4 * len(np.union1d(sets[x], sets[y]))}
        assert set(found) <= want

        def labels(links):
            label = list(range(90))
            for x, y in links:
                low, high = sorted((label[x], label[y]))
                label = [low if v == high else v for v in label]
            return label

        assert labels(found) == labels(want)
