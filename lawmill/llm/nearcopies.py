"""SimHash near-dedup at a similarity: groups of documents whose 5-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of ``simhash``; a text of fewer words is one shingle, a text without words has none. Equal
shingle sets are folded into one node first, named by its smallest doc_id.

Two sets of similarity 0.8 differ in about 15 of 100 SimHash bits, too many for a 64-bit fingerprint to tell from
chance. So the fingerprint here is wide: a ring of 129 segments of 20 bits, the signs of 2,580 random projections of
the set (each shingle adds +1 or -1 to one of 4,096 places; random signs and Hadamard transforms mix the places).

Candidates, by pigeonring: a chain starts at a segment that two fingerprints share and goes on for three segments; the
differences of its first 2, 3 and 4 segments must stay within the proportional budget of 4 a segment. A pair of
similarity 0.8 fails to share all 129 segments with a probability of (1 - 0.848^20)^129 = 0.008, one of 0.85 with 0.0002.
Candidates then go through the full Hamming check (a fifth of all bits) and an exact check of the shingle sets.

The rows of one segment value give a spanning forest of the chain relation by a walk, not pairs, so a dense group of n
nodes yields n - 1 links there. All forests together have the components of that relation, the families: a similar pair
that shares a chain is in one family, whatever the walk has linked its ends to. Of a family's links, each node's nearest one
and the one to its neighbour of most links are checked exactly; that makes most families one group. Families of several
groups are then searched in full: their nodes are dealt to blocks of bounded size (a group that fills blocks has its own), and
each pair of blocks that could join two groups is one task, which counts all its shared shingles exactly (a matrix product
for the frequent ones, lists for the rare) and gives the links of a spanning forest.

Defined results: null text is empty; texts without words are one group; null doc_id rows are in no group; repeated
rows and ties are equal sets; very long texts count whole; an empty table gives an empty table; only ``doc_id`` and
``text`` are read, so other columns may have any names.

Scale: the shuffled rows are 129 of 20 bytes for each distinct shingle set. The rows that share a segment by chance
grow with the square of the corpus, divided by 2 to the power of the bits of a segment: 20 bits suit some ten
million distinct texts; beyond, take longer segments and more of them (1.18 times as many for each further bit). The
search of a family of several groups grows with the square of its blocks: texts from one template, alike to 0.7 or so, are
what it is for. A block pair holds ``BLOCK_SHINGLES`` twice; of n blocks each goes to n tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawmill.llm.components import connected_components
from lawmill.llm.memory import give_back
from lawmill.session import materialise, small

WORDS = 5
SIMILAR = (4, 5)  # four fifths
SEGMENTS, BITS, CHAIN = 129, 20, 3  # CHAIN segments are compared after the shared one
BUDGET = 4  # differing bits a segment, a fifth
PLACES = 4096
SALTS = 32
BLOCK_SHINGLES, BLOCK_ROWS = 300_000, 2_000  # of a block of a family
PAIRS_AT_ONCE = 1_000_000
MARKS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("ring", T.ArrayType(T.LongType()))])
SETS = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("ring", T.ArrayType(T.LongType()))])
_random = np.random.default_rng(5)
SIGNS = _random.choice((-1.0, 1.0), (2, PLACES))
ORDER = _random.permutation(PLACES)[: SEGMENTS * BITS]
MASK = np.int64((1 << BITS) - 1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    width, digest = min(WORDS, len(words)), xxhash.xxh64_intdigest
    if not width:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))


def _hadamard(size: int) -> np.ndarray:
    matrix = np.ones((1, 1))
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix


def rings(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set: the ring's segments, three in each 64-bit word. Sums stay whole numbers, so signs are exact."""
    side = _hadamard(64)
    mixed = np.stack([np.bincount((s & np.uint64(PLACES - 1)).astype(np.int64), 1.0 - 2.0 * (s >> np.uint64(63)), PLACES) for s in sets])
    for signs in SIGNS:
        mixed = (side @ (mixed * signs).reshape(-1, 64, 64) @ side).reshape(-1, PLACES)
    bits = (mixed[:, ORDER] > 0).reshape(len(sets), SEGMENTS // 3, 3 * BITS)
    return bits @ (np.int64(1) << np.arange(3 * BITS, dtype=np.int64))


@F.pandas_udf(MARKS)
def marks(texts: pd.Series) -> pd.DataFrame:
    digests, found = [], []
    for at in range(0, len(texts), 64):
        sets = [shingles(t) for t in texts[at : at + 64]]
        digests += [hashlib.md5(s.tobytes()).digest() for s in sets]
        found += list(rings(sets))
    give_back()
    return pd.DataFrame({"digest": pd.Series(digests, dtype=object), "ring": pd.Series(found, dtype=object)})


@F.pandas_udf(SETS)
def shingle_sets(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    found = [ring for at in range(0, len(sets), 64) for ring in rings(sets[at : at + 64])]
    return pd.DataFrame({"shingles": pd.Series([s.view(np.int64) for s in sets], dtype=object), "ring": pd.Series(found, dtype=object)})


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, chain): each segment of a ring, with the segments that follow in one word."""
    for batch in batches:
        for at in range(0, len(batch), 200):
            part = batch.slice(at, 200)
            words = part.column("ring").flatten().to_numpy().reshape(len(part), -1)
            segments = np.stack([words & MASK, words >> BITS & MASK, words >> 2 * BITS & MASK], axis=2).reshape(len(part), SEGMENTS)
            chain = sum(np.roll(segments, -1 - k, axis=1) << (BITS * k) for k in range(CHAIN))
            key = segments | np.arange(SEGMENTS, dtype=np.int64) << BITS
            node = np.repeat(part.column("node").to_numpy(), SEGMENTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().astype(np.int32)), pa.array(node), pa.array(chain.ravel())], ["key", "node", "chain"]
            )


def _close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether two chains keep every prefix within its budget, and all their differing bits."""
    differ, total, ok = a ^ b, 0, True
    for k in range(CHAIN):
        total = total + np.bitwise_count(differ >> BITS * k & MASK).astype(np.int64)
        ok = ok & (total <= BUDGET * (k + 2))
    return ok, total


def _walk(node: np.ndarray, chain: np.ndarray) -> list[tuple[int, int, int]]:
    """(a, b, differing bits) of a spanning forest of the rows of one key."""
    links, rest = [], np.arange(len(node))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop(0)
            ok, total = _close(chain[rest], chain[here])
            links += [(int(node[here]), int(node[x]), int(d)) for x, d in zip(rest[ok], total[ok])]
            queue.extend(rest[ok])
            rest = rest[~ok]
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all keys; rows come sorted by key and node, so a key may reach over several batches."""

    def links_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        key, node, chain = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("key", "node", "chain"))
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge)
        # keys of few rows are walked only if some pair is close
        wanted = size > 8
        for step in range(1, 8):
            first = np.flatnonzero(key[step:] == key[:-step])
            close = first[_close(chain[first], chain[first + step])[0]]
            wanted[np.searchsorted(edge, close, "right") - 1] = True
        links = [x for at, n in zip(edge[:-1][wanted], size[wanted]) for x in _walk(node[at : at + n], chain[at : at + n])]
        a, b, d = np.array(links, np.int64).reshape(-1, 3).T
        a, b, d = a[a != b], b[a != b], d[a != b]  # a doc_id may stand for two texts
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d)], ["a", "b", "d"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last == 0 and held and held[-1].column("key")[0].as_py() == key[0]:
            held.append(batch)  # one key goes on
            continue
        yield links_of([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield links_of(held)
        held.clear()
    give_back()


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b, d) from (node, ring): links between close fingerprints and their differing bits on the best chain."""
    # a ring is a few hundred bytes but becomes 129 rows, so rings are spread by the rows' size, not their own
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("node"))
    keyed = spread.select("node", "ring").mapInArrow(_keyed, "key int, node long, chain long")
    sorted_rows = keyed.repartition("key").sortWithinPartitions("key", "node")
    return sorted_rows.mapInArrow(_bucket_links, "a long, b long, d long").groupBy("a", "b").agg(F.min("d").alias("d"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) within the Hamming budget whose shingle sets have a Jaccard similarity of 0.8 or more."""
    # a is the hub of a dense group; its set goes out once per salt, so that no task has all of its pairs
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    left, right = (sets.select(F.col("node").alias(n), F.col("ring").alias(f"ring_{n}"), F.col("shingles").alias(f"set_{n}")) for n in ("a", "b"))
    hubs = salted.select("a", "salt").distinct().join(left, "a")
    differ = F.aggregate(F.zip_with("ring_a", "ring_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    near = salted.join(hubs, ["a", "salt"]).join(right, "b").filter(differ <= BUDGET * SEGMENTS)
    both = F.size(F.array_intersect("set_a", "set_b"))
    low, high = SIMILAR
    return near.filter((low + high) * both >= low * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def first_links(links: DataFrame) -> DataFrame:
    """(a, b): of each node the nearest link and the link to the neighbour that has most links."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "d").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "d"))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ranked = ends.join(degrees.select(F.col("node").alias("other"), "n"), "other")
    nearest, hub = F.min(F.struct("d", "other")).alias("nearest"), F.max(F.struct("n", -F.col("other"), "other")).alias("hub")
    chosen = ranked.groupBy("node").agg(nearest, hub).select("node", F.explode(F.array_distinct(F.array("nearest.other", "hub.other"))).alias("other"))
    return chosen.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _shared(rows: list[np.ndarray], first: int) -> np.ndarray:
    """How many shingles each of the first ``first`` sets shares with each of the others (with each of the first, if there are no others)."""
    n = len(rows)
    others = np.arange(first, n) if n > first else np.arange(n)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    _, code, holders = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    often = holders >= max(16, n // 16)
    hot, place = often[code], (np.cumsum(often) - 1)[code]
    shared = np.zeros((first, len(others)), np.float32)  # whole numbers, exact
    wide = max(1, PAIRS_AT_ONCE // n)
    for at in range(0, int(often.sum()), wide):
        own = hot & (place >= at) & (place < at + wide)
        dense = np.zeros((n, wide), np.float32)
        dense[owner[own], place[own] - at] = 1
        shared += dense[:first] @ dense[others].T
    shared = shared.astype(np.int32).ravel()
    some = ~hot & (holders[code] > 1)
    code, owner = code[some], owner[some]
    by = np.lexsort((owner, code))
    code, owner = code[by], owner[by]
    left = owner < first
    right = ~left if n > first else left
    lefts, rights = (np.searchsorted(code[x], np.arange(len(holders) + 1)) for x in (left, right))
    per = np.diff(rights)  # of each left row, how many rows on the right have its code
    mine, own_code = owner[left], code[left]
    theirs = owner[right] - (first if n > first else 0)
    ends = np.cumsum(per[own_code])
    at = 0
    while at < len(mine):  # a bounded number of pairs at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        times = per[own_code[at:to]]
        y = theirs[np.repeat(rights[own_code[at:to]] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
        np.add.at(shared, np.repeat(mine[at:to], times) * len(others) + y, 1)
        at = to
    return shared.reshape(first, len(others))


def _forest(near: np.ndarray, alike: bool) -> list[tuple[int, int]]:
    """(row, column) of a spanning forest of a matrix of links; ``alike`` if rows and columns are the same nodes."""
    links, rows = [], np.ones(len(near), bool)
    columns = rows if alike else np.ones(near.shape[1], bool)
    for start in np.flatnonzero(near.any(axis=1)).tolist():
        if not rows[start]:
            continue
        rows[start] = False
        queue = [(start, True)]
        while queue:
            here, is_row = queue.pop()
            free = columns if is_row else rows
            hit = np.flatnonzero((near[here] if is_row else near[:, here]) & free)
            free[hit] = False
            links += [(here, x) if is_row else (x, here) for x in hit.tolist()]
            queue += [(x, alike or not is_row) for x in hit.tolist()]
    return links


def block_links(sets: list[np.ndarray], root: np.ndarray, first: int) -> list[tuple[int, int]]:
    """Places of a spanning forest of the similar pairs between the first ``first`` sets and the others (or among the first, if
    there are no others), those of one ``root`` left out."""
    others = np.arange(first, len(sets)) if len(sets) > first else np.arange(first)
    if not first:
        return []
    low, high = SIMILAR
    size = np.array([len(x) for x in sets])
    near = (low + high) * _shared(sets, first) >= low * (size[:first, None] + size[others][None, :])
    near &= root[:first, None] != root[others][None, :]
    return [(x, int(others[y])) for x, y in _forest(near, len(sets) == first)]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of all pairs of blocks; rows come sorted by family, pair and side, and are held for one pair at a time."""
    key, first, nodes, roots, sets = None, 0, [], [], []

    def links() -> pa.RecordBatch:
        found = np.array(block_links(sets, np.array(roots), first), np.int64).reshape(-1, 2)
        ends = np.array(nodes, np.int64)[found]
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    for batch in batches:
        shingles = batch.column("shingles")
        values, offsets = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        names = ("family", "one", "two", "side", "node", "root")
        for at, (family, one, two, side, node, root) in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
            if (family, one, two) != key:
                if len(nodes) > 1:
                    yield links()
                key, first, nodes, roots, sets = (family, one, two), 0, [], [], []
            first += side == 0
            nodes.append(node)
            roots.append(root)
            sets.append(values[offsets[at] : offsets[at + 1]].copy())
    if len(nodes) > 1:
        yield links()
    sets.clear()
    give_back()


def family_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect all similar nodes of each family. ``members``: node, family, and root, the group known so far."""
    weight = F.size("shingles") + F.lit(BLOCK_SHINGLES // BLOCK_ROWS)
    sized = materialise(members.join(sets.select("node", weight.cast("long").alias("w")), "node"))
    groups = sized.groupBy("family", "root").agg(F.sum("w").alias("gw")).withColumn("own", F.col("gw") > BLOCK_SHINGLES)
    small_ones = groups.groupBy("family").agg(F.sum(F.when(~F.col("own"), F.col("gw"))).alias("fw"))
    # a large group has blocks of its own, the others of a family share blocks
    parts = F.ceil(F.when(F.col("own"), F.col("gw")).otherwise(F.col("fw")) / BLOCK_SHINGLES)
    dealt = F.pmod(F.xxhash64(F.when(F.col("own"), F.col("node")).otherwise(F.col("root"))), parts)
    owner = F.when(F.col("own"), F.col("root"))
    placed = sized.join(groups, ["family", "root"]).join(small_ones, "family").select(
        "family", "node", "root", owner.alias("owner"), F.concat_ws(":", owner, dealt).alias("block")
    )
    placed = materialise(placed)
    blocks = placed.select("family", "block", "owner").distinct()
    one, two = (blocks.select("family", F.col("block").alias(n), F.col("owner").alias(f"owner_{n}")) for n in ("one", "two"))
    pairs = one.join(two, "family").filter((F.col("one") <= F.col("two")) & ~F.coalesce(F.col("owner_one") == F.col("owner_two"), F.lit(False)))
    pairs = pairs.select("family", "one", "two")
    sides = pairs.select("family", "one", "two", F.col("one").alias("block"), F.lit(0).alias("side")).unionByName(
        pairs.filter("one < two").select("family", "one", "two", F.col("two").alias("block"), F.lit(1).alias("side"))
    )
    rows = placed.join(sides, ["family", "block"]).join(sets.select("node", "shingles"), "node")
    rows = rows.select("family", "one", "two", "side", "node", "root", "shingles")
    whole = rows.repartition("family", "one", "two").sortWithinPartitions("family", "one", "two", "side")
    return whole.mapInArrow(_searched, "a long, b long")


def between(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of different groups that ``links`` connect, by their roots; a node without one is a group."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        root = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        ends = ends.join(root, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    pairs = ends.filter("root_a <> root_b")
    return pairs.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` with a doc_id."""
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    marked = materialise(texts.select("doc_id", marks("text").alias("m")).select("doc_id", "m.*"))
    classes = materialise(marked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("ring").alias("ring")))
    links = materialise(candidate_links(classes.select("node", "ring")))
    # few documents have a link: their ids go to the texts while they are counted to be few, else both are shuffled
    ends = small(links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))).distinct(), 1_000_000)
    sets = texts.join(ends, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), shingle_sets("text").alias("s"))
    sets = materialise(sets.select("node", "s.*"))
    done = materialise(similar(materialise(first_links(links)), sets))
    roots = connected_components(done)
    # what is left to search: links between different groups, and the families that they make of groups
    rest = materialise(between(links, roots))
    if not rest.isEmpty():
        families = connected_components(rest).select(F.col("node").alias("root"), F.col("root").alias("family"))
        groups = roots.unionByName(families.select(F.col("root").alias("node"), "root")).distinct()
        # what the search finds joins groups, so components are of groups, not of all links again
        joined = connected_components(between(family_links(groups.join(families, "root"), sets), roots))
        whole = joined.select(F.col("node").alias("root"), F.col("root").alias("whole"))
        roots = groups.join(whole, "root", "left").select("node", F.coalesce("whole", "root").alias("root"))
    named = classes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return marked.join(named, "digest").select("doc_id", "component_id")
