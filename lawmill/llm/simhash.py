"""SimHash near-dedup with pigeonring candidate filtering.

Fingerprint: the ASCII-lower-cased words of the whole text, their 4-word shingles with repeats (the whole
sequence if there are fewer words), XXH64 with seed 42 of each; a bit is set if more than half of the hashes
set it. No words give fingerprint zero.

Candidates: a fingerprint is a ring of five segments of 13, 13, 13, 13 and 12 bits. If two fingerprints
differ in at most 4 bits, some segment starts a chain whose first 1, 2, ... 5 segments differ in at most
0, 1, 2, 3 and 4 bits (the proportional budget 4 * k / 5 rounded down, for each prefix of length k). So both
carry one key made of the start, its exact bits and the next segment with one bit masked. Keys have about 25
free bits; the rest of the chain and then the full Hamming distance are checked inside a key's bucket.

Buckets give a spanning forest, not pairs: a breadth-first walk marks each fingerprint once, so a dense group
of n fingerprints yields n - 1 links that connect just what all of its pairs would. Equal fingerprints are
folded into one row first. Components are then joins and aggregations.

Defined results: null text is empty text; null doc_id rows get a fingerprint and their component's smallest
doc_id (null where nothing else is in it); repeated rows and ties stay; very long texts count whole; an empty table
gives an empty table; only ``doc_id`` and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawmill.llm.components import connected_components
from lawmill.session import materialise

SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (lowest bit, bits)
BUDGET = 4
WORDS = 4


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)), np.uint64, len(words) - width + 1
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """The fingerprint as a signed long."""
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _bits(fp: Column, segment: int) -> Column:
    low, width = SEGMENTS[segment]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def chain_keys(fp: Column) -> Column:
    """All keys of a fingerprint: for each start, its bits and the next segment with each bit masked in turn."""
    keys = []
    for start in range(len(SEGMENTS)):
        after = (start + 1) % len(SEGMENTS)
        first, second = _bits(fp, start), _bits(fp, after)
        for bit in range(SEGMENTS[after][1]):
            masked = second.bitwiseAND(F.lit(~(1 << bit) & 0x1FFF))
            keys.append(F.lit((start * 16 + bit) << 26) + F.shiftleft(first, 13) + masked)
    return F.array(*keys)


def _chain_ok(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from ``start`` keeps every prefix within its budget."""
    counts = np.stack([np.bitwise_count((diff >> np.uint64(low)) & np.uint64((1 << width) - 1)) for low, width in SEGMENTS])
    total, ok = np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
    at = np.arange(len(diff))
    for length in range(1, len(SEGMENTS) + 1):
        total += counts[(start + length - 1) % len(SEGMENTS), at]
        ok &= total <= BUDGET * length // len(SEGMENTS)
    return ok


def _forest(members: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the bucket's graph, in which fingerprints are linked that keep the chain from
    ``start`` and the Hamming budget. A link that keeps another chain only is found in that chain's bucket."""
    links, rest = [], members
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            differ = rest ^ here
            near = _chain_ok(differ, np.full(len(rest), start)) & (np.bitwise_count(differ) <= BUDGET)
            if near.any():
                links += [(int(here), int(x)) for x in rest[near]]
                queue.extend(rest[near])
                rest = rest[~near]
    return links


def _bucket_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of all buckets; rows come sorted by key, so a bucket may reach over several batches."""

    def links_of(parts: list[pd.DataFrame]) -> pd.DataFrame:
        key = np.concatenate([p["key"].to_numpy(np.int64) for p in parts])
        fp = np.concatenate([p["fp"].to_numpy(np.int64) for p in parts]).view(np.uint64)
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        a, b, start = fp[two], fp[two + 1], key[two] >> 30
        ok = _chain_ok(a ^ b, start)
        ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= BUDGET
        more = [x for at, n in zip(edge[:-1][size > 2], size[size > 2]) for x in _forest(fp[at : at + n], int(key[at]) >> 30)]
        more_a, more_b = (np.array([x[k] for x in more], np.uint64) for k in (0, 1))
        return pd.DataFrame({"a": np.r_[a[ok], more_a].view(np.int64), "b": np.r_[b[ok], more_b].view(np.int64)}).drop_duplicates()

    held: list[pd.DataFrame] = []  # rows of one key
    for batch in batches:
        if not len(batch):
            continue
        key = batch["key"].to_numpy(np.int64)
        last = int(np.searchsorted(key, key[-1]))
        if last == 0 and held and held[-1]["key"].iloc[0] == key[0]:
            held.append(batch)  # the bucket goes on
            continue
        yield links_of([*held, batch.iloc[:last]])
        held = [batch.iloc[last:]]
    if held:
        yield links_of(held)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints within the budget of each other, from distinct ``fp``."""
    # fingerprints are few bytes but each becomes 64 keys, so they are spread by the keys' size, not their own;
    # by a hash of their own, as Spark would take a second exchange by the same column out
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    keyed = spread.select(F.explode(chain_keys(F.col("fp"))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_bucket_links, "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``."""
    marked = materialise(docs.select("doc_id", fingerprints("text").alias("fp")))
    # a class of equal fingerprints is named by its smallest doc_id, so that a component's smallest name is its id;
    # a class without any doc_id sorts behind all others
    least = F.min("doc_id")
    name = F.struct(least.isNull().alias("unnamed"), F.coalesce(least, "fp").alias("id")).alias("name")
    classes = materialise(marked.groupBy("fp").agg(name))
    links = fingerprint_links(classes.select("fp"))
    for end in ("a", "b"):
        links = links.join(classes.select(F.col("fp").alias(end), F.col("name").alias(f"name_{end}")), end)
    roots = connected_components(links.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    named = classes.join(roots, classes["name"] == roots["node"], "left").select("fp", F.coalesce("root", "name").alias("root"))
    component = F.when(~F.col("root.unnamed"), F.col("root.id"))
    return marked.join(named, "fp").select("doc_id", "fp", component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, groups_of: Callable[[DataFrame], DataFrame] = near_duplicate_groups) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, of which ``groups_of`` names the kind.

    A doc_id stands for one document: its repeated rows stay or go together. Rows without a doc_id stay.
    """
    groups = groups_of(docs.filter(F.col("doc_id").isNotNull()))
    losers = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(losers, "doc_id", "left_anti")
    return kept.select(*docs.columns)
