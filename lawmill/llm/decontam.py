"""Benchmark decontamination with spaced-seed hashes.

Texts become token hashes (lower-cased runs of word characters). Fixed masks pick some of the positions of a
short window and ignore the others; the hash of the picked tokens is the window's seed. Seeds of documents are
joined with the seeds of the benchmark, so a window still meets its item if substitutions fall on ignored
positions, and the masks ignore different ones. The aligned document and item are then compared token by token.
They overlap if

* at least four fifths of the item's tokens are equal, or
* the stretch that maximises +1 per equal and -4 per different token has at least 13 equal tokens.

Items of less than 13 tokens have masks of their own length, which leave out each choice of as many positions as the
rule lets differ, so none of their overlaps is missed. For longer items with a fifth of their tokens replaced at
random the masks find 0.978 of those of 15 tokens, 0.99 or more of all others (``tests/llm`` measures it).

Defined results: null or empty text has no overlap; null items and items of less than ``MIN_ITEM`` tokens match
nothing, as a word or two prove no copying; repeated items and repeated rows are reported each; of equal overlaps
the first counts, overlaps are ordered by item_id; very long texts count whole; empty tables give no overlap; a
column named ``contamination`` is replaced, other columns may have any names.

Scale: documents are read in place. A bitmap of the benchmark's seeds (three times at most 2^22 bits, whatever the
benchmark's size) lets a worker drop the documents without any hit; hits, as rows, meet the benchmark's seeds in a
join, which broadcasts the seeds only up to a counted bound and is salted beyond it, so that a hot passage spreads.
Equal texts are compared once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawmill.llm.rows import pack, unpack
from lawmill.session import materialise

#: Window masks for items of ``SHORT`` tokens or more: 1 counts, 0 is ignored. Fixed values of the method.
MASKS = ("111010011", "110010111", "1101001011", "1011100101")
SHORT = 13
MIN_ITEM = 4
MIN_OVERLAP = 13
MISMATCH = -4
SLICE_BYTES = 1_000_000
BROADCAST_SEEDS = 500_000
SALTS = 32
WORD = re.compile(r"\w+")
#: Bitmaps of a seed: its bits from ``low`` on, ``bits`` of them.
SLOTS = ((42, 22), (20, 22), (0, 20))
OVERLAP = T.StructType([T.StructField(name, T.IntegerType()) for name in ("start", "length", "matched")])
FOUND = "array<struct<item_id:bigint,start:int,length:int,matched:int>>"


class TokenHashes(dict):
    """Token to 63-bit hash, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) & 0x7FFFFFFFFFFFFFFF
        return value


def token_hashes(text: str | None, known: TokenHashes) -> np.ndarray:
    tokens = WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)).view(np.uint64)


def masks_of(length: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number, positions) of the masks for items of a length.

    Shorter items fall into three or four classes of positions; each mask leaves out as many classes as tokens may differ."""
    if length >= SHORT:
        return [(n, tuple(i for i, c in enumerate(mask) if c == "1")) for n, mask in enumerate(MASKS)]
    differ = length // 5
    classes = (1, 3, 4)[differ]
    kept = combinations(range(classes), classes - differ)
    return [(100 * length + n, tuple(i for i in range(length) if i % classes in some)) for n, some in enumerate(kept)]


def seeds(tokens: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """One seed per window of the mask's span."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, (2 * number + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for at in mask:
        total ^= tokens[at : at + n]
        total *= np.uint64(0xD6E8FEB86659FD93)
        total ^= total >> np.uint64(32)
    return total


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item, length, tokens, seeds, places) of each benchmark text."""
    known = TokenHashes()
    for batch in batches:
        rows = []
        for item, text in zip(batch["item"], batch["text"]):
            tokens = token_hashes(text, known)
            each = [seeds(tokens, mask, n) for n, mask in masks_of(len(tokens))] if len(tokens) >= MIN_ITEM else []
            if len(tokens) < SHORT:
                each = [found[:1] for found in each]
            both = np.concatenate([np.empty(0, np.uint64), *each]).view(np.int64)
            places = np.concatenate([np.empty(0, np.int64), *map(np.arange, map(len, each))]).astype(np.int32)
            rows.append((item, len(tokens), tokens.view(np.int64), both, places))
        yield pd.DataFrame(rows, columns=["item", "length", "tokens", "seeds", "places"])


def _bitmaps(seeds_table: DataFrame) -> list[np.ndarray]:
    """One array of flags per entry of ``SLOTS``; what reaches the driver is bounded by their bits."""
    slots = [F.shiftrightunsigned("seed", low).bitwiseAND(F.lit((1 << bits) - 1)) for low, bits in SLOTS]
    each = seeds_table.select(F.posexplode(F.array(*slots)).alias("table", "slot"))
    words = each.groupBy("table", F.shiftright("slot", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 31 AS INT))")).alias("flags")
    )
    maps = [np.zeros(1 << bits - 5, np.uint32) for _, bits in SLOTS]
    for table, part in words.toPandas().groupby("table"):
        maps[table][part["word"].to_numpy()] = part["flags"].to_numpy().astype(np.uint32)
    return maps


def _hits(spark_context, maps: list[np.ndarray], lengths: list[int]):
    """A mapInArrow function: documents (key, text) to (key, tokens, seeds, places) of those with a possible hit."""
    shared = spark_context.broadcast((maps, [mask for length in lengths for mask in masks_of(length)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, masks = shared.value
        flags = [np.unpackbits(m.view(np.uint8), bitorder="little").view(bool) for m in packed]
        known = TokenHashes()
        for batch in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
            first = 0
            while first < len(batch):
                before = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
                yield hits_of(batch.slice(first, last - first), masks, flags, known)
                first = last

    def hits_of(part: pa.RecordBatch, masks, flags, known) -> pa.RecordBatch:
        each = [token_hashes(t, known) for t in part.column("text").to_pylist()]
        tokens = np.concatenate(each)
        ends = np.cumsum([len(t) for t in each])
        at, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for number, mask in masks:
            seed = seeds(tokens, mask, number)
            live = np.arange(len(seed))
            for (low, bits), flag in zip(SLOTS, flags):
                live = live[flag[(seed[live] >> np.uint64(low)).astype(np.int64) & (1 << bits) - 1]]
            owner = np.searchsorted(ends, live, "right")
            live = live[live + mask[-1] < ends[owner]]  # a window stays in its document
            at.append(live)
            found.append(seed[live])
        at, found = np.concatenate(at), np.concatenate(found)
        by = np.argsort(at, kind="stable")
        at, found = at[by], found[by]
        owner = np.searchsorted(ends, at, "right")
        rows, counts = np.unique(owner, return_counts=True)
        starts = ends - [len(t) for t in each]
        kept = [each[r].view(np.int64) for r in rows]
        lists = lambda values, lengths, kind: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [
                part.column("key").take(pa.array(rows)),
                lists(np.concatenate([np.empty(0, np.int64), *kept]), [len(t) for t in kept], pa.int64()),
                lists(found.view(np.int64), counts, pa.int64()),
                lists(at - starts[owner], counts, pa.int32()),
            ],
            ["key", "tokens", "seeds", "places"],
        )

    return run


def compare(part: np.ndarray, item: np.ndarray, lead: int) -> tuple[int, int, int] | None:
    """(start in ``part``, length, equal tokens) of an overlap of aligned tokens; ``lead`` tokens of the item come before."""
    equal = part == item[lead : lead + len(part)]
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, MISMATCH))])
    last = int((sums - np.minimum.accumulate(sums)).argmax())
    first = int(np.flatnonzero(sums[: last + 1] == sums[: last + 1].min())[-1])
    matched, total = int(equal[first:last].sum()), int(equal.sum())
    if 5 * total >= 4 * len(item):
        ends = np.flatnonzero(equal)
        return int(ends[0]), int(ends[-1] - ends[0] + 1), total
    return (first, last - first, matched) if matched >= MIN_OVERLAP else None


@F.pandas_udf(OVERLAP)
def overlaps(parts: pd.Series, items: pd.Series, leads: pd.Series) -> pd.DataFrame:
    found = [compare(np.asarray(p), np.asarray(i), int(n)) or (None, None, None) for p, i, n in zip(parts, items, leads)]
    return pd.DataFrame(found, columns=["start", "length", "matched"]).astype("Int32")


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(key, contamination): the overlaps of each distinct text that has any, ``key`` being the MD5 of the text."""
    named = benchmark.filter(F.col("text").isNotNull()).select("item_id", _key(F.col("text")).alias("item"), "text")
    items = materialise(
        named.groupBy("item").agg(F.first("text").alias("text")).mapInPandas(
            _item_seeds, "item string, length int, tokens array<long>, seeds array<long>, places array<int>"
        ).filter(F.size("seeds") > 0)
    )
    known = items.select("item", "length", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("item", "length", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    lengths = sorted(r["n"] for r in known.select(F.least("length", F.lit(SHORT)).alias("n")).distinct().collect())  # at most SHORT of them
    search = _hits(docs.sparkSession.sparkContext, _bitmaps(known), lengths)
    texts = docs.select(_key(F.col("text")).alias("key"), "text")
    # a text without any hit ends in the worker; equal texts fold
    found = materialise(texts.mapInArrow(search, "key string, tokens array<long>, seeds array<long>, places array<int>").dropDuplicates(["key"]))
    hits = found.select("key", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("key", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    sides, on_seed, on_item = [known, items.select("item", F.col("tokens").alias("item_tokens"))], ["seed"], ["item"]
    if known.limit(broadcast_seeds + 1).count() <= broadcast_seeds:
        known, item_tokens = map(F.broadcast, sides)
    else:
        known, item_tokens = (side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) for side in sides)
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        on_seed, on_item = ["seed", "salt"], ["item", "salt"]
    pairs = hits.join(known, on_seed).select("key", *on_item, "length", (F.col("at") - F.col("place")).alias("shift")).distinct()
    start = F.greatest("shift", F.lit(0))
    stop = F.least(F.size("tokens"), F.col("shift") + F.col("length"))
    cut = pairs.join(found.select("key", "tokens"), "key").select(
        "key", *on_item, start.alias("from"), F.greatest(-F.col("shift"), F.lit(0)).alias("lead"), F.slice("tokens", start + 1, stop - start).alias("part")
    )
    compared = cut.join(item_tokens, on_item).select("key", "item", "from", overlaps("part", "item_tokens", "lead").alias("o")).filter("o.matched IS NOT NULL")
    first = F.struct(F.col("o.matched"), (-(F.col("from") + F.col("o.start"))).alias("before"), F.col("o.length"))
    best = compared.groupBy("key", "item").agg(F.max(first).alias("best"))
    each = best.join(named.select("item", "item_id"), "item").select(
        "key", F.struct("item_id", (-F.col("best.before")).alias("start"), F.col("best.length"), F.col("best.matched")).alias("overlap")
    )
    return each.groupBy("key").agg(F.array_sort(F.collect_list("overlap")).cast(FOUND).alias("contamination"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``docs`` plus ``contamination``: array of (item_id, start, length, matched), empty for a clean document.

    Starts and lengths count tokens. A column of that name is replaced."""
    found = materialise(contamination(docs, benchmark, broadcast_seeds))
    if (found.agg(F.sum(F.size("contamination"))).first()[0] or 0) <= broadcast_seeds:
        found = F.broadcast(found)
    joined = pack(docs, "text").withColumn("key", _key(F.col("text"))).join(found, "key", "left")
    return unpack(joined, docs.columns, "text", contamination=F.coalesce("contamination", F.array().cast(FOUND)))
