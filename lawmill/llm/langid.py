"""Language identification by prediction by partial matching.

Every language has a variable-order context tree over bytes: contexts of up to three bytes with the counts of the bytes
that followed them in its sample. A byte's probability in a context is count / (total + kinds); a byte not seen there
escapes with kinds / (total + kinds) to the context that is one byte shorter, in which the bytes already refused are
excluded; below the empty context all bytes not seen there are equally likely. The statistics are frozen after the fit, so
a text's exact code length under a language is a sum over its bytes. The shortest code names the language; the score is
its share of the probability that all languages together give to the text.

Before a text stand three zero bytes as context. Code lengths are whole numbers of 1/65536 bit, so that sums don't depend
on how rows are batched.

The fit takes, for each of the ``LANGUAGES`` most frequent languages, the ``SAMPLE_ROWS`` distinct texts with the smallest
hashes, whole; tasks count their byte sequences and Spark adds them up. The trees keep contexts seen ``LEAST`` times or
more, the most frequent first, as long as contexts times languages stay within ``CELLS``. The tree counts are a few MB,
whatever the corpus; they are broadcast, and each worker makes a table of code lengths of them once. Scoring is one step
over the scan without a shuffle: one look-up by the three bytes before, one by context and byte.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the name that sorts first;
a model without languages gives ``und``; very long texts count whole, a slice at a time; repeated rows count once in the
fit and are each judged; an empty table gives no rows; other columns pass through, whatever their names, result columns
are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lawmill.session import materialise

ORDER = 3
LANGUAGES = 64
SAMPLE_ROWS = 600
LEAST = 3
CELLS = 80_000
UNIT = 1 << 16
SLICE_BYTES = 1 << 18
UNKNOWN = "und"


@dataclass
class Model:
    """Counts of byte sequences of one to four bytes: ``grams[k]`` has those of k + 1 bytes as numbers, ``counts[k]`` a column
    for each language; ``contexts[k]`` the contexts of k bytes that are kept."""

    names: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes with three zeros before each, and where each text begins and ends."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes + ORDER)
    return np.frombuffer((b"\0" * ORDER).join([b"", *parts]), np.uint8), ends - sizes, ends


def _windows(data: np.ndarray) -> np.ndarray:
    """The four bytes that end at each place from the fourth on, as one number."""
    wide = data.astype(np.uint32)
    return wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): how often each sequence of four bytes ends in a text of a language; few rows for each slice."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in dict.fromkeys(langs):
            own, first = [t for t, x in zip(texts, langs) if x == lang and t], 0
            while first < len(own):
                last, size = first, 0
                while last < len(own) and (last == first or size < 16 * SLICE_BYTES):
                    size += len(own[last])
                    last += 1
                data, begin, end = _joined(own[first:last])
                inside = np.zeros(len(data), bool)
                for a, b in zip(begin.tolist(), end.tolist()):
                    inside[a:b] = True
                grams, n = np.unique(_windows(data)[inside[ORDER:]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                )
                first = last


def _sums(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal grams folded; ``counts`` has a column for each language."""
    found, at = np.unique(grams, return_inverse=True)
    out = np.zeros((len(found), counts.shape[1]), np.int64)
    np.add.at(out, at, counts)
    return found, out


def build(names: list[str], grams: np.ndarray, counts: np.ndarray) -> Model:
    """The trees from counts of four-byte sequences (``counts`` has a column for each language)."""
    order = [_sums(grams & ((1 << 8 * k) - 1), counts) for k in (1, 2, 3, 4)]
    contexts = [np.zeros(1, np.int64)]
    ranked = []
    for k in (1, 2, 3):
        found, n = _sums(order[k][0] >> 8, order[k][1].sum(axis=1, keepdims=True))
        ranked += [(-int(c), k, int(g)) for g, c in zip(found, n[:, 0]) if c >= LEAST]
    kept = sorted(ranked)[: max(0, CELLS // max(1, len(names)) - 1)]
    # a kept context's shorter ones are at least as frequent, so they are kept or tie with it
    for k in (1, 2, 3):
        contexts.append(np.array(sorted(g for _, kind, g in kept if kind == k), np.int64))
    return Model(names, [g for g, _ in order], [c for _, c in order], contexts)


def fit(labelled: DataFrame) -> Model:
    """A model of the rows of ``labelled`` (text, lang) with a lang."""
    rows = labelled.select("lang", "text").filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    langs = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # hashes are even, so a share of their range holds twice the rows asked for; only those are ranked
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE_ROWS) / F.col("texts"))
    low = hashed.join(F.broadcast(langs), "lang").filter(F.col("h") <= share * 2.0**64 - 2.0**63).select("lang", "h", "text")
    ranked = low.select("lang", "h").distinct().withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    cuts = ranked.filter(F.col("r") <= SAMPLE_ROWS).groupBy("lang").agg(F.max("h").alias("cut"))
    near = low.join(F.broadcast(cuts), "lang").filter(F.col("h") <= F.col("cut"))  # of each text all copies still
    sample = near.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    counted = materialise(sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    table = counted.toPandas()
    names = sorted(table["lang"].unique())
    counts = np.zeros((len(table), len(names)), np.int64)
    counts[np.arange(len(table)), np.searchsorted(np.array(names, object), table["lang"].to_numpy(object)) if names else []] = table["n"].to_numpy()
    return build(names, table["gram"].to_numpy(np.int64), counts)


class Scorer:
    """Code lengths of texts under a model."""

    def __init__(self, model: Model):
        self.names = model.names
        sizes = [len(c) for c in model.contexts]
        first = np.cumsum([0, *sizes])
        languages = len(self.names)
        self.costs = np.zeros((first[-1] * 256, languages), np.int32)
        for lang in range(languages):
            chances: list[np.ndarray] = []
            for k, contexts in enumerate(model.contexts):
                chances.append(self._level(model, k, contexts, lang, chances[-1] if k else None))
            bits = -np.log2(np.concatenate(chances))
            self.costs[:, lang] = np.rint(bits * UNIT).astype(np.int32).ravel()
        self.at = np.zeros(1 << 24, np.uint16 if first[-1] < 1 << 16 else np.int32)
        for k in range(1, ORDER + 1):  # longer contexts in place of shorter ones
            wide = 1 << 8 * (ORDER - k)
            view = self.at.reshape(wide, -1)  # rows by the bytes before the context
            view[:, model.contexts[k]] = np.arange(first[k], first[k] + sizes[k]).astype(self.at.dtype)[None, :]

    def _level(self, model: Model, k: int, contexts: np.ndarray, lang: int, shorter: np.ndarray | None) -> np.ndarray:
        """Probabilities of all bytes in each context of ``k`` bytes."""
        counts = np.zeros((len(contexts), 256))
        own = model.counts[k][:, lang] > 0
        grams, n = model.grams[k][own], model.counts[k][own, lang]
        row = np.searchsorted(contexts, grams >> 8)
        held = row < len(contexts)
        held[held] = contexts[row[held]] == grams[held] >> 8
        counts[row[held], grams[held] & 255] = n[held]
        if k == 0:
            below = np.full((len(contexts), 256), 1 / 256)
        else:
            tails = contexts & ((1 << 8 * (k - 1)) - 1)
            below = shorter[np.searchsorted(model.contexts[k - 1], tails)]
        seen = counts > 0
        kinds, total = seen.sum(axis=1, keepdims=True), counts.sum(axis=1, keepdims=True)
        free = np.where(seen, 0, below)
        rest = free.sum(axis=1, keepdims=True)
        whole = kinds + total
        escaped = np.divide(kinds, whole, out=np.ones_like(total), where=whole > 0) * np.divide(free, rest, out=np.zeros_like(free), where=rest > 0)
        return np.where(seen, np.divide(counts, whole, out=np.zeros_like(counts), where=whole > 0), escaped)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code lengths in 1/65536 bit: a row for each text, a column for each language."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not self.names:
            return out
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < SLICE_BYTES):
                size += len(texts[last])
                last += 1
            data, begin, end = _joined(texts[first:last])
            for a in range(0, len(data) - ORDER, SLICE_BYTES):  # a long text goes in parts
                windows = _windows(data[a : a + SLICE_BYTES + ORDER])
                cells = self.at[windows >> 8].astype(np.int64) << 8 | windows & 255
                low, high = a + ORDER, a + ORDER + len(windows)
                hit = np.flatnonzero((begin < high) & (end > low) & (end > begin))
                if not len(hit):
                    continue
                cuts = np.empty(2 * len(hit), np.int64)  # between the texts are places that count for none
                cuts[::2], cuts[1::2] = np.maximum(begin[hit], low) - low, np.minimum(end[hit], high) - low
                costs = np.concatenate([self.costs[cells], np.zeros((1, len(self.names)), np.int32)])
                out[first + hit] += np.add.reduceat(costs, cuts, axis=0, dtype=np.int64)[::2]
            first = last
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text; None is a text that has no letter."""
        if not self.names or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        lengths = self.lengths([t or "" for t in texts])
        best = lengths.argmin(axis=1)
        least = lengths[np.arange(len(texts)), best]
        shares = 1 / np.exp2((least[:, None] - lengths) / UNIT).sum(axis=1)
        named = [self.names[b] if t is not None else UNKNOWN for b, t in zip(best.tolist(), texts)]
        return named, [s if t is not None else 0.0 for s, t in zip(shares.tolist(), texts)]


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model, column: str = "text", to: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` plus the language of ``column`` and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in (to, score)]
    schema = T.StructType([*kept, T.StructField(to, T.StringType()), T.StructField(score, T.DoubleType())])
    # a letter is one in Java's sense, looked for in the engine
    letter = F.col(f"`{column}`").rlike(r"\p{L}")
    marked = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.when(letter, F.col(f"`{column}`")).alias("_judged"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        if tree.key not in _scorers:
            _scorers.clear()
            _scorers[tree.key] = Scorer(tree)
        scorer = _scorers[tree.key]
        for batch in batches:
            named, shares = scorer.judge(batch.column(len(kept)).to_pylist())
            columns = [*(batch.column(k) for k in range(len(kept))), pa.array(named, pa.string()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return marked.mapInArrow(run, schema)
