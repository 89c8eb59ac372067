"""Alignment of two tokenizers' tokens, and corpus-wide counts of the aligned pairs by external spill counting.

A is a byte-level BPE over a blank and the text, B a SentencePiece model over the text (it adds the blank). Where a token
of A and one of B end at the same byte, a group of tokens ends. All occurrence pairs of a group are links; the count of
a pair of ids is the number of documents that hold it linked.

Texts are cut before single blanks between two other characters. No token of either kind reaches over such a blank, so
the parts are tokenised alone, and parts met before come from a memo of bounded size.

Counting, in four steps:

1 Each task gathers its documents into runs of bounded size. A run's pair-document records are partitioned by radix (of
  the id of A), sorted by A, B and document and compressed with zstd; equal records fold into one with a number. Runs go
  to the shared folder.
2 Of each run only the heads (pair and number of documents) are shuffled, by radix. So a pair that every document holds
  is one row of a run, not one of a document.
3 A task of some radices spills its heads as sorted zstd runs of bounded size and merges them by a heap, which counts each
  pair; as A comes first in the order, the most frequent count of each A is known when its pairs are through. The heads are
  then read again in the order they came, and the counts of their pairs stream back, run by run.
4 A run meets its counts, and each document sums them over its records.

What a task holds: one run (``RUN_CHARS`` characters of text, or one document), the memo of ``REMEMBERED`` parts and a run's, ``SPILL_ROWS`` heads, and the counts of
the distinct pairs of its radices, which the two vocabularies bound. Spilled runs live in the task's own temporary folder and
go with the task; a lost task is run again from the shared runs.

Defined results: null and empty texts, and texts whose tokens' bytes aren't the text's (B reads a blank mark as a blank),
have no tokens: zeros and an empty hash; null doc_ids are documents of their own; repeated rows count each as a document;
ties for the highest count are all best; very long texts are taken whole, as a run of their own; an empty table gives no
rows; only ``doc_id`` and ``text`` are read, other columns may have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import tempfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawmill.session import materialise

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
RADIXES = (64, 4096)  # least and most; between them one for each shuffle partition
RUN_CHARS = 4_000_000
RUN_DOCS = 20_000
REMEMBERED = 300_000
BLOCK_CHARS, LEARN_BLOCKS = 4_000, 64  # what is tokenised at a time
MANY = 1_000  # links of a group
BLANK = "▁"
SPILL_ROWS = 2_000_000
BLOCK_ROWS = 1 << 16
LEVEL = 3

RUNS = (
    "run string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, frames array<struct<radix: int, pairs: long, records: long, heads: binary, body: binary>>"
)
COUNTED = "run string, radix int, counts binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# --- tokens and their groups ------------------------------------------------------------------------------------------


def _byte_level() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        stands = _byte_level()
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = token.encode() if token in added else bytes(stands[c] for c in token)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(BLANK, " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in found], np.int64) for found in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a blank, which B adds itself."""
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)


PART = re.compile(r"(?<=\S)(?= \S)")


def parts_of(text: str) -> list[str]:
    """The text with a blank before it, cut before single blanks between two characters that are no white space."""
    return PART.split(" " + text)


class Aligner:
    """Aligns parts and remembers them. What is known of a part is kept in flat arrays."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.names = list(map(str, range(max(len(tokenizers.bytes_a), len(tokenizers.bytes_b)))))
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, whether the bytes are the part's
        self.written: list[str] = []
        self.starts = np.zeros(1, np.int64)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the numbers of its parts, new ones learned first. Before, if much is remembered, all is forgotten."""
        if len(self.index) > REMEMBERED or len(self.pairs) > 8 * REMEMBERED:
            self.forget()
        index, new, out = self.index, [], []
        for text in texts:
            own = parts_of(text) if text else []
            found = list(map(index.get, own))
            if None in found:
                for at, k in enumerate(found):
                    if k is None:
                        found[at] = k = index.setdefault(own[at], len(index))
                        if k == len(self.written) + len(new):
                            new.append(own[at])
            out.append(np.array(found, np.int64))
        if new:
            self._learn(new)
        return out

    def _learn(self, parts: list[str]) -> None:
        """Parts without white space at their ends stand side by side as in a text, so that many are tokenised at once."""
        numbers, written, found = np.zeros((len(parts), 5), np.int64), [""] * len(parts), [np.zeros((0, 3), np.int64)]
        blocks: list[list[int]] = [[]]
        size = 0
        odd = []
        for k, part in enumerate(parts):
            if len(part) < 2 or part[1].isspace() or part[-1].isspace() or BLANK in part:
                odd.append([k])
                continue
            if size > BLOCK_CHARS:
                blocks.append([])
                size = 0
            blocks[-1].append(k)
            size += len(part)
        blocks = [x for x in blocks if x] + odd
        while blocks:
            some, blocks = blocks[-LEARN_BLOCKS:], blocks[:-LEARN_BLOCKS]
            texts = ["".join([parts[k] for k in own]) for own in some]
            for own, text, a, b in zip(some, texts, *self.t.encode(texts)):
                ends = np.cumsum([len(parts[k].encode("utf-8", "surrogatepass")) for k in own])
                done = self._block(np.array(own), text, ends, a, b, numbers, written)
                if done is not None:
                    found.append(done)
                elif len(own) > 1:
                    blocks += [[k] for k in own]  # one of them doesn't read back
        rows = np.concatenate(found)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        self.numbers = np.concatenate([self.numbers, numbers])
        self.written += written
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum(np.bincount(rows[:, 0], minlength=len(parts)))]
        self.pairs, self.times = np.r_[self.pairs, rows[:, 1]], np.r_[self.times, rows[:, 2]]

    def _block(self, own: np.ndarray, text: str, ends: np.ndarray, a: list[int], b: list[int], numbers: np.ndarray, written: list[str]):
        """Rows (part, pair, links) of parts that stand side by side; their numbers and groups are put in place. None if tokens
        don't give the text back or reach over two parts."""
        plain = text.encode("utf-8", "surrogatepass")
        if b"".join([self.t.bytes_a[i] for i in a]) != plain or b"".join([self.t.bytes_b[i] for i in b]) != plain:
            return None
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.t.size_a[ids_a]), np.cumsum(self.t.size_b[ids_b])
        to_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True)) + 1  # where groups end
        to_b = np.searchsorted(ends_b, ends_a[to_a - 1]) + 1
        if not np.isin(ends, ends_a[to_a - 1], assume_unique=True).all():
            return None
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        part = np.searchsorted(ends, ends_a[to_a - 1])
        for k, values in enumerate((n_a, n_b, np.ones(len(part)), n_a * n_b)):
            numbers[own, k] = np.bincount(part, values, len(own))
        numbers[own, 4] = 1
        names, lines, x, y = self.names, [], 0, 0
        names_a, names_b = [names[i] for i in a], [names[i] for i in b]
        for i, j in zip(to_a.tolist(), to_b.tolist()):
            lines.append(names_a[x] + "|" + names_b[y] if i - x == 1 == j - y else ",".join(names_a[x:i]) + "|" + ",".join(names_b[y:j]))
            x, y = i, j
        stops = np.cumsum(numbers[own, 2]).tolist()
        for k, start, stop in zip(own.tolist(), [0, *stops], stops):
            written[k] = lines[start] if stop - start == 1 else ";".join(lines[start:stop])
        links = np.where(n_a * n_b > MANY, 0, n_a * n_b)
        group = np.repeat(np.arange(len(part)), links)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        at_a, at_b = (to_a - n_a)[group] + inside // n_b[group], (to_b - n_b)[group] + inside % n_b[group]
        keys, times = np.unique(part[group] << 40 | ids_a[at_a] << 20 | ids_b[at_b], return_counts=True)
        rows = [np.stack([keys >> 40, keys & (1 << 40) - 1, times], axis=1)]
        for g in np.flatnonzero(n_a * n_b > MANY).tolist():  # by distinct ids
            (some_a, times_a), (some_b, times_b) = (
                np.unique(ids[to[g] - n[g] : to[g]], return_counts=True) for ids, to, n in ((ids_a, to_a, n_a), (ids_b, to_b, n_b))
            )
            pairs, times = (some_a[:, None] << 20 | some_b).ravel(), (times_a[:, None] * times_b).ravel()
            rows.append(np.stack([np.full(len(pairs), part[g]), pairs, times], axis=1))
        out = np.concatenate(rows)
        out[:, 0] = own[out[:, 0]]
        return out


# --- runs -------------------------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as the narrowest kind that holds them, compressed."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or int(values.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=LEVEL).compress(values.astype(kind).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob[1:])
    return np.frombuffer(raw, f"u{blob[0]}").astype(np.int64)


def _framed(*columns: np.ndarray) -> bytes:
    blobs = [pack(c) for c in columns]
    return np.array([len(b) for b in blobs], np.uint32).tobytes() + b"".join(blobs)


def _unframed(blob: bytes, n: int) -> list[np.ndarray]:
    ends = np.cumsum(np.frombuffer(blob[: 4 * n], np.uint32)) + 4 * n
    return [unpack(blob[a:b]) for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def _gaps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=0)


def radix_of(pairs: np.ndarray, radixes: int) -> np.ndarray:
    """By the id of A, mixed, so that the low ids of frequent tokens are spread."""
    return ((pairs >> 20).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % radixes


def make_run(name: str, ids: list[int | None], texts: list[str | None], aligner: Aligner, radixes: int) -> tuple:
    """A row of RUNS."""
    each = aligner.places(texts)
    written, n_docs = aligner.written, len(texts)
    counts = np.array([len(p) for p in each], np.int64)
    parts = np.concatenate([*each, np.empty(0, np.int64)])
    doc = np.repeat(np.arange(n_docs), counts)
    good = np.bincount(doc, 1 - aligner.numbers[parts, 4], n_docs) == 0
    numbers = [(np.bincount(doc, aligner.numbers[parts, k], n_docs) * good).astype(np.int64) for k in range(4)]
    hashes = [
        hashlib.sha256(";".join([written[k] for k in own.tolist()]).encode()).hexdigest() if ok and len(own) else ""
        for ok, own in zip(good.tolist(), each)
    ]
    live = good[doc]
    key, n = np.unique(doc[live] << 32 | parts[live], return_counts=True)  # parts of a document, with their number
    part, doc = key & 0xFFFFFFFF, key >> 32
    sizes = aligner.starts[part + 1] - aligner.starts[part]
    ends = np.cumsum(sizes)
    place = np.repeat(aligner.starts[part] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
    pairs, times, doc = aligner.pairs[place], aligner.times[place] * np.repeat(n, sizes), np.repeat(doc, sizes)
    by = np.argsort(pairs * n_docs + doc)
    pairs, times, doc = pairs[by], times[by], doc[by]
    first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (doc[1:] != doc[:-1])][: len(pairs)])
    times = np.add.reduceat(times, first) if len(first) else times
    pairs, doc = pairs[first], doc[first]
    frames, radix = [], radix_of(pairs, radixes)
    for r in np.unique(radix).tolist():
        own = radix == r
        p, d, t = pairs[own], doc[own], times[own]
        heads, at, holders = np.unique(p, return_index=True, return_counts=True)
        step = _gaps(d)
        step[at] = d[at]  # documents rise within a pair
        frames.append((r, len(heads), len(p), _framed(_gaps(heads), holders), _framed(step, t - 1)))
    return (name, list(ids), *(n.tolist() for n in numbers), hashes, frames)


def _run_schema() -> pa.Schema:
    long, text = pa.list_(pa.int64()), pa.list_(pa.string())
    frame = pa.list_(pa.struct([("radix", pa.int32()), ("pairs", pa.int64()), ("records", pa.int64()), ("heads", pa.binary()), ("body", pa.binary())]))
    return pa.schema([("run", pa.string()), ("doc_ids", long), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("groups_sha256", text), ("frames", frame)])


def _runs(path_a: str, path_b: str, radixes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema, task, made = _run_schema(), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[str | None] = []
        chars = 0

        def close() -> pa.RecordBatch:
            nonlocal made, chars
            row = make_run(f"{task}-{made}", ids, texts, _aligner(path_a, path_b), radixes)
            ids.clear()
            texts.clear()
            made, chars = made + 1, 0
            frames = [dict(zip(("radix", "pairs", "records", "heads", "body"), f)) for f in row[-1]]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*row[:-1], frames), schema)], schema=schema)

        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    size = len(text or "")
                    if ids and (chars + size > RUN_CHARS or len(ids) >= RUN_DOCS):
                        yield close()
                    ids.append(doc_id)
                    texts.append(text)
                    chars += size
        if ids:
            yield close()

    return run


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker, as loading takes a second and the memo is worth keeping."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(Tokenizers(path_a, path_b))
    return _aligners[path_a, path_b]


# --- counting ---------------------------------------------------------------------------------------------------------


class SpillCounter:
    """Numbers of documents by pair, over any number of heads: sorted zstd runs in a file, merged by a heap."""

    def __init__(self):
        self.file: BinaryIO = tempfile.TemporaryFile()
        self.runs: list[list[tuple[int, int]]] = []  # of each run its blocks' places in the file
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, pairs: np.ndarray, n: np.ndarray) -> None:
        self.held.append((pairs, n))
        self.rows += len(pairs)
        if self.rows >= SPILL_ROWS:
            self._spill()

    def _spill(self) -> None:
        if not self.rows:
            return
        pairs, at = np.unique(np.concatenate([p for p, _ in self.held]), return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, at, np.concatenate([x for _, x in self.held]))
        blocks = []
        for k in range(0, len(pairs), BLOCK_ROWS):
            blob = _framed(_gaps(pairs[k : k + BLOCK_ROWS]), n[k : k + BLOCK_ROWS])
            blocks.append((self.file.seek(0, 2), len(blob)))
            self.file.write(blob)
        self.runs.append(blocks)
        self.held, self.rows = [], 0

    def _read(self, blocks: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        for place, size in blocks:
            self.file.seek(place)
            gaps, n = _unframed(self.file.read(size), 2)
            yield from zip(np.cumsum(gaps).tolist(), n.tolist())

    def counts(self) -> Iterator[tuple[int, int]]:
        """(pair, documents) in the order of A, then B."""
        self._spill()
        last, total = -1, 0
        for pair, n in heapq.merge(*(self._read(blocks) for blocks in self.runs)):
            if pair != last:
                if last >= 0:
                    yield last, total
                last, total = pair, 0
            total += n
        if last >= 0:
            yield last, total


def with_best(counts: Iterator[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, and twice their count plus whether it is the highest of their A, from counts in side-major order."""
    pairs: list[int] = []
    coded: list[int] = []
    begin, most = 0, 0
    for pair, n in counts:
        if pairs and pairs[-1] >> 20 != pair >> 20:
            coded[begin:] = [2 * x + (x == most) for x in coded[begin:]]
            begin, most = len(pairs), 0
        pairs.append(pair)
        coded.append(n)
        most = max(most, n)
    coded[begin:] = [2 * x + (x == most) for x in coded[begin:]]
    return np.array(pairs, np.int64), np.array(coded, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTED from (run, radix, heads): the heads are kept as they came in a file of the task until all are counted."""
    counter, places = SpillCounter(), []
    with counter.file, tempfile.TemporaryFile() as spool:
        for batch in batches:
            for run, radix, heads in zip(batch.column("run"), batch.column("radix"), batch.column("heads")):
                blob = heads.as_py()
                gaps, n = _unframed(blob, 2)
                counter.add(np.cumsum(gaps), n)
                places.append((run.as_py(), radix.as_py(), spool.tell(), len(blob)))
                spool.write(blob)
        pairs, coded = with_best(counter.counts())
        for run, radix, place, size in places:
            spool.seek(place)
            own = np.cumsum(_unframed(spool.read(size), 2)[0])
            blob = pack(coded[np.searchsorted(pairs, own)])
            yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([radix], pa.int32()), pa.array([blob], pa.binary())], ["run", "radix", "counts"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ALIGNED from runs and their counts."""
    names = [x.split()[0] for x in ALIGNED.split(", ")]
    for batch in batches:
        for at in range(len(batch)):
            part = batch.slice(at, 1)
            columns = {n: part.column(n)[0].values for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            n_docs = len(columns["doc_ids"])
            best, total = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
            counted = {c["radix"]: c["counts"] for c in part.column("counted")[0].as_py() or []}
            for frame in part.column("frames")[0]:
                coded = unpack(counted[frame["radix"].as_py()])
                holders = _unframed(frame["heads"].as_py(), 2)[1]
                step, times = _unframed(frame["body"].as_py(), 2)
                ends = np.cumsum(holders)
                run_of = np.cumsum(step)  # documents rise within a pair and begin anew with the next
                base = np.repeat(run_of[ends - holders] - step[ends - holders], holders)
                doc, times, coded = run_of - base, times + 1, np.repeat(coded, holders)
                np.add.at(best, doc, times * (coded & 1))
                np.add.at(total, doc, times * (coded >> 1))
            arrays = [columns["doc_ids"], *(columns[n] for n in ("n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(total), columns["groups_sha256"]]
            yield pa.RecordBatch.from_arrays(arrays, names)


def align(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """One row of ALIGNED for each row of ``docs`` (doc_id, text)."""
    low, high = RADIXES
    radixes = min(high, max(low, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs = materialise(rows.mapInArrow(_runs(path_a, path_b, radixes), RUNS))
    heads = runs.select("run", F.explode("frames").alias("f")).select("run", "f.radix", "f.heads")
    counted = heads.repartition("radix").mapInArrow(_count, COUNTED)
    by_run = counted.groupBy("run").agg(F.collect_list(F.struct("radix", "counts")).alias("counted"))  # one for each radix at most
    return runs.join(by_run, "run", "left").mapInArrow(_settle, ALIGNED)
