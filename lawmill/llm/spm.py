"""SentencePiece encoding and decoding of BPE models by suffix-array matching.

A batch's texts are normalised and cut into chunks that no piece can span (a run of blank marks and what follows
it; long chunks also between two characters that stand side by side in no piece). The chunks not seen before are concatenated and indexed by a suffix array, deep enough for the longest
piece; every piece is looked up by binary search, which gives its range of occurrences; the resulting edges are
sorted by position and relaxed from left to right.

Relaxing follows the merge order instead of adding scores: a prefix's encoding ends in exactly one piece, and a
piece that starts where the prefix ends continues it if the two stay apart under the merges, i.e. if at no time
a merge across their border is due before the merges that build the two. That gives the pieces which BPE
merging gives, in one pass over the edges.

Characters without a piece become byte pieces. Decoding joins pieces and bytes and drops the first blank.

Defined results: null text gives null, empty text no ids; null ids, and ids of which one is
outside the vocabulary, decode to null. A text that holds the blank mark itself reads back with a blank there. Repeated rows are encoded each;
very long texts are encoded whole, and what is indexed at a time is bounded by ``LEARN_CHARS`` and the longest chunk,
whose places take one small step each; an empty table gives no rows; the result columns are replaced where they
exist, others may have any names.

The model file is read on the driver only; its tables (a few MB, bounded by the vocabulary) are broadcast.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lawmill.llm.memory import give_back

BLANK = "▁"
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 1_200_000
REMEMBERED = 150_000
LEARN_CHARS = 150_000
LONG = 64
VERY_LONG = 2_000
FEW = 12
NEVER = np.int64(1) << 60


@dataclass
class Vocabulary:
    """Tables of one model. ``rank`` is a piece's place in the merge order, -1 for single characters."""

    pieces: list[str]
    normal: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    bytes_at: np.ndarray
    unknown: int


def _merge(symbols: list[str], order: dict[str, int]) -> list[str]:
    """BPE: join the pair of the lowest place in the order, the leftmost of equals, until none is left."""
    while len(symbols) > 1:
        best = min((order.get(a + b, NEVER), at) for at, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if best[0] == NEVER:
            break
        symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
    return symbols


def load_vocabulary(path: str = TOKENIZER) -> Vocabulary:
    """Tables from a BPE model with identity normalisation, a dummy blank in front and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    bytes_at = np.full(256, model.unk_id(), np.int32)
    normal = np.ones(n, bool)
    for i in range(n):
        if model.is_byte(i):
            bytes_at[int(pieces[i][3:5], 16)] = i
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or not pieces[i]:
            normal[i] = False
    if any(BLANK in p.lstrip(BLANK) for p, ok in zip(pieces, normal) if ok):
        raise ValueError("pieces that reach over a blank are not supported")
    ids = {p: i for i, p in enumerate(pieces) if normal[i]}
    merged = sorted((i for i in ids.values() if len(pieces[i]) > 1), key=lambda i: (-model.get_score(i), i))
    rank, left, right = (np.full(n + 1, -1, np.int64) for _ in range(3))
    order = {pieces[i]: at for at, i in enumerate(merged)}
    for at, i in enumerate(merged):
        rank[i] = at
    for i in merged:
        parts = _merge(list(pieces[i]), {k: v for k, v in ((s, order[s]) for s in _inside(pieces[i], order)) if v < rank[i]})
        if len(parts) == 2 and all(p in ids for p in parts):
            left[i], right[i] = ids[parts[0]], ids[parts[1]]
        else:  # no merges lead to it, so it never comes out
            normal[i] = False
    keys, ranks = [], []
    for i in merged:
        piece = pieces[i]
        for cut in range(1, len(piece)):
            a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
            if a is not None and b is not None:
                keys.append(a * (n + 1) + b)
                ranks.append(rank[i])
    by = np.argsort(np.array(keys, np.int64))
    return Vocabulary(
        pieces, normal, rank, left, right, np.array(keys, np.int64)[by], np.array(ranks, np.int64)[by], bytes_at, model.unk_id()
    )


def _inside(piece: str, order: dict[str, int]) -> set[str]:
    return {piece[a:b] for a in range(len(piece)) for b in range(a + 2, len(piece) + 1)} & order.keys()


class Encoder:
    """Encodes slices of texts; remembers the chunks it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.none = len(v.pieces)  # stands for a character without a piece
        chosen = [i for i, ok in enumerate(v.normal) if ok]
        self.depth = max(len(v.pieces[i]) for i in chosen)
        # characters by the order of their code points: 0 between chunks, 1 for those in no piece
        chars = sorted({c for i in chosen for c in v.pieces[i]})
        self.dense = np.ones(0x110000, np.uint16)
        self.dense[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
        windows = np.zeros((len(chosen), self.depth), ">u2")
        for row, i in enumerate(chosen):
            windows[row, : len(v.pieces[i])] = self.dense[_codes(v.pieces[i])]
        tails = windows.copy()
        for row, i in enumerate(chosen):
            tails[row, len(v.pieces[i]) :] = 0xFFFF
        kind = f"S{2 * self.depth}"
        low, high = (np.ascontiguousarray(x).view(kind).ravel() for x in (windows, tails))
        by = np.argsort(low)
        self.low, self.high, self.found = low[by], high[by], np.array(chosen, np.int64)[by]
        self.length = np.array([len(v.pieces[i]) if v.normal[i] else 0 for i in range(self.none)] + [1], np.int64)
        bits = 1
        while 1 << bits < 16 * len(v.pair_keys):
            bits += 1
        self.filter, self.shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        self.filter[self._slot(v.pair_keys)] = True
        # a control character in no piece stands alone, as no merge reaches over it
        alone = "".join(f"\\x{c:02x}" for c in range(32) if chr(c) not in chars)
        self.cut = re.compile(f"{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        side = {(a, b) for i in chosen for a, b in zip(v.pieces[i], v.pieces[i][1:])}
        self.side = np.sort(np.array([int(self.dense[ord(a)]) << 16 | int(self.dense[ord(b)]) for a, b in side], np.int64))
        self.forget()

    def _parts(self, chunk: str) -> list[str]:
        """A long chunk, cut between characters that are side by side in no piece, so that no merge reaches over."""
        codes = self.dense[_codes(chunk)].astype(np.int64)
        both = codes[:-1] << 16 | codes[1:]
        at = np.minimum(np.searchsorted(self.side, both), len(self.side) - 1)
        cuts = [0, *(np.flatnonzero(self.side[at] != both) + 1).tolist(), len(chunk)]
        return [chunk[a:b] for a, b in zip(cuts, cuts[1:])]

    def _apart_few(self, a: list[int], b: list[int]) -> list[bool]:
        """``apart`` for a few pairs."""
        rank, left, right, pairs = self.lists
        out = []
        for x, y in zip(a, b):
            limit, ok = 2 * int(NEVER), True
            while True:
                if 2 * pairs.get(x * (self.none + 1) + y, int(NEVER)) < limit:
                    ok = False
                    break
                rx, ry = rank[x], rank[y]
                if rx < 0 and ry < 0:
                    break
                if ry >= rx:
                    limit, y = 2 * ry + 1, left[y]
                else:
                    limit, x = 2 * rx, right[x]
            out.append(ok)
        return out

    @cached_property
    def lists(self):
        """The tables of ``_apart_few``."""
        v = self.v
        return v.rank.tolist(), v.left.tolist(), v.right.tolist(), dict(zip(v.pair_keys.tolist(), v.pair_ranks.tolist()))

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.seen = np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * (self.none + 1) + b
        out = np.full(len(keys), NEVER)
        maybe = np.flatnonzero(self.filter[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.v.pair_keys, keys[maybe]), len(self.v.pair_keys) - 1)
        hit = self.v.pair_keys[at] == keys[maybe]
        out[maybe[hit]] = self.v.pair_ranks[at[hit]]
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece ``a`` followed by piece ``b`` stays so.

        Both are undone, the later merge first; a merge across the border is due if it comes before the merge
        undone last. Of two equal pieces the left one merges first.
        """
        rank = self.v.rank
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        x, y, limit = a.copy(), b.copy(), np.full(len(a), 2 * NEVER)
        while len(live):
            due = 2 * self._pair_rank(x, y) < limit
            ok[live[due]] = False
            go = ~due & ((rank[x] >= 0) | (rank[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            rx, ry = rank[x], rank[y]
            second = ry >= rx
            limit = np.where(second, 2 * ry + 1, 2 * rx)
            x, y = np.where(second, x, self.v.right[x]), np.where(second, self.v.left[y], y)
        return ok

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks and remember their ids."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        begin = np.cumsum(sizes + 1) - sizes  # a zero stands before each chunk
        raw = _codes("\0" + "\0".join(chunks))
        n = len(raw)
        codes = np.zeros(n + self.depth, np.uint16)
        codes[:n] = self.dense[raw]
        codes[begin - 1] = 0
        chunk_of = np.repeat(np.arange(len(chunks)), sizes + 1)
        offset = np.arange(n) - begin[chunk_of]
        suffixes = _suffix_array(codes, n, self.depth)
        windows = np.lib.stride_tricks.sliding_window_view(codes, self.depth)[suffixes].astype(">u2")
        # what follows a chunk's end is not part of it
        over = np.arange(self.depth)[None, :] >= (sizes[chunk_of[suffixes]] - offset[suffixes])[:, None]
        windows[over] = 0
        texts = np.ascontiguousarray(windows).view(self.low.dtype).ravel()
        low, high = np.searchsorted(texts, self.low, "left"), np.searchsorted(texts, self.high, "right")
        counts = high - low
        piece = np.repeat(self.found, counts)
        place = suffixes[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        inside = offset[place] >= 0
        piece, place = piece[inside], place[inside]
        alone = offset >= 0
        alone[place[self.length[piece] == 1]] = False
        lone = np.flatnonzero(alone)
        piece, place = np.r_[piece, np.full(len(lone), self.none)], np.r_[place, lone]
        last = np.full(n + 1, -1, np.int64)  # the piece that ends just before a place
        long = sizes[chunk_of[place]] > VERY_LONG
        if long.any():
            self._relax_in_turn(place[long], piece[long], begin, last)
            place, piece = place[~long], piece[~long]
        key = offset[place]
        by = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")
        piece, place = piece[by], place[by]
        steps = np.searchsorted(offset[place], np.arange(int(offset[place].max(initial=-1)) + 2))
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            p, t = place[a:b], piece[a:b]
            if a != 0:
                good = np.array(self._apart_few(last[p].tolist(), t.tolist())) if b - a <= FEW else self.apart(last[p], t)
                p, t = p[good], t[good]
            last[p + self.length[t]] = t
        at, rows = begin + sizes, np.arange(len(chunks))
        found, owners = [], []
        while len(rows):
            t = last[at]
            found.append(t)
            owners.append(rows)
            at = at - self.length[t]
            more = at > begin[rows]
            at, rows = at[more], rows[more]
        tokens, owners = np.concatenate(found[::-1]), np.concatenate(owners[::-1])
        by = np.argsort(owners, kind="stable")
        tokens, owners = tokens[by], owners[by]
        odd = tokens == self.none
        if odd.any():
            tokens, owners = self._with_bytes(tokens, owners, chunks, begin, raw)
        ends = np.cumsum(np.bincount(owners, minlength=len(chunks)))
        self.starts = np.r_[self.starts, len(self.flat) + ends]
        self.flat = np.r_[self.flat, tokens.astype(np.int32)]
        self.seen = np.r_[self.seen, np.zeros(len(chunks), np.int64)]
        first = len(self.index)
        self.index.update((c, first + k) for k, c in enumerate(chunks))

    def _relax_in_turn(self, place: np.ndarray, piece: np.ndarray, begin: np.ndarray, last: np.ndarray) -> None:
        """The same for very long chunks, edge by edge: few of their places are at the same distance from a chunk's start, and few
        pairs of pieces meet, so what is known of a pair is looked up."""
        by = np.argsort(place, kind="stable")
        starts, length, known = set(begin.tolist()), self.length.tolist(), {}
        ends: dict[int, int] = {}
        for p, t in zip(place[by].tolist(), piece[by].tolist()):
            if p not in starts:
                before = (ends[p], t)
                ok = known.get(before)
                if ok is None:
                    ok = known[before] = self._apart_few([ends[p]], [t])[0]
                if not ok:
                    continue
            ends[p + length[t]] = t
        last[np.fromiter(ends.keys(), np.int64, len(ends))] = np.fromiter(ends.values(), np.int64, len(ends))

    def _with_bytes(self, tokens, owners, chunks, begin, codes):
        """Byte pieces in place of characters without a piece."""
        ends = np.cumsum(self.length[tokens])
        ahead = ends - self.length[tokens]
        starts = np.zeros(len(chunks), np.int64)
        counted = np.bincount(owners, minlength=len(chunks))
        firsts = np.cumsum(counted) - counted
        starts[counted > 0] = ahead[firsts[counted > 0]]
        place = begin[owners] + ahead - starts[owners]
        out, who = [], []
        before = 0
        for at in np.flatnonzero(tokens == self.none):
            out.append(tokens[before:at])
            who.append(owners[before:at])
            ids = self.v.bytes_at[list(chr(codes[place[at]]).encode("utf-8"))]
            out.append(ids.astype(np.int64))
            who.append(np.full(len(ids), owners[at]))
            before = at + 1
        return np.concatenate([*out, tokens[before:]]), np.concatenate([*who, owners[before:]])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end, from a leading 0 on."""
        cut, index = self.cut.findall, self.index
        chunks = [cut((BLANK + t.replace(" ", BLANK)) if t else "") for t in texts]
        met = set(chain.from_iterable(chunks))
        if max(map(len, met), default=0) > LONG:
            chunks = [[p for c in row for p in (self._parts(c) if len(c) > LONG else (c,))] for row in chunks]
            met = set(chain.from_iterable(chunks))
        new = list(met - index.keys())
        sizes = np.cumsum([len(c) for c in new])
        first = 0
        while first < len(new):
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + LEARN_CHARS, "right")))
            self._learn(new[first:last])
            first = last
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        k = np.fromiter(map(index.__getitem__, chain.from_iterable(chunks)), np.int64, int(counts.sum()))
        sizes = self.starts[k + 1] - self.starts[k]
        ends = np.r_[0, np.cumsum(sizes)]
        flat = self.flat[np.repeat(self.starts[k] - ends[:-1], sizes) + np.arange(ends[-1])]
        self.seen += np.bincount(k, minlength=len(self.seen))
        self._keep()
        return flat, ends[np.r_[0, np.cumsum(counts)]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        flat, ends = self.encode_flat(texts)
        return np.split(flat, ends[1:-1]) if texts else []

    def _keep(self) -> None:
        """Keep the more frequent half of the chunks once there are too many."""
        if len(self.index) <= REMEMBERED:
            return
        chosen = self.seen > np.median(self.seen)
        kept, sizes = np.flatnonzero(chosen), np.diff(self.starts)
        self.flat = self.flat[np.repeat(chosen, sizes)]
        self.starts = np.r_[0, np.cumsum(sizes[kept])]
        self.seen = self.seen[kept]
        names = list(self.index)
        self.index = {names[k]: at for at, k in enumerate(kept.tolist())}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _suffix_array(codes: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Places 0..n-1 in the order of the ``depth`` codes from each on: by four codes at once, then prefix doubling."""
    wide = np.concatenate([codes, np.zeros(3, codes.dtype)]).astype(np.uint64)
    key = wide[:-3] << np.uint64(48) | wide[1:-2] << np.uint64(32) | wide[2:-1] << np.uint64(16) | wide[3:]
    span = 4
    while True:
        order = np.argsort(key)
        if span >= depth:
            return order[order < n]
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        key = rank * (int(rank.max()) + 1)
        key[: len(rank) - span] += rank[span:]
        span *= 2


class Decoder:
    """Texts of ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = [p.replace(BLANK, " ").encode() if ok else b"" for p, ok in zip(vocabulary.pieces, vocabulary.normal)]
        for byte, i in enumerate(vocabulary.bytes_at):
            if i != vocabulary.unknown:
                self.table[i] = bytes([byte])

    def decode(self, ids: np.ndarray) -> str | None:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.table):
            return None
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch whose texts have a bounded size together (or one text), with these texts."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    first = 0
    while first < len(sizes):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), SLICE_BYTES, "right")))
        part = batch.slice(first, last - first)
        yield part, part.column(column).to_pylist()
        first = last


def _with(df: DataFrame, columns: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with columns that ``make(slice, texts)`` gives as Arrow arrays; columns of these names are replaced.

    Rows go through Arrow in slices, so that a worker holds one slice's objects at a time."""
    kept = [f for f in df.schema.fields if f.name not in columns]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in columns.items()])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slicer = make()
        for batch in batches:
            for part, arrays in slicer(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *arrays], [*names, *columns])
        del slicer
        give_back()

    return df.mapInArrow(run, schema)


def _id_lists(flat: np.ndarray, ends: np.ndarray, texts: list[str | None]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([t is None for t in texts]))


def encode(docs: DataFrame, vocabulary: Vocabulary, column: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` plus the ids of ``column``."""
    return _encode(docs, vocabulary, column, to, None)


def encode_checked(docs: DataFrame, vocabulary: Vocabulary, column: str = "text", to: str = "ids", check: str = "lossless") -> DataFrame:
    """``docs`` plus the ids and whether they decode to the text; null text is lossless.

    Encoding and decoding share one Python worker, so the ids cross to Spark once."""
    return _encode(docs, vocabulary, column, to, check)


def _encode(docs: DataFrame, vocabulary: Vocabulary, column: str, to: str, check: str | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)

        def slicer(batch):
            for part, texts in _slices(batch, column):
                flat, ends = encoder.encode_flat([t or "" for t in texts])
                arrays = [_id_lists(flat, ends, texts)]
                if check:
                    arrays.append(pa.array([decoder.decode(flat[a:b]) == (t or "") for a, b, t in zip(ends[:-1], ends[1:], texts)]))
                yield part, arrays

        return slicer

    kinds = {to: T.ArrayType(T.IntegerType())} | ({check: T.BooleanType()} if check else {})
    return _with(docs, kinds, make)


def decode(docs: DataFrame, vocabulary: Vocabulary, column: str = "ids", to: str = "decoded") -> DataFrame:
    """``docs`` plus the text of the ids in ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        decoder = Decoder(shared.value)

        def slicer(batch):
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                lists = part.column(column)
                yield part, [pa.array([None if not x.is_valid else decoder.decode(np.asarray(x.values)) for x in lists], pa.string())]

        return slicer

    return _with(docs, {to: T.StringType()}, make)
