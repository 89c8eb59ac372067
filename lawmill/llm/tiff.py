"""TIFF media columns: 8-bit grey pages, read and written in batches.

Reading walks the image directories and decodes strips or tiles stored plain, with PackBits, LZW or deflate, and
undoes horizontal prediction; one row per page comes out. Writing lays bytes out as pages of 64 samples a row, in the
layout that a column names (``LAYOUTS``); by default the checksum of a text picks one, whatever the text's size, so
that equal texts give equal files and a corpus uses every codec.

Defined results: null bytes have no pages, null text is empty text (one page of 64 zeros); bytes that aren't a TIFF, that
break off, that ask on all pages together for more samples than their codec can hold or for 2 GB or more (which no Spark
value holds), or whose directories overlap give no pages and an error string; repeated rows are read each; very long texts give more pages; an empty table gives
no rows; further columns pass through, those named like a page field are replaced; nothing is shuffled.

Scale: rows are independent. A worker holds one Arrow batch's files and pages; what a file's pages may expand to in
sum, and how many there may be, is checked against its size first, and decoding stops at the size that the directory states.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946  # the format's compression codes
WIDTH = 64
PAGE_ROWS = 4096
TILE = 64
LIMIT = 1 << 31
#: No codec here makes more than this many samples of one stored byte (LZW: 4,096 of 12 bits; deflate: 1,032; PackBits: 64).
MOST_EXPANSION = 2_800
#: A directory takes as many bytes at least; a file's directories may state its bytes as values so many times in all.
LEAST_DIRECTORY, MOST_VALUES = 18, 16
PAGES = T.StructType(
    [
        T.StructField(
            "pages",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("page", T.IntegerType()),
                        T.StructField("width", T.IntegerType()),
                        T.StructField("height", T.IntegerType()),
                        T.StructField("samples_per_pixel", T.IntegerType()),
                        T.StructField("compression", T.IntegerType()),
                        T.StructField("predictor", T.IntegerType()),
                        T.StructField("tiled", T.BooleanType()),
                        T.StructField("sample_sum", T.LongType()),
                        T.StructField("sample_squares", T.LongType()),
                        T.StructField("pixels", T.BinaryType()),
                    ]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)
_FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}  # field type: struct code


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of 3 or more equal bytes, literals otherwise."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1], True]) if len(raw) else np.zeros(1, int)
    size = np.diff(edge)
    out, literal = bytearray(), 0

    def flush(stop: int) -> None:
        for at in range(literal, stop, 128):
            part = data[at : min(at + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, n in zip(edge[:-1][size >= 3].tolist(), size[size >= 3].tolist()):
        flush(start)
        for at in range(0, n, 128):
            run = min(128, n - at)
            out.extend((257 - run if run > 1 else 0, data[start]))
        literal = start + n
    flush(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    """At least ``size`` bytes, or all there are."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: high bit first, 9 to 12 bits, the width growing one code early."""
    value, filled, out, width = 256, 9, bytearray(), 9
    table: dict[int, int] = {}  # (code of a string << 8 | byte) to the code of the longer string
    following, code = 258, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        longer = code << 8 | byte
        known = table.get(longer)
        if known is not None:
            code = known
            continue
        value, filled = value << width | code, filled + width
        while filled >= 8:
            filled -= 8
            out.append(value >> filled & 255)
        value &= (1 << filled) - 1
        table[longer] = following
        following += 1
        code = byte
        if following >= 4094:
            value, filled = value << width | 256, filled + width
            table, following, width = {}, 258, 9
        elif following > (1 << width) - 1:
            width += 1
    if code >= 0:
        value, filled = value << width | code, filled + width
        if following + 1 > (1 << width) - 1 and width < 12:
            width += 1
    value, filled = value << width | 257, filled + width
    pad = -filled % 8
    return bytes(out) + (value << pad).to_bytes((filled + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    """At least ``size`` bytes, or all there are."""
    clear = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, value, filled, before, out, held = clear[:], 9, 0, 0, b"", [], 0
    for byte in data:
        value, filled = (value << 8 | byte) & 0xFFFFFF, filled + 8
        if filled < width:
            continue
        filled -= width
        code = value >> filled & ((1 << width) - 1)
        if code == 257 or held >= size:
            break
        if code == 256:
            table, width, before = clear[:], 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("LZW code out of range")
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
        before = entry
        out.append(entry)
        held += len(entry)
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def _compress(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return pack_bits(data)
    return zlib.compress(data, 1) if compression in (DEFLATE, OLD_DEFLATE) else data


def _expand(data: bytes, compression: int, size: int) -> bytes:
    """``size`` bytes of a strip or tile, or fewer if it breaks off."""
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == PLAIN:
        return data
    raise ValueError(f"compression {compression} is not supported")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int | None = None, strip_rows: int = 256) -> bytes:
    """Bytes of a little-endian TIFF with one directory per (height, width) page of 8-bit grey samples."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            full = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            full[:height, :width] = page
            parts = [full[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        places, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            data = _compress(part.tobytes(), compression)
            places.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        layout = [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [strip_rows]), (279, 4, sizes)]
        entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        directory = bytearray()
        for tag, kind, values in sorted(entries + layout):
            data = struct.pack(f"<{len(values)}{_FIELD[kind]}", *values)
            if len(data) > 4:
                place = struct.pack("<I", len(out))
                out += data
            else:
                place = data.ljust(4, b"\0")
            directory += struct.pack("<HHI", tag, kind, len(values)) + place
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(directory) // 12) + directory
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_tiff(data: bytes) -> list[dict]:
    """The pages of a TIFF, in directory order."""
    order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("not a TIFF")
    pages, walked = [], set()
    # what all pages and all values may come to is bounded by the file's size
    samples_left, values_left = min(LIMIT - 1, MOST_EXPANSION * len(data)), MOST_VALUES * len(data)
    while at and at not in walked:
        walked.add(at)
        if len(walked) * LEAST_DIRECTORY > len(data):
            raise ValueError("directories overlap")
        (count,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            code = _FIELD.get(kind)
            if code is None:
                continue
            place = at + 10 + 12 * k
            size = n * struct.calcsize(code)
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            if place + size > len(data):
                raise ValueError("a directory's values lie outside the file")
            values_left -= size
            if values_left < 0:
                raise ValueError("directories share their values too often")
            tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
        pages.append(_page(data, tags, len(pages), samples_left))
        samples_left -= len(pages[-1]["pixels"])
    return pages


def _page(data: bytes, tags: dict[int, tuple], number: int, bound: int) -> dict:
    one = lambda tag, usual: tags.get(tag, (usual,))[0]
    width, height, samples = one(256, 0), one(257, 0), one(277, 1)
    compression, predictor, tiled = one(259, PLAIN), one(317, 1), 324 in tags
    if any(bits != 8 for bits in tags.get(258, (8,))) or one(284, 1) != 1:
        raise ValueError("only 8-bit interleaved samples are supported")
    if tiled:
        across, down = one(322, width), one(323, height)
        places, sizes = tags[324], tags[325]
    else:
        across, down = width, min(one(278, height), height) or 1
        places, sizes = tags[273], tags[279]
    if min(width, height, samples, across, down) < 1 or max(width * height, across * down) * samples > bound:
        raise ValueError(f"{width} x {height} x {samples} samples in {len(data)} bytes")
    if tiled:
        spots = [(y, x) for y in range(0, height, down) for x in range(0, width, across)]
    else:
        spots = [(y, 0) for y in range(0, height, down)]
    page = np.zeros((height, width, samples), np.uint8)
    for (y, x), place, size in zip(spots, places, sizes, strict=True):
        rows = down if tiled else min(down, height - y)
        wanted = rows * across * samples
        part = np.frombuffer(_expand(data[place : place + size], compression, wanted), np.uint8, wanted)
        part = part.reshape(rows, across, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        page[y : y + down, x : x + across] = part[: height - y, : width - x]
    histogram = np.bincount(page.ravel(), minlength=256)
    return {
        "page": number, "width": width, "height": height, "samples_per_pixel": samples,
        "compression": compression, "predictor": predictor, "tiled": tiled,
        "sample_sum": int(histogram @ np.arange(256)), "sample_squares": int(histogram @ np.arange(256) ** 2), "pixels": page.tobytes(),
    }


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled with zeros to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\0" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


#: Layouts of stored texts by number: options of ``write_tiff``.
LAYOUTS = (
    {"compression": LZW},
    {"compression": PACKBITS},
    {"compression": DEFLATE, "predictor": 2},
    {"compression": DEFLATE, "predictor": 2, "tile": TILE},
)


def store_text(text: str | None, layout: int) -> bytes:
    """A text as a TIFF of the numbered layout."""
    rows = np.frombuffer(payload_of(text), np.uint8).reshape(-1, WIDTH)
    return write_tiff([rows[at : at + PAGE_ROWS] for at in range(0, len(rows), PAGE_ROWS)], **LAYOUTS[layout])


def layout_of(text: Column) -> Column:
    """The layout that a text's checksum picks."""
    return F.pmod(F.crc32(F.coalesce(text, F.lit(""))), F.lit(len(LAYOUTS))).cast("int")


@F.pandas_udf(T.BinaryType())
def _text_to_tiff(texts: pd.Series, layouts: pd.Series) -> pd.Series:
    return pd.Series([store_text(t, n) for t, n in zip(texts, layouts)], dtype=object)


# the same text always gives the same file; marked so that Spark writes a file once and hands that one on
_text_to_tiff = _text_to_tiff.asNondeterministic()


def text_to_tiff(text: Column, layout: Column | None = None) -> Column:
    """A TIFF per text; null text is empty text."""
    return _text_to_tiff(text, layout_of(text) if layout is None else layout)


@F.pandas_udf(PAGES)
def tiff_pages(files: pd.Series) -> pd.DataFrame:
    """Struct of the pages and an error string."""
    pages, errors = [], []
    for data in files:
        found, error = [], None
        if data is not None:
            try:
                found = read_tiff(data)
            except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as why:
                error = f"{type(why).__name__}: {why}"
        pages.append(found)
        errors.append(error)
    return pd.DataFrame({"pages": pd.Series(pages, dtype=object), "error": pd.Series(errors, dtype=object)})


def explode_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page: the columns of ``media`` without the bytes, then the page's fields and error.

    Files without a page keep one row with null page fields. Columns named like a page field are replaced."""
    fields = PAGES["pages"].dataType.elementType.fieldNames()
    kept = [c for c in media.columns if c != column and c not in fields and c != "error"]
    read = media.select(*(F.col(f"`{c}`") for c in kept), tiff_pages(F.col(column)).alias("#read"))
    out = read.select(*(F.col(f"`{c}`") for c in kept), F.col("`#read`.error").alias("error"), F.explode_outer("`#read`.pages").alias("#page"))
    return out.select(*(F.col(f"`{c}`") for c in kept), "error", *(F.col(f"`#page`.{f}").alias(f) for f in fields))


def joined_pixels(pages: Column) -> Column:
    """The pixels of all pages in a row. Latin-1 maps each byte to one character and back, so one join does it."""
    return F.encode(F.array_join(F.transform(pages, lambda p: F.decode(p["pixels"], "ISO-8859-1")), ""), "ISO-8859-1")
