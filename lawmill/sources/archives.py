"""Zipped run logs read by member.

Archives are listed by Spark; tasks read each one's central directory only, and its members become rows that are dealt out
again, so that the members of one archive are read by many tasks, each by the range of bytes it takes. A member is read
piece by piece: once to see that it is whole, once for its lines; neither it nor its archive is ever held whole.

Small archives, and all archives in a store that only Spark's readers can open, come as values instead.
"""

from __future__ import annotations

import codecs
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a broken, cut off, encrypted or oddly packed archive raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError, ValueError, KeyError, struct.error)
PIECE = 1 << 20
ROWS = 20_000
LINES = "run string, file string, line_no long, line string"
MEMBERS = "run string, path string, file string, at long, packed long, size long, crc long, method int, locked boolean"


def open_range(path: str) -> BinaryIO:
    """A file of any file system that Arrow opens, with seek and read."""
    store, inner = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path))
    return store.open_input_file(inner)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """MEMBERS of archives (path): the top-level text files; one row without a file for an archive that can't be read."""
    for batch in batches:
        for path in batch["path"]:
            run, rows = path.rsplit("/", 1)[-1].removesuffix(".zip"), []
            try:
                with open_range(path) as source, zipfile.ZipFile(source) as archive:
                    for m in archive.infolist():
                        if m.filename.endswith(".txt") and "/" not in m.filename:
                            rows.append((run, path, m.filename, m.header_offset, m.compress_size, m.file_size, m.CRC, m.compress_type, bool(m.flag_bits & 1)))
            except UNREADABLE:
                rows = [(run, path, None, 0, 0, 0, 0, 0, False)]
            for at in range(0, len(rows), ROWS):
                yield pd.DataFrame(rows[at : at + ROWS], columns=[c.split()[0] for c in MEMBERS.split(", ")])


def pieces(source: BinaryIO, at: int, packed: int, method: int) -> Iterator[bytes]:
    """The plain bytes of a member that begins at a place, piece by piece."""
    source.seek(at)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member begins there")
    source.seek(at + 30 + sum(struct.unpack("<HH", head[26:30])))
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"method {method}")
    plain = zlib.decompressobj(-15) if method == zipfile.ZIP_DEFLATED else None
    while packed > 0:
        data = source.read(min(PIECE, packed))
        if not data:
            raise EOFError("the archive is cut off")
        packed -= len(data)
        if plain is None:
            yield data
            continue
        while data:
            yield plain.decompress(data, PIECE)
            data = plain.unconsumed_tail
    if plain is not None:
        yield plain.flush()


def lines_of(parts: Iterator[bytes]) -> Iterator[str]:
    """Lines of UTF-8 bytes that come in pieces; bytes that aren't UTF-8 are replaced."""
    decoder, rest = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for part in parts:
        found = (rest + decoder.decode(part)).splitlines(keepends=True)
        # the last line may go on, and a carriage return may be half of a line end
        rest = found.pop() if found and (found[-1].endswith("\r") or found[-1].splitlines()[0] == found[-1]) else ""
        yield from (x.splitlines()[0] for x in found)
    yield from (rest + decoder.decode(b"", True)).splitlines()


def frame(run: str, file: str | None, first: int, lines: list[str] | None) -> pd.DataFrame:
    """Rows of LINES; one null line for None. Plain objects, as Arrow-backed strings come in chunks that Spark doesn't take."""
    n = 1 if lines is None else len(lines)
    numbers = pd.array([None] if lines is None else range(first, first + n), "Int64")
    texts = {"run": [run] * n, "file": [file] * n, "line": [None] if lines is None else lines}
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in texts.items()}).assign(line_no=numbers)[["run", "file", "line_no", "line"]]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """LINES of members; one null line for a member that isn't whole."""
    for batch in batches:
        for m in batch.itertuples(index=False):
            try:
                if m.file is None or m.locked:
                    raise RuntimeError("not readable")
                with open_range(m.path) as source:
                    crc, size = 0, 0
                    for part in pieces(source, m.at, m.packed, m.method):
                        crc, size = zlib.crc32(part, crc), size + len(part)
                    if (crc, size) != (m.crc, m.size):
                        raise zipfile.BadZipFile("other bytes than the directory says")
            except UNREADABLE:
                yield frame(m.run, m.file, 0, None)
                continue
            with open_range(m.path) as source:
                held, number = [], 0
                for line in lines_of(pieces(source, m.at, m.packed, m.method)):
                    held.append(line)
                    if len(held) == ROWS:
                        yield frame(m.run, m.file, number, held)
                        held, number = [], number + ROWS
                if held:
                    yield frame(m.run, m.file, number, held)


def read_by_member(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """LINES of archives (path), in tasks by member."""
    members = archives.select("path").mapInPandas(_members, MEMBERS)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return members.repartition(tasks, "path", "at").mapInPandas(_read, LINES)
