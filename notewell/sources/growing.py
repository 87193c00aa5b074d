"""Line files that grow, as a source for batches and streams: plain ones by byte offset, compressed ones (.gz, .zst) once.

A stream's offset says how many bytes of each open file were consumed; Spark keeps it with the stream's checkpoint and moves it on
only when a batch is done, so a batch that failed is read again and nothing else is read twice.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..session import ship
from .notes import file_system

NAME, SCHEMA = "growing_lines", "session string, file string, at long, line string"
CODECS = {".gz": "gzip", ".zst": "zstd"}
#: What names the sessions that are closed; and bytes that one task reads, that are read at once, and that leave in one batch.
CLOSED, BUNDLE, CHUNK, BATCH = ".closed", 64 << 20, 1 << 20, 4 << 20


class Pieces(InputPartition):
    """(file, first byte, byte after the last) of what one task reads."""

    def __init__(self, pieces: list[tuple[str, int, int]]) -> None:
        self.pieces = pieces


def session_of(path: str, suffix: str) -> str:
    """A file's name without its codec and the suffix."""
    name = posixpath.basename(path)
    for codec in CODECS:
        name = name.removesuffix(codec)
    return name.removesuffix(suffix)


def sizes(root: str, suffix: str, only: str = "") -> dict[str, int]:
    """Bytes of each file below ``root`` (of those that end with ``only``) whose session is not closed. Only the listing is read."""
    store, path = file_system(root)
    found = [i for i in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if i.is_file]
    closed = {posixpath.basename(i.path).removesuffix(CLOSED) for i in found if i.path.endswith(CLOSED)}
    files = {i.path: i.size for i in found if i.path.removesuffix(".gz").removesuffix(".zst").endswith(suffix) and i.path.endswith(only)}
    return {p: n for p, n in sorted(files.items()) if session_of(p, suffix) not in closed}


def bundles(start: dict[str, int], end: dict[str, int]) -> list[Pieces]:
    """What came between two offsets, in tasks of some BUNDLE bytes; long plain files are cut. A file that shrank has nothing new, and a compressed one only when it is first seen."""
    out: list[Pieces] = []
    held = BUNDLE
    for path, size in end.items():
        at = start.get(path, 0)
        whole = posixpath.splitext(path)[1] in CODECS
        if whole and at:
            continue
        while at < size:
            to = size if whole else min(size, at + BUNDLE)
            if held >= BUNDLE:
                out.append(Pieces([]))
                held = 0
            out[-1].pieces.append((path, at, to))
            held += to - at
            at = to
    return out


def plain_lines(store: fs.FileSystem, path: str, begin: int, end: int, finish: bool) -> Iterator[tuple[int, bytes]]:
    """(at, line) of the lines whose line feed lies from ``begin`` to before ``end``; the first may begin before, and what follows the last line feed waits for its own,
    unless the file is to be read to its ``finish``."""
    with store.open_input_file(path) as f:
        at = begin
        # back to where the line that is under way began
        while at > 0:
            step = min(CHUNK, at)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                at += cut + 1 - step
                break
            at -= step
        f.seek(at)
        parts: list[bytes] = []
        position = at
        while position < end:
            block = f.read(min(CHUNK, end - position))
            if not block:
                return
            position += len(block)
            *whole, rest = block.split(b"\n")
            for piece in whole:
                line = b"".join([*parts, piece])
                parts.clear()
                yield at, line
                at += len(line) + 1
            parts.append(rest)
        if finish and end >= f.size() and (last := b"".join(parts)):
            yield at, last


def compressed_lines(store: fs.FileSystem, path: str, codec: str) -> Iterator[tuple[int, bytes]]:
    """(at, line) of a compressed file, unpacked as it is read; of a torn file the lines that are whole."""
    at, parts = 0, []
    with store.open_input_stream(path, compression=None) as raw, pa.CompressedInputStream(raw, codec) as f:
        while True:
            try:
                block = f.read(CHUNK)
            except OSError:
                return
            if not block:
                break
            *whole, rest = block.split(b"\n")
            for piece in whole:
                line = b"".join([*parts, piece])
                parts.clear()
                yield at, line
                at += len(line) + 1
            parts.append(rest)
    if last := b"".join(parts):
        yield at, last


def read_pieces(root: str, suffix: str, pieces: list[tuple[str, int, int]], finish: bool) -> Iterator[pa.RecordBatch]:
    store, _ = file_system(root)
    rows: list[tuple] = []
    held = 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["session", "file", "at", "line"])

    for path, begin, end in pieces:
        codec = CODECS.get(posixpath.splitext(path)[1])
        for at, line in compressed_lines(store, path, codec) if codec else plain_lines(store, path, begin, end, finish):
            if line.strip():
                rows.append((session_of(path, suffix), path, at, line.decode("utf-8", "ignore").rstrip("\r")))
                held += len(line)
            if held > BATCH:
                yield told()
                rows.clear()
                held = 0
    if rows:
        yield told()


class GrowingLines(DataSource):
    """Options: ``path``, ``suffix`` of the files before any codec's (``.jsonl``), and for batches ``only``, what their whole names end with."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Once(self.options["path"], self.options.get("suffix", ".jsonl"), self.options.get("only", ""))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802 (Spark's name)
        return Following(self.options["path"], self.options.get("suffix", ".jsonl"))


class Once(DataSourceReader):
    def __init__(self, root: str, suffix: str, only: str) -> None:
        self.root, self.suffix, self.only = root, suffix, only

    def partitions(self) -> list[InputPartition]:
        return bundles({}, sizes(self.root, self.suffix, self.only))

    def read(self, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
        # without any file Spark asks once, for nothing
        yield from read_pieces(self.root, self.suffix, partition.pieces if partition else [], True)


class Following(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str) -> None:
        self.root, self.suffix = root, suffix

    def initialOffset(self) -> dict:  # noqa: N802
        return {"read": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"read": sizes(self.root, self.suffix)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return bundles(start["read"], end["read"])

    def read(self, partition: Pieces | None) -> Iterator[pa.RecordBatch]:
        yield from read_pieces(self.root, self.suffix, partition.pieces if partition else [], False)


def read_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", only: str = "") -> DataFrame:
    """(session, file, at, line) of the line files below ``path``, plain or compressed: whole lines that are not blank, with the byte that each begins at (of the unpacked text)."""
    ship(spark)
    spark.dataSource.register(GrowingLines)
    return spark.read.format(NAME).option("path", path).option("suffix", suffix).option("only", only).load()


def follow_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """The same as a stream. Lines come once their line feed is there; closed sessions, those with a file ``<session>.closed``, drop out, and a compressed file is read once."""
    ship(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).option("path", path).option("suffix", suffix).load()
