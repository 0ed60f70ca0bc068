"""Tar archives: an index of members, reading by member, and writing.

Plain archives are indexed by their headers alone, one task an archive, and their members are
then read at their offsets by as many tasks as their bytes ask for. A compressed archive has no
offsets and is one stream. Members and lines are streamed, so memory is bounded by a line.
"""

from __future__ import annotations

import gzip
import io
import math
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of members that a task reads, about, and lines that leave it at once, by number and characters.
SPLIT, LINES, CHARS = 64 << 20, 4096, 8 << 20
KINDS = (".jsonl", ".jsonl.gz")
PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ")


def opened(path: str) -> BinaryIO:
    """A file of any store that Arrow reads, for seeking; a path without a scheme is a local one."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return io.BufferedReader(_Raw(store.open_input_file(at)), 1 << 20)


class _Raw(io.RawIOBase):
    """An Arrow file as Python's own kind, or a stretch of one."""

    def __init__(self, file, begin: int = 0, size: int | None = None):
        self.file, self.begin, self.at = file, begin, 0
        self.size = file.size() - begin if size is None else size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        want = max(0, min(len(buffer), self.size - self.at))
        self.file.seek(self.begin + self.at)
        got = self.file.read(want) if want else b""
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, offset, size, packed): the ``.jsonl`` and ``.jsonl.gz`` members of plain archives; one row, without a member, for a compressed one.

    The archives' contents do not leave the store: only headers are read, by seeking from one to the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in _chunked(_headers(archive, length)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["archive", "member", "offset", "size", "packed"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    n = max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism))
    return files.repartition(n, "path").mapInArrow(run, "archive string, member string, offset long, size long, packed boolean")


def _headers(archive: str, length: int) -> Iterator[tuple]:
    with opened(archive) as file:
        start = file.read(6)
        if start.startswith(PACKED):
            yield archive, None, 0, length, True
            return
        file.seek(0)
        with tarfile.open(fileobj=file, mode="r:") as tar:
            while (member := tar.next()) is not None:
                tar.members = []  # the list would hold them all
                if member.isfile() and member.name.endswith(KINDS):
                    yield archive, member.name, member.offset_data, member.size, False


def _chunked(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += len(row[-1]) if isinstance(row[-1], str) else 0
        if len(held) >= LINES or chars >= CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _lines(archive: str, name: str, stream: BinaryIO) -> Iterator[tuple[str, str, int, str]]:
    if name.endswith(".gz"):
        stream = gzip.GzipFile(fileobj=stream)
    for i, raw in enumerate(stream):
        try:
            text = raw.decode().strip()
        except UnicodeDecodeError:
            continue
        if text:
            yield archive, name, i, text


def _of_archive(archive: str) -> Iterator[tuple[str, str, int, str]]:
    """Lines of a compressed archive, as one stream."""
    with opened(archive) as file, tarfile.open(fileobj=file, mode="r|*") as tar:
        for member in tar:
            tar.members = []
            if member.isfile() and member.name.endswith(KINDS):
                yield from _lines(archive, member.name, tar.extractfile(member))


def lines(index: DataFrame, split: int = SPLIT) -> DataFrame:
    """(archive, member, line_no, line) of the members of an index. Blank and undecodable lines fall away.

    Members that lie near each other go to one task, of ``split`` bytes about; a member is
    not cut. An archive or member that is damaged is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple[str, str, int, str]]:
            file, now = None, None
            for batch in batches:
                for archive, member, offset, size, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if packed:
                        yield from _of_archive(archive)
                        continue
                    if archive != now:
                        if file is not None:
                            file.close()
                        file, now = opened(archive), archive
                    yield from _lines(archive, member, io.BufferedReader(_Raw(file.raw.file, offset, size), 1 << 20))
            if file is not None:
                file.close()

        for part in _chunked(every()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["archive", "member", "line_no", "line"])

    total = index.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).collect()[0]["n"]
    slot = F.floor(F.col("offset") / split)
    dealt = index.repartition(max(1, math.ceil(total / split)), "archive", slot).sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "member", "offset", "size", "packed").mapInArrow(run, "archive string, member string, line_no long, line string")


def tar_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(archive, member, line_no, line) of tar archives, plain or compressed; patterns name several."""
    return lines(members(spark, path), split)


def write_tars(rows: DataFrame, folder: str, member: str = "member", line: str = "line", archives: int = 8) -> DataFrame:
    """Write lines as members of ``archives`` tar files, and return (archive, n_members, n_lines).

    A member's lines are in one archive, in order of the line; one member at a time is in
    memory. ``.gz`` members are compressed. An archive appears whole, under its own name, so a
    task that runs again replaces it. Rows without a member's name are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        store.create_dir(at, recursive=True)
        name = f"part-{task.partitionId():05d}.tar"
        hidden = f"{at}/_{name}.{task.taskAttemptId()}"
        n_members = n_lines = 0
        with store.open_output_stream(hidden) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            now, held = None, []

            def close() -> None:
                nonlocal n_members
                if now is not None:
                    data = "".join(f"{x}\n" for x in held).encode()
                    data = gzip.compress(data, mtime=0) if now.endswith(".gz") else data
                    info = tarfile.TarInfo(now)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                    n_members += 1

            for batch in batches:
                for m, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if m != now:
                        close()
                        now, held = m, []
                    held.append(x or "")
                    n_lines += 1
            close()
        store.move(hidden, f"{at}/{name}")
        yield pa.RecordBatch.from_pydict({"archive": [name], "n_members": [n_members], "n_lines": [n_lines]})

    dealt = rows.select(F.col(member).alias("m"), F.col(line).alias("x")).where("m IS NOT NULL").repartition(archives, "m").sortWithinPartitions("m", "x")
    return dealt.mapInArrow(run, "archive string, n_members long, n_lines long")
