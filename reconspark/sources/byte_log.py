"""Console logs as a stream of bytes: growing files included.

Spark's own file source takes each file once and never sees what is appended to it.  This source's offset is a byte position per
file: a query starts ``tailBytes`` before the end of each log, follows what is appended, and takes new files from their start.  A
batch is cut into partitions of ``chunkBytes``; a line belongs to the partition that its first byte lies in, and counts once its
line end has been written, so half a line is never handed on.

    spark.dataSource.register(ByteLog)
    spark.readStream.format("byte_log").option("path", folder).option("tailBytes", 262144).load()

The folder is one that driver and executors share: a mounted path or any URI that pyarrow's file systems open.
"""

from __future__ import annotations

import posixpath

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: What the logs' viewer shows at first and reads at once, in bytes.
TAIL_BYTES, CHUNK_BYTES = 256 * 1024, 512 * 1024
#: Bytes read at a time in search of a line end.
STEP = 64 * 1024


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of each file below a folder, by its path in it; files whose names begin with a dot or an underscore are left out."""
    from pyarrow import fs

    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inside = lambda p: posixpath.relpath(p, root)
    return {inside(f.path): f.size for f in found if f.type == fs.FileType.File and not any(part[0] in "._" for part in inside(f.path).split("/"))}


def whole_lines(file, size: int, least: int = 0) -> int:
    """The position behind the last line end before ``size``, ``least`` at the earliest."""
    at = size
    while at > least:
        start = max(least, at - STEP)
        file.seek(start)
        end = file.read(at - start).rfind(b"\n")
        if end >= 0:
            return start + end + 1
        at = start
    return least


def lines_between(file, start: int, end: int, limit: int):
    """(position, bytes) of the lines whose first byte lies in start .. end - 1; all line ends lie before ``limit``."""
    at, held = start, b""
    if start:  # the line that runs over the start belongs to the part before
        file.seek(start - 1)
        at = start - 1
        while True:
            piece = file.read(min(STEP, limit - at))
            if not piece:
                return
            cut = piece.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(piece)
    file.seek(at)
    read = at
    while at < end:
        cut = held.find(b"\n")
        if cut < 0:
            piece = file.read(min(STEP, limit - read))
            if not piece:
                return
            read += len(piece)
            held += piece
            continue
        yield at, held[:cut]
        at, held = at + cut + 1, held[cut + 1 :]


class Chunk(InputPartition):
    def __init__(self, name: str, start: int, end: int, limit: int):
        self.name, self.start, self.end, self.limit = name, start, end, limit


class ByteLogReader(DataSourceStreamReader):
    """Offsets are {file: position}; a file that the start lacks is new and read from its first byte."""

    def __init__(self, options):
        self.path = options.get("path")
        self.tail = int(options.get("tailBytes", TAIL_BYTES))
        self.chunk = int(options.get("chunkBytes", CHUNK_BYTES))

    def _ends(self) -> dict[str, int]:
        files, root = _open(self.path)
        out = {}
        for name, size in sizes(self.path).items():
            with files.open_input_file(posixpath.join(root, name)) as file:
                out[name] = whole_lines(file, size)
        return out

    def initialOffset(self) -> dict:
        return {name: max(0, end - self.tail) for name, end in self._ends().items()}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict):
        out = []
        for name, limit in sorted(end.items()):
            at = start.get(name, 0)
            at = 0 if limit < at else at  # a log that was begun anew
            out += [Chunk(name, s, min(s + self.chunk, limit), limit) for s in range(at, limit, self.chunk)]
        return out

    def read(self, partition: Chunk):
        files, root = _open(self.path)
        with files.open_input_file(posixpath.join(root, partition.name)) as file:
            for at, line in lines_between(file, partition.start, partition.end, partition.limit):
                yield partition.name, at, line.removesuffix(b"\r").decode("utf-8", "replace")


class ByteLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_log"

    def schema(self) -> str:
        return "file string, position long, line string"

    def streamReader(self, schema) -> ByteLogReader:
        return ByteLogReader(self.options)


def follow(spark, path: str, tail_bytes: int = TAIL_BYTES, chunk_bytes: int = CHUNK_BYTES):
    """A stream of (file, position, line) of the logs below a folder: the last ``tail_bytes`` of each, then what comes."""
    spark.dataSource.register(ByteLog)
    return spark.readStream.format("byte_log").option("path", path).option("tailBytes", tail_bytes).option("chunkBytes", chunk_bytes).load()
