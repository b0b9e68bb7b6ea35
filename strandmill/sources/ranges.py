"""FASTA files by ranges of bytes, as a data source.

A range has the sequence bytes between its ends and the names that begin there. What stands before its first name belongs to
a record that an earlier range began. Files are opened by ``pyarrow.fs``; folders give their files.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
#: Bytes of a header line at most; a line that began longer ago is a sequence.
HEADER = 1 << 20
SCHEMA = "file string, start long, segment int, name string, at long, piece binary"


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class FastaRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastaReader(self.options)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def in_header(file, start: int) -> bool:
    """Whether a place lies in a header line, behind its first sign."""
    end = start
    while end > 0 and start - end < HEADER:
        begin = max(0, end - (1 << 16))
        file.seek(begin)
        part = file.read(end - begin)
        if (line := part.rfind(b"\n")) >= 0:
            line += begin + 1
            file.seek(line)
            return line < start and file.read(1) == b">"
        end = begin
    file.seek(0)
    return end == 0 and file.read(1) == b">"


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.range, self.piece = options["path"], int(options["range_bytes"]), int(options["piece_bytes"])

    def partitions(self) -> list[Range]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
        return [Range(x.path, at, min(x.size, at + self.range)) for x in sorted(files, key=lambda x: x.path) for at in range(0, x.size, self.range)]

    def read(self, partition: Range):
        system, _ = opened(self.path)
        with system.open_input_file(partition.file) as file:
            segment, name, at, held, rows = 0, None, 0, [], []
            header = b"" if partition.start and in_header(file, partition.start) else None
            ours = header is None  # the rest of an earlier range's header is not
            file.seek(partition.start - 1 if partition.start else 0)
            line_begins = file.read(1) == b"\n" if partition.start else True
            file.seek(partition.start)
            place = partition.start

            def row(name, at, piece):
                return (partition.file, partition.start, segment, name, at, piece)

            def batch():
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

            def flush(last: bool):
                """Pieces of what is held; a segment's first one has its name, though it be empty."""
                nonlocal at, name, held
                whole = b"".join(held)
                step = len(whole) if last else len(whole) // self.piece * self.piece
                for k in range(0, step, self.piece):
                    rows.append(row(name, at + k, whole[k : min(k + self.piece, step)]))
                    name = None
                if last and name is not None:
                    rows.append(row(name, 0, b""))
                at, held = at + step, [whole[step:]]

            while place < partition.end or header is not None:
                # beyond the range only a name that began in it is read
                data = file.read(min(CHUNK, partition.end - place) if place < partition.end else CHUNK)
                if not data:
                    break
                if place == 0 and data.lstrip()[:1] == b"@":
                    raise ValueError(f"FASTQ records in a file read as FASTA: {partition.file}")
                k = 0
                while k < len(data) and (place + k < partition.end or header is not None):
                    if header is not None:
                        end = data.find(b"\n", k)
                        header += data[k : len(data) if end < 0 else end]
                        k = len(data) if end < 0 else end + 1
                        if end >= 0:
                            if ours:
                                flush(True)
                                segment, name, at, held = segment + 1, (header.decode("utf-8", "replace").split() or [""])[0], 0, []
                            header, ours, line_begins = None, True, True
                    elif line_begins and data[k : k + 1] == b">":
                        header, k = b"", k + 1
                    else:
                        end = data.find(b"\n>", k)
                        part = data[k : len(data) if end < 0 else end + 1]
                        held.append(part.translate(None, b" \t\r\n\v\f"))
                        line_begins, k = part.endswith(b"\n"), k + len(part)
                place += len(data)
                if sum(map(len, held)) >= self.piece:
                    flush(False)
                if len(rows) >= 16:
                    yield batch()
                    rows.clear()
            if header is not None and ours:  # a last line without an end
                flush(True)
                segment, name, at, held = segment + 1, (header.decode("utf-8", "replace").split() or [""])[0], 0, []
            flush(True)
            if rows:
                yield batch()
