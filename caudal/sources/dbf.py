"""Tables in dBASE files and their compressed form, as a Spark data source.

``spark.dataSource.register(DbfSource)``, then ``spark.read.format("dbf").load(path)``; options: ``columns`` (comma-separated,
only these are decoded), ``limit`` (rows per file), ``encoding``, ``file_column`` (a column for the name of the file). Plain files are
split by records, ``SPLIT_BYTES`` a partition; a compressed file is one. Every column is a string, numeric fields that don't hold a
number are null. Paths are those of a folder that all executors mount.
"""

from __future__ import annotations

import glob
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_NUMERIC = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)$")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    at: int
    width: int


def parse_header(data: bytes) -> tuple[int, int, int, list[Field]]:
    """Number of records, length of the header and of a record, and the fields."""
    n, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 1
    for p in range(32, head - 1, 32):
        if data[p : p + 1] in (b"\r", b""):
            break
        name = data[p : p + 11].split(b"\0")[0].decode("ascii", "replace").strip()
        fields.append(Field(name, chr(data[p + 11]), at, data[p + 16]))
        at += data[p + 16]
    return n, head, width, fields


def records(data: bytes, columns: list[str] | None = None, limit: int | None = None, encoding: str = "latin-1") -> Iterator[tuple[str | None, ...]]:
    """The live records, in the order of ``columns`` (unknown names give null); deleted ones are skipped."""
    n, head, width, fields = parse_header(data)
    by_name = {f.name: f for f in fields}
    wanted = [by_name.get(c) for c in columns] if columns else fields
    given = 0
    for k in range(n):
        row = data[head + k * width : head + (k + 1) * width]
        if len(row) < width or given == limit:
            return
        if row[:1] == b"*":
            continue
        out: list[str | None] = []
        for f in wanted:
            v = row[f.at : f.at + f.width].decode(encoding, "replace").strip(" \0") if f else ""
            out.append(v if v and (f.kind not in "NF" or _NUMERIC.match(v)) else None)
        given += 1
        yield tuple(out)


def write_dbf(rows: list[tuple], fields: list[tuple[str, str, int]], encoding: str = "latin-1") -> bytes:
    """A dBASE III file; fields are (name, kind, width). For tests and small exports."""
    head, width = 32 + 32 * len(fields) + 1, 1 + sum(w for _, _, w in fields)
    out = bytearray(struct.pack("<BBBBIHH20x", 3, 121, 1, 1, len(rows), head, width))
    for name, kind, w in fields:
        out += struct.pack("<11sc4xBB14x", name.encode("ascii")[:11], kind.encode(), w, 0)
    out += b"\r"
    for r in rows:
        out += b" "
        for v, (_, kind, w) in zip(r, fields):
            cell = ("" if v is None else str(v)).encode(encoding)[:w]
            out += cell.rjust(w) if kind in "NF" else cell.ljust(w)
    return bytes(out + b"\x1a")


# --- compressed files ----------------------------------------------------------------------------------------------------
# Fixed values of the public "implode" format: code lengths as (repeat, length) runs, and the bases of the length codes.
LITERAL_RUNS = (
    11, 124, 8, 7, 28, 7, 188, 13, 76, 4, 10, 8, 12, 10, 12, 10, 8, 23, 8, 9, 7, 6, 7, 8, 7, 6, 55, 8, 23, 24, 12, 11, 7, 9, 11,
    12, 6, 7, 22, 5, 7, 24, 6, 11, 9, 6, 7, 22, 7, 11, 38, 7, 9, 8, 25, 11, 8, 11, 9, 12, 8, 12, 5, 38, 5, 38, 5, 11, 7, 5, 6,
    21, 6, 10, 53, 8, 7, 24, 10, 27, 44, 253, 253, 253, 252, 252, 252, 13, 12, 45, 12, 45, 12, 61, 12, 45, 44, 173,
)
LENGTH_RUNS = (2, 35, 36, 53, 38, 23)
DISTANCE_RUNS = (2, 20, 53, 230, 247, 151, 248)
LENGTH_BASE = (3, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 72, 136, 264)
LENGTH_EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8)


def _codes(runs: tuple[int, ...]) -> dict[tuple[int, int], int]:
    """Canonical prefix codes: (length, code) to symbol. A run holds a length in its low four bits, repeats less one above."""
    lengths = [r & 15 for r in runs for _ in range((r >> 4) + 1)]
    out, code = {}, 0
    for n in range(1, max(lengths) + 1):
        for symbol, length in enumerate(lengths):
            if length == n:
                out[n, code] = symbol
                code += 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.buffer, self.count = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.count < n:
            if self.at >= len(self.data):
                raise EOFError("compressed data ends early")
            self.buffer |= self.data[self.at] << self.count
            self.at, self.count = self.at + 1, self.count + 8
        out = self.buffer & ((1 << n) - 1)
        self.buffer >>= n
        self.count -= n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        """Code bits come inverted, most significant first."""
        code = 0
        for n in range(1, 16):
            code = code << 1 | (self.take(1) ^ 1)
            if (s := codes.get((n, code))) is not None:
                return s
        raise ValueError("no such code")


def explode(data: bytes) -> bytes:
    """Undoes "implode" compression: literals, and copies of (length, distance) from what came before."""
    lengths, distances = _codes(LENGTH_RUNS), _codes(DISTANCE_RUNS)
    coded, window = data[0], data[1]
    if coded not in (0, 1) or window not in (4, 5, 6):
        raise ValueError("not imploded data")
    literals = _codes(LITERAL_RUNS) if coded else None
    bits, out = _Bits(data[2:]), bytearray()
    while True:
        if not bits.take(1):
            out.append(bits.symbol(literals) if literals else bits.take(8))
            continue
        s = bits.symbol(lengths)
        n = LENGTH_BASE[s] + bits.take(LENGTH_EXTRA[s])
        if n == 519:
            return bytes(out)
        low = 2 if n == 2 else window
        back = (bits.symbol(distances) << low) + bits.take(low) + 1
        if back > len(out):
            raise ValueError("a copy reaches before the start")
        for _ in range(n):
            out.append(out[-back])


def decompress_dbc(data: bytes) -> bytes:
    """A compressed table as a dBASE file: its plain header, four bytes of checksum, then the imploded records."""
    head = struct.unpack("<H", data[8:10])[0]
    return data[: head - 1] + b"\r" + explode(data[head + 4 :])


def load(path: str, start: int = 0, count: int | None = None) -> bytes:
    """A file as plain dBASE; of a plain one only ``count`` records from ``start`` on are read."""
    with open(path, "rb") as f:
        if path.lower().endswith(".dbc"):
            return decompress_dbc(f.read())
        if count is None:
            return f.read()
        head = f.read(65_536)
        _, size, width, _ = parse_header(head)
        f.seek(size + start * width)
        return head[:4] + struct.pack("<I", count) + head[8:size] + f.read(count * width)


#: Bytes of a plain file that one task reads.
SPLIT_BYTES = 64 << 20


class FilePartition(InputPartition):
    def __init__(self, path: str, start: int = 0, count: int | None = None) -> None:
        super().__init__((path, start))
        self.path, self.start, self.count = path, start, count


class DbfReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in DbfSource.files(self.options):
            if p.lower().endswith(".dbc") or self.options.get("limit"):
                out.append(FilePartition(p))
                continue
            with open(p, "rb") as f:
                n, _, width, _ = parse_header(f.read(65_536))
            step = max(1, SPLIT_BYTES // max(width, 1))
            out += [FilePartition(p, k, min(step, n - k)) for k in range(0, n, step)]
        return out

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        limit = self.options.get("limit")
        extra = self.options.get("file_column")
        names = [f.name for f in self.schema.fields if f.name != extra]
        rows = records(load(partition.path, partition.start, partition.count), names, int(limit) if limit else None, self.options.get("encoding", "latin-1"))
        at = [f.name for f in self.schema.fields].index(extra) if extra else 0
        for r in rows:
            yield (*r[:at], os.path.basename(partition.path), *r[at:]) if extra else r


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    @staticmethod
    def files(options: dict) -> list[str]:
        root = options["path"].removeprefix("file:")
        if os.path.isdir(root):
            found = [p for p in glob.glob(f"{root}/**/*", recursive=True) if p.lower().endswith((".dbf", ".dbc"))]
        else:
            found = glob.glob(root)
        if not found:
            raise FileNotFoundError(root)
        return sorted(found)

    def schema(self) -> StructType:
        if columns := self.options.get("columns"):
            names = [c.strip() for c in columns.split(",") if c.strip()]
        else:
            with open(self.files(self.options)[0], "rb") as f:
                names = [x.name for x in parse_header(f.read(65_536))[3]]
        names += [self.options["file_column"]] if self.options.get("file_column") else []
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DbfReader:
        return DbfReader(dict(self.options), schema)
