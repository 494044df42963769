"""OSM PBF files as a data source whose partitions are ranges of blobs.

Planning reads nothing but the blobs' headers: four bytes of length, the header, then a jump over the data. Neighbouring blobs form a
partition of about partition_bytes, so one large extract is decoded by as many tasks as it has such ranges, and a lost task reads its range again.
Files are opened through pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = "array<struct<type:string,id:long,role:string>>"
SCHEMA = f"kind string, id long, lat double, lon double, refs array<long>, members {MEMBERS}, tags map<string,string>"
ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("id", pa.int64()), ("role", pa.string())]))), ("tags", pa.map_(pa.string(), pa.string()))])
#: Bytes of a partition; a blob is never cut.
PARTITION_BYTES = 32 << 20
#: Rows of an Arrow batch.
BATCH = 1 << 14
SCHEMES = ("file", "hdfs", "s3", "gs")
_KINDS = ("node", "way", "relation")


def _varint(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[at]
        at += 1
        value |= (c & 0x7F) << shift
        if c < 0x80:
            return value, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            value, at = _varint(b, at)
        elif key & 7 == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = 8 if key & 7 == 1 else 4
            value, at = b[at : at + n], at + n
        yield key >> 3, value


def _packed(b: bytes, signed: bool = False) -> np.ndarray:
    """All varints of a packed field at once."""
    raw = np.frombuffer(b, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    value = np.add.reduceat((raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)
    if signed:
        value = (value >> np.uint64(1)) ^ (np.uint64(0) - (value & np.uint64(1)))
    return value.view(np.int64)


def blobs(content: bytes) -> Iterator[bytes]:
    """Data blobs of a file or a range of whole blobs, unpacked."""
    at = 0
    while at < len(content):
        n = struct.unpack(">I", content[at : at + 4])[0]
        header = dict(fields(content[at + 4 : at + 4 + n]))
        at += 4 + n
        blob = content[at : at + header[3]]
        at += header[3]
        if header[1] == b"OSMData":
            parts = dict(fields(blob))
            yield parts[1] if 1 in parts else zlib.decompress(parts[3])


def objects(block: bytes) -> Iterator[tuple]:
    """(kind, id, lat, lon, refs, members, tags) of a primitive block."""
    parts: dict[int, list] = {}
    for k, v in fields(block):
        parts.setdefault(k, []).append(v)
    text = [v.decode() for _, v in fields(parts[1][0])]
    step, lat0, lon0 = (parts.get(k, [d])[0] for k, d in ((17, 100), (19, 0), (20, 0)))
    tags = lambda f: {text[a]: text[b] for a, b in zip(_packed(f.get(2, b"")), _packed(f.get(3, b"")), strict=True)}
    place = lambda lat, lon: ((lat0 + step * lat) / 1e9, (lon0 + step * lon) / 1e9)
    zigzag = lambda n: (n >> 1) ^ -(n & 1)
    for group in parts.get(2, []):
        for kind, raw in fields(group):
            f = dict(fields(raw))
            if kind == 1:
                yield ("node", zigzag(f[1]), *place(zigzag(f[8]), zigzag(f[9])), None, None, tags(f))
            elif kind == 2:
                ids, lats, lons = (np.cumsum(_packed(f[k], True)) for k in (1, 8, 9))
                pairs, n = _packed(f.get(10, b"")).tolist(), 0
                for i, lat, lon in zip(ids.tolist(), lats.tolist(), lons.tolist(), strict=True):
                    own = {}
                    while n < len(pairs) and pairs[n]:
                        own[text[pairs[n]]] = text[pairs[n + 1]]
                        n += 2
                    n += 1
                    yield ("node", i, *place(lat, lon), None, None, own)
            elif kind == 3:
                yield ("way", f[1], None, None, np.cumsum(_packed(f.get(8, b""), True)).tolist(), None, tags(f))
            elif kind == 4:
                refs = np.cumsum(_packed(f.get(9, b""), True)).tolist()
                members = [{"type": _KINDS[t], "id": i, "role": text[r]} for t, i, r in zip(_packed(f.get(10, b"")).tolist(), refs, _packed(f.get(8, b"")).tolist(), strict=True)]
                yield ("relation", f[1], None, None, None, members, tags(f))


def batches(blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """The objects of unpacked blocks, BATCH rows at most at once."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([list(t.items()) for t in c] if f.name == "tags" else list(c), f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    rows: list[tuple] = []
    for block in blocks:
        for o in objects(block):
            rows.append(o)
            if len(rows) == BATCH:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


@dataclass
class BlobRange(InputPartition):
    path: str
    start: int
    end: int


def blob_ranges(system: fs.FileSystem, path: str, partition_bytes: int) -> list[BlobRange]:
    """Ranges of whole blobs of a file, by its headers alone. A file that ends within a blob is an error."""
    found: list[BlobRange] = []
    with system.open_input_file(path) as f:
        size, at, begin = f.size(), 0, 0
        while at < size:
            n = struct.unpack(">I", f.read_at(4, at))[0]
            header = dict(fields(f.read_at(n, at + 4)))
            end = at + 4 + n + header[3]
            if end > size:
                raise ValueError(f"{path} ends within the blob at byte {at}")
            if header[1] != b"OSMData":  # a file's header blob stands alone, and holds no objects
                if at > begin:
                    found.append(BlobRange(path, begin, at))
                begin = end
            elif end - begin >= partition_bytes:
                found.append(BlobRange(path, begin, end))
                begin = end
            at = end
        if at > begin:
            found.append(BlobRange(path, begin, at))
    return found


class _Reader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.uri, self.partition_bytes = path, partition_bytes

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def partitions(self) -> list[BlobRange]:
        system, path = self._system()
        info = system.get_file_info(path)
        files = [path] if info.is_file else sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.is_file and x.path.endswith(".pbf"))
        return [r for f in files for r in blob_ranges(system, f, self.partition_bytes)] or [BlobRange(path, 0, 0)]

    def read(self, partition: BlobRange) -> Iterator[pa.RecordBatch]:
        if partition.end == partition.start:
            return
        system, _ = self._system()
        with system.open_input_file(partition.path) as f:
            yield from batches(blobs(f.read_at(partition.end - partition.start, partition.start)))


class OsmPbf(DataSource):
    """spark.read.format("osm_pbf").load(path): objects of a file or of a folder's .pbf files. Option partition_bytes: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))
