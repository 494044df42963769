"""Words of whole Arrow text columns by numpy: no Python object per word.

A word is a run of bytes of one class after A-Z were lower-cased. Both classes in use let every byte of a
multi-byte character pass, so that runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .storage import workers_import_us

_codes = np.arange(256, dtype=np.uint8)
LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)
#: Letters and digits of ASCII and everything beyond ASCII.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
#: All but ASCII white space.
SOLID = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose output bits look random (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of consecutive rows: row (from 0 in this chunk), byte span in data, 64-bit hash; bounds[r]:bounds[r + 1] are the words of row r."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, hashed: bool = True) -> Words:
    """Words of the rows data[offsets[r]:offsets[r + 1]]."""
    n = len(data)
    low = LOWER[data]
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[low]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[1:-1][edge]
    ends[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    value = np.zeros(0, np.uint64)
    if hashed:
        up, down = _power_tables(max(n, 1 << 20))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low] * up[:n], out=total[1:])
        value = mix((total[end] - total[start]) * down[start])
    return Words(low, row, start, end, value, bounds)


def text_chunks(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows, of about most_bytes each; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1)
        b = min(b, len(texts))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct sorted hashes of all runs of size words of one text; of the whole text if it has fewer words; none without words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(n, size)
    acc = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n - width + 1])
    return np.unique(acc.view(np.int64))


def map_text(df, text: str, keep: tuple[str, ...], fields: str, make):
    """The keep columns of df and new fields, computed from whole texts by chunks.

    make() runs once in each task and returns f(data, offsets) -> list of Arrow arrays, one for each of fields,
    with a value for each row of the chunk. keep may hold names or columns with aliases.
    """
    from pyspark.sql import types as T

    workers_import_us(df.sparkSession)
    picked = df.select(*keep)
    names = picked.columns
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([*picked.schema.fields, *new.fields])

    def run(batches):
        f = make()
        for batch in batches:
            texts = batch.column(len(names))
            for a, b, data, offsets in text_chunks(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), *f(data, offsets)], names=schema.names)

    return df.select(*keep, df[text].alias("af_text")).mapInArrow(run, schema)
