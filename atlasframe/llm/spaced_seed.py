"""Benchmark decontamination by spaced-seed hashing.

A fixed mask reads some words of a window and ignores the others, so a window whose ignored words were substituted
keeps its hash. MASKS are so chosen that of any WINDOW words, or of any shorter item of SPAN words or more, of which
AGREE are kept, some mask reads kept words only. Items of fewer than SPAN words must occur whole. Test items give the
hash of every window under every mask; a bitmap of fixed size (BITMAP bits, two for each hash) made from those goes to all tasks and
lets each text keep only windows that may be hits. Hits join the test hashes; each (stretch of text, item) is then verified once,
along every diagonal on which the two share a seed: some WINDOW consecutive words (all of a shorter item) must agree in at least
AGREE of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textbatch import ALNUM, map_text, mix, words_of

#: 1: the word is read; six of up to SPAN words each.
MASKS = ("11101011", "111111", "110110011", "101001111", "1111011", "11011011")
SPAN = 9
WINDOW, AGREE = 16, 0.8
BITMAP = 1 << 26
#: Words kept around a hit; enough for every window that holds it.
CONTEXT = WINDOW


def seeds(hashes: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, last position, hash) of each window under each mask, and of each run of as many words as short names."""
    at, end, out = [], [], []
    for m, mask in enumerate([*MASKS, *("1" * n for n in short)]):
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        acc = np.full(n, m + 1 if m < len(MASKS) else 1000 + len(mask), np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
        at.append(np.arange(n))
        end.append(np.arange(len(mask) - 1, len(hashes)))
        out.append(acc)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, end, [x.view(np.int64) for x in out]))


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    x = mix(hashes.view(np.uint64))
    return x % np.uint64(BITMAP), (x >> np.uint64(32)) % np.uint64(BITMAP)


def _own_seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of an item: one of its whole if it has fewer than SPAN words."""
    n = len(hashes)
    at, end, hashed = seeds(hashes, (n,) if 0 < n < SPAN else ())
    whole = (end - at == n - 1) & (np.arange(len(at)) == len(at) - 1) if n < SPAN else np.ones(len(at), bool)
    return at[whole], hashed[whole]


def diagonals(text: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Where the item's first word lies in the text, for every seed that both share. All places, where repetitions make more than those."""
    at, hashed = _own_seeds(item)
    t_at, _, t_hash = seeds(text, (len(item),) if len(item) < SPAN else ())
    order = np.argsort(hashed, kind="stable")
    low, high = np.searchsorted(hashed[order], t_hash, "left"), np.searchsorted(hashed[order], t_hash, "right")
    n = high - low
    if n.sum() > 8 * (len(text) + len(item)):
        return np.arange(1 - len(item), len(text))
    rows = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + low[rows]
    return np.unique(t_at[rows] - at[order][inner])


def agreement(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[float, int, int]:
    """(share of agreeing words, first, end) of the best window of item laid on text with its first word at diagonal; the earliest of equals."""
    low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
    size = min(WINDOW, len(item))
    if high - low < size:
        return 0.0, 0, 0
    same = np.concatenate([[0], np.cumsum(text[low + diagonal : high + diagonal] == item[low:high])])
    sums = same[size:] - same[:-size]
    at = int(sums.argmax())
    return float(sums[at]) / size, low + at + diagonal, low + at + diagonal + size


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, words, hash) of test items, their words and seeds."""

    def make():
        def f(data, offsets):
            w = words_of(data, offsets, ALNUM)
            own = [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
            return [pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())), pa.array([np.unique(_own_seeds(x)[1]) for x in own], pa.list_(pa.int64()))]

        return f

    return map_text(benchmark, text, (F.col(item_id).cast("long").alias("item"),), "words array<long>, hash array<long>", make)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_key, item, share, first, end): the best verified overlap of each text with each item.

    text_key is the md5 of the text; first and end count words (runs of letters and digits, from 0) of it. Null and empty
    texts, and items without words or an id, overlap with nothing; repeated texts and items are found once. Of windows
    that agree equally the first counts. Other columns of either table may have any name.
    """
    spark = docs.sparkSession
    items = materialize(_items(benchmark, item_id, item_text).where("item is not null and size(hash) > 0").dropDuplicates(["item", "words"]))
    short = tuple(sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < SPAN).distinct().collect()))  # SPAN - 1 numbers at most

    def bitmap(batches):  # one bitmap a task, of fixed size
        own = np.zeros(BITMAP, bool)
        for b in batches:
            for places in _places(b.column(0).to_numpy()):
                own[places] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(own), pa.int64())], names=["bit"])

    hashes = items.select(F.explode("hash").alias("hash")).distinct()
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    on = hashes.mapInArrow(bitmap, "bit long").groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(F.bit_or(set_bit).alias("v")).toPandas()  # BITMAP / 64 rows at most
    bits = np.zeros(BITMAP // 64, np.uint64)
    bits[on["at"].to_numpy(np.int64)] = on["v"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)

    def make():
        bits = shared.value
        on = lambda at: (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0

        def f(data, offsets):
            w = words_of(data, offsets, ALNUM)
            stretches: list[list] = [[] for _ in range(len(offsets) - 1)]
            if len(w.hash):
                pos, end, hashed = seeds(w.hash, short)
                one, two = _places(hashed)
                may = np.flatnonzero(on(one))
                may = may[on(two[may])]
                may = may[w.row[pos[may]] == w.row[end[may]]]
                pos, hashed = pos[may], hashed[may]
                order = np.argsort(pos, kind="stable")
                pos, hashed = pos[order], hashed[order]
                # Hits close to each other share a stretch.
                cut = np.flatnonzero((np.diff(pos) > CONTEXT) | (np.diff(w.row[pos]) > 0)) + 1
                for own, values in zip(np.split(pos, cut), np.split(hashed, cut), strict=True):
                    if len(own):
                        r = w.row[own[0]]
                        a, b = max(w.bounds[r], own[0] - CONTEXT), min(w.bounds[r + 1], own[-1] + SPAN + CONTEXT)
                        stretches[r].append({"at": int(a - w.bounds[r]), "words": w.hash[a:b].view(np.int64), "hash": np.unique(values)})
            kind = pa.struct([("at", pa.int64()), ("words", pa.list_(pa.int64())), ("hash", pa.list_(pa.int64()))])
            return [pa.array(stretches, pa.list_(kind))]

        return f

    kept = map_text(docs, text, (F.md5(text).alias("text_key"),), "stretches array<struct<at:long,words:array<long>,hash:array<long>>>", make)
    # Repeated texts have equal stretches.
    stretches = kept.where("size(stretches) > 0").dropDuplicates(["text_key"])
    stretches = materialize(stretches.select("text_key", F.explode("stretches").alias("s")).select("text_key", "s.*"))
    tests = materialize(items.select("item", F.explode("hash").alias("hash")).distinct())
    pairs = stretches.select("text_key", "at", F.explode("hash").alias("hash")).join(tests, "hash").select("text_key", "at", "item").distinct()
    checked = pairs.join(stretches.select("text_key", "at", "words"), ["text_key", "at"]).join(items.select("item", F.col("words").alias("own")), "item").select("text_key", "at", "item", "words", "own")

    def verify(batches):
        for b in batches:
            rows = []
            for key, at, item, words, own in zip(*(b.column(k).to_pylist() for k in ("text_key", "at", "item")), b.column("words"), b.column("own"), strict=True):
                words, own = words.values.to_numpy(), own.values.to_numpy()
                best = max(((s, -x, y) for s, x, y in (agreement(words, own, d) for d in diagonals(words.view(np.uint64), own.view(np.uint64)).tolist())), default=(0.0, 0, 0))
                if best[0] >= AGREE:
                    rows.append((key, item, best[0], at - best[1], at + best[2]))
            kinds = (("text_key", pa.string()), ("item", pa.int64()), ("share", pa.float64()), ("first", pa.int64()), ("end", pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[k for k, _ in kinds])

    found = checked.mapInArrow(verify, "text_key string, item long, share double, first long, end long")
    top = F.struct("share", (-F.col("first")).alias("early"), "end")
    return found.groupBy("text_key", "item").agg(F.max(top).alias("top")).select("text_key", "item", "top.share", (-F.col("top.early")).alias("first"), "top.end")


def leaked_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, share, first, end): the verified overlaps of find_leaks, for every row of docs that has them."""
    found = materialize(find_leaks(docs, benchmark, text, item_id, item_text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(text).alias("text_key"))
    return rows.join(found, "text_key").select("doc_id", F.col("item").alias("item_id"), "share", "first", "end")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text overlaps with an item; all columns pass through."""
    found = materialize(find_leaks(docs, benchmark, text, item_id, item_text).select(F.col("text_key").alias("af_key")).distinct())
    return docs.withColumn("af_key", F.md5(text)).join(found, "af_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
