"""Katz backoff language model over bigrams, counted, normalised and evaluated as joins of tables.

    p(w | h) = d_r r / C(h)               if (h, w) was seen r times in training, once is enough
             = alpha(h) p(w)              otherwise
    p(w)     = d_c c / N                  if w was seen c times, the rest of the mass for all unknown words together

d are Good-Turing discounts up to counts of GT_LIMIT, and alpha(h) = (1 - seen mass after h) / (1 - p of the words seen
after h), so that each history's probabilities sum to 1 exactly. A token's log probability unrolls the recursion
into table look-ups: log p(w) + log alpha(h), plus a correction for each (h, w) of the bigram table.

The HOT most frequent words and HOT_GRAMS most frequent bigrams, fixed numbers, go to every task, where they answer
most tokens; so no frequent word or pair is ever a shuffle key with many rows. All other words and pairs are asked for
in compressed packs, one for each run of texts and bucket of keys, and come back as sums for each text. Nothing that
grows with the corpus is held by the driver or by one task.

Pairs lie in buckets: by their second word where it is not hot, else by both. So the count of a word that is not hot is
the sum of its pairs' counts within its bucket (each token ends exactly one pair), one question about a pair brings the
word's own values too, and the table of bigrams is written by bucket and read for scoring without a shuffle. A history
has a bucket as if it were a word alone: the buckets of its pairs send their sums there, one row for each two buckets,
and get back what the pairs need of it. A group holds BUCKET tokens on average, and one word's share at most more: a word
outside the HOT ones has fewer than 1 / HOT of all tokens, and any history one row of sums for each bucket. Tables hold
a bucket in a row, its columns packed, so that pairs are never rows one by one. Intermediate tables are deleted, and
shuffles end, once the table that needs them is written.
"""

from __future__ import annotations

from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BucketedTable, batches_of, discard, materialize, workers_import_us
from .textbatch import SOLID, mix, text_chunks, words_of

HOT, HOT_GRAMS = 1 << 16, 1 << 18
GT_LIMIT = 5
#: Tokens of a run of texts that is packed at once, and of a bucket of keys on average.
RUN, BUCKET = 1 << 20, 1 << 20
#: Rows that a Python worker is handed at once; rows of whole buckets.
BATCH, BUCKETS_AT_ONCE = 1 << 11, 1 << 3
#: Most files of a table of buckets.
MOST_FILES = 1 << 16
#: Ids: hot words by rank, then these; other words are negative (their hash).
BEGIN, END, ALONE = HOT, HOT + 1, HOT + 2
_PRIME = (1 << 31) - 1


def pack(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes by byte planes, compressed: small numbers leave most planes empty."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, kind)
    flat = np.frombuffer(pa.decompress(raw[8:], n * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, n).T).view(kind).ravel()


class _Finder:
    """Places of numbers in a sorted array of distinct ones whose leading bits look random: these lead to within a few steps of the place."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, 0)
        bits = min(24, len(keys).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        n = np.bincount(self._slots(keys), minlength=1 << bits)
        self.first, self.steps = np.zeros(1 << bits, np.int32), int(n.max())
        np.cumsum(n[:-1], out=self.first[1:], dtype=np.int32)

    def _slots(self, x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, its place, else any) of each number of wanted."""
        at = self.first[self._slots(wanted)]
        last = len(self.keys) - 1
        for _ in range(self.steps - 1):
            at += (self.keys[at] < wanted) & (at < last)
        return (self.keys[at] == wanted) & (at < last), at


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15) * w.view(np.uint64)).view(np.int64)


def _bucket(h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return (np.where(w < 0, 0, np.mod(h, _PRIME) * 40503) + np.mod(w, _PRIME) * 30011) % n


def _grouped(bucket: np.ndarray, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, its places in order) of the buckets that occur: packs and time grow with the tokens, whatever the number of buckets."""
    sorted_ = bucket[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    return list(zip(sorted_[first].tolist(), np.split(order, first[1:]), strict=True)) if len(first) else []


def _histories(h: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of pairs that lie by history: the first place of each history, and (bucket, numbers of its histories) of the histories' own buckets."""
    # The complement differs from what it is the complement of.
    first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
    bucket = _bucket(np.zeros(len(first), np.int64), h[first], n)
    return first, _grouped(bucket, np.argsort(bucket, kind="stable"))


def discounts(counts: dict[int, int], least: int = 1, limit: int = GT_LIMIT) -> list[float]:
    """d_r for r from 0 to limit (those below least are 0), from the numbers of types by count; Katz's formula where it lies in (0, 1], else r less a fixed share."""
    n = [0, *(counts.get(r, 0) for r in range(1, limit + 2))]
    out = [0.0] * (limit + 1)
    cut = (limit + 1) * n[limit + 1] / n[1] if n[1] else 1.0
    share = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    for r in range(least, limit + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out[r] = d if 0 < d <= 1 else (r - min(share, 0.9)) / r
    return out


def _discount_column(count: Column, d: list[float]) -> Column:
    """d_r r of a count r."""
    of_small = F.element_at(F.array(*[F.lit(x) for x in d[1:]]), F.least(count, F.lit(len(d) - 1)).cast("int"))
    return F.when(count < len(d), of_small).otherwise(1.0) * count


def _discounted(count: np.ndarray, d: list[float]) -> np.ndarray:
    """d_r r of counts r."""
    return np.append(d, 1.0)[np.minimum(count, len(d))] * count


def _step(count: np.ndarray) -> np.ndarray:
    """Counts from 1 by the logarithm, in steps that a histogram can hold."""
    return np.floor(np.log2(count) * 8).astype(np.int64)


def _least_step(sizes: dict[int, int], most: int) -> int | None:
    """The step from which on there are at most that many, by the number in each step."""
    bound, total = None, 0
    for at, n in sorted(sizes.items(), reverse=True):
        if total + n > most:
            break
        bound, total = at, total + n
    return bound


class _Runs:
    """Consecutive texts until there are RUN tokens, and word ids."""

    def __init__(self, hot: np.ndarray | None, f=None):
        """f(first word of each text and the end, hashes): what is kept of a chunk, the hashes by default."""
        self.f = f or (lambda bounds, hashes: hashes)
        self.order = np.argsort(hot) if hot is not None else None
        self.hot = _Finder(hot[self.order]) if hot is not None else None

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        met, at = self.hot.find(hashes)
        ids = hashes | np.int64(-(1 << 63))
        ids[met] = self.order[at[met]]
        return ids

    def read(self, batches, n_keep: int):
        """Runs of texts as lists of chunks (kept rows, first word of each text and the end, f of both and the hashes of their words); the text is the last column.

        f is applied to each chunk as it is read, so that what it needs on the way is held for one chunk and not for a run.
        """
        run, total = [], 0
        for batch in batches:
            for a, b, data, offsets in text_chunks(batch.column(n_keep)):
                w = words_of(data, offsets, SOLID)
                # Copies: slices would hold the texts of their batch.
                kept = pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(np.arange(a, b))) for k in range(n_keep)], names=[str(k) for k in range(n_keep)])
                bounds, hashes = w.bounds, w.hash.view(np.int64)
                total += len(hashes) + b - a
                del w
                run.append((kept, bounds, self.f(bounds, hashes)))
                if total >= RUN:
                    yield run
                    run, total = [], 0
        if run:
            yield run

    def bigrams(self, bounds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, h, w) of every token, the end of each text included."""
        n = len(bounds) - 1
        size = np.diff(bounds) + 1
        text = np.repeat(np.arange(n), size)
        last = np.cumsum(size) - 1
        w = np.full(len(text), END, np.int64)
        inner = np.ones(len(text), bool)
        inner[last] = False
        w[inner] = self.ids(hashes)
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[last - size + 1] = BEGIN
        return text, h, w


def _sums(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, the sum of its weights, or how often it occurs), in the keys' order."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    if weight is None or not len(first):
        return order[first], np.diff(first, append=len(key))
    return order[first], np.add.reduceat(weight[order], first)


def count_words(train: DataFrame) -> DataFrame:
    """(hash, n) of the words of train (text); each text's end is the word END."""

    def run(batches):
        held: list = []

        def merged():
            key, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            first, total = _sums(key, n)
            return key[first], total

        for chunks in _Runs(None).read(batches, 0):
            hashes = np.concatenate([x for _, _, x in chunks])
            first, n = _sums(hashes)
            held.append((np.append(hashes[first], END), np.append(n, sum(len(bounds) - 1 for _, bounds, _ in chunks))))
            if sum(len(k) for k, _ in held) > RUN:
                held[:] = [merged()]
                if len(held[0][0]) > RUN:
                    yield _table(hash=held[0][0], n=held[0][1])
                    held.clear()
        if held:
            key, n = merged()
            yield _table(hash=key, n=n)

    return train.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def count_bigrams(train: DataFrame, hot, n_buckets: int, n_files: int) -> DataFrame:
    """A row for each bucket: its bigrams by history (packs h, w, r and c, the count of w where it is not hot, else 0), types, the number of bigrams of each count r up to GT_LIMIT + 1, and steps, of each step of r. A bucket's row lies in the part of n_files that its number's hash names."""

    def count(batches):
        runs = _Runs(hot.value, lambda bounds, hashes: runs.bigrams(bounds, hashes)[1:])
        for chunks in runs.read(batches, 0):
            h, w = (np.concatenate([x[k] for _, _, x in chunks]) for k in (0, 1))
            chunks.clear()
            first, n = _sums(_pair(h, w))
            h, w = h[first], w[first]
            bucket = _bucket(h, w, n_buckets)
            own = _grouped(bucket, np.argsort(bucket))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int32()), *(pa.array([pack(x[at]) for _, at in own], pa.binary()) for x in (h, w, n))], names=["bucket", "h", "w", "n"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        h, w, n = (np.concatenate([unpack(x.as_py()) for x in t.column(k)]) for k in ("h", "w", "n"))
        first, r = _sums(_pair(h, w), n)
        # By history: the table is smaller so, and what follows finds the histories without sorting.
        by_h = np.argsort(h[first])
        first = first[by_h]
        h, w, r = h[first], w[first], r[by_h]
        del n, first, by_h
        # All pairs that end in a word which is not hot are here, so their counts add up to the word's.
        c, tail = np.zeros(len(w), np.int64), np.flatnonzero(w < 0)
        _, own = np.unique(w[tail], return_inverse=True)
        if len(tail):
            c[tail] = np.bincount(own, r[tail])[own]
        lists = [np.bincount(r[r <= GT_LIMIT + 1], minlength=GT_LIMIT + 2), np.bincount(_step(r))]
        return pa.table([[key[0].as_py()], *([pack(x)] for x in (h, w, r, c)), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in lists)], schema=pa.schema(fields))

    fields = [("bucket", pa.int32()), *((k, pa.binary()) for k in ("h", "w", "r", "c")), *((k, pa.list_(pa.int64())) for k in ("types", "steps"))]
    packs = train.mapInArrow(count, "bucket int, h binary, w binary, n binary")
    return packs.repartition(n_files, "bucket").groupBy("bucket").applyInArrow(add, "bucket int, h binary, w binary, r binary, c binary, types array<long>, steps array<long>")


def normalise(grams: DataFrame, n_buckets: int, n_files: int, hot_p, p_of, d2: list[float], least_step: int | None) -> DataFrame:
    """A row for each bucket: its bigrams and, with h = ALONE, its words that are not hot (packs h, w, r, delta and count, see Model), the keys of its bigrams of least_step or more (often, often_delta) and its hot histories (hot, hot_alpha). Rows lie in the parts in which those of grams are.

    grams: rows of count_bigrams(), read from a table of n_files parts. hot_p: broadcast p of hot words by id; p_of(counts): p of other words.
    """

    def pairs(row: dict) -> tuple[np.ndarray, ...]:
        """h, w, r and the pairs' discounted counts and p(w)."""
        h, w, r, c = (unpack(row[k]) for k in ("h", "w", "r", "c"))
        of_hot = w >= 0
        return h, w, r, _discounted(r, d2), np.where(of_hot, hot_p.value[np.where(of_hot, w, 0)], p_of(c))

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, _, r, mass, p = pairs(row)
                first, parts = _histories(h, n_buckets)
                sums = [h[first], *(np.add.reduceat(x, first).view(np.int64) for x in (mass, p, r))]
                packs = [pack(np.concatenate([x[at] for x in sums])) for _, at in parts]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([row["bucket"]] * len(parts), pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "asker", "sums"])

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        """What each asker's histories cost their pairs, in its order; a row of the bucket itself has the histories' values."""
        rows = sorted(t.to_pylist(), key=lambda row: row["asker"])
        sums = [unpack(row.pop("sums")).reshape(4, -1) for row in rows]
        ids, at = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
        mass, p = (np.bincount(at, np.concatenate([x[k] for x in sums]).view(np.float64)) for k in (1, 2))
        n = np.bincount(at, np.concatenate([x[3] for x in sums]))
        # Each token but the end is a history once, so the counts of its pairs add up to its own.
        total = np.where(mass < n - 1e-9, n, n + 1)
        log_alpha = np.log10((1 - mass / total) / np.maximum(1 - p, 1e-12))
        costs = np.split((np.log10(total) + log_alpha)[at], np.cumsum([x.shape[1] for x in sums])[:-1])
        own = key[0].as_py()
        return pa.table(
            {
                "bucket": pa.array([*(row["asker"] for row in rows), own], pa.int32()),
                "of": pa.array([own] * (len(rows) + 1), pa.int32()),
                "cost": pa.array([*map(pack, costs), None], pa.binary()),
                **{k: pa.array([None] * len(rows) + [pack(x)], pa.binary()) for k, x in (("id", ids), ("n", n.astype(np.int64)), ("log_alpha", log_alpha))},
            }
        )

    def complete(key: tuple, answers: pa.Table, own: pa.Table) -> pa.Table:
        none, no_values = np.zeros(0, np.int64), np.zeros(0)
        h, w, r, delta, often, hot, hot_alpha = none, none, none, no_values, none, none, no_values
        count, answered = none, answers.to_pylist()
        for row in own.to_pylist():
            h, w, r, mass, p = pairs(row)
            first, parts = _histories(h, n_buckets)
            places, cost = dict(parts), np.zeros(len(first))
            for x in answered:
                if x["cost"] is not None:
                    cost[places[x["of"]]] = unpack(x["cost"], np.float64)
            delta = np.log10(mass) - np.repeat(cost, np.diff(first, append=len(h))) - np.log10(p)
            often = np.flatnonzero(_step(r) >= least_step) if least_step is not None else none
            del mass, p
        often, often_delta, count = _pair(h[often], w[often]), delta[often], np.zeros(len(h), np.int64)
        for x in answered:
            if x["id"] is not None:
                ids, n, log_alpha = unpack(x["id"]), unpack(x["n"]), unpack(x["log_alpha"], np.float64)
                tail = ids < 0
                hot, hot_alpha, ids, n = ids[~tail], log_alpha[~tail], ids[tail], n[tail]
                h, w, r = np.append(h, np.full_like(ids, ALONE)), np.append(w, ids), np.append(r, np.zeros_like(ids))
                delta, count = np.append(delta, np.log10(p_of(n)) + log_alpha[tail]), np.append(count, n)
        packs = {"h": h, "w": w, "r": r, "delta": delta, "count": count, "often": often, "often_delta": often_delta, "hot": hot, "hot_alpha": hot_alpha}
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([pack(x)], pa.binary()) for k, x in packs.items()}})

    asked = grams.select("bucket", "h", "w", "r", "c").mapInArrow(ask, "bucket int, asker int, sums binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "bucket int, of int, cost binary, id binary, n binary, log_alpha binary")
    own = grams.select("bucket", "h", "w", "r", "c")
    fields = ", ".join(f"{k} binary" for k in ("h", "w", "r", "delta", "count", "often", "often_delta", "hot", "hot_alpha"))
    return answers.repartition(n_files, "bucket").groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(complete, f"bucket int, {fields}")


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, most of them at most: all from a count on that a histogram over logarithms (a few hundred rows) gives. Nothing is sorted."""
    step = F.floor(F.log2(F.col(count)) * 8)
    bound = _least_step({r["step"]: r["count"] for r in rows.groupBy(step.alias("step")).count().collect()}, most)
    return rows.where(F.lit(False)) if bound is None else rows.where(step >= bound)


class Model:
    """Tables and numbers of a trained model.

    hot_words (w, n, log_p, log_alpha) and bigrams (h, w, r, delta, count, bucket) are tables; delta is what a seen pair adds to
    log p(w) + log alpha(h). table is written and holds, packed in a row for each bucket, the bigrams and, with h = ALONE, each word w that
    is not hot: delta is its log p + log alpha and count its count. hot: hashes of hot words by rank; hot_values: their n, log_p and
    log_alpha by id.
    """

    def __init__(self, train: DataFrame, hot_words: int = HOT, hot_grams: int = HOT_GRAMS, bucket: int = BUCKET):
        """train: one column of texts. hot_words (HOT at most) and hot_grams bound what every task holds."""
        spark = train.sparkSession
        workers_import_us(spark)
        words = materialize(count_words(train))
        totals = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = int(totals["n"] or 0), int(totals["v"])
        top = most_frequent(words.where(F.col("hash") != END), "n", hot_words).toPandas().sort_values(["n", "hash"], ascending=[False, True])  # hot_words rows at most
        self.hot = top["hash"].to_numpy(np.int64)
        self.shared_hot = spark.sparkContext.broadcast(self.hot)
        self.n_buckets = max(1, -(-self.tokens // bucket))
        texts = words.where(F.col("hash") == END).select("n").first()
        self.texts = int(texts["n"]) if texts else 0

        counts = {r["n"]: r["count"] for r in words.where(F.col("n") <= GT_LIMIT + 1).groupBy("n").count().collect()}
        d1 = discounts(counts)
        known = float(words.agg(F.sum(_discount_column(F.col("n"), d1))).first()[0] or 0.0) / max(1, self.tokens)
        discard(words)
        # Without singletons nothing would be left for unknown words.
        self.scale = 1.0 if known < 1 else self.tokens / (self.tokens + 1)
        self.unknown = log10(max(1 - known * self.scale, 1e-12)) if self.tokens else 0.0
        of_token = self.scale / max(1, self.tokens)
        p_of = lambda count: _discounted(count, d1) * of_token
        # The words that fit every task: hot ones, END and BEGIN.
        ids, n = np.append(np.arange(len(top)), [END, BEGIN]), np.append(top["n"].to_numpy(np.int64), [self.texts] * 2)
        hot_p = np.zeros(ALONE)
        hot_p[ids] = p_of(n)

        n_files = min(-(-self.tokens // BUCKET) or 1, MOST_FILES)
        written = BucketedTable(spark, "bucket", n_files)
        written.append(count_bigrams(train, self.shared_hot, self.n_buckets, n_files), in_parts=True)
        grams = written.read()
        sums = lambda k: {r["pos"]: int(r["n"]) for r in grams.select(F.posexplode(k).alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
        d2 = discounts(sums("types"))
        table = BucketedTable(spark, "bucket", n_files)
        with batches_of(spark, BUCKETS_AT_ONCE):
            table.append(normalise(grams, self.n_buckets, n_files, spark.sparkContext.broadcast(hot_p), p_of, d2, _least_step(sums("steps"), hot_grams)), in_parts=True)
        written.drop()
        self.table = table.read()

        shared = self.table.select("often", "often_delta", "hot", "hot_alpha").collect()  # hot_grams and hot_words entries at most
        one = lambda k, kind=np.int64: np.concatenate([np.zeros(0, kind), *(unpack(r[k], kind) for r in shared)])
        key = one("often")
        order = np.argsort(key)
        self.hot_grams = key[order], one("often_delta", np.float64)[order]
        log_p = np.log10(hot_p, where=hot_p > 0, out=np.zeros(ALONE))
        log_p[BEGIN] = 0.0
        self.hot_values = values = np.zeros((ALONE + 1, 3))
        values[ids, 0], values[ids, 1], values[one("hot"), 2] = n, log_p[ids], one("hot_alpha", np.float64)
        some = (ids == BEGIN) | (n > 0)
        ids, n = ids[some], n[some]
        self.hot_words = spark.createDataFrame(pa.table({"w": ids, "n": n, "log_p": pa.array(values[ids, 1], mask=ids == BEGIN), "log_alpha": values[ids, 2]}))

    @property
    def bigrams(self) -> DataFrame:
        def rows(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    h, w, r, count = (unpack(row[k]) for k in ("h", "w", "r", "count"))
                    yield _table(h=h, w=w, r=r, delta=unpack(row["delta"], np.float64), count=count, bucket=np.full(len(h), row["bucket"], np.int32))

        packed = self.table.select("h", "w", "r", "delta", "count", "bucket")
        return packed.mapInArrow(rows, "h long, w long, r long, delta double, count long, bucket int").where(F.col("h") != ALONE)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of each row of docs; see the query's contract."""
    workers_import_us(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.hot, model.hot_values, *model.hot_grams))
    tokens, types, unknown, n_buckets = model.tokens, model.types, model.unknown, model.n_buckets
    base_of = lambda c: np.log10((c + 1) / (tokens + types + 1))
    kinds = {"run": pa.int64(), "bucket": pa.int32(), **{k: pa.binary() for k in ("h", "w", "text", "n", "ids", "meta", "own")}}

    def ask(batches):
        hot, values, gram_keys, gram_values = shared.value
        grams, number = _Finder(gram_keys), TaskContext.get().partitionId() << 32

        def look_up(bounds, hashes):
            """(sums of each text, (text, h, w, n) of what is asked for) of a chunk."""
            at, h, w = runs.bigrams(bounds, hashes)
            n_texts = len(bounds) - 1
            of_hot = w >= 0
            count = np.where(of_hot, values[np.where(of_hot, w, ALONE), 0], 0)
            # What is known here: hot words, hot histories, hot pairs.
            log_p = np.where(of_hot, np.where(count > 0, values[np.where(of_hot, w, ALONE), 1], unknown), 0.0)
            log_p += np.where(h >= 0, values[np.where(h >= 0, h, ALONE), 2], 0.0)
            met, where = grams.find(_pair(h, w))
            log_p[met] += gram_values[where[met]]
            own = [np.bincount(at, x, n_texts) for x in (log_p, np.where(of_hot, base_of(count), 0.0), (count > 0).astype(float), np.ones(len(at)))]
            # Other pairs, and words that are not hot (alone where the pair is known), are asked for once for each text.
            asked = ~met | ~of_hot
            ask_text, ask_w = at[asked], w[asked]
            ask_h = np.where(met[asked], ALONE, h[asked])
            first, n = _sums(_pair(_pair(ask_h, ask_w), ask_text.astype(np.int64)))
            return own, (ask_text[first], ask_h[first], ask_w[first], n)

        runs = _Runs(hot, look_up)
        for chunks in runs.read(batches, 2):
            first_text = np.cumsum([0, *(len(bounds) - 1 for _, bounds, _ in chunks)])
            n_texts = int(first_text[-1])
            kept = pa.Table.from_batches([x for x, _, _ in chunks])
            own = [np.concatenate([x[k] for _, _, (x, _) in chunks]) for k in range(4)]
            meta = [np.asarray(kept.column(0).fill_null(0).to_numpy(), np.int64), np.asarray(kept.column(0).is_null().to_numpy(), np.int64), np.asarray(kept.column(1).to_numpy(), np.int64)]
            ask_text = np.concatenate([x[0] + t for t, (_, _, (_, x)) in zip(first_text, chunks, strict=False)])
            ask_h, ask_w, n = (np.concatenate([x[k] for _, _, (_, x) in chunks]) for k in (1, 2, 3))
            chunks.clear()
            bucket = _bucket(ask_h, ask_w, n_buckets)
            parts = _grouped(bucket, np.argsort(bucket * n_texts + ask_text))
            rows = {k: [] for k in kinds}
            for b, i in parts:
                for k, v in zip(kinds, (number, b, pack(ask_h[i]), pack(ask_w[i]), pack(np.diff(ask_text[i], prepend=0).astype(np.int64)), pack(n[i]), None, None, None), strict=True):
                    rows[k].append(v)
            # The run's own sums pass through some bucket unchanged.
            for k, v in zip(kinds, (number, (number ^ (number >> 32)) % n_buckets, None, None, None, None, pack(meta[0]), pack(np.concatenate(meta[1:])), pack(np.concatenate(own))), strict=True):
                rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], kind) for k, kind in kinds.items()], names=list(kinds))
            number += 1

    answer_schema = "run long, text binary, sums binary, ids binary, meta binary, own binary"

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        held = table.to_pylist()
        of = lambda k, kind=np.int64: np.concatenate([np.zeros(0, kind), *(unpack(row.pop(k), kind) for row in held)])
        key = _pair(of("h"), of("w"))
        order = np.argsort(key)
        known = _Finder(key[order])
        # A last entry of no word, so that there is one.
        value, count = np.append(of("delta", np.float64)[order], 0.0), np.append(of("count")[order], 0)
        out: dict[str, list] = {k: [] for k in ("run", "text", "sums", "ids", "meta", "own")}
        for row in asked.to_pylist():
            if row["own"] is not None:
                found = (row["run"], None, None, row["ids"], row["meta"], row["own"])
            else:
                h, w, text_no, n = (unpack(row[k]) for k in ("h", "w", "text", "n"))
                text_no = np.cumsum(text_no)
                met, at = known.find(_pair(h, w))
                v = np.where(met & (h != ALONE), value[at], 0.0)
                # The bucket of a word that is not hot has its own values too; those of an unseen word are not there.
                alone = w < 0
                met, at = known.find(_pair(np.full_like(w, ALONE), w))
                v += np.where(alone, np.where(met, value[at], unknown), 0.0)
                c = np.where(met & alone, count[at], 0)
                texts, group = np.unique(text_no, return_inverse=True)
                sums = [np.bincount(group, x * n, len(texts)) for x in (v, np.where(alone, base_of(c), 0.0), c > 0)]
                found = (row["run"], pack(np.diff(texts, prepend=0).astype(np.int64)), pack(np.concatenate(sums)), None, None, None)
            for k, x in zip(out, found, strict=True):
                out[k].append(x)
        return pa.table({k: pa.array(v, pa.int64() if k == "run" else pa.binary()) for k, v in out.items()})

    def finish(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(r for r in rows if r["own"] is not None)
        ids, (null, out), sums = unpack(own["ids"]), unpack(own["meta"]).reshape(2, -1), unpack(own["own"], np.float64).reshape(4, -1).copy()
        for r in sorted((r for r in rows if r["own"] is None), key=lambda r: (r["text"], r["sums"])):
            at = np.cumsum(unpack(r["text"]))
            sums[:3, at] += unpack(r["sums"], np.float64).reshape(3, -1)
        return pa.table({"doc_id": pa.array(ids, mask=null > 0), "held_out": pa.array(out > 0), "n_tokens": pa.array(sums[3].astype(np.int64)), "n_known": pa.array(sums[2].astype(np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0])})

    asked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (held_out if held_out is not None else F.lit(False)).alias("held_out"), F.col(text).alias("t")).mapInArrow(ask, "run long, bucket int, h binary, w binary, text binary, n binary, ids binary, meta binary, own binary")
    # log alpha of a tail word counts where the word is a history, once for each time it occurs: together with log p.
    table = model.table.select("bucket", "h", "w", "delta", "count")
    found = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(answer, answer_schema)
    return found.groupBy("run").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def is_held_out(doc_id: str) -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 7; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **model_options: int) -> DataFrame:
    """score() of all rows of docs by a model of those that aren't held out, with train_tokens (long).

    A null or empty text is its end token alone. An empty table gives no rows; without training rows every token is
    unknown and has probability 1 as the one kind of token there is.
    """
    out = is_held_out(doc_id)
    with batches_of(docs.sparkSession, BATCH):
        model = Model(docs.where(~out).select(F.col(text).alias("t")), **model_options)
        return materialize(score(docs, model, doc_id, text, out).withColumn("train_tokens", F.lit(model.tokens).cast("long")))
