"""Packing documents into token sequences by order-preserving dynamic programming.

The documents of a partition, in order, form one stream of tokens. Windows of up to SIZE tokens are cut from it
at document ends, sentence ends, or, inside long sentences, on a grid. A window's cost is its padding plus the penalty
of the cut it ends with. Padding grows linearly with where a window starts, so the cheapest start
of a window is the head of a monotone queue, and a stretch of n possible cuts takes O(n) steps. A window of a power
of two needs no padding, whatever SIZE is. Streams are solved in segments of SEGMENT tokens, so memory is bounded; each
segment begins with the last open window of the one before.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .storage import workers_import_us

SIZE = 2048
SEGMENT = 1 << 18
#: Penalties of cutting a document at the end of a sentence, and inside one, in tokens of padding.
SENTENCE_CUT, WORD_CUT = 4.0, 20.0
GRID = 32
END_ID = 1
#: What each window costs besides, so that a few tokens of padding aren't saved by many short windows.
WINDOW = 16.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a byte-level BPE vocabulary in the tokenizers library's file format.

    The tiktoken library, given the same vocabulary as ranks, finds the same ids several times faster. It serves files whose
    pre-tokenizer is the one of PATTERN and whose merges are ordered by their products' ids; others are read by tokenizers alone. So are texts that may
    hold a special token's string, which tokenizers reads as special tokens, and texts with a run of LONG_SPACE white-space characters, whose
    look-ahead would take tiktoken's stack beyond its limit.
    """

    #: Fixed value: the pre-tokenizer's pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LONG_SPACE = 1 << 15

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # Printable Latin-1 characters stand for their own bytes, those from U+0100 on for the others in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.space = re.compile(rf"\s{{{self.LONG_SPACE}}}")
        self.ends = [i for token, i in vocabulary.items() if re.search(r"[.!?\n]", token.translate({0x10A: "\n"}))]  # U+010A stands for a line's end
        self.fast = None
        if self._serves(json.loads(self.tokenizer.to_str())):
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _serves(spec: dict) -> bool:
        """Whether tiktoken finds the ids of this tokenizer."""
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] is not None or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("truncation"):
            return False
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        products = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        return all(a < b for a, b in zip(products, products[1:], strict=False))

    def __call__(self, text: str) -> np.ndarray:
        slow = self.fast is None or self.special.search(text) or (len(text) >= self.LONG_SPACE and self.space.search(text))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if slow else self.fast(text), np.uint32)

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether a sentence may end after it: it holds a full stop, an exclamation or question mark, or a line's end."""
        found = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        found[self.ends] = True
        return found


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into at (increasing positions from 0, the first a given start) of the cheapest cuts up to the last one."""
    n = len(at)
    cost, came = [0.0] * n, [0] * n
    position, fee = at.tolist(), penalty.tolist()
    where = {p: i for i, p in enumerate(position)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    queue: deque = deque([(0.0, 0)])
    for i in range(1, n):
        p = position[i]
        while position[queue[0][1]] < p - size:
            queue.popleft()
        value, j = queue[0]
        best = value + size - p  # the first of the cheapest
        for w in powers:
            k = where.get(p - w)
            if k is not None and cost[k] < best:
                best, j = cost[k], k
        cost[i], came[i] = best + fee[i] + WINDOW, j
        value = cost[i] + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    cuts, i = [], n - 1
    while i:
        cuts.append(i)
        i = came[i]
    return cuts[::-1]


class _Stream:
    """Pieces of one partition's sequences, segment by segment."""

    def __init__(self, size: int, ends: np.ndarray, first_sequence: int):
        self.size, self.ends, self.sequence = size, ends, first_sequence
        self.docs: list[list] = []  # [keep, ids not yet given out, ids given out so far, ids in all]
        self.held = 0

    def add(self, keep: tuple, ids: np.ndarray) -> None:
        self.docs.append([keep, ids, 0, len(ids)])
        self.held += len(ids)

    def pieces(self, last: bool) -> list[tuple]:
        """(keep, start, ids, doc tokens, sequence, offset) of the windows that are settled."""
        if not self.docs:
            return []
        ids = np.concatenate([d[1] for d in self.docs])
        doc_end = np.cumsum([len(d[1]) for d in self.docs])
        fee = np.full(len(ids) + 1, np.inf)
        fee[1:][self.ends[ids]] = SENTENCE_CUT
        fee[doc_end] = 0.0
        fee[0] = 0.0
        known = np.flatnonzero(np.isfinite(fee))
        # No two cuts on offer are further apart than a sequence is long.
        grid = min(GRID, self.size)
        long = np.flatnonzero(np.diff(known) > (2 * grid if 2 * grid <= self.size else grid))
        for a, b in zip(known[long], known[long + 1], strict=True):
            fee[a + grid : b : grid] = WORD_CUT
        at = np.flatnonzero(np.isfinite(fee))
        cuts = at[best_cuts(at, fee[at], self.size)]
        if not last:
            cuts = cuts[:-1] if len(cuts) > 1 else cuts[:0]
        out, begin, d, left = [], 0, 0, 0  # left: first position of document d
        for end in map(int, cuts):
            offset = 0
            while begin < end:
                keep, own, given, total = self.docs[d]
                take = min(end, int(doc_end[d])) - begin
                out.append((keep, given, own[begin - left : begin - left + take], total, self.sequence, offset))
                self.docs[d][2] += take
                offset, begin = offset + take, begin + take
                if begin == doc_end[d]:
                    d, left = d + 1, begin
            self.sequence += 1
        rest = self.docs[d:]
        if rest and begin > left:
            rest[0][1] = rest[0][1][begin - left :]
        self.docs, self.held = rest, sum(len(x[1]) for x in rest)
        return out


def pack(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", size: int = SIZE, vocabulary: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """keep columns and, per piece: start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is its end token alone; a text of any length is packed whole, over as many sequences as it fills. Rows that repeat, in id or
    text, are packed each for itself; other columns of docs may have any name, keep may not name one of the new columns, and an empty table gives no pieces. Each partition of docs is packed in its own order into sequences of
    its own, so nothing is shuffled and a lost partition is packed again with the same result where docs is reread
    from files. sequence_id is the partition's number times 2^33 plus the sequence's number there.
    """
    from pyspark.sql import types as T

    workers_import_us(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    names = list(keep)
    picked = docs.select(*names)
    fields = T.StructType.fromDDL("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    schema = T.StructType([*picked.schema.fields, *fields.fields])

    def run(batches):
        encode = Encoder(path)
        kinds, stream = None, None

        def table(found: list[tuple]):
            kept = [pa.array([x[0][k] for x in found], kind) for k, kind in enumerate(kinds)]
            own = [x[2].astype("<u4") for x in found]
            return pa.RecordBatch.from_arrays([*kept, pa.array([x[1] for x in found], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.int64()), pa.array([x[5] for x in found], pa.int64())], names=schema.names)

        for batch in batches:
            if stream is None:
                kinds = [batch.column(k).type for k in range(len(names))]
                stream = _Stream(size, encode.sentence_ends(), TaskContext.get().partitionId() << 33)
            columns = [batch.column(k).to_pylist() for k in range(len(names))]
            for r, scalar in enumerate(batch.column(len(names))):
                ids = encode(scalar.as_py() or "")
                stream.add(tuple(c[r] for c in columns), np.append(ids, np.uint32(END_ID)))
                if stream.held >= segment:
                    yield table(stream.pieces(False))
        if stream is not None:
            yield table(stream.pieces(True))

    return docs.select(*names, docs[text].alias("af_text")).mapInArrow(run, schema)
