"""Phrase collocations by level-wise passes over the corpus (Apriori).

Pass k counts phrases of k words, but only where both phrases of k - 1 words inside are frequent. Tasks know the frequent
ones by a bitmap that is broadcast: of a size bounded by MOST_BITS, filled by Spark from the written table of the level before. A phrase
that the bitmap lets through by chance costs a row and is dropped by its own count, so results are exact at every size. Tasks count
exact words of a few megabytes of text by numpy; Spark sums these counts by language and phrase, drops rare phrases and writes the level.
Cuts are scored by joining the level tables, in decimals.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, workers_import_us
from .textbatch import mix, text_chunks, words_of

MIN_COUNT, LONGEST, TOP, INSIDE_PERCENT = 10, 3, 2000, 50
LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 27, 16
#: Bytes of text that a task counts at once, and rows of a batch of counts.
CHUNK, BATCH = 1 << 21, 1 << 15
#: Scores run from 0 to 10^6; the best of a language are looked for from the top in steps of this.
STEP = 1000
NO_LANG = "und"

_codes = np.arange(256)
#: Bytes that end a piece, and bytes of words.
BREAK = np.isin(_codes, list(b".,;:!?")) | ((_codes >= 0x0A) & (_codes <= 0x0D))
WORD = ~(BREAK | (_codes == 0x20) | (_codes == 0x09))


def _hashes(values: pa.Array) -> np.ndarray:
    return pd.util.hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(values) else np.zeros(0, np.uint64)


def _fold(total: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase (first of its language alone) and one more word."""
    return mix(total * np.uint64(0x9E3779B97F4A7C15) + word)


class _Bitmap:
    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.mask = words, np.uint64(bits - 1)

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        at = hashed & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _frequent(level: DataFrame) -> _Bitmap:
    """The bitmap of a level table's phrases: a power of two of bits, BITS_EACH a phrase, MOST_BITS at most."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_EACH * level.count()):
        bits *= 2

    def places(batches):
        for b in batches:
            total = _hashes(b.column(0))
            words = pc.split_pattern(b.column(1), " ")
            lengths, parts = pc.list_value_length(words).to_numpy(zero_copy_only=False), words.flatten().dictionary_encode()
            hashed = _hashes(parts.dictionary)[parts.indices.to_numpy()]
            first = np.cumsum(lengths) - lengths
            for k in range(int(lengths.max(initial=0))):
                on = lengths > k
                total[on] = _fold(total[on], hashed[first[on] + k])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(total & np.uint64(bits - 1)).astype(np.int64))], names=["bit"])

    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    found = level.select("lang", "phrase").mapInArrow(places, "bit long").groupBy(F.floor(F.col("bit") / 64).alias("at")).agg(F.bit_or(set_bit).alias("v")).toPandas()  # MOST_BITS / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[found["at"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64).view(np.uint64)
    return _Bitmap(words, bits)


def _count_chunk(langs: np.ndarray, names: pa.Array, data: np.ndarray, offsets: np.ndarray, size: int, frequent: _Bitmap | None) -> list[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(language, phrase, count) columns of the phrases of size words in rows of text; langs are their indices into names. Of single words, the phrase '' counts all."""
    w = words_of(data, offsets, WORD, hashed=False)
    n = len(w.start)
    if not n:
        return []
    # Words side by side without what stands between them, as one Arrow column.
    spelled = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)), pa.py_buffer(w.data[WORD[w.data]])).dictionary_encode()
    spelling = spelled.indices.to_numpy().astype(np.int64)
    lang = langs[w.row].astype(np.int64)
    _, first, word = np.unique(lang * len(spelled.dictionary) + spelling, return_index=True, return_inverse=True)
    kinds = len(first)
    if size == 1:
        in_all = np.bincount(lang, minlength=len(names))
        own = np.flatnonzero(in_all)
        words = (names.take(pa.array(lang[first])), spelled.dictionary.take(pa.array(spelling[first])), np.bincount(word, minlength=kinds))
        return [words, (names.take(pa.array(own)), pa.array([""] * len(own), pa.large_string()), in_all[own])]
    # Pieces: rows cut at the bytes that end one.
    piece = np.cumsum(BREAK[w.data])[w.start] + w.row
    together = lambda k: piece[: n - k + 1] == piece[k - 1 :]  # noqa: E731  # whether k words from each place lie in one piece
    phrase, example, length = word, first, 1
    while length < size - 1:
        length += 1
        at = np.flatnonzero(together(length) & (phrase[: n - length + 1] >= 0)) if n >= length else np.zeros(0, np.int64)
        _, one, own = np.unique(phrase[at] * kinds + word[at + length - 1], return_index=True, return_inverse=True)
        phrase, example = np.full(n, -1, np.int64), at[one]
        phrase[at] = own
    total = _hashes(names)[lang[example]]
    hashed = _hashes(spelled.dictionary)
    for k in range(length):
        total = _fold(total, hashed[spelling[example + k]])
    on = np.append(frequent.holds(total), False)[phrase]  # a phrase of -1 takes the last
    if n < size:
        return []
    at = np.flatnonzero(together(size) & on[: n - size + 1] & on[1 : n - size + 2])
    _, one, count = np.unique(phrase[at] * kinds + word[at + size - 1], return_index=True, return_counts=True)
    example = at[one]
    parts = [spelled.dictionary.take(pa.array(spelling[example + k])) for k in range(size)]
    return [(names.take(pa.array(lang[example])), pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())), count)]


def count_phrases(docs: DataFrame, size: int, frequent: _Bitmap | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, n): occurrences of the phrases of size words whose first and last size - 1 words frequent holds; of single words all, with the phrase '' for their sum."""
    spark = docs.sparkSession
    workers_import_us(spark)
    shared = spark.sparkContext.broadcast(frequent) if frequent else None

    def run(batches):
        for b in batches:
            own = b.column(0).dictionary_encode()
            langs = own.indices.to_numpy(zero_copy_only=False)
            for start, end, data, offsets in text_chunks(b.column(1), CHUNK):
                for names, phrases, count in _count_chunk(langs[start:end], own.dictionary, data, offsets, size, shared and shared.value):
                    found = pa.RecordBatch.from_arrays([names.cast(pa.string()), phrases.cast(pa.string()), pa.array(count.astype(np.int64))], names=["lang", "phrase", "n"])
                    yield from (found.slice(a, BATCH) for a in range(0, found.num_rows, BATCH))

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> list[DataFrame]:
    """A written table (lang, phrase, n) for each length from 1 to longest: the phrases with n >= min_count. The first has all words' number too, as the phrase ''."""
    levels = [materialize(count_phrases(docs, 1, text=text, lang=lang).where((F.col("n") >= min_count) | (F.col("phrase") == "")))]
    for size in range(2, longest + 1):
        below = levels[-1].where("phrase != ''")
        levels.append(materialize(count_phrases(docs, size, _frequent(below), text, lang).where(F.col("n") >= min_count)))
    return levels


#: floor(10^6 a a / (l r)) in decimals: exact for counts below 10^15.
_SCORE = "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"


def scored(levels: list[DataFrame], inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more that lie in no longer one with inside_percent of their count.

    Joins are by language and phrase, one row a phrase on one side; where many phrases share a frequent part, Spark splits that part's rows.
    """
    parts = levels[0].where("phrase != ''")
    for level in levels[1:]:
        parts = parts.unionByName(level)
    size = F.size(F.split("phrase", " "))
    phrases = parts.withColumn("words", size).where("words > 1").withColumnRenamed("n", "a")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - words)").alias("right")
    )
    of = lambda side, name: parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    cut_scores = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).withColumn("score", F.expr(_SCORE))
    best = cut_scores.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # Of the longer phrases around one, those with one word more are the most frequent.
    longer = phrases.where("words > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    free = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < inside_percent * F.col("a"), F.lit(True)))
    return free.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases by score, count and spelling.

    Texts are lower-cased in A-Z only and read whole, whatever their length; a null text is empty, a null language counts as NO_LANG. Rows that are
    repeated count again. Ties in score and count go by the bytes of the phrase. A language without frequent phrases, as an empty table, gives no rows. Other columns may have any name.
    """
    levels = frequent_phrases(docs, longest, min_count, text, lang)
    found = materialize(scored(levels, inside_percent))
    # Steps of scores in which each language's top phrases lie: a thousand rows a language.
    step = F.floor(F.col("score") / STEP).alias("step")
    steps = found.groupBy("lang", step).count().withColumn("above", F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("step"))) - F.col("count"))
    lowest = steps.where(F.col("above") < top).groupBy("lang").agg(F.min("step").alias("lowest"))
    # What one step holds may be many: parts of it are ranked before the best of all parts are.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = 1 + isqrt(found.count() // top)
    salted = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)).cast("int"))
    wanted = lowest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    high = salted.join(wanted, ["lang", "part"]).where(step >= F.col("lowest"))
    ahead = high.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(levels[0].where("phrase = ''").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """DuckDB SQL for mine with its defaults over documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '{NO_LANG}') AS lang, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
pieces AS (SELECT row, lang, unnest(parts) AS piece, generate_subscripts(parts, 1) AS p FROM (SELECT row, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS parts FROM docs)),
words AS (SELECT lang, row, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT lang, row, p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)),
follow AS (SELECT lang, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM words WINDOW o AS (PARTITION BY row, p ORDER BY i)),
one AS (SELECT lang, x, count(*) AS f FROM follow GROUP BY ALL),
two AS (SELECT lang, x, y, count(*) AS f FROM follow WHERE y IS NOT NULL GROUP BY ALL HAVING f >= {MIN_COUNT}),
three AS (SELECT lang, x, y, z, count(*) AS f FROM follow WHERE z IS NOT NULL GROUP BY ALL HAVING f >= {MIN_COUNT}),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM two t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN one r ON r.lang = t.lang AND r.x = t.y
  WHERE NOT EXISTS (SELECT 1 FROM three s WHERE s.lang = t.lang AND s.x = t.x AND s.y = t.y AND 100 * s.f >= {INSIDE_PERCENT} * t.f)
    AND NOT EXISTS (SELECT 1 FROM three s WHERE s.lang = t.lang AND s.y = t.x AND s.z = t.y AND 100 * s.f >= {INSIDE_PERCENT} * t.f)
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, l.f, r.f FROM three t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f FROM three t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.x = t.z),
graded AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM graded QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
