"""Language identification by Bayesian fusion of four kinds of evidence.

Text: multinomial naive Bayes over hashed character trigrams, trained on all texts by their declared language.
Declared language: how often texts of each language declare which one, counted over the table. Address suffix
and host: a prior for each host, smoothed towards its suffix's, which is smoothed towards the table's; all three
levels are grouped counts. Posteriors multiply the three. A language none of the given ones is a further outcome, whose
trigrams are all equally likely: texts in other scripts have it. Only counts leave the rows' own tasks: the trigram
table has BUCKETS entries for each of the given languages, and host priors are joined.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, workers_import_us
from .textbatch import LOWER, map_text, mix, text_chunks

#: Languages, and the outcome beside them. A caller passes its own list; each language needs texts that declare it.
LANGUAGES, OTHER = ("de", "en", "es", "fr"), "other"
BUCKETS = 1 << 15
#: Trigrams overlap, so their evidence counts as that of so many independent ones at most.
EVIDENCE = 40
#: Rows that a suffix's or a host's own counts are weighed against.
SMOOTH = 20
#: A text with fewer letters, or whose best language is less probable, is rejected.
MIN_LETTERS, MIN_POSTERIOR = 3, 0.5

_code = np.arange(256)
_LETTER = ((_code >= 0x61) & (_code <= 0x7A)) | (_code >= 0x80)


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of each trigram with a letter in its middle, and each row's number of letters (each non-ASCII byte counts)."""
    low = LOWER[data]
    letter = _LETTER[low]
    n = np.diff(np.concatenate([[0], np.cumsum(letter)])[offsets])
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(letter[1:-1] & (row[:-2] == row[2:]))
    word = np.where(letter, low, 0x20).astype(np.uint64)
    key = (word[at] << np.uint64(16)) | (word[at + 1] << np.uint64(8)) | word[at + 2]
    return (mix(key) % np.uint64(BUCKETS)).astype(np.int64), row[at], n


def train(docs: DataFrame, text: str, declared: str, languages: tuple[str, ...]) -> np.ndarray:
    """log P(trigram bucket | language), one row for each language and for OTHER; counts of all texts that declare one of them, plus a half."""

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            label = pa.compute.index_in(batch.column(0), pa.array(languages)).fill_null(-1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch.column(1)):
                bucket, row, _ = _buckets(data, offsets)
                own = label[a:b][row]
                total += np.bincount(own[own >= 0] * BUCKETS + bucket[own >= 0], minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["key", "n"])

    own = docs.where(F.col(declared).isin(*languages)).select(F.col(declared).cast("string"), F.col(text))
    counts = own.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BUCKETS rows
    total = np.full(len(languages) * BUCKETS, 0.5)
    total[counts["key"]] += counts["n"]
    total = total.reshape(len(languages), BUCKETS)
    return np.vstack([np.log(total / total.sum(1, keepdims=True)), np.full(BUCKETS, -np.log(BUCKETS))])


def _normal(weights: list[Column]) -> Column:
    """Array of exp(w - max) over its sum."""
    let = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    e = let(F.array(*weights), lambda w: F.transform(w, lambda x: F.exp(x - F.array_max(w))))
    return let(e, lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, y: a + y)))


def identify(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text", declared: str = "lang", host: str = "source", languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """keep columns and: language, posterior, text_posterior (of that language), declared, suffix, n_letters, accepted.

    language is null and accepted false for texts of fewer than MIN_LETTERS letters (null and empty ones too) and
    where the best posterior is below MIN_POSTERIOR; it is OTHER, and accepted false, where that is most probable. Ties go
    to the language first in the list. Null or unlisted declarations and null hosts are evidence classes of their own
    ('' in the output). Repeated rows count as often as they stand there. A column in keep that is named like one of the
    output comes out as kept_ and its name; other columns may have any name.
    """
    workers_import_us(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text, declared, languages))
    outcomes = (*languages, OTHER)
    n_lang = len(outcomes)

    def make():
        table = model.value

        def f(data, offsets):
            bucket, row, letters = _buckets(data, offsets)
            rows = len(offsets) - 1
            size = np.maximum(np.bincount(row, minlength=rows), 1)
            logs = np.stack([np.bincount(row, table[k][bucket], rows) for k in range(n_lang)], 1)
            logs = logs * (np.minimum(size, EVIDENCE) / size)[:, None]  # bincount of no trigrams at all gives integers
            return [pa.array(letters.astype(np.int64)), pa.array(list(logs), pa.list_(pa.float64()))]

        return f

    address = F.lower(F.coalesce(F.col(host).cast("string"), F.lit("")))
    said = F.coalesce(F.when(F.col(declared).isin(*languages), F.col(declared).cast("string")), F.lit(""))
    own = ("language", "posterior", "text_posterior", "declared", "suffix", "n_letters", "accepted")
    kept = [docs[c].alias(f"kept_{c}" if c in own else c) if isinstance(c, str) else c for c in keep]
    scored = materialize(map_text(docs, text, (*kept, said.alias("af_declared"), address.alias("af_host")), "af_letters long, af_logs array<double>", make))
    names = scored.columns[: len(keep)]
    suffix = F.when(F.instr("af_host", ".") > 0, F.substring_index("af_host", ".", -1)).otherwise("")
    soft = _normal([F.element_at("af_logs", k + 1) for k in range(n_lang)])
    seen = scored.select("*", suffix.alias("af_suffix"), soft.alias("af_text")).withColumn("af_known", F.col("af_letters") >= MIN_LETTERS)
    known = seen.where("af_known")
    mass = [F.sum(F.element_at("af_text", k + 1)).alias(f"m{k}") for k in range(n_lang)]

    def prior(counts: DataFrame, parent: list[Column], name: str) -> list[Column]:
        total = reduce(lambda a, b: a + b, [F.col(f"m{k}") for k in range(n_lang)])
        return [((F.col(f"m{k}") + SMOOTH * parent[k]) / (total + SMOOTH)).alias(f"{name}{k}") for k in range(n_lang)]

    # One row for each host, then for each suffix; the table's own counts are one row.
    hosts = known.groupBy("af_suffix", "af_host").agg(*mass)
    suffixes = hosts.groupBy("af_suffix").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(n_lang)])
    whole = suffixes.agg(*[F.coalesce(F.sum(f"m{k}"), F.lit(0.0)).alias(f"m{k}") for k in range(n_lang)]).first()
    total = sum(whole)
    overall = [F.lit((whole[k] + 1) / (total + n_lang)) for k in range(n_lang)]
    suffixes = suffixes.select("af_suffix", *prior(suffixes, overall, "s"))
    hosts = hosts.join(suffixes, "af_suffix")
    hosts = materialize(hosts.select("af_suffix", "af_host", *prior(hosts, [F.col(f"s{k}") for k in range(n_lang)], "h")))
    # How texts of each language declare themselves: languages + 1 classes at most.
    cells = {r["af_declared"]: r for r in known.groupBy("af_declared").agg(*mass).collect()}
    classes = ["", *languages]
    said_p = {d: [((cells[d][f"m{k}"] if d in cells else 0) + 0.5) / (whole[k] + 0.5 * len(classes)) for k in range(n_lang)] for d in classes}
    declared_log = [reduce(lambda acc, d, k=k: F.when(F.col("af_declared") == d, float(np.log(said_p[d][k]))).otherwise(acc), classes, F.lit(0.0)) for k in range(n_lang)]

    joined = seen.join(hosts, ["af_suffix", "af_host"], "left").withColumn("af_post", _normal([F.element_at("af_logs", k + 1) + declared_log[k] + F.log(F.coalesce(F.col(f"h{k}"), F.lit(1.0 / n_lang))) for k in range(n_lang)]))
    best = F.array_position("af_post", F.array_max("af_post")).cast("int")
    sure = F.col("af_known") & (F.array_max("af_post") >= MIN_POSTERIOR)
    taken = sure & (best < n_lang)
    return joined.select(
        *names, F.when(sure, F.element_at(F.array(*map(F.lit, outcomes)), best)).alias("language"), F.when(F.col("af_known"), F.array_max("af_post")).alias("posterior"),
        F.when(F.col("af_known"), F.element_at("af_text", best)).alias("text_posterior"), F.col("af_declared").alias("declared"), F.col("af_suffix").alias("suffix"), F.col("af_letters").alias("n_letters"), taken.alias("accepted"),
    )


def remove_rejected(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """docs without the rows whose language identify rejects; all columns pass through."""
    key = F.xxhash64(text, declared, host)
    found = identify(docs, (key.alias("af_key"),), text, declared, host, languages)
    rejected = materialize(found.where("not accepted").select("af_key").distinct())
    return docs.withColumn("af_key", key).join(rejected, "af_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def page_evidence(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", html: str = "html") -> DataFrame:
    """keep columns with text (tags, scripts and styles taken out), lang (of the html element) and host of web pages, for identify."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit(""))
    host = F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    return pages.select(*keep, text.alias("text"), declared.alias("lang"), host.alias("source"))
