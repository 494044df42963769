"""Line deduplication by the number of distinct sites that carry a line; DataFrame functions only.

Each line's hash gets a HyperLogLog sketch of its sites; sketches merge in the aggregation's partial and final
steps, so a line on a third of all pages costs each task one small sketch. Lines whose estimate lies near the
threshold are counted exactly. A line that reaches the threshold is boilerplate: it stays where it first occurs
(smallest doc_id, then line number) and goes everywhere else, so that no text leaves the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

MIN_SITES = 8
MIN_CHARS = 16
SKETCH_BITS = 11
#: Share of the threshold around it within which the estimate isn't trusted: over six standard errors of a sketch of 2^11 registers.
BAND = 0.25


def _line_hash(line: Column) -> Column:
    """128 bits, so that among 10^12 lines none goes for another's sake."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.xxhash64(F.lit(1), F.trim(line)).alias("b"))


def line_table(docs: DataFrame, doc_id: str, text: str, site: str, min_chars: int) -> DataFrame:
    """One row for each line of min_chars or more: row key, doc_id, pos, line hash and site. A null site counts as the site ''."""
    # The key is made before the lines: beside them it would read the whole text once for each.
    texts = docs.select(F.xxhash64(doc_id, text).alias("row_key"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.split(text, "\n").alias("lines"))
    lines = texts.select("row_key", "doc_id", "site", F.posexplode("lines").alias("pos", "line"))
    return lines.where(F.length(F.trim("line")) >= min_chars).select("row_key", "doc_id", "pos", _line_hash(F.col("line")).alias("line_hash"), "site")


def wide_lines(lines: DataFrame, min_sites: int, band: float = BAND) -> DataFrame:
    """Hashes of the lines that at least min_sites distinct sites carry: (line_hash)."""
    sketches = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    spread = materialize(sketches.select("line_hash", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high).select("line_hash")
    exact = lines.join(near, "line_hash", "left_semi").select("line_hash", "site").distinct().groupBy("line_hash").count().where(F.col("count") >= min_sites)
    return spread.where(F.col("sites") > high).select("line_hash").unionByName(exact.select("line_hash"))


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text column cleaned, and n_lines and n_removed (long) added.

    Every row stays. Null text stays null with no lines; an empty text has one empty line. Lines of fewer than
    min_chars characters (trimmed) always stay. Rows equal in doc_id and text share one decision. Columns of
    docs named n_lines or n_removed are replaced; all others pass through.
    """
    docs = docs.drop("n_lines", "n_removed")
    lines = materialize(line_table(docs, doc_id, text, site, min_chars))
    wide = materialize(wide_lines(lines, min_sites))
    hits = materialize(lines.join(wide, "line_hash", "left_semi").select("row_key", "doc_id", "pos", "line_hash"))
    first = hits.groupBy("line_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos", "row_key")).alias("first")).select("line_hash", F.col("first.row_key").alias("first_key"), F.col("first.pos").alias("first_pos"))
    gone = hits.join(first, "line_hash").where((F.col("row_key") != F.col("first_key")) | (F.col("pos") != F.col("first_pos")))
    gone = materialize(gone.groupBy("row_key").agg(F.array_distinct(F.collect_list("pos")).alias("af_gone")).withColumnRenamed("row_key", "af_key"))
    joined = docs.withColumn("af_key", F.xxhash64(doc_id, text)).join(gone.hint("merge"), "af_key", "left")  # one plan at every size: texts meet their decisions once
    rows = F.split(text, "\n")
    # Places that stay, by a set, and their lines; the lines are bound to a variable, so that a text is split once.
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "af_gone")
    kept = F.transform(F.array(rows), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))[0]
    n_gone = F.coalesce(F.size("af_gone"), F.lit(0))
    return joined.select(
        *[F.when(F.col("af_gone").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(rows)).cast("long").alias("n_lines"),
        F.when(F.col("af_gone").isNull(), 0).otherwise(n_gone).cast("long").alias("n_removed"),
    )


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
long_lines AS (SELECT doc_id, site, pos, trim(line, ' ') AS line FROM lines WHERE length(trim(line, ' ')) >= {MIN_CHARS}),
wide AS (SELECT line FROM long_lines GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
hits AS (SELECT l.*, row_number() OVER (PARTITION BY l.line ORDER BY doc_id, pos) AS nth FROM long_lines l JOIN wide USING (line)),
gone AS (SELECT doc_id, pos FROM hits WHERE nth > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id)::BIGINT AS n_removed,
       sha256(CASE WHEN d.text IS NULL THEN '' ELSE coalesce(k.text, '') END) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
