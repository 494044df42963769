"""Quality rules: a table of thresholds compiled into one projection of DataFrame functions.

A text's measures (lengths, symbols, stop words, lines, repetitions) are found once, inside one expression that binds the
text's words and lines to lambda variables; rules compare whole numbers, so that no rounding decides. Nothing is
shuffled, and a text costs its words times the logarithm of their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as contents of a class for regular expressions, and as characters.
SPACE, SPACE_CHARS = r"\x20\x09-\x0D", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Punctuation that may stand around a stop word.
AROUND = ".,;:!?\"'()"
WINDOW = 3

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as at by this are or an",
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als",
    "le la les de des et un une du en que qui dans pour par sur au avec il elle",
    "el los las y del se con una su no es lo más al o",
)
STOP = tuple(sorted({w for own in STOP_WORDS for w in own.split()}))

#: The measures, in the order of the struct.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_digits", "n_capitals")


@dataclass(frozen=True)
class Rule:
    """Fails where 100 * part is below low percent or above high percent of whole; whole None compares part itself with low and high."""

    name: str
    part: str
    whole: str | None = None
    low: int | None = None
    high: int | None = None

    def sides(self, of: str = "") -> list[str]:
        """SQL conditions of failing; of stands before the names of measures."""
        left, right = (f"100 * {of}{self.part}", f" * {of}{self.whole}") if self.whole else (f"{of}{self.part}", "")
        return [f"{left} {op} {limit}{right}" for op, limit in (("<", self.low), (">", self.high)) if limit is not None]


#: These two fail whatever the table says.
BASE = (Rule("few_words", "n_words", low=50), Rule("repeated_windows", "n_repeat_words", "n_words", high=50))
#: Production thresholds.
RULES = (
    Rule("many_words", "n_words", high=1_000_000),
    Rule("word_length", "word_chars", "n_words", low=250, high=1200),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
    Rule("digits", "n_digits", "word_chars", high=25),
    Rule("capitals", "n_capitals", "word_chars", high=40),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _count(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def _occurs(text: Column, characters: str) -> Column:
    """How many characters of text are of a class."""
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words that lie in windows found twice or more: hashes of equal windows stand side by side once they are sorted; pairs of neighbours are compared word by word."""

    def twins(s: Column) -> Column:
        pairs = F.transform(s, lambda e, k: F.when(e["h"] == F.get(s, k + 1)["h"], F.array(e["i"], F.get(s, k + 1)["i"])))
        equal = lambda p, k: F.get(words, p[0] + k) == F.get(words, p[1] + k)
        return F.filter(F.array_compact(pairs), lambda p: equal(p, 0) & equal(p, 1) & equal(p, 2))

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, n: total + n)

    hashed = F.transform(words, lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    windows = F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return _let(F.sort_array(windows), lambda s: _let(F.sort_array(F.array_distinct(F.flatten(twins(s)))), covered))


def measures(text: Column) -> Column:
    """A struct of MEASURES of text, all long. A null text measures as an empty one."""
    text = F.coalesce(text, F.lit(""))
    solid = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, f"[{SPACE}]+"))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.btrim(x, F.lit(SPACE_CHARS)).alias("solid")))
    lines = F.filter(lines, lambda x: x["solid"] != "")
    bullet = lambda x: x["solid"].startswith("-") | x["solid"].startswith("*") | x["solid"].startswith("•")
    ellipsis = lambda x: x["solid"].endswith("...") | x["solid"].endswith("…")

    def of(w: Column, l: Column) -> Column:  # noqa: E741
        found = (
            F.size(w).cast("long"), F.aggregate(w, F.lit(0).cast("long"), lambda total, x: total + F.length(x)), _occurs(text, SYMBOLS), (F.size(l) - F.size(F.array_distinct(F.transform(l, lambda x: x["line"])))).cast("long"), _repeat_words(w),
            _count(w, lambda x: F.lower(F.btrim(x, F.lit(AROUND))).isin(*STOP)), F.size(l).cast("long"), _count(l, bullet), _count(l, ellipsis), _occurs(text, "0-9"), _occurs(text, "A-Z"),
        )
        return F.struct(*[c.alias(name) for c, name in zip(found, MEASURES, strict=True)])

    return _let(words, lambda w: _let(lines, lambda l: of(w, l)))  # noqa: E741


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs and, from its whole text: MEASURES (long), base_failed, failed (names of the rules that failed, the base ones first) and kept.

    Every row gives a row, repeated ones too; no other column counts. A null text has no words and fails as an empty one does.
    Ratios of nothing (no words, no lines) fail no rule but few_words. Texts of any length are measured whole: their words, windows and lines
    are held once by the task that reads them. An empty table gives an empty table. Columns of docs named like the new ones are replaced.
    """
    new = {*MEASURES, "base_failed", "failed", "kept", "af_m"}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    failing = lambda some: [F.expr(" or ".join(r.sides())) for r in some]
    names = [F.when(hit, F.lit(r.name)) for r, hit in zip((*BASE, *rules), failing((*BASE, *rules)), strict=True)]
    base, other = failing(BASE), failing(rules)
    any_of = lambda some: F.lit(False) if not some else some[0] if len(some) == 1 else some[0] | any_of(some[1:])
    measured = docs.select(*own, measures(F.col(text)).alias("af_m")).select(*own, "af_m.*")
    return measured.select("*", any_of(base).alias("base_failed"), F.array_compact(F.array(*names)).alias("failed"), (~any_of([*base, *other])).alias("kept"))


def remove_poor(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects; all columns pass through."""
    marked = docs.select("*", measures(F.col(text)).alias("af_m"))
    fails = " or ".join(f"({s})" for r in (*BASE, *rules) for s in r.sides("af_m."))
    return marked.where(f"not ({fails})").drop("af_m")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for judge's base columns and verdict over documents."""
    fails = lambda some: " OR ".join(f"({s})" for r in some for s in r.sides()) or "false"
    stop = ", ".join(f"'{w}'" for w in STOP)
    around = AROUND.replace("'", "''")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
split AS (SELECT row, doc_id, text, regexp_extract_all(text, '[^{SPACE}]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: trim(x, {white}) <> '') AS lines FROM docs),
placed AS (SELECT row, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM split),
windows AS (SELECT row, i, x, lead(x, 1) OVER w AS y, lead(x, 2) OVER w AS z FROM placed WINDOW w AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, i FROM windows WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, x, y, z) > 1),
repeated AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS r(k) GROUP BY row),
measured AS (
  SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(list_filter(words, lambda x: lower(trim(x, '{around}')) IN ({stop})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines, len(list_filter(lines, lambda x: trim(x, {white})[1] IN ('-', '*', '•')))::BIGINT AS n_bullet_lines,
         len(list_filter(lines, lambda x: ends_with(trim(x, {white}), '...') OR ends_with(trim(x, {white}), '…')))::BIGINT AS n_ellipsis_lines,
         length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM split s LEFT JOIN repeated r USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {fails(BASE)} AS base_failed, NOT ({fails((*BASE, *rules))}) AS kept FROM measured
"""
