"""Secret scan over a trigram inverted index; DataFrame functions only.

Each rule's regex is reduced on the driver to a Boolean query over lower-case trigrams, as code search does: a text
that matches the regex must satisfy the query. The index holds postings (trigram, text) of the trigrams that any query
names; joined with the clauses by trigram, the lists of each clause are intersected by text, and only candidates are
verified with the regex. A rule from whose regex no trigram
follows scans every text. Positions come from the pieces between matches, so they count code points.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what to search for (valid in Java, RE2 and Python), and the least length of a group for a match to count."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order that breaks ties at one start.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Formats that their issuers publish.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + EXTRA

#: A Boolean query in disjunctive form: any of the sets of trigrams, all of whose members must occur. None: no text can be excluded.
Query = frozenset | None
_MOST = 64
#: Matches of one text whose places are added up at once.
CHUNK = 256


def _grams(s: str) -> frozenset:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= _MOST else min(a, b, key=len)


def _need(strings: frozenset) -> Query:
    return frozenset(map(_grams, strings)) if strings and all(len(x) >= 3 for x in strings) else None


def _walk(items: list) -> tuple[frozenset | None, Query]:
    """(all strings that items can match, if few; what else a match needs)."""
    run, whole, query = frozenset([""]), True, None
    for op, arg in items:
        own, inner = None, None
        if op is sre.LITERAL:
            own = frozenset([chr(arg).lower()])
        elif op is sre.IN and len(arg) <= 8 and all(k is sre.LITERAL for k, _ in arg):
            own = frozenset(chr(v).lower() for _, v in arg)
        elif op is sre.SUBPATTERN:
            own, inner = _walk(list(arg[3]))
        elif op is sre.BRANCH:
            parts = [_walk(list(x)) for x in arg[1]]
            if all(strings is not None for strings, _ in parts):
                own = frozenset().union(*(strings for strings, _ in parts))
            else:
                each = [q if strings is None else _need(strings) for strings, q in parts]
                inner = None if None in each else frozenset().union(*each)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            strings, needed = _walk(list(sub))
            if strings is not None and high is not sre.MAXREPEAT and high <= 2:
                own = frozenset(x * k for x in strings for k in range(low, high + 1))
            inner = _both(needed, _need(strings) if strings else None) if low else None
        query = _both(query, inner)
        if own is not None and len(own) * len(run) <= _MOST:
            run = frozenset(x + y for x in run for y in own)
        else:  # a new run of strings begins
            query, run, whole = _both(query, _need(run)), own or frozenset([""]), False
    return (run, query) if whole else (None, _both(query, _need(run)))


def trigram_query(regex: str) -> Query:
    """The clauses of trigrams, one of which every text that matches regex has whole; None if none follow."""
    strings, query = _walk(list(sre_parser.parse(regex)))
    query = _both(query, _need(strings) if strings else None)
    return None if query is None else frozenset(c for c in query if not any(other < c for other in query))


def spans(text: Column, rule: Rule) -> Column:
    """Matches of rule as array<struct<start, end, kind>>, leftmost and not overlapping, in code points, the end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    pieces = F.split(text, rule.regex, -1)
    checked = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.least else found
    step = F.transform(found, lambda m, i: F.struct(F.length(F.element_at(pieces, i + 1)).alias("gap"), F.length(m).alias("len"), (F.length(F.element_at(checked, i + 1)) >= rule.least).alias("ok")))
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        own = F.array(F.struct(a.alias("start"), (a + x["len"]).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct((a + x["len"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def placed(steps: Column) -> Column:
        """Spans of all matches; a fold copies what it has, so it goes by chunks and stays short."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, CHUNK))
        return _let(chunks, lambda parts: F.flatten(F.zip_with(parts, _starts(parts), lambda part, at: F.aggregate(part, F.struct(at.alias("at"), nothing.alias("out")), add, lambda acc: acc["out"]))))

    def _starts(parts: Column) -> Column:
        ends = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(ends, first, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    return _let(step, lambda steps: F.when(F.size(steps) > 0, placed(steps)).otherwise(nothing))


def _let(value: Column, then) -> Column:
    """then(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def postings(docs: DataFrame, text: str, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, af_key), one row for each of trigrams that a text, named by its hash, holds in lower case."""
    low = docs.select(F.xxhash64(text).alias("af_key"), F.lower(text).alias("low"))
    return low.select(F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))).alias("trigram"), "af_key")


def candidates(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(af_key, af_rules): which of the rules with a trigram query may match the text of that key; texts with none are left out.

    Two texts of one hash are candidates for what either holds; the regex decides.
    """
    clauses = [(r.kind, n, t, i, len(c)) for r in rules for n, c in enumerate(x[:60] for x in sorted(map(sorted, trigram_query(r.regex) or ()))) for i, t in enumerate(c)]  # 60 trigrams of a clause leave few candidates
    if not clauses:
        return docs.select(F.xxhash64(text).alias("af_key"), F.array().cast("array<string>").alias("af_rules")).where(F.lit(False))
    fields = ("kind", "clause", "trigram", "place", "size")
    named = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, c, strict=True)]) for c in clauses])))
    index = materialize(postings(docs, text, sorted({c[2] for c in clauses})))
    # The clauses come from the rules alone, so what is broadcast is fixed.
    met = index.join(F.broadcast(named), "trigram").groupBy("kind", "clause", "size", "af_key").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "place")).alias("have"))
    return met.where(F.bit_count("have") == F.col("size")).groupBy("af_key").agg(F.collect_set("kind").alias("af_rules"))


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column secrets: array<struct<start, end, kind>> by start, then in the order of the rules.

    Every row stays; null and empty texts have no spans. A column of docs named secrets is replaced.
    """
    docs = docs.drop("secrets")
    joined = docs.withColumn("af_key", F.xxhash64(text)).join(materialize(candidates(docs, text, rules)), "af_key", "left")
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    own = [F.when(F.coalesce(F.array_contains("af_rules", r.kind), F.lit(False)) if trigram_query(r.regex) else F.lit(True), spans(F.col(text), r)).otherwise(nothing) for r in rules]
    order = F.array(*[F.lit(r.kind) for r in rules])
    ranked = F.transform(F.flatten(F.array(*[F.coalesce(x, nothing) for x in own])), lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.transform(F.array_sort(ranked), lambda x: F.struct(x["start"], x["end"], x["kind"])).alias("secrets"))


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The contract's columns from the spans."""
    joined = lambda kinds: F.array_join(F.transform(F.filter("secrets", lambda x: x["kind"].isin(*kinds)) if kinds else F.col("secrets"), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = [r.kind for r in BASE]
    return scanned.select(doc_id, *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined(base), 256).alias("base_sha256"), joined(None).alias("spans"))


def _sql_spans(rule: Rule) -> str:
    regex = rule.regex.replace("'", "''")
    ok = f"length(list_extract(regexp_extract_all(text, '{regex}', {rule.group}), i)) >= {rule.least}" if rule.least else "true"
    before = "list_sum(list_transform(list_slice({x}, 1, {n}), lambda p: length(p)))"
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {RULES.index(rule)} AS rank,
  (coalesce({before.format(x="pieces", n="i")}, 0) + coalesce({before.format(x="found", n="i - 1")}, 0))::BIGINT AS s, s + length(found[i]) AS e
FROM (SELECT doc_id, text, found, pieces, unnest(generate_series(1, len(found))) AS i
      FROM (SELECT doc_id, text, regexp_extract_all(text, '{regex}') AS found, string_split_regex(text, '{regex}') AS pieces FROM documents WHERE text IS NOT NULL))
WHERE {ok}"""


def oracle() -> str:
    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    one = "kind || ':' || s || ':' || e"
    return f"""
WITH spans AS ({" UNION ALL ".join(map(_sql_spans, RULES))})
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in BASE)},
  sha256(coalesce(string_agg({one}, ',' ORDER BY s, rank) FILTER (kind IN ({kinds})), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
