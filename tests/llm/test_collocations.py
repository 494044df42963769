"""Phrase mining against a plain version and against SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from atlasframe.llm import collocations as c
from atlasframe.llm import queries

from . import cases


def plain(rows, longest=3, least=10, top=2000):
    """mine() by dictionaries; rows are (lang, text)."""
    f = defaultdict(Counter)
    total = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", cases.low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {g: n for g, n in own.items() if len(g) > 1 and n >= least}
        inside = defaultdict(int)
        for g, n in found.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i : i + k]] = max(inside[g[i : i + k]], n)
        graded = []
        for g, a in found.items():
            if 100 * inside[g] >= 50 * a:
                continue
            score, k = min((10**6 * a * a // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            graded.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (s, a, g, l, r) in enumerate(sorted(graded)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = ["New", "york", "city", "of", "the", "größe", "世界", "a", "b", "x\x00y", "É"]
    rows = []
    for k in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", ", ", ".", "\n", "\x0b", " ; ", "! "]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None, "und"]), text if k % 9 else text + " new york city " * 3))
    return rows + [("en", None), ("de", ""), ("fr", "only here"), (None, " . , "), ("en", "one very long text of words " * 20_000)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_equals_a_plain_version(spark, longest):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("x"), "n": F.lit(1), "part": F.lit("y")})
    got = c.mine(docs.repartition(3), longest=longest, top=9)
    assert [n for n, _ in got.dtypes] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {k for n, k in got.dtypes if n not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == plain(rows, longest, top=9)


def test_many_equal_scores_are_ranked_in_parts(spark):
    """Phrases of one score, more than are asked for, in the order of count and bytes."""
    rows = [("en", f"{'Éab'[k % 3]}{k} x{k}") for k in range(300) for _ in range(10 + k % 2)]
    got = [tuple(r) for r in c.mine(spark.createDataFrame(rows, "lang string, text string"), top=20).collect()]
    assert sorted(got) == plain(rows, top=20) and len(got) == 20 and {r[-1] for r in got} == {10**6}


def test_rows_that_repeat_count_again(spark):
    docs = spark.createDataFrame([("en", "red fox")] * 10 + [("en", "red hen")] * 9, "lang string, text string")
    assert [tuple(r) for r in c.mine(docs).collect()] == [("en", 1, "red fox", 10, 19, 10, 38, 10**6 * 100 // 190)]


def test_products_beyond_64_bits(spark):
    n = 3 * 10**12
    levels = [spark.createDataFrame([("en", "a", n), ("en", "b", n + 7), ("en", "", 3 * n)], "lang string, phrase string, n long"), spark.createDataFrame([("en", "a b", n - 1)], "lang string, phrase string, n long")]
    assert [tuple(r) for r in c.scored(levels).collect()] == [("en", "a b", n - 1, n, n + 7, 10**6 * (n - 1) ** 2 // (n * (n + 7)))]


def test_a_full_bitmap_only_costs_rows(spark, monkeypatch):
    """With far too few bits everything passes, and results stay."""
    monkeypatch.setattr(c, "LEAST_BITS", 64)
    monkeypatch.setattr(c, "MOST_BITS", 64)
    rows = corpus()[:200]
    assert sorted(map(tuple, c.mine(spark.createDataFrame(rows, "lang string, text string")).collect())) == plain(rows)


def test_rare_parts_keep_phrases_from_being_made(spark):
    docs = spark.createDataFrame([("en", "a b")] * 10 + [("en", f"a w{k} b") for k in range(50)], "lang string, text string")
    one = c.frequent_phrases(docs, longest=1)[0]
    made = c.count_phrases(docs, 2, c._frequent(one.where("phrase != ''")))
    assert [tuple(r) for r in made.collect()] == [("en", "a b", 10)]


def test_empty_tables(spark):
    assert c.mine(cases.no_documents(spark)).count() == 0
    assert c.mine(cases.edge_documents(spark)).where("lang = 'und'").count() == 0


def test_query_equals_its_sql(spark):
    assert cases.rows_of(queries.op13_collocations(spark, cases.SMALL)) == cases.duck_rows(c.oracle())
