"""Quality rules against a plain version over edge cases, and against SQL."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from atlasframe.llm import quality_rules as q
from atlasframe.llm import queries

from . import cases


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    solid = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_stop_words": sum(w.strip(q.AROUND).lower() in q.STOP for w in words), "n_lines": len(lines), "n_bullet_lines": sum(x[0] in "-*•" for x in solid), "n_ellipsis_lines": sum(x.endswith(("...", "…")) for x in solid),
        "n_digits": len(re.findall("[0-9]", text)), "n_capitals": len(re.findall("[A-Z]", text)),
    }

    def fails(r):
        part, whole = (100 * m[r.part], m[r.whole]) if r.whole else (m[r.part], 1)
        return (r.low is not None and part < r.low * whole) or (r.high is not None and part > r.high * whole)

    failed = [r.name for r in (*q.BASE, *q.RULES) if fails(r)]
    return m, any(r.name in failed for r in q.BASE), failed


TEXTS = [
    "a a a a", "a b a b a b c", "x\ny\nx\n\n\n x\nx", "tab\tand\vmore\f\rhere", "ſ İ é 世界 🎉🎉 #*$%&|<>", "* one\n- two\n• three\nfour...\nfive…\n \n", "The (the) 'THE' und, und.", "a b c d",
    "ab c ab c a bc a bc", " ".join(["the", "of"] * 60), " ".join(f"w{k} of" for k in range(60)), " ".join(f"word{k % 40} the" for k in range(300)), "\n".join(["one line that repeats"] * 40),
]


def test_measures_and_verdicts_equal_a_plain_version(spark):
    docs = cases.documents(spark, TEXTS).unionByName(cases.edge_documents(spark))
    want = sorted((r["doc_id"] or -1, r["text"] or "", *plain(r["text"])[0].values(), plain(r["text"])[1], plain(r["text"])[2], not plain(r["text"])[2]) for r in docs.collect())
    got = q.judge(docs)
    assert got.columns == [*docs.columns, *q.MEASURES, "base_failed", "failed", "kept"]
    rows = got.select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")), *q.MEASURES, "base_failed", "failed", "kept").collect()
    assert sorted(map(tuple, rows)) == want


def test_remove_poor_keeps_the_rows_that_pass(spark):
    docs = cases.small(spark, "documents")
    want = sorted(r["doc_id"] for r in docs.collect() if not plain(r["text"])[2])
    kept = q.remove_poor(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want and 0 < len(want) < docs.count()


def test_rules_are_a_table(spark):
    docs = cases.documents(spark, [" ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(70))])
    only = q.judge(docs, rules=(q.Rule("long", "n_words", high=65),))
    assert [tuple(r) for r in only.orderBy("doc_id").select("failed", "kept").collect()] == [([], True), (["long"], False)]
    assert [r["kept"] for r in q.judge(docs, rules=()).collect()] == [True, True]


def test_clashing_names_and_empty_tables(spark):
    docs = cases.documents(spark, ["one two"]).withColumns({"kept": F.lit("x"), "n_words": F.lit("y"), "af_m": F.lit(1)})
    assert q.judge(docs).select("n_words", "kept").first() == (2, False)
    assert q.judge(cases.no_documents(spark)).count() == 0


def test_query_equals_its_sql(spark):
    assert cases.rows_of(queries.op12_quality_rules(spark, cases.SMALL)) == cases.duck_rows(q.oracle())


def test_nothing_is_shuffled_and_no_python_runs(spark):
    plan = queries.op12_quality_rules(spark, cases.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan) and "text" in re.search(r"ReadSchema: (.*)", plan)[1] and "source" not in re.search(r"ReadSchema: (.*)", plan)[1]
