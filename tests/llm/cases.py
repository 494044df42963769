"""Rows at the edge of what tables hold, and helpers that need no Spark."""

from __future__ import annotations

import re
import string

import duckdb
from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: documents with more columns, whose names operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, value int, hash string, words array<string>, h double, start string, pos int"


def low(text: str | None) -> str:
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def solid_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def documents(spark: SparkSession, texts: list, sources: list | None = None, ids: list | None = None) -> DataFrame:
    """documents of those texts, with the columns of SCHEMA."""
    rows = []
    for k, text in enumerate(texts):
        source = sources[k] if sources else "site.example"
        rows.append((ids[k] if ids else k + 1, text, "en", source, len(text or ""), "x", k, "y", ["z"], 0.5, "s", 3))
    return spark.createDataFrame(rows, SCHEMA)


def edge_documents(spark: SparkSession) -> DataFrame:
    """Nulls, empty and blank texts, one very long text, repeated rows and texts, a null id and a null in each other column."""
    long = " ".join(f"Wort{k % 977} größe {k % 31}" for k in range(60_000))
    texts = [None, "", " \n\t ", "one", "ONE two\nthree", long, "same text of a row that stands here twice", "same text of a row that stands here twice", "same text of a row that stands here twice"]
    ids = [1, 2, 3, 4, 5, 6, 7, 7, 8]
    rows = [(i, t, "en", "a.example", len(t or ""), None, None, None, None, None, None, None) for i, t in zip(ids, texts, strict=True)]
    rows.append((None, "a row without an id but with a text", None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def small(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def rows_of(df: DataFrame) -> list[tuple]:
    """Sorted rows, columns by name."""
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def duck_rows(sql: str, sf_dir: str = SMALL, **frames) -> list[tuple]:
    """The same of a DuckDB query over the sample tables, or over pandas frames of those names."""
    con = duckdb.connect()
    for t in TABLES:
        if t not in frames:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, frame in frames.items():
        con.register(name, frame)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)
