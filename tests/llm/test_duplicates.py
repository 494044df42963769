"""Near-duplicates, benchmark decontamination and the pipeline."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from atlasframe.llm import components, language_id, line_spread, minhash, packing, spaced_seed

from . import cases


def shingles(text):
    w = cases.solid_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(rows, percent=85):
    """{doc_id: component_id} by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = sorted((root(i), root(j)))
                    top[y] = x
    return {i: root(i) for i, _ in rows}


def edited(words, rng, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"neu{rng.randint(0, 10**9)}"
    return " ".join(out)


def families(seed=3):
    """Exact copies, edits around the threshold, chains whose ends aren't similar, and one large group."""
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 400))]
        texts += [" ".join(base)] * 2 + [edited(base, rng, max(1, round(len(base) * x))) for x in (0.005, 0.01, 0.015, 0.02, 0.03)]
    chain = [f"c{rng.randint(0, 10**6)}" for _ in range(300)]
    for k in range(10):
        chain[k * 25] = f"step{k}"
        chain[k * 25 + 9] = f"step{k}b"
        texts.append(" ".join(chain))
    big = [f"g{rng.randint(0, 10**6)}" for _ in range(200)]
    texts += [edited(big, rng, 1) for _ in range(60)] + [edited(big, rng, 3) for _ in range(30)]
    return texts


def test_near_duplicates_equal_brute_force(spark):
    docs = cases.documents(spark, families())
    expected = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    found = minhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    kept = minhash.remove_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in expected.items() if i == c)


def cut_texts(n, n_cuts, length, words=400, seed=11):
    """One text with several stretches cut out of each copy: copies that lack nearly the same parts are similar, all others are not."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        starts = [rng.randrange(words - length) for _ in range(n_cuts)]
        out.append(" ".join(f"x{k}" for k in range(words) if not any(a <= k < a + length for a in starts)))
    return out


def matrix_groups(texts, percent=85):
    """The groups of plain_groups, ids from 1, by a product of matrices."""
    number: dict = {}
    sets = [[number.setdefault(x, len(number)) for x in shingles(t)] for t in texts]
    m = np.zeros((len(sets), len(number)), np.float32)
    for k, s in enumerate(sets):
        m[k, s] = 1
    both, size = m @ m.T, m.sum(1)
    linked = 100 * both >= percent * (size[:, None] + size - both)
    label = np.arange(1, len(sets) + 1)
    while True:
        lower = np.where(linked, label, len(sets) + 1).min(1)
        if (lower == label).all():
            return dict(enumerate(label.tolist(), 1))
        label = lower


def test_near_duplicates_of_a_group_of_cuts(spark):
    texts = cut_texts(300, 4, 30)
    expected = matrix_groups(texts)
    assert 100 < len(set(expected.values())) < 300
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(cases.documents(spark, texts)).collect()} == expected


def edited_group(seed, n=400):
    """Edits of one text, some beyond the threshold of all others, and families of edits of edits."""
    rng = random.Random(seed)
    base = [f"g{rng.randint(0, 10**6)}" for _ in range(220)]
    out = [edited(base, rng, rng.choice([1, 2, 3, 4, 5, 6, 8, 10])) for _ in range(n // 2)]
    for _ in range(n // 20):
        own = edited(base, rng, 8).split()
        out += [edited(own, rng, rng.choice([0, 1, 2, 3])) for _ in range(10)]
    return out


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80), (3, 85)])
def test_near_duplicates_of_a_large_group(spark, seed, percent):
    texts = edited_group(seed)
    expected = matrix_groups(texts, percent)
    assert len(set(expected.values())) > 20
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(cases.documents(spark, texts), percent=percent).collect()} == expected


def test_texts_with_a_passage_in_common_leave_early(spark):
    """Differences of their own go by a part of their elements; any two that share enough stay, whatever else the hub holds."""
    rng = random.Random(8)
    word = lambda: rng.randint(-(1 << 62), 1 << 62)
    line = [word() for _ in range(8)]
    rows = [(1, k, k, line + [word() for _ in range(100)]) for k in range(300)]
    for k in range(300, 340, 2):
        own = [word() for _ in range(100)]
        rows += [(1, k, k, line + own), (1, k + 1, k + 1, own[: rng.randint(82, 100)] + [word() for _ in range(8)])]
    diff = spark.createDataFrame(rows, "hub long, class long, component long, elements array<long>").withColumn("d", F.size("elements").cast("long"))
    assert sorted(r["class"] for r in minhash._that_meet(diff, F.lit(82)).collect()) == list(range(300, 340))
    assert {r["class"] for r in minhash._that_meet(diff, F.lit(1)).collect()} == set(range(340))


def test_groups_among_texts_with_a_passage_in_common(spark):
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(60):
        own = [f"o{rng.randint(0, 10**9)}" for _ in range(70)]
        texts += [" ".join(own[:20] + passage + own[20:])] + [edited(own[:20] + passage + own[20:], rng, 1 + k % 4) for _ in range(k % 3)]
    base = [f"g{rng.randint(0, 10**9)}" for _ in range(70)] + passage
    texts += [edited(base, rng, 1 + k % 5) for k in range(60)]
    docs = cases.documents(spark, texts)
    expected = plain_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == expected


def test_sets_of_one_class_hash_stay_apart(spark):
    rows = [(1, 1, 3, 50, 7, [1, 2, 3]), (2, 2, 3, 50, 7, [1, 2, 3]), (3, 3, 3, 50, 8, [4, 5, 6])]
    own = spark.createDataFrame(rows, "doc_id long, row_key long, n_shingles long, class long, twin long, sketch array<long>")
    own, classes = minhash._classes(own)
    assert classes.count() == 2 and sorted(r["count"] for r in own.groupBy("class").count().collect()) == [1, 2]


@pytest.mark.parametrize("percent", [80, 85])
def test_blocks_of_differences_meet_every_pair(spark, monkeypatch, percent):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    texts = cut_texts(150, 2, 40)
    sets = [np.array(sorted(hash(x) for x in shingles(t))) for t in texts]
    rows = [(1, k + 1, k + 1, len(s), np.setxor1d(s, sets[0]).tolist()) for k, s in enumerate(sets)]
    diff = spark.createDataFrame(rows, "hub long, class long, component long, n long, elements array<long>")
    links = minhash._joined(diff, percent)
    found = {r.node: r.component for r in components.components(links).collect()}
    assert {k: found.get(k, k) for k in range(1, 151)} == matrix_groups(texts, percent)


def test_near_duplicates_of_the_sample(spark):
    docs = cases.small(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = plain_groups(rows)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in found.items()} == expected
    assert all(found[i].n_shingles == len(shingles(t)) for i, t in rows)


def test_near_duplicates_edges(spark):
    docs = cases.edge_documents(spark)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    rows = {}
    for r in found:
        rows.setdefault(r.doc_id, []).append(r)
    assert [r.n_shingles for i in (1, 2, 3) for r in rows[i]] == [0, 0, 0] and all(r.kept for i in (1, 2, 3, 4, 5, 6) for r in rows[i])
    assert [r.component_id for r in rows[7]] == [7, 7] and rows[8][0].component_id == 7 and not rows[8][0].kept
    assert rows[None][0].component_id is None and rows[None][0].kept
    assert sorted(r.doc_id or 0 for r in minhash.remove_near_duplicates(docs).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 7]
    assert minhash.near_duplicates(cases.no_documents(spark)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (20, 20), *((k, k + 1) for k in range(100, 160))]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, **dict.fromkeys(range(100, 161), 100)}


# ---- benchmark items


def plain_leaks(texts, items):
    """(text number, item) whose words agree along any diagonal, shared seeds or not."""
    number: dict = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in cases.alnum_words(t)])
    texts = [coded(t) for t in texts]
    out = set()
    for i, own in items:
        words = coded(own)
        size = min(spaced_seed.WINDOW, len(words))
        least = spaced_seed.AGREE * size if len(words) >= spaced_seed.SPAN else size
        for n, w in enumerate(texts):
            if not size or len(np.intersect1d(w, words)) < min(3, size):
                continue
            for d in range(size - len(words), len(w) - size + 1):
                low, high = max(0, -d), min(len(words), len(w) - d)
                same = np.concatenate([[0], np.cumsum(w[low + d : high + d] == words[low:high])])
                if high - low >= size and (same[size:] - same[:-size]).max() >= least:
                    out.add((n, i))
                    break
    return out


def test_leaks_equal_brute_force(spark):
    items = [(r.item_id, r.text) for r in cases.small(spark, "benchmark").collect()]
    docs = cases.small(spark, "documents")
    rows = docs.orderBy("doc_id").collect()
    expected = {(rows[n].doc_id, i) for n, i in plain_leaks([r.text for r in rows], items)}
    found = spaced_seed.leaked_documents(docs, cases.small(spark, "benchmark")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    kept = {r.doc_id for r in spaced_seed.remove_leaks(docs, cases.small(spark, "benchmark")).collect()}
    assert kept == {r.doc_id for r in rows} - {i for i, _ in expected}


def test_leaks_tolerate_substitutions(spark):
    words = [f"term{k}" for k in range(40)]
    swap = lambda step: " ".join("other" if k % step == step - 1 else w for k, w in enumerate(words))
    texts = [" ".join(words), "before " * 30 + swap(8) + " after" * 30, swap(5), swap(2), "nothing of it", None, "", " ".join(words[:15]), " ".join(words[5:30]).upper()]
    docs = cases.documents(spark, texts)
    items = spark.createDataFrame([(7, " ".join(words)), (8, "too short an item"), (9, None), (None, " ".join(words)), (7, " ".join(words))], "item_id long, text string").withColumn("hash", F.lit("clash"))
    items = items.unionByName(spark.createDataFrame([(10, "Term3 term4 term5"), (11, "term3 term5"), (12, " ".join(f"term{k}" for k in range(9)))], "item_id long, text string"), allowMissingColumns=True)
    found = {(r.doc_id, r.item_id): r for r in spaced_seed.leaked_documents(docs, items).collect()}
    own = [(r.item_id, r.text) for r in items.collect() if r.item_id is not None]
    assert set(found) == {(n + 1, i) for n, i in plain_leaks(texts, own)} >= {(1, 7), (2, 7), (3, 7), (9, 7), (1, 10), (1, 12)}
    assert not any(i in (8, 9, 11) for _, i in found)
    assert found[1, 7].share == 1.0 and (found[1, 7]["first"], found[1, 7].end) == (0, 16) and found[2, 7]["first"] >= 30
    assert spaced_seed.remove_leaks(docs, items).columns == docs.columns
    assert spaced_seed.leaked_documents(docs, items.limit(0)).count() == 0
    assert spaced_seed.leaked_documents(cases.no_documents(spark), items).count() == 0
    assert spaced_seed.remove_leaks(cases.edge_documents(spark), items).count() == cases.edge_documents(spark).count()


def test_seeds_meet_every_pattern_of_substitutions():
    """Whatever words are exchanged in a window, as long as AGREE of them stay, some seed is shared."""
    for n in range(spaced_seed.SPAN, spaced_seed.WINDOW + 1):
        words = np.arange(1, n + 1, dtype=np.uint64)
        own = set(zip(*(x.tolist() for x in spaced_seed.seeds(words)[::2]), strict=True))
        for out in itertools.combinations(range(n), int(n * (1 - spaced_seed.AGREE) + 1e-9)):
            other = words.copy()
            other[list(out)] = 1000 + np.arange(len(out), dtype=np.uint64)
            assert own & set(zip(*(x.tolist() for x in spaced_seed.seeds(other)[::2]), strict=True))


def test_repetitive_texts_are_verified_once(spark):
    docs = cases.documents(spark, ["la la " * 10_000, "other words " * 20, None])
    items = spark.createDataFrame([(1, "la " * 500), (2, "la di " * 50)], "item_id long, text string")
    found = spaced_seed.leaked_documents(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.share, r["first"]) for r in found] == [(1, 1, 1.0, 0)]


# ---- pipeline


def test_pipeline_stages_hand_over(spark):
    """Each stage against its operator's brute-force version, on what the stage before kept."""
    docs = start = cases.small(spark, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, cases.SMALL))
        seen[name] = (before, docs)
        if name != "pack":
            assert docs.columns == start.columns
    before, after = seen["language_id"]
    good = {r.doc_id for r in language_id.identify(before).where("accepted").collect()}
    assert {r.doc_id for r in after.collect()} == good and len(good) > 0.8 * before.count()
    before, after = seen["line_dedup"]
    expected = {r[0]: r for r in cases.duck_rows(line_spread.ORACLE.replace("sha256(CASE WHEN d.text IS NULL THEN '' ELSE coalesce(k.text, '') END)", "coalesce(k.text, '')"), documents=before.toPandas())}
    for r in after.collect():
        assert r.text == expected[r.doc_id][3] and r.n_chars == (len(r.text) if expected[r.doc_id][2] else r.n_chars)
    assert {i for i, r in expected.items() if r[3].strip() or not r[2]} == {r.doc_id for r in after.collect()}
    before, after = seen["near_dedup"]
    groups = plain_groups([(r.doc_id, r.text) for r in before.collect()], corpus_pipeline.NEAR_PERCENT)
    assert {r.doc_id for r in after.collect()} == {i for i, c in groups.items() if i == c}
    before, after = seen["decontaminate"]
    rows = before.collect()
    bad = {rows[n].doc_id for n, _ in plain_leaks([r.text for r in rows], [(r.item_id, r.text) for r in cases.small(spark, "benchmark").collect()])}
    assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in rows} - bad
    before, after = seen["pack"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {r.doc_id: r.n for r in packing.pack(before).groupBy("doc_id").agg(F.max("doc_tokens").alias("n")).collect()}


@pytest.mark.parametrize("make", [cases.edge_documents, cases.no_documents])
def test_pipeline_stages_at_the_edges(spark, make):
    docs = make(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, cases.SMALL))
    assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_registered():
    named = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in named} and "pipeline" in named
    assert set(__spark_entry__.oracle_sql()) <= set(named)
