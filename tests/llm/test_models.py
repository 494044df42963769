"""Language model, packing, HTML extraction and nearest neighbours."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atlasframe.llm import ann_tree, html_extract, katz, packing, queries

from . import cases

# ---- Katz backoff


def plain_discounts(counts):
    """d_1 to d_5 by Katz's formula from a multiset of counts, absolute discounting where the formula leaves (0, 1]."""
    n = Counter(counts)
    if not n[1]:
        return {r: (r - 0.5) / r for r in range(1, 6)}
    loss = 6 * n[6] / n[1]
    fixed = min(n[1] / (n[1] + 2 * n[2]), 0.9)
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - loss) / (1 - loss) if n[r] and loss < 1 else 0
        out[r] = d if 0 < d <= 1 else 1 - fixed / r
    return out


class PlainKatz:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = [*cases.solid_words(t), katz.END]
            self.uni.update(w)
            self.bi.update(zip([katz.BEGIN, *w[:-1]], w, strict=True))
        self.n = sum(self.uni.values())
        d1, d2 = plain_discounts(self.uni.values()), plain_discounts(self.bi.values())
        mass = lambda r, d: d.get(r, 1.0) * r
        known = sum(mass(c, d1) for c in self.uni.values()) / max(1, self.n)
        scale = 1.0 if known < 1 else self.n / (self.n + 1)
        self.p = {w: mass(c, d1) * scale / self.n for w, c in self.uni.items()}
        self.p_unknown = max(1 - known * scale, 1e-12) if self.n else 1.0
        seen = {g: mass(r, d2) for g, r in self.bi.items()}
        self.after, self.alpha, self.total = seen, {}, {}
        count = self.uni | {katz.BEGIN: len(texts)}
        followers = {}
        for (h, w), v in seen.items():
            followers.setdefault(h, []).append((w, v))
        for h, after in followers.items():
            m = sum(v for _, v in after)
            self.total[h] = count[h] if m < count[h] - 1e-9 else count[h] + 1
            self.alpha[h] = (1 - m / self.total[h]) / max(1 - sum(self.p[w] for w, _ in after), 1e-12)

    def prob(self, h, w):
        if (h, w) in self.after:
            return self.after[h, w] / self.total[h]
        return self.alpha.get(h, 1.0) * self.p.get(w, self.p_unknown)

    def score(self, text):
        w = [*cases.solid_words(text), katz.END]
        return sum(log10(self.prob(h, x)) for h, x in zip([katz.BEGIN, *w[:-1]], w, strict=True))


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@pytest.mark.parametrize("options", [{}, {"hot_words": 5, "hot_grams": 3, "bucket": 500}])
def test_katz_equals_dictionaries(spark, options):
    docs = cases.small(spark, "documents").select("doc_id", "text").unionByName(cases.edge_documents(spark).select("doc_id", "text"))
    rows = docs.collect()
    model = PlainKatz([r.text for r in rows if not held_out(r.doc_id)])
    v, n = len(model.uni), model.n
    expected = []
    for r in rows:
        w = [*cases.solid_words(r.text), katz.END]
        base = sum(log10((model.uni[x] + 1) / (n + v + 1)) for x in w)
        expected.append((r.doc_id is None, r.doc_id or 0, held_out(r.doc_id), len(w), sum(model.uni[x] > 0 for x in w), n, base, model.score(r.text)))
    found = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.train_and_score(docs, **options).collect()]
    expected.sort()
    found.sort()
    assert [x[:6] for x in found] == [x[:6] for x in expected]
    assert np.allclose([x[6:] for x in found], [x[6:] for x in expected], rtol=1e-9)


def test_katz_is_normalised(spark):
    texts = ["a b a b a c", "a b c a b", "c c c b a", "a b a b"] * 3
    plain = PlainKatz(texts)
    for h in [katz.BEGIN, *(w for w in plain.uni if w != katz.END)]:
        assert sum(plain.prob(h, w) for w in plain.uni) + plain.alpha.get(h, 1.0) * plain.p_unknown == pytest.approx(1)
    model = katz.Model(cases.documents(spark, texts).select("text"))
    assert sum(10 ** r.log_p for r in model.hot_words.collect() if r.log_p is not None) + 10**model.unknown == pytest.approx(1)


def test_katz_keeps_pairs_seen_once(spark):
    texts = ["a b a b a c", "a b c a b", "c c c b a", "a b a b", "a d b", "d c"]
    model = katz.Model(cases.documents(spark, texts).select("text"))
    seen = Counter()
    for t in texts:
        seen.update(zip([None, *t.split()], [*t.split(), None], strict=True))
    assert sorted(r.r for r in model.bigrams.collect()) == sorted(seen.values()) and 1 in seen.values()


def test_katz_empty(spark):
    assert katz.train_and_score(cases.no_documents(spark)).count() == 0
    r = katz.train_and_score(cases.documents(spark, [None], ids=[next(i for i in range(99) if held_out(i))])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (1, 0, 0, 0.0, 0.0)


def test_katz_tables_hold_a_bucket_in_a_row(spark, monkeypatch):
    """Pairs are no rows of Spark one by one, and a bucket's row goes to the part that it is written in without another shuffle."""
    docs = cases.small(spark, "documents").limit(60).select("text")
    texts = [r.text for r in docs.collect()]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    plain, seen, append = PlainKatz(texts), [], katz.BucketedTable.append
    monkeypatch.setattr(katz.BucketedTable, "append", lambda self, rows, **options: seen.append((rows._jdf.queryExecution().executedPlan().toString(), options)) or append(self, rows, **options))
    monkeypatch.setattr(katz, "BUCKET", 2000)
    model = katz.Model(docs, hot_words=20, hot_grams=5, bucket=700)
    assert model.n_buckets > 5 and model.table.count() == model.table.select("bucket").distinct().count() <= model.n_buckets
    assert len(seen) == 2 and all(options == {"in_parts": True} for _, options in seen)
    # One exchange for the packs of texts; one for the sums of histories and one for their answers.
    assert [plan.count("Exchange hashpartitioning") for plan, _ in seen] == [1, 2]
    found = model.bigrams.collect()
    assert sorted(r.r for r in found) == sorted(plain.bi.values())
    # A seen pair's delta, with what its words have alone, gives its probability.
    alone = {w: (p, plain.alpha.get(w, 1.0)) for w, p in plain.p.items()} | {katz.BEGIN: (None, plain.alpha[katz.BEGIN])}
    expected = sorted(log10(plain.prob(h, w)) - log10(alone[w][0]) - log10(alone[h][1]) for h, w in plain.bi)
    assert np.allclose(sorted(r.delta for r in found), expected, rtol=1e-9, atol=1e-9)


def test_katz_histories_of_extreme_ids():
    low, high = -(1 << 63), (1 << 63) - 1
    h = np.array([low, low, -1, 0, 0, 0, 1, high])
    first, parts = katz._histories(h, 3)
    assert first.tolist() == [0, 2, 3, 6, 7]
    assert sorted(i for _, at in parts for i in at) == list(range(5)) and len({b for b, _ in parts}) == len(parts)
    # A history that is a word alone asks where the word itself lies.
    assert all(katz._bucket(np.array([katz.ALONE]), h[first][[i]], 3)[0] == b for b, at in parts for i in at if h[first][i] < 0)
    assert [len(x) for x in katz._histories(h[:0], 3)] == [0, 0]
    counts = np.arange(1, 12)
    d = katz.discounts(Counter([1] * 9 + [2] * 5 + [3] * 3 + [4] * 2 + [5, 6]))
    assert katz._discounted(counts, d).tolist() == [d[r] * r if r < 6 else r for r in counts]


def test_katz_looks_up_chunks_of_a_run():
    """What a look-up needs on the way is held for one chunk of texts, not for a run, and no texts stay with a run."""
    texts = pa.array([f"w{k} " * 5000 for k in range(400)] + [None])
    batch = pa.RecordBatch.from_arrays([pa.array(range(401)), texts], names=["doc_id", "t"])
    sizes = []

    def f(bounds, hashes):
        sizes.append(len(hashes))
        return hashes[:1]

    runs = list(katz._Runs(None, f).read([batch], 1))
    assert sum(sizes) == 2_000_000 and max(sizes) <= 1 << 19 and [len(x) for x in runs][0] > 1 and len(runs) == 2
    kept = [k for run in runs for k, _, _ in run]
    assert [i for k in kept for i in k.column(0).to_pylist()] == list(range(401))
    assert all(k.get_total_buffer_size() <= 8 * len(k) + 64 for k in kept)


def test_katz_leaves_the_size_of_batches_as_it_was(spark, monkeypatch):
    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", [], katz.score
    before = spark.conf.get(key)
    monkeypatch.setattr(katz, "score", lambda *a: seen.append(spark.conf.get(key)) or plain(*a))
    assert katz.train_and_score(cases.documents(spark, ["a b", "b c"])).count() == 2
    assert seen == [str(katz.BATCH)] and spark.conf.get(key) == before


# ---- packing


def plain_cuts(at, fee, size):
    cost = [0.0] + [float("inf")] * (len(at) - 1)
    for i in range(1, len(at)):
        for j in range(i):
            length = at[i] - at[j]
            if length <= size:
                padding = 0 if length & (length - 1) == 0 else size - length
                cost[i] = min(cost[i], cost[j] + padding + fee[i] + packing.WINDOW)
    return cost[-1]


def test_cuts_are_optimal():
    rng = random.Random(5)
    for _ in range(60):
        size = rng.choice([16, 32, 64])
        at = np.cumsum([0, *(rng.randint(1, size // 2) for _ in range(rng.randint(1, 40)))])
        fee = np.array([0.0, *(rng.choice([0.0, 4.0, 20.0]) for _ in at[1:])])
        cuts = packing.best_cuts(at, fee, size)
        cost, last = 0.0, 0
        for i in cuts:
            length = int(at[i] - at[last])
            assert 0 < length <= size
            cost += (0 if length & (length - 1) == 0 else size - length) + fee[i] + packing.WINDOW
            last = i
        assert last == len(at) - 1
        assert cost == pytest.approx(plain_cuts(at, fee, size))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    odd = ["don't  stop\n\n it's   fine <|endoftext|> 漢字 😀 x", "x" * 5000, "   \t\n  ", " a\r\n b\x00c"]
    docs = cases.edge_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    docs = docs.unionByName(cases.small(spark, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text")).unionByName(cases.documents(spark, odd, ids=[500, 501, 502, 503]).select("doc_id", "text"))
    pieces = packing.pack(docs, segment=20_000).collect()
    by_doc: dict = {}
    by_sequence: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in own])
        assert ids.tolist() == [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, packing.END_ID]
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist() and {p.doc_tokens for p in own} == {len(ids)}
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        total = sum(p.length for p in own)
        assert 0 < total <= packing.SIZE
        padding += 0 if total & (total - 1) == 0 else packing.SIZE - total
    assert padding < 0.02 * sum(p.length for p in pieces)
    assert packing.pack(cases.no_documents(spark)).count() == 0


# ---- pages

PAGE = """<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a>Menu one</a></li></ul></nav>
<div class="wrap{k}"><div class="sidebar"><p>Side words that are long enough to look like a text of the page, but aren't.</p></div>
<div class="story-{k}"><h1>Title {k}</h1><p>First &amp; <b>bold</b>
  words of article {k}, with some length to them.</p><p>Second block&nbsp;here.</p>{more}</div></div>
<div class="comments"><p>Great post, reader number {k} says, and goes on for a very very very long time, far longer than the article.</p></div>
<footer>Imprint {k}</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_pages_text(spark):
    rows = [(k, "https://Host.example/p", PAGE.format(k=k, more="")) for k in range(6)]
    rows += [(10, None, None), (11, "https://host.example/q", ""), (12, "https://host.example/r", "<p>bare text"), (13, "https://other.example/", "<div class=x><p>Only page &lt;here&gt;</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("path", F.lit("clash"))
    found = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for k in range(6):
        assert found[k].text == f"Title {k}\nFirst & bold words of article {k}, with some length to them.\nSecond block here."
        assert found[k].by_host
    assert found[10].text == found[11].text == ""
    assert found[12].text == "bare text" and found[13].text == "Only page <here>"


def test_page_follows_its_host(spark):
    """A page whose own best container is a long table takes the path that its host's other pages chose."""
    table = "<div class='data'><p>" + "figures of a long table " * 40 + "</p></div>"
    rows = [(k, "https://h.example/", f"<body><div class='story'><p>{'words of the article ' * 8}{k}</p></div></body>") for k in range(8)]
    rows.append((99, "https://h.example/", f"<body><div class='story'><p>the article itself</p></div>{table}</body>"))
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[99] == "the article itself"


def test_pages_query_and_empty(spark):
    found = queries.op6_html_extract(spark, cases.SMALL)
    rows = found.collect()
    assert len(rows) == cases.small(spark, "pages").count()
    assert all(r.n_chars == len(r.text) and "  " not in r.text and "<p" not in r.text for r in rows)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- neighbours


def plain_nearest(rows, queried, k=10):
    ok = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, v in ok:
        if queried(q):
            far = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in ok if i != q)
            out[q] = far[:k]
    return out


def test_neighbours_recall_and_scores(spark):
    table = cases.small(spark, "embeddings")
    true = plain_nearest([(r.vec_id, r.embedding) for r in table.collect()], lambda i: i % 10 == 0)
    found: dict = {}
    for r in ann_tree.nearest(table, F.col("vec_id") % 10 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(found) == set(true)
    met = total = 0
    vectors = {r.vec_id: np.asarray(r.embedding, float) for r in table.collect()}
    for q, own in found.items():
        own.sort()
        assert [x[0] for x in own] == list(range(1, 11)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
        assert all(s == pytest.approx(float(np.linalg.norm(vectors[q] - vectors[i])), rel=1e-12) for _, s, i in own)
        met += len({i for _, _, i in own} & {i for _, i in true[q]})
        total += len(true[q])
    assert met / total >= 0.9


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (100, [0.0, 0.0]), (200, None), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [None, 1.0]), (600, [2.0, 2.0]), (3, [5.0, 5.0]), (None, [1.0, 1.0]), (700, [1.0])]
    table = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], "vec_id long, embedding array<float>, leaf int, v int, score string")
    found: dict = {}
    for r in ann_tree.nearest(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [x[1] for x in sorted(v)] for q, v in found.items()} == {0: [1, 2, 600, 3], 600: [0, 1, 2, 3]}
    assert ann_tree.nearest(table.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_one_repeated_vector(spark):
    table = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.rand(1), F.rand(2))).cast("array<float>").alias("embedding"))
    found = ann_tree.nearest(table, F.col("vec_id") == 3000).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [3 * k for k in range(10)] and all(r.score == 0 for r in found)


def test_neighbours_in_small_leaves_are_as_many_as_asked_for(spark, monkeypatch):
    """Outliers whose leaves hold next to nothing, and an id that stands in many rows, still get k rows."""
    monkeypatch.setattr(ann_tree, "LEAF", 4)
    monkeypatch.setattr(ann_tree, "TARGET", 0.01)
    rows = [(k, [float(k % 7) / 100, 1.0]) for k in range(500)] + [(1000 + k, [1e6 * (k + 1), -1e6]) for k in range(3)] + [(2000, [5e5, 5e5])] * 30
    found = ann_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") >= 1000, target=0.01).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {1000: 10, 1001: 10, 1002: 10, 2000: 10}


def test_leaves_come_nearest_centre_first():
    x = np.random.default_rng(3).normal(size=(2000, 8))
    tree = ann_tree.Tree(x)
    q = x[5] + 0.1
    order = tree.order(q, tree.n_leaves)
    centres = {tree.leaf[k]: np.sqrt(((tree.centers[k] - q) ** 2).sum()) for k in range(len(tree.leaf)) if tree.leaf[k] >= 0}
    assert sorted(order) == sorted(centres) and np.all(np.diff([centres[leaf] for leaf in order]) > -1e-9)


def test_packing_into_short_sequences(spark):
    docs = cases.documents(spark, ["word " * 300, "a. " * 50, None, "x" * 500])
    for size in (1, 7, 32):
        pieces = packing.pack(docs, size=size).collect()
        assert max(r.length for r in pieces) <= size
        total = {r.doc_id: r.doc_tokens for r in pieces}
        assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in total} == total


def test_finder_and_sums_against_plain_search():
    rng = np.random.default_rng(5)
    for keys in (np.zeros(0, np.int64), np.array([7]), np.arange(-500, 500), np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 5000))):
        asked = np.concatenate([keys, rng.integers(-(1 << 63), (1 << 63) - 1, 500), [0, -1, -(1 << 63), (1 << 63) - 1]])
        met, at = katz._Finder(keys).find(asked)
        assert (met == np.isin(asked, keys)).all() and (keys[at[met]] == asked[met]).all()
    key, weight = rng.integers(0, 50, 1000), rng.integers(0, 9, 1000)
    kinds = np.unique(key)
    for w, sums in ((None, np.bincount(key)[kinds]), (weight, np.bincount(key, weight)[kinds])):
        first, n = katz._sums(key, w)
        assert (key[first] == kinds).all() and (n == sums).all()
    assert len(katz._sums(key[:0])[0]) == len(katz._sums(key[:0], weight[:0])[1]) == 0


# ---- packing: texts and vocabularies that the fast encoder can't read


@pytest.mark.parametrize("run", [" ", "\n", "\t ", "　", "a", "-", "é"])
def test_two_million_characters_of_one_class_have_the_ids_of_tokenizers(run):
    encode = packing.Encoder(packing.default_vocabulary())
    text = "one two" + run * (2_000_000 // len(run)) + "three."
    assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert encode("one two" + run * 1000 + "three.").tolist() == encode.tokenizer.encode("one two" + run * 1000 + "three.", add_special_tokens=False).ids


def test_long_white_space_passes_op5(spark):
    texts = [" " * 2_000_000, "a\n" + "\n" * 2_000_000 + "b", "a clean text. It stays as it is."]
    docs = cases.documents(spark, texts)
    tokenizer = packing.Encoder(packing.default_vocabulary()).tokenizer
    want = {k + 1: [*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID] for k, t in enumerate(texts)}
    got: dict[int, list] = {}
    for r in sorted(packing.pack(docs).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert got == want


def test_other_vocabularies_are_read_by_tokenizers(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    text = "The QUICK brown fox, naïve  cafés 123 and\n\nlines... don't"
    words = public_tokenizers.path("word_bpe_49k.json")
    spec = json.loads(Tokenizer.from_file(packing.default_vocabulary()).to_str())
    paths = [words]
    for name, change in (("prefix", {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}), ("lower", {"normalizer": {"type": "Lowercase"}}), ("merges", {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}})):
        paths.append(str(tmp_path / f"{name}.json"))
        (tmp_path / f"{name}.json").write_text(json.dumps(spec | change))
    for path in paths:
        encode = packing.Encoder(path)
        assert encode.fast is None and encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.Encoder(packing.default_vocabulary()).fast is not None
