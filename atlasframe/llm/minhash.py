"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A text's set is its distinct five-word shingles as 64-bit hashes; texts of one set form a class at once. A
   class's sketch is its SKETCH smallest hashes.
2. Inverted lists of the INDEXED smallest values of each sketch, apart by the size of sets, propose pairs: all pairs
   within lists of up to SHORT classes. The sketch of the union of two sets, which follows from their sketches,
   estimates their similarity; pairs far below the threshold go, the others are verified on whole texts.
3. Longer lists aren't expanded into pairs. Their classes are described by what they and one class of the list, its hub,
   have not in common, made from whole texts. The elements that most of these differences hold lead from the hub to the
   group's centre, a set that need not be a document. The difference of two classes' differences from the centre is the
   difference of the classes, so the rest is exact and needs no texts.
4. With d the size of a class's difference from the centre, n its own size, and w = (100 + percent) d - (100 - percent) n, the
   triangle inequality links any two classes whose w add up to 0 or less. So all are linked with the most central class
   whose w is at most minus its own: in a group of edits of one text nearly all, without a comparison.
5. Any other linked pair shares at least (w_a + w_b) / 2 (100 + percent) elements of its differences, so it shares one
   of the rarest d - that + 1 of either. Only those are indexed, in bands of w so that the bound is close. Classes that
   by a part of their differences can't share so many, such as texts with one line in common, leave before they are counted.
   Lists of up to LISTED entries propose pairs, decided by the size of the intersection of their differences.
6. Classes in longer lists than that, such as those that lack overlapping parts of one text, are compared block by block: every pair
   of components, by a product of matrices of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, materialize, workers_import_us
from .textbatch import SOLID, map_text, mix, shingle_hashes, words_of

SHINGLE, PERCENT = 5, 85
SKETCH, INDEXED, SHORT, LISTED = 64, 16, 12, 64
#: A class with that many of its values in short lists meets all it is linked with there; the odds against one link are below 0.2 ** 12 (1e-10 at 85 percent).
ENOUGH = 12
#: Differences of one hub that meet its text in one task.
ROWS = 512
#: Below the threshold by over five standard errors of a full sketch's estimate.
SLACK = 0.25
#: Classes and elements of a block of differences on average; columns of a product at once.
BLOCK, BLOCK_ELEMENTS, COLUMNS = 512, 1 << 20, 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    words = words_of(data, offsets, SOLID)
    return [shingle_hashes(words.hash[a:b], size) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]


def sketches(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, class, twin, sketch); class and twin are two hashes of the whole set, null for an empty one."""

    def key(s: np.ndarray, salt: int) -> int | None:
        total = np.add.reduce(mix(s.view(np.uint64) ^ np.uint64(salt))) + np.uint64(len(s))
        return int(mix(np.array([total], np.uint64))[0].astype(np.int64)) if len(s) else None

    def make():
        def f(data, offsets):
            sets = shingle_sets(data, offsets, size)
            keys = [pa.array([key(s, salt) for s in sets], pa.int64()) for salt in (0, 0x5851F42D4C957F2D)]
            return [pa.array([len(s) for s in sets], pa.int64()), *keys, pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))]

        return f

    return map_text(docs, text, (F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key")), "n_shingles long, class long, twin long, sketch array<long>", make)


def _classes(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own and its classes (class, rep, n, sketch). Sets are told apart by 128 bits: where two share a class, each takes one of its own."""

    def grouped(rows: DataFrame) -> DataFrame:
        found = rows.where("class is not null and doc_id is not null").groupBy("class")
        return materialize(found.agg(F.min(F.struct("doc_id", "row_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("twin").alias("low"), F.max("twin").alias("high")))

    classes = grouped(own)
    clash = classes.where("low <> high").select("class", F.lit(True).alias("clash"))
    if not clash.isEmpty():
        own = materialize(own.join(clash, "class", "left").withColumn("class", F.when(F.col("clash"), F.xxhash64("class", "twin")).otherwise(F.col("class"))).drop("clash"))
        classes = grouped(own)
    return own, classes.drop("low", "high")


def _estimate(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that may reach the threshold, with their estimated similarity."""
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    x = pairs.join(side("b"), "b").join(side("a"), "a")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH)
    x = x.withColumn("top", union).withColumn("last", F.element_at("top", -1))
    both = F.size(F.filter(F.array_intersect("s_a", "s_b"), lambda v: v <= F.col("last")))
    x = x.select("a", "b", (both / F.size("top")).alias("estimate"), ((F.col("n_a") <= SKETCH) & (F.col("n_b") <= SKETCH) & (F.size("top") < SKETCH)).alias("whole"))
    return x.where(F.col("estimate") >= percent / 100 - F.when(F.col("whole"), 1e-9).otherwise(SLACK)).select("a", "b", "estimate")


def _with_texts(pairs: DataFrame, docs: DataFrame, reps: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes with the whole texts of their representatives. Classes that are a in many pairs have them in parts of about ROWS."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), F.col(text).alias("t"))
    named = reps.select("class", "doc_id", "row_key").join(texts, ["doc_id", "row_key"]).select("class", "t")
    often = materialize(pairs.groupBy("a").count().where(F.col("count") > ROWS).select("a", F.ceil(F.col("count") / ROWS).cast("int").alias("parts")))
    asked = pairs.select("a", "b").join(often, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    firsts = named.withColumnsRenamed({"class": "a", "t": "t_a"}).join(often, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return asked.join(named.withColumnsRenamed({"class": "b", "t": "t_b"}), "b").join(firsts, ["a", "part"]).select("a", "b", "t_a", "t_b")


def _set_pairs(batch: pa.RecordBatch, size: int):
    """Both sets of each row of a batch of _with_texts; rows of one a follow each other, so its set is made once."""
    last, own = None, None
    column_a, column_b = batch.column("t_a"), batch.column("t_b")
    for i, a in enumerate(batch.column("a").to_pylist()):
        if a != last:
            last, own = a, _set(column_a[i], size)
        yield own, _set(column_b[i], size)


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets, made anew from the representatives' whole texts, reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for own, other in _set_pairs(batch, size):
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_texts(pairs, docs, reps, doc_id, text).mapInArrow(run, "a long, b long").distinct()


def _differences(pairs: DataFrame, docs: DataFrame, reps: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(hub, class, n, elements) of pairs (a: hub, b: class): the size of the class's set and the shingles that only one of the two has."""

    def run(batches):
        for batch in batches:
            apart = [(np.setxor1d(own, other, assume_unique=True), len(other)) for own, other in _set_pairs(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([n for _, n in apart], pa.int64()), pa.array([d for d, _ in apart], pa.list_(pa.int64()))], names=["hub", "class", "n", "elements"])

    return _with_texts(pairs, docs, reps, doc_id, text).mapInArrow(run, "hub long, class long, n long, elements array<long>").dropDuplicates(["hub", "class"])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left shares with each of right."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        row, x = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(both, x)
        met = at < len(both)
        met[met] = both[at[met]] == x[met]
        order = np.argsort(at[met], kind="stable")
        sides.append((row[met][order], at[met][order]))
    for first in range(0, len(both), COLUMNS):
        parts = []
        for sets, (row, at) in zip((left, right), sides, strict=True):
            a, b = np.searchsorted(at, [first, first + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, len(both) - first)), np.float32)
            part[row[a:b], at[a:b] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _joined(diff: DataFrame, percent: int) -> DataFrame:
    """(a, b): a link for any two components (hub, class, component, n, elements) of a hub that hold classes which reach the threshold.

    A hub's rows outside its largest component are compared with all its rows, block by block, every pair of them.
    """
    sizes = diff.groupBy("hub", "component").agg(F.count("*").alias("rows"), F.sum(F.size("elements")).alias("held"))
    whole = sizes.groupBy("hub").agg(F.max(F.struct("rows", "component", "held")).alias("main"), F.sum("rows").alias("rows"), F.sum("held").alias("held")).where("rows > main.rows")
    blocks = lambda rows, held: F.greatest(F.ceil(rows / BLOCK), F.ceil(held / BLOCK_ELEMENTS), F.lit(1)).cast("int")
    cuts = whole.select("hub", F.col("main.component").alias("main"), blocks(F.col("main.rows"), F.col("main.held")).alias("n_main"), blocks(F.col("rows") - F.col("main.rows"), F.col("held") - F.col("main.held")).alias("n_rest"))
    rows = diff.join(cuts, "hub").withColumn("rest", F.col("component") != F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.when(F.col("rest"), F.col("n_rest")).otherwise(F.col("n_main"))).cast("int"))
    # Blocks of the rest are 0 to n_rest - 1, those of the largest component follow; (i, j) has i among the rest and j from i on.
    number = F.when(F.col("rest"), F.col("own")).otherwise(F.col("n_rest") + F.col("own"))
    low = F.transform(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("own")).otherwise(F.col("n_rest") - 1)), lambda i: F.struct(i.alias("i"), number.alias("j")))
    high = F.when(F.col("rest"), F.transform(F.sequence(F.col("own"), F.col("n_rest") + F.col("n_main") - 1), lambda j: F.struct(number.alias("i"), j.alias("j")))).otherwise(low)
    asked = rows.select("hub", "class", "component", "n", "elements", number.alias("number"), F.explode(F.array_distinct(F.concat(low, high))).alias("pair"))

    def compare(t: pa.Table) -> pa.Table:
        number, i, j = t.column("number").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        cls, component, n = (t.column(k).to_numpy() for k in ("class", "component", "n"))
        elements = t.column("elements").combine_chunks()
        offsets, flat = elements.offsets.to_numpy(), elements.values.to_numpy()
        left, right = np.flatnonzero(number == i), np.flatnonzero(number == j)
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            sets = lambda at: [flat[offsets[k] : offsets[k + 1]] for k in at]
            d = np.diff(offsets)
            total = n[left][:, None] + n[right]
            both = (total - (d[left][:, None] + d[right] - 2 * _shared(sets(left), sets(right)))) // 2
            x, y = np.nonzero((100 * both >= percent * (total - both)) & (component[left][:, None] != component[right]))
            x, y = left[x], right[y]
            # One link joins two components.
            ends = np.stack([np.minimum(component[x], component[y]), np.maximum(component[x], component[y])], axis=1)
            first = np.unique(ends, axis=0, return_index=True)[1]
            a, b = np.minimum(cls[x], cls[y])[first], np.maximum(cls[x], cls[y])[first]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    asked = asked.select("hub", "class", "component", "n", "elements", "number", "pair.i", "pair.j")
    return asked.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _set(text: pa.Scalar, size: int) -> np.ndarray:
    raw = np.frombuffer(text.as_buffer(), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), size)[0]


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, class, n, at, long): lists of two or more classes by sketch value, the class's smallest but at, and size of set.

    Sizes go by powers of two; a set within the threshold of the next power stands in that list as well, so that any two
    sets of similar sizes meet.
    """
    size = F.floor(F.log2("n"))
    above = F.when(100 * F.col("n") >= percent * F.pow(F.lit(2), size + 1), F.array(size, size + 1)).otherwise(F.array(size))
    posted = classes.select("class", "n", above.alias("sizes"), F.posexplode(F.slice("sketch", 1, INDEXED)).alias("at", "v"))
    posted = posted.withColumn("size", F.explode("sizes")).select(F.xxhash64("v", "size").alias("value"), "class", "n", "at")
    return materialize(posted.join(posted.groupBy("value").agg(F.count("*").alias("long")).where("long > 1"), "value"))


def _most_held(t: pa.Table) -> pa.Table:
    """(hub, element, count) of the elements that more than half of the rows of t, a part of one hub, hold."""
    element, count = np.unique(t.column("elements").combine_chunks().flatten().to_numpy(), return_counts=True)
    most = 2 * count > len(t)
    return pa.table({"hub": pa.array(np.full(most.sum(), t.column("hub")[0].as_py()), pa.int64()), "element": pa.array(element[most], pa.int64()), "count": pa.array(count[most], pa.int64())})


def _centred(diff: DataFrame, percent: int) -> DataFrame:
    """diff (hub, class, n, elements) by differences from the centre of each hub's classes, with d and w, see 3 and 4."""
    rows = materialize(diff.groupBy("hub").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / ROWS).cast("int").alias("parts")))
    parts = diff.join(rows, "hub").select("hub", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), "elements")
    # Any set can be the centre; this one is close to all. What most of a hub's rows hold, most of some part hold.
    held = parts.groupBy("hub", "part").applyInArrow(_most_held, "hub long, element long, count long").groupBy("hub", "element").agg(F.sum("count").alias("count"))
    most = held.join(rows, "hub").where(2 * F.col("count") > F.col("rows")).groupBy("hub").agg(F.collect_list("element").alias("most"))
    moved = diff.join(materialize(most), "hub", "left").withColumn("most", F.coalesce("most", F.array().cast("array<long>")))
    moved = moved.withColumn("elements", F.concat(F.array_except("elements", "most"), F.array_except("most", "elements")))
    d = F.size("elements").cast("long")
    return materialize(moved.select("hub", "class", "n", "elements", d.alias("d"), ((100 + percent) * d - (100 - percent) * F.col("n")).alias("w")))


def _that_meet(rows: DataFrame, least: Column) -> DataFrame:
    """The rows (hub, class, component, elements, d) that may share least elements or more with a row of their hub in another component.

    Two sets that share so many share k of the first d - least + k of either in any order, here that of the numbers, for
    any k up to least. So a text that has but a line in common with its group goes by a part of its elements.
    """
    k = F.ceil(least / 8)
    prefix = F.when(least <= F.col("d"), F.col("d") - least + k).otherwise(0).cast("int")
    first = materialize(rows.select("hub", "class", "component", k.alias("k"), F.explode(F.slice(F.array_sort("elements"), 1, prefix)).alias("element")))
    met = first.groupBy("hub", "element").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one < two").select("hub", "element")
    near = materialize(first.join(met, ["hub", "element"]).groupBy("hub", "class").agg(F.count("*").alias("met"), F.first("k").alias("k")).where("met >= k").select("hub", "class"))
    discard(first)
    return materialize(rows.join(near, ["hub", "class"], "left_semi"))


def _rare_lists(centred: DataFrame, middle: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Index and probes (hub, element, band, class, at) of 5 for rows (hub, class, component, n, elements, d, w) and middle (hub, low, home, size).

    Of a pair the class with the smaller w is looked for in the index, by the other's probes; at is the place of the
    element in the class's order from rare to frequent. low is the least w of the hub, home the component of the class that has it.
    """
    # Only hubs that hold other components take part.
    rows = centred.join(middle, "hub").withColumn("rest", F.col("component") != F.col("home"))
    some = materialize(rows.where("rest").select("hub").distinct())
    unit, reach = 100 + percent, 100 - percent
    width = F.greatest(F.lit(2 * unit), F.floor(reach * F.col("size") / 4))
    need = lambda w: F.greatest(F.lit(1), F.ceil(w / unit))
    # A class at home is linked with others only, whose w is above -low.
    other = 1 - F.col("low")
    least = need(F.when(F.col("rest"), F.col("w")).otherwise((F.col("w") + F.greatest("w", other)) / 2))
    lowest = F.greatest(F.col("low"), F.floor(F.col("w") - 200 * reach * F.col("n") / percent))
    lowest = F.when(F.col("rest"), lowest).otherwise(F.greatest(lowest, other))
    rows = _that_meet(rows.join(some, "hub", "left_semi"), F.when(lowest <= F.col("w"), need((lowest + F.col("w")) / 2)).otherwise(least))
    # Of their elements those that two classes hold.
    spread = rows.select("hub", "class", F.explode("elements").alias("element"))
    often = spread.groupBy("hub", "element").agg(F.count("*").alias("count")).where("count > 1")
    order = spread.join(often, ["hub", "element"]).groupBy("hub", "class").agg(F.sort_array(F.collect_list(F.struct("count", "element"))).alias("order"))
    x = materialize(rows.drop("elements").join(order, ["hub", "class"]).withColumn("alone", F.col("d") - F.size("order")))
    column = lambda k, prefix: F.transform(F.slice("order", 1, prefix), lambda x, i: F.struct(x["element"].alias("element"), (F.col("alone") + i + 1).alias("at"), k.alias("band")))
    kept = lambda prefix: F.greatest(F.lit(0), F.least(prefix, F.col("d")) - F.col("alone")).cast("int")
    picked = ("hub", "class", "component", "rest", "n", "d", "w")
    index = x.select(*picked, F.explode(column(F.floor(F.col("w") / width), kept(F.col("d") - least + 1))).alias("e")).select(*picked, "e.*")
    bands = F.sequence(F.floor(lowest / width), F.floor(F.col("w") / width))
    probes = x.where(lowest <= F.col("w")).withColumn("band", F.explode(bands))
    share = need((F.greatest(F.col("band") * width, lowest) + F.col("w")) / 2)
    probes = probes.select(*picked, F.explode(column(F.col("band"), kept(F.col("d") - share + 1))).alias("e")).select(*picked, "e.*")
    return materialize(index), materialize(probes)


def _rare_pairs(index: DataFrame, probes: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """(hub, a, b): pairs of classes that index and probes propose in lists (hub, element, band), both within the prefix of what they must share."""
    key = ["hub", "element", "band"]
    side = lambda x, y: x.join(lists, key).select(*key, *[F.col(k).alias(f"{k}_{y}") for k in ("class", "component", "rest", "n", "d", "w", "at")])
    x = side(probes, "b").join(side(index, "a"), key)
    share = F.greatest(F.lit(1), F.ceil((F.col("w_a") + F.col("w_b")) / (2 * (100 + percent))))
    near = (F.col("w_a") <= F.col("w_b")) & (F.col("component_a") != F.col("component_b")) & (F.col("rest_a") | F.col("rest_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    x = x.where(near & (F.col("at_a") <= F.col("d_a") - share + 1) & (F.col("at_b") <= F.col("d_b") - share + 1))
    return x.select("hub", F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def _linked(pairs: DataFrame, centred: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, a, b) whose similarity, by the differences of centred, reaches the threshold."""
    side = lambda x: centred.select("hub", F.col("class").alias(x), *[F.col(k).alias(f"{k}_{x}") for k in ("n", "d", "elements")])
    x = pairs.join(side("b"), ["hub", "b"]).join(side("a"), ["hub", "a"])
    apart = F.col("d_a") + F.col("d_b") - 2 * F.size(F.array_intersect("elements_a", "elements_b"))
    return x.where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, kept) of each row of docs; row_key is xxhash64 of the text.

    Rows without words have no shingles and are linked with nothing, as are rows without an id, whose component_id
    is null; both are kept. Repeated rows share a class. component_id is the smallest doc_id of the component.
    """
    workers_import_us(docs.sparkSession)
    own, classes = _classes(materialize(sketches(docs, doc_id, text, size)))
    reps = classes.select("class", "rep.doc_id", "rep.row_key")
    lists = _lists(classes, percent)
    short = lists.where(F.col("long") <= SHORT)
    side = lambda x: short.select("value", F.col("class").alias(x), F.col("n").alias(f"n_{x}"))
    alike = (F.col("a") < F.col("b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = side("a").join(side("b"), "value").where(alike).select("a", "b").distinct()
    pairs = materialize(_estimate(pairs, classes, percent))

    # The most similar proposal of each class first: these connect nearly all that can be connected.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "estimate")
    best = materialize(ends.groupBy("x").agg(F.max(F.struct("estimate", "a", "b")).alias("best")).select("best.a", "best.b").distinct())
    links = materialize(_verify(best, docs, reps, doc_id, text, size, percent))
    found = materialize(components(links))

    def labelled(rows: DataFrame, key: str = "class", name: str = "component") -> DataFrame:
        """rows with the component found so far of the class in column key."""
        return rows.join(found.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    def add(more: DataFrame) -> None:
        nonlocal links, found
        more = materialize(more)
        if not more.isEmpty():
            links = materialize(links.unionByName(more))
            found = materialize(components(links))

    far = labelled(labelled(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), "a", "c_a"), "b", "c_b").where("c_a <> c_b")
    add(_verify(far.select("a", "b"), docs, reps, doc_id, text, size, percent))

    # Long lists, of the classes that their other values don't answer for, as far as they hold several components.
    in_long = F.bit_count(F.bit_or(F.when(F.col("long") > SHORT, F.call_function("shiftleft", F.lit(1), "at")).otherwise(0)))
    stand = lists.groupBy("class").agg(in_long.alias("n_long"), F.first("n").alias("n"), F.sum("long").alias("weight"))
    open_ones = stand.where((F.col("n_long") > 0) & (F.least("n", F.lit(INDEXED)) - F.col("n_long") < ENOUGH)).select("class", "weight")
    member = lists.where(F.col("long") > SHORT).select("value", "class").join(open_ones, "class")
    member = materialize(labelled(member))
    hubs = member.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct("weight", "class")).alias("top")).where("low < high").select("value", F.col("top.class").alias("hub"))
    # A class whose values stand in the longest lists is near the middle of its group, and the same one leads most lists of the group.
    around = materialize(member.join(hubs, "value").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct())
    if not around.isEmpty():
        centred = _centred(materialize(_differences(around, docs, reps, doc_id, text, size)), percent)
        middle = materialize(centred.groupBy("hub").agg(F.min(F.struct("w", "class", "n")).alias("top")).select("hub", F.col("top.w").alias("low"), F.col("top.class").alias("centre"), F.col("top.n").alias("size")))
        near = centred.join(middle, "hub").where((F.col("w") + F.col("low") <= 0) & (F.col("class") != F.col("centre")))
        add(near.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct())
        index, probes = _rare_lists(labelled(centred), labelled(middle, "centre", "home").drop("centre"), percent)
        sizes = materialize(index.groupBy("hub", "element", "band").agg(F.count("*").alias("long")))
        key = ["hub", "element", "band"]
        add(_linked(_rare_pairs(index, probes, sizes.where(F.col("long") <= LISTED).select(key), percent), centred, percent))
        hot = sizes.where(F.col("long") > LISTED).select(key)
        if not hot.isEmpty():
            crowd = index.unionByName(probes).join(hot, key, "left_semi").select("hub", "class").distinct()
            add(_joined(materialize(labelled(centred.join(crowd, ["hub", "class"], "left_semi"))), percent))

    smallest = labelled(classes.select("class", F.col("rep.doc_id").alias("first")))
    heads = smallest.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(smallest.join(heads, "component").select("class", "component_id"))
    out = own.drop("sketch", "twin").withColumn("class", F.when(F.col("doc_id").isNotNull(), F.col("class"))).join(named, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def remove_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: the one with the smallest id. Rows repeated with id and text stay together; all columns pass through."""
    found = near_duplicates(docs, doc_id, text, size, percent)
    gone = materialize(found.where("not kept").select(F.col("doc_id").alias("af_id"), F.col("row_key").alias("af_key")).distinct())
    rows = docs.withColumns({"af_id": F.col(doc_id).cast("long"), "af_key": F.xxhash64(text)})
    # One plan at every size, see line_spread.
    return rows.join(gone.hint("merge"), ["af_id", "af_key"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
