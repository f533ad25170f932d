"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns word shingles.  Documents with equal
sets are one class, its smallest doc_id stands for it.  Columns are ordered by a bounded
sketch of their frequencies (then by hash), and a pair that reaches the threshold must share a
column among each one's first ``n - ceil(threshold * n) + 1``; only that part of the matrix is
multiplied.  Within a column, sizes and positions bound the overlap that a pair can still
reach, and pairs below it are discarded before they are made.

So that a column of thousands of near copies doesn't make all their pairs, the product is
taken twice.  First, in each column, every class meets the column's hub, the class that has the fewest columns
before it (the text that the others were edited from has none), and its neighbour in size; the
classes' connected components are found.  Then, column by column, only classes of different components are
multiplied, by kinds of equal component, size and position, which the bounds discard together; the
products are added up by pair, and a pair goes on only if its overlap so far and what both have left
after their last common column reach the size bound.  Pairs within a component would change no
component.

Both products' pairs then meet the bound over the whole matrix: its columns are cut into ``BLOCKS`` blocks,
a class keeps its number of columns in each, and two classes share at most the smaller number,
block by block.  What is left is verified by the full overlap of its sets.

The sketch orders columns and nothing else: any order gives the same result.  Shingles compare
by 64-bit hashes, equal sets by a 128-bit sum.  Empty or null texts have an empty set, link with
nothing and are their own component.  Rows with a null doc_id have a null component and link
with nothing.  Rows that share a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteline.llm import blocks, store
from siteline.llm import text as T
from siteline.llm.quality import add_vectors

SKETCH = 1 << 20
#: Column blocks by which the overlap of two whole sets is bounded.
BLOCKS = 256
_CHUNK = 1 << 16
#: Rows of a column that the first product takes together.
TOGETHER = 4096


def shingles(w: T.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a slice's documents, by document and hash, and the documents' bounds."""
    at = w.gram_starts(width)
    docs, hashes = [w.doc[at]], [T.grams(w.hashes, width)[at] if len(at) else w.hashes[:0]]
    for n in range(1, width):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            docs.append(short)
            hashes.append(T.mix(T.grams(w.hashes, n)[w.bounds[short]] + np.uint64(n)))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))
        doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(w.n_docs + 1))


def least_overlap(percent: int) -> Column:
    """The overlap that documents of sizes na and nb need."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - F.lit(1e-9))


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Documents by hashed shingle, ``SKETCH`` counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for w in T.words(batch.column(0), lower=True):
                np.add.at(sums, (shingles(w, width)[0] & np.uint64(SKETCH - 1)).astype(np.int64), 1)
        rows = [(k, sums[k * _CHUNK : (k + 1) * _CHUNK]) for k in range(SKETCH // _CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v.tobytes() for _, v in rows], pa.binary())], ["key", "counts"])

    out = np.zeros(SKETCH, np.int64)
    for k, v in add_vectors(docs.select("text").mapInArrow(store.trimmed(count), "key int, counts binary")).items():
        out[k * _CHUNK : (k + 1) * _CHUNK] = v
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, set size, set signature, the packed first columns in the order of columns, and the sizes by block, of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, width))  # 4 MB at any size
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("head", pa.binary()), ("sizes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for w in T.words(batch.column(1), lower=True):
                h, bounds = shingles(w, width)
                n = np.diff(bounds)
                for c, salt in zip(cols[1:3], (1, 2), strict=True):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))])
                    c.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                doc = np.repeat(np.arange(w.n_docs), n)
                ordered = h[np.lexsort((h, often[(h & np.uint64(SKETCH - 1)).astype(np.int64)], doc))]
                head = n - (-(-n * percent // 100)) + 1
                sizes = np.bincount(doc * BLOCKS + (h >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int64), minlength=w.n_docs * BLOCKS)
                cols[4].extend(blocks.pack(x) if m else b"" for x, m in zip(sizes.reshape(-1, BLOCKS), n.tolist(), strict=True))
                cols[0].append(n)
                cols[3].extend(ordered[a : a + k].tobytes() if m else b"" for a, k, m in zip(bounds[:-1].tolist(), head.tolist(), n.tolist(), strict=True))
            arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(store.trimmed(run), "doc_id long, n long, sig1 long, sig2 long, head binary, sizes binary")


def entries(classes: DataFrame) -> DataFrame:
    """The matrix's first columns: column, position, class and its size."""
    schema = pa.schema([("column", pa.int64()), ("pos", pa.int32()), ("rep", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            size = np.array([len(x) for x in heads], np.int64)
            if len(size):
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(pos.astype(np.int32)), *(pa.array(np.repeat(batch.column(k).to_numpy(), size), t) for k, t in ((0, pa.int64()), (1, pa.int32())))], schema=schema)

    return classes.select("rep", "n", "head").mapInArrow(store.trimmed(run), "column long, pos int, rep long, n int")


def reachable(percent: int) -> Column:
    """Whether sizes (na, nb) and positions (pa, pb) of a first common column leave enough overlap."""
    return F.lit(1) + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1 >= least_overlap(percent)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def neighbours(columns: DataFrame, percent: int) -> DataFrame:
    """Pairs of each class with its column's hub, and with the next smaller class.

    A column of more than ``TOGETHER`` rows is taken in parts by a hash; the parts' hubs meet the column's hub.
    """
    n_parts = F.ceil(F.col("count") / TOGETHER)
    me = F.struct(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    dealt = columns.select("column", "pos", "n", "rep", F.pmod(F.xxhash64("rep"), n_parts).alias("part"), (n_parts > 1).alias("many"), me.alias("me"))
    part = Window.partitionBy("column", "part")
    seen = dealt.select("column", "many", "me", F.lag("me").over(part.orderBy("n", "rep")).alias("last"), F.first("me").over(part.orderBy("pos", "n", "rep")).alias("hub"))
    hubs = seen.filter(F.col("many") & (F.col("me") == F.col("hub"))).select("column", "me")
    over = hubs.select("me", F.first("me").over(Window.partitionBy("column").orderBy("me.pb", "me.nb", "me.b")).alias("other"))  # a row a part
    both = seen.select("me", F.explode(F.array_distinct(F.array("last", "hub"))).alias("other")).unionByName(over).filter("other is not null and other.b <> me.b")
    named = both.select("me.*", F.col("other.b").alias("a"), F.col("other.nb").alias("na"), F.col("other.pb").alias("pa"))
    return _ordered(named.filter(reachable(percent))).distinct()


def across(columns: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components whose added-up overlap can still reach the threshold."""
    own = columns.join(components, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = own.groupBy("column").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("column")
    own = store.written(own.join(mixed, "column", "left_semi"), "mixed")
    kinds = own.select("column", "comp", "n", "pos").distinct()
    left = kinds.select("column", F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    right = kinds.select("column", F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    met = left.join(right, "column").filter((F.col("ca") < F.col("cb")) & reachable(percent))
    a = own.select("column", F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("rep").alias("a"))
    b = own.select("column", F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("rep").alias("b"))
    products = met.join(a, ["column", "ca", "na", "pa"]).join(b, ["column", "cb", "nb", "pb"])
    # positions only grow along the common columns, so those left out above come after all that are counted
    overlap = products.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("overlap"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    left_over = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return _ordered(overlap.filter(F.col("overlap") + left_over >= least_overlap(percent))).distinct()


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes by block allow the overlap that they need."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = blocks.unpack(x, BLOCKS), blocks.unpack(y, BLOCKS)
                keep[k] = (100 + percent) * int(np.minimum(x, y).sum()) >= percent * int(x.sum() + y.sum())
            yield batch.select([0, 1]).filter(pa.array(keep))

    sizes = lambda side: classes.select(F.col("rep").alias(side), F.col("sizes").alias(f"sizes_{side}"))
    return pairs.join(sizes("a"), "a").join(sizes("b"), "b").select("a", "b", "sizes_a", "sizes_b").mapInArrow(store.trimmed(bound), "a long, b long")


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    met = store.written(pairs, "met")
    pairs = store.written(possible(met, classes, percent), "pairs")
    store.delete(met)
    blocks.free(docs.sparkSession)
    wanted = store.written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for w in T.words(batch.column(1), lower=True):
                h, bounds = shingles(w, width)
                out.extend(h[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "set"])

    sets = store.written(texts.mapInArrow(store.trimmed(make), "id long, set binary").distinct(), "sets")
    blocks.free(docs.sparkSession)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    out = store.written(joined.select("a", "b", "set_a", "set_b").mapInArrow(store.trimmed(verify), "a long, b long").distinct(), "links")
    store.delete(sets, pairs, wanted)
    blocks.free(docs.sparkSession)
    return out


def _contract(edges: DataFrame) -> DataFrame:
    """Each task's edges (u > v) replaced by stars on the smallest node of its own components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.get(root, root) != root:
                root = parent[root]
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        def stars() -> pa.RecordBatch:
            made = [(u, r) for u in parent if (r := find(u)) != u]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in made], pa.int64()), pa.array([v for _, v in made], pa.int64())], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:
                yield stars()
        yield stars()

    return edges.mapInArrow(store.trimmed(run), "u long, v long")


def components(pairs: DataFrame) -> DataFrame:
    """rep and comp, its component's smallest node, for every node of ``pairs`` (a, b).

    Alternating large and small stars, after each task has contracted its own edges; a
    round reads what the one before wrote, until nothing changes.
    """
    edges = store.written(_contract(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        edges, last = store.written(small, "edges"), edges
        store.delete(last)
        blocks.free(edges.sparkSession)  # a round's plans and broadcasts, too, stay in the driver until then
        now = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))")).first()
        if now == before:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
        before = now


def joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    store.small_batches(spark)
    made = store.written(rows(docs, width, percent), "rows")
    sets = ["n", "sig1", "sig2"]
    least = made.filter("n > 0 and doc_id is not null").groupBy(*sets).agg(F.min(F.struct("doc_id", "head", "sizes")).alias("least"))
    classes = store.written(least.select(*sets, F.col("least.doc_id").alias("rep"), F.col("least.head").alias("head"), F.col("least.sizes").alias("sizes")), "classes")
    all_ = entries(classes)
    shared = all_.groupBy("column").count().filter("count > 1")
    columns = store.written(all_.join(shared.hint("merge"), "column"), "columns")
    blocks.free(spark)
    first = links(neighbours(columns, percent), classes, docs, width, percent)
    second = links(across(columns, components(first), percent), classes, docs, width, percent)
    store.delete(columns)
    blocks.free(spark)
    comps = components(first.unionByName(second))
    found = classes.join(comps, "rep", "left").select(*sets, F.coalesce("comp", "rep").alias("component_id"))
    found = store.written(found.groupBy(*sets).agg(F.min("component_id").alias("component_id")), "found")
    linked = made.select("doc_id", *sets).join(found, sets, "left")
    same = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), same.alias("component_id"))


def kept(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs`` that are the smallest of their component, with all their columns; null ids stay."""
    other = store.unused(docs.columns, "other")
    others = joined(docs.select("doc_id", "text"), width, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(others.hint("merge"), F.col("doc_id").cast("long") == F.col(other), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(store.documents(spark, sf_dir), 3, 90)


SQL = r"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where text is not null),
grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] end) as g from texts),
sizes as (select doc_id, count(*) as n from grams group by 1),
same as (select doc_id, md5(string_agg(g, chr(10) order by g)) as k from grams group by 1),
class as (select doc_id, min(doc_id) over (partition by k) as rep from same),
own as (select g.doc_id, g.g from grams g join class c on c.doc_id = g.doc_id and c.rep = g.doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from own a join own b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * p.n >= 90 * (x.n + y.n - p.n)),
near as (select a, b from links union select b, a from links),
reach(a, b) as (select distinct a, a from near union select r.a, n.b from reach r join near n on n.a = r.b),
comps as (select a, min(b) as c from reach group by 1)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(k.c, c.rep, d.doc_id) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id left join class c on c.doc_id = d.doc_id left join comps k on k.a = c.rep
"""

QUERIES = {"op10_jaccard_join": query}
ORACLE_SQL = {"op10_jaccard_join": SQL}
