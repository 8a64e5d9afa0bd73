"""Operator 1: n-gram Jaccard self-join by count vectors in R-trees.

Shingles are hashed into groups; a document's point is its count in each group; the sum over groups of the
smaller count bounds the overlap of two documents from above, so a pair whose bound is too small is dropped
without looking at its shingles, and what is left is verified on the whole sets.  Points have so many groups that the bound
is within about 1 % of the overlap: few pairs under the similarity asked for get as far as their texts.

Boxes of count vectors are selective only with as many groups as a document has shingles, so boxes alone can't
deal documents out to machines.  Blocks do that: documents that share the least shingle hash under one of
``tables`` hash orders meet in a block.  A pair at similarity s shares no block with probability
(1 - s) ** tables: 1e-12 at 0.75 with 20.  A block of over HOT_BLOCK unlinked rows (a shingle that is the least one of very many
documents that are no copies) is dealt out once more, by a second order, and there a pair must agree in two of the 20: it is lost
with probability 6e-11 at 0.75.

Equal sets are one node, known by 128 bits.  First each node is verified against the block leader it meets most often; groups of near
copies fall into one component by that.  Only blocks that still hold several components are searched by their R-tree, for a
spanning forest of survivors, so that a group isn't written out pair by pair.  Where all of these hold, the block's other
survivors can't merge anything; a block where one fails between components that stay apart is searched once more for all survivors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import heavy_join, row_windows, sorted_groups, stage_table, tidy, utf8_column
from .components import connected_components
from .countvector import CountVectorTree, pack_point, point_of, unpack_point
from .line_dedup import hash128

WINDOW = 2 << 20  # bytes of text handled at a time
TABLES = 20
BLOCK = 1024  # rows of a block that one task searches at a time
HOT_BLOCK = 8 * BLOCK  # rows outside its largest component from which a block is dealt out anew
LEADERS = 4
MEMBERS = 250  # members verified against one copy of their leader
BROADCAST_ROWS = 200_000  # rows (ids only) sent to every task at most; beyond, texts are joined by shuffle

_SIGNATURE = "doc_id long, t1 long, t2 long, n_shingles long, d1 long, d2 long, lows array<long>, point binary"
_SALTS = K.mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def _digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    out = []
    for salt in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9):
        total = int(K.mix64(values ^ np.uint64(salt)).sum(dtype=np.uint64)) + len(values) * 0x9FB21C651E98DF25
        out.append(int(np.array(total % (1 << 64), np.uint64).view(np.int64)))
    return out[0], out[1]


def _sets(col, width: int):
    offsets, data, _ = utf8_column(col)
    for a, b in row_windows(offsets, WINDOW):
        part = data[offsets[a] : offsets[b]]
        yield from K.row_sets(*K.shingle_hashes(part, offsets[a : b + 1] - offsets[a], width))


def _signatures(width: int, tables: int):
    """(doc_id, t1, t2, text) -> rows of _SIGNATURE."""
    order = np.arange(tables, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            rows = []
            for values in _sets(batch.column(3), width):
                if not len(values):
                    rows.append((0, None, None, None, None))
                    continue
                low = np.array([((values ^ _SALTS[k]) * _SALTS[-1 - k]).min() for k in range(tables)], np.uint64)
                rows.append((len(values), *_digest(values), K.mix64(low + order).view(np.int64), pack_point(*point_of(values))))
            n, d1, d2, lows, point = zip(*rows) if rows else [[]] * 5
            cols = [pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(lows, pa.list_(pa.int64())), pa.array(point, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *cols], names=["doc_id", "t1", "t2", "n_shingles", "d1", "d2", "lows", "point"])

    return run


def _verifier(width: int, percent: int):
    """(a, salt, role, b, d1, d2, text), leaders (role 0) first -> the pairs (a, b) that reach percent."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        at, leader = None, None
        for batch in batches:
            a, salt, role, b, d1, d2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            found = []
            for i, values in enumerate(_sets(batch.column(6), width)):
                if not len(values) or _digest(values) != (d1[i], d2[i]):
                    continue  # another row that has the same id
                if role[i] == 0:
                    at, leader = (a[i], salt[i]), values
                elif at == (a[i], salt[i]):
                    both = len(np.intersect1d(leader, values, assume_unique=True))
                    if 100 * both >= percent * (len(leader) + len(values) - both):
                        found.append((int(a[i]), int(b[i])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

    return run


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach percent.  Texts of b stream past the set of a;
    a hot a is split over salts, each with its own copy of a.  Only texts that a pair asks for are dealt out.  Equal texts under
    one id, and other texts under it with another set, do no harm: found pairs are distinct, and a text is known by its set."""
    load = stage_table(pairs.groupBy("a").agg(F.count("*").alias("n")), "load")
    salts = F.ceil(F.col("n") / MEMBERS)
    members = heavy_join(pairs, load, ["a"], "n").select("a", F.pmod(F.xxhash64("b"), salts).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    leaders = load.select("a", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
    need = members.unionByName(leaders).join(nodes.select("node", "head", "d1", "d2"), "node")
    need = stage_table(need.select("a", "salt", "role", F.col("node").alias("b"), "d1", "d2", F.col("head").alias("doc_id")), "need")
    few = need.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(need) if few else need.hint("shuffle_hash"), "doc_id")
    dealt = texts.select("a", "salt", "role", "b", "d1", "d2", "text").repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "role")
    return dealt.mapInArrow(tidy(_verifier(width, percent)), "a long, b long").distinct()


def _stars(multi: DataFrame, tables: int) -> DataFrame:
    """Pairs (a, b) to verify first: for each b of the LEADERS leaders of each of its blocks the one it meets most often.

    A block is led by its most central node, the one whose blocks are the largest, and by the first nodes in a few hash orders.
    """
    central = multi.groupBy("node").agg(F.sum("size").alias("weight"))
    rows = stage_table(multi.select("key", "node").join(central, "node"), "weights")
    orders = [F.min(F.struct(F.xxhash64("node", F.lit(s)).alias("h"), "node"))["node"] for s in range(LEADERS - 1)]
    leads = rows.groupBy("key").agg(F.count("*").alias("size"), F.array(F.max(F.struct("weight", "node"))["node"], *orders).alias("leads"))
    leads = stage_table(leads, "leads")
    met = heavy_join(rows.select("key", "node"), leads, ["key"], "size").select("node", F.explode(F.array_distinct("leads")).alias("lead")).where("node <> lead")
    met = met.groupBy("node", "lead").agg(F.count("*").alias("met")).where(F.col("met") * 2 >= tables)
    best = met.groupBy("node").agg(F.max(F.struct("met", (-F.col("lead")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), F.col("node").alias("b"))


_CELL = ["key", "i", "j", "slot", "node", "comp", "base", "low", "lows", "point"]


def _searcher(percent: int, spanning: bool, tables: int):
    """Cells of blocks, rows _CELL sorted by key, i, j -> (base, a, b): pairs of nodes that survive the R-tree."""
    schema = pa.schema([("base", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def search(cell):
        slot, node, comp = (cell.column(c).to_numpy() for c in (3, 4, 5))
        if len(node) < 2 or (comp == comp[0]).all():
            return None
        i, j, base, low = (cell.column(c)[0].as_py() for c in (1, 2, 6, 7))
        lows = cell.column(8).flatten().to_numpy().reshape(-1, tables)

        def wanted(p, q):
            ok = comp[p] != comp[q]
            if i != j and (i, j) != (0, -1):
                ok &= slot[p] != slot[q]
            at = np.flatnonzero(ok)
            # of all blocks that hold a pair, only the first one looks at it
            both = lows[p[at]] == lows[q[at]]
            rows = np.arange(len(at))
            first = both.argmax(1)
            own = lows[p[at], first] == base
            if low is not None:
                both[rows, first] = False
                second = both.argmax(1)
                own &= both[rows, second] & (lows[p[at], second] == low)
            ok[at] = own
            return ok

        tree = CountVectorTree([unpack_point(v) for v in cell.column(9).to_pylist()])
        x, y = tree.survivors(percent, comp, wanted, spanning)
        x, y = node[x], node[y]
        keep = x != y
        low_, high = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(low_), base, np.int64)), pa.array(low_), pa.array(high)], schema=schema)

    def run(batches):
        for cell in sorted_groups(batches, 3):
            if (out := search(cell)) is not None and len(out):
                yield out

    return run


def _open_blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, node, comp, ...) of blocks that hold more than one component, with the block's size, its largest
    component and the number of rows outside that.  rows is read twice."""
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    blocks = each.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps"))
    blocks = blocks.select("key", "size", "comps", F.col("most.comp").alias("main"), (F.col("size") - F.col("most.n")).alias("others"))
    # closed blocks take part in the join, so that a hot one isn't dealt out either
    return heavy_join(rows, stage_table(blocks, "blocks"), ["key"], "size").where("comps > 1").drop("comps")


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the component of a node column, the node itself where it has no link."""
    own = labels.select(F.col("id").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def _candidates(multi: DataFrame, points: DataFrame, labels: DataFrame, percent: int, tables: int, spanning: bool) -> DataFrame:
    """Rows (base, a, b): pairs of nodes in different components that meet in a block, base, and that the R-tree can't rule
    out; with spanning, only those that connect the components of a cell.  A pair belongs to one cell of one block."""
    rows = stage_table(_labelled(multi.select("key", "node"), labels, "node", "comp"), "labelled")
    rows = stage_table(_open_blocks(rows), "open")
    # A block of one frequent shingle, in many documents that are no copies: its rows meet again under each of the other orders.
    lows = points.select("node", "lows")
    hot = rows.where(F.col("others") > HOT_BLOCK)
    rows = rows.where(F.col("others") <= HOT_BLOCK).withColumns({"base": F.col("key"), "low": F.lit(None).cast("long")})
    if not hot.isEmpty():
        again = hot.select("key", "node", "comp").join(lows, "node").select("node", "comp", F.col("key").alias("base"), F.explode(F.array_except("lows", F.array("key"))).alias("low"))
        again = stage_table(again.withColumn("key", F.xxhash64("base", "low")), "again")
        rows = rows.unionByName(_open_blocks(again))
    # The largest component of a block is compared with the others only, slot by slot; if the others are too many
    # still, all rows are compared slot against slot.
    rows = rows.withColumns({"slots": F.ceil(F.col("size") / BLOCK), "few": F.col("others") <= BLOCK, "in_main": F.col("comp") == F.col("main")})
    rows = rows.withColumn("slot", F.when(F.col("few") & ~F.col("in_main"), -1).otherwise(F.expr("pmod(xxhash64(node, 7), slots)")))
    cells = F.when(F.col("few") & F.col("in_main"), F.array("slot")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))
    rows = rows.withColumn("t", F.explode(cells))
    i = F.when(F.col("few"), F.col("t")).otherwise(F.least("slot", "t"))
    j = F.when(F.col("few"), F.lit(-1)).otherwise(F.greatest("slot", "t"))
    rows = stage_table(rows.select("key", i.alias("i"), j.alias("j"), "slot", "node", "comp", "base", "low"), "cells")
    dealt = rows.join(points, "node").select(*_CELL).repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(tidy(_searcher(percent, spanning, tables)), "base long, a long, b long")


def _linked(docs: DataFrame, width: int, percent: int, tables: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, t1, t2 (the text's hash), n_shingles, comp (a number for each component), component_id (both null
    without shingles, or where the id is null and no row with an id has an equal set); a row for each row.  Where one id has
    several texts, several components may have one component_id."""
    t1, t2 = hash128("text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text").mapInArrow(tidy(_signatures(width, tables)), _SIGNATURE)
    signed = stage_table(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    # A node is known by the number of one of its rows; points stay with the rows until a search asks for them.
    heads = signed.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("m"))
    heads = heads.select("d1", "d2", F.col("m.doc_id").alias("head"), F.col("m.row").alias("node"))
    points = signed.select(F.col("row").alias("node"), "lows", "point")
    nodes = stage_table(heads.join(points.select("node", "lows"), "node"), "nodes")

    entries = nodes.select("node", F.explode("lows").alias("key"))
    blocks = stage_table(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "blocks")
    multi = stage_table(heavy_join(entries, blocks, ["key"], "size"), "multi")
    stars = stage_table(_stars(multi, tables), "stars")
    links = stage_table(_verify(docs, nodes, stars, width, percent), "links")

    labels = connected_components(links)
    for spanning in (True, False):
        pairs = stage_table(_candidates(multi, points, labels, percent, tables, spanning), "pairs")
        if pairs.isEmpty():
            break
        found = stage_table(_verify(docs, nodes, pairs.select("a", "b").distinct(), width, percent), "found")
        stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
        labels = connected_components(stars.unionByName(found))
        failed = _labelled(_labelled(pairs.join(found, ["a", "b"], "left_anti"), labels, "a", "ca"), labels, "b", "cb")
        failed = failed.where("ca <> cb").select(F.col("base").alias("key")).distinct()
        multi = multi.join(failed, "key", "left_semi")

    known = _labelled(nodes.select("node", "d1", "d2", "head"), labels, "node", "comp")
    least = known.groupBy("comp").agg(F.min("head").alias("component_id"))
    placed = stage_table(known.join(least, "comp").select("d1", "d2", "comp", "component_id"), "placed")
    return signed.select("doc_id", "t1", "t2", "n_shingles", "d1", "d2").join(placed, ["d1", "d2"], "left").drop("d1", "d2")


def ngram_jaccard_join(docs: DataFrame, width: int = 5, percent: int = 75, tables: int = TABLES) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, one row for each row of docs.

    Two documents link when 100 * intersection >= percent * union of their sets of width-word shingles; words
    are maximal runs without blanks and control white space, A-Z lower-cased; with fewer words the whole sequence is the
    one shingle.  component_id is the smallest doc_id reachable by links.

    Null and empty texts and texts without words have 0 shingles and are their own component.  A null doc_id
    takes part in the count only: its component_id is null unless an equal set has an id.  Repeated rows keep a row each.
    Rows of one doc_id with different texts are different nodes.  Other columns are not read.  Copies and repeated rows are
    collapsed before any pair is made.  No rows: no rows.
    """
    return _linked(docs, width, percent, tables).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 75, tables: int = TABLES) -> DataFrame:
    """docs (doc_id, text, ...) without the near duplicates: of each component one row stays, that of the smallest doc_id.

    Of several texts under that id the one of the least hash stays, and of rows that repeat id and text the one whose other columns
    come first as JSON.  Rows without shingles all stay, as do those of a null doc_id that equal no row with an id.
    Columns are passed through, whatever their names.  docs is read several times.  No rows: no rows.
    """
    rows = stage_table(_linked(docs, width, percent, tables).where("comp is not null"), "grouped")
    key = ["doc_id", "t1", "t2"]
    best = rows.where("doc_id is not null").groupBy("comp").agg(F.min(F.struct(*key)).alias("best")).select("best.*")
    counted = stage_table(rows.groupBy(*key).agg(F.count("*").alias("n")), "counted")
    gone = stage_table(counted.join(best, key, "left_anti").select(*key), "gone")
    again = stage_table(counted.where("n > 1").join(best, key, "left_semi").select(*key), "again")
    t1, t2 = hash128("text")

    def same(facts: DataFrame):
        return F.col("doc_id").cast("long").eqNullSafe(facts["_id"]) & (t1 == facts["_1"]) & (t2 == facts["_2"])

    gone, again = (x.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_1"), F.col("t2").alias("_2")) for x in (gone, again))
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, same(gone), "left_anti")
    if again.isEmpty():
        return kept
    others = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c != "text")))
    first = docs.join(again, same(again), "left_semi").groupBy(F.col("doc_id").alias("_id"), t1.alias("_1"), t2.alias("_2")).agg(F.min_by(F.struct(*docs.columns), others).alias("_row"))
    return kept.join(again, same(again), "left_anti").unionByName(first.select("_row.*"))
