"""Operator 8: exact top-k inner products on a bit-sliced index.

The index is built once: a block of rows keeps every quantised attribute as bit slices, bitmaps with a bit for each row, and is
written as one row of a table.  For a query the slices are added with bitmap logic (full adders), weighted by the bits of
the query's own components, which gives the score of all rows as slices.  From the most significant slice downward the
top rows are split off; rows tied at the boundary are resolved by id.

Queries go to the blocks in batches of bounded size, one pass over the index for each batch, so neither rows nor index are
copied for the number of queries.  A block yields k rows a query at most, and the best k of all are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

ROW_BLOCK = 1 << 16
QUERY_BYTES = 32 << 20  # bytes of queries sent to every task at a time, about


class BitSlicedIndex:
    """Slices of offset attributes: values - lows is stored, bit b of attribute i in slices[i][b]."""

    def __init__(self, values: np.ndarray):
        """Builds the index of the rows of an integer matrix."""
        n, dims = values.shape
        lows = values.min(0)
        shifted = (values - lows).T
        width = [int(x).bit_length() for x in shifted.max(1)]
        words = -(-n // 64)
        slices = [self._pack((shifted[i] >> b) & 1 == 1, words) for i in range(dims) for b in range(width[i])]
        self._set(n, lows, np.array(width, np.int64), np.array(slices, np.uint64).reshape(-1, words))

    def _set(self, n: int, lows: np.ndarray, width: np.ndarray, slices: np.ndarray) -> None:
        self.n, self.lows, self.width, self.matrix = n, lows, width, slices
        self.full = self._pack(np.ones(n, bool), -(-n // 64))
        ends = np.cumsum(width).tolist()
        self.slices = [list(slices[e - w : e]) for e, w in zip(ends, width.tolist())]
        self.flipped = [[s ^ self.full for s in own] for own in self.slices]

    def dump(self) -> tuple[int, bytes, bytes, bytes]:
        return self.n, self.lows.astype("<i8").tobytes(), self.width.astype("<i8").tobytes(), self.matrix.tobytes()

    @classmethod
    def load(cls, n: int, lows: bytes, width: bytes, slices: bytes) -> BitSlicedIndex:
        self = cls.__new__(cls)
        self._set(n, np.frombuffer(lows, "<i8"), np.frombuffer(width, "<i8"), np.frombuffer(slices, np.uint64).reshape(-1, -(-n // 64)))
        return self

    @staticmethod
    def _pack(bits: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices, base): the score of a row is base + sum of 2**b over the slices b that hold it."""
        base = 0
        columns: list[list[np.ndarray]] = []
        for i, q in enumerate(query.tolist()):
            if not q:
                continue
            base += q * int(self.lows[i])
            # q * v for q < 0 is |q| * (top - v) - |q| * top
            own = self.slices[i] if q > 0 else self.flipped[i]
            if q < 0:
                base += q * ((1 << len(own)) - 1)
            for b in range(abs(q).bit_length()):
                if abs(q) >> b & 1:
                    while len(columns) < b + len(own):
                        columns.append([])
                    for s, bitmap in enumerate(own):
                        columns[b + s].append(bitmap)
        out = []
        at = 0
        while at < len(columns):
            column = columns[at]
            if at + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) >= 3:  # full adder: three bitmaps leave a sum here and a carry one slice up
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                column.insert(0, half ^ z)
                columns[at + 1].append((x & y) | (half & z))
            if len(column) == 2:
                x, y = column
                column[:] = [x ^ y]
                columns[at + 1].append(x & y)
            out.append(column[0] if column else np.zeros_like(self.full))
            at += 1
        return out, base

    def top(self, query: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows surely among the top k, rows tied at the boundary, score of all these), leave taking no part."""
        slices, base = self.scores(query)
        tied = self.full.copy()
        if leave >= 0:
            tied[leave >> 6] &= ~np.uint64(1 << (leave & 63))
        sure = np.zeros_like(tied)
        have = 0
        for s in reversed(slices):
            ones = tied & s
            more = have + int(np.bitwise_count(ones).sum())
            if more > k:
                tied = ones
            else:
                sure |= ones
                have = more
                tied &= ~s
                if have == k:
                    tied[:] = 0
                    break
        a, b = self._rows(sure), self._rows(tied)
        rows = np.concatenate([a, b])
        score = np.full(len(rows), base, np.int64)
        for bit, s in enumerate(slices):
            score += (((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)) << bit
        return a, b, score

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
        w, b = np.nonzero(bits)
        return words[w] * 64 + b


_INDEX = "n long, ids binary, rids binary, lows binary, width binary, slices binary, own int"


def _build(dims: int):
    """Rows (vec_id, rid, v) -> blocks of the index, rows ordered by (vec_id, rid)."""

    def block(parts):
        ids, rids, values = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((rids, ids))
        n, lows, width, slices = BitSlicedIndex(values[order]).dump()
        cols = [[n], [ids[order].tobytes()], [rids[order].tobytes()], [lows], [width], [slices]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(cols)], names=["n", "ids", "rids", "lows", "width", "slices"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for at in range(0, len(batch), ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                parts.append((part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).flatten().to_numpy().reshape(-1, dims)))
                held += len(part)
                if held >= ROW_BLOCK:
                    yield block(parts)
                    parts, held = [], 0
        if held:
            yield block(parts)

    return run


def _search(k: int, queries: tuple[np.ndarray, np.ndarray, np.ndarray], splits: int):
    """Blocks, each with the split of the queries that it is to answer -> rid and id of the query, id and rid of a row, score."""
    schema = pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "rid", "score")])
    asked, query_ids, values = queries

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                index = BitSlicedIndex.load(row["n"], row["lows"], row["width"], row["slices"])
                ids, rids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rids"], np.int64)
                by_rid = np.argsort(rids)
                found = [np.zeros((5, 0), np.int64)]
                for q in range(row["own"], len(asked), splits):
                    at = np.searchsorted(rids, asked[q], sorter=by_rid)
                    own = int(by_rid[at]) if at < len(rids) and rids[by_rid[at]] == asked[q] else -1
                    sure, tied, score = index.top(values[q], k, own)
                    keep = len(sure) + len(tied[: k - len(sure)])  # rows ascend by id: the smaller ones win
                    rows = np.concatenate([sure, tied])[:keep]
                    found.append(np.stack([np.full(keep, asked[q]), np.full(keep, query_ids[q]), ids[rows], rids[rows], score[:keep]]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], schema=schema)

    return run


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score.

    Components become floor(scale * x) in double precision; queries are the rows whose vec_id is divisible by
    every, candidates all rows but the query's own; score is the inner product, ties go to the smaller
    vec_id.  A query gets all candidates if there are fewer than k.  Rows with a null vec_id, and vectors
    that are null, empty or hold null or non-finite components, take no part; nor do vectors of another length than
    the table's most common (of equally common ones the shortest).  A row that repeats a vec_id is a candidate and, if divisible, a
    query of its own.  Where scores could leave 64 bits a ValueError is raised.  Other columns aren't read.  No rows: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("vec_id is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    far = F.max(F.array_max(F.transform("x", F.abs)))
    sizes = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"), far.alias("far")).orderBy(F.desc("n"), "dims").first()
    dims, total, most = (sizes["dims"], sizes["n"], scale * sizes["far"] + 1) if sizes else (1, 0, 0)
    if dims * most * most >= 2.0**62:
        raise ValueError(f"components up to {most / scale:g}: inner products of {dims} of them leave 64 bits")
    rows = rows.where(F.size("x") == dims).select("vec_id", F.monotonically_increasing_id().alias("rid"), F.transform("x", lambda v: F.floor(F.lit(float(scale)) * v)).alias("v"))
    rows = stage_table(rows, "quantised")
    blocks = -(-total // ROW_BLOCK) or 1
    index = rows.repartition(blocks, "rid").mapInArrow(_build(dims), _INDEX.removesuffix(", own int"))
    index = stage_table(index, "index")

    # Few blocks: each is read by several tasks, which share the queries, so that all cores have work.
    splits = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    index = index.withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).repartition(blocks * splits)
    queries = rows.where(F.col("vec_id") % every == 0)
    n_queries = queries.count()
    passes = -(-n_queries * (dims + 2) * 8 // QUERY_BYTES) or 1
    found = None
    for number in range(passes):
        own = queries.where(F.pmod(F.xxhash64("rid"), F.lit(passes)) == number) if passes > 1 else queries
        table = own.toArrow().combine_chunks()  # QUERY_BYTES, about: rids are dealt evenly
        flat = [c.to_numpy() for c in (table["rid"], table["vec_id"])] + [pc.list_flatten(table["v"]).to_numpy().reshape(-1, dims)]
        part = index.mapInArrow(_search(k, tuple(flat), splits), "query long, query_id long, vec_id long, rid long, score long")
        part = stage_table(part, "found") if passes > 1 else part
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
