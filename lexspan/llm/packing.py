"""Operator 6: best-fit packing into bins of several permitted capacities.

Pieces of equal length are interchangeable, so packing works on the histogram of lengths (at most as many rows as the
largest capacity): runs of equal bins take runs of equal pieces, the longest first, each into the bin
with the least room that holds it.  Where none holds it, a bin opens.  All permitted capacities compete at every opening: each is
filled in thought with the piece and the longest unclaimed shorter ones, downsized to what that leaves, and the one of least
cost for a token opens and claims what filled it.  At the end every bin is downsized to its contents.  The plan is a
list of runs; documents find their place in it by their rank among pieces of their length, which is counted in parallel.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import bpe_lengths
from .common import stage_table, tidy

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64  # tokens that a sequence costs besides its capacity
RANK_ROWS = 100_000  # pieces of one length that a task ranks, about
RANK_SALTS = 256  # tasks at least that pieces of one length are dealt to


def sequence_cost(capacity: int) -> float:
    return capacity + OVERHEAD


class Plan:
    """Runs: pieces of length[i] with rank first[i].. go per[i] to a bin, from bin bin0[i], at offset[i]."""

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.bins: list[list[int]] = []  # first bin, bins, tokens in each

    def cost(self, capacities, cost) -> float:
        return sum(n * cost(capacities[bisect.bisect_left(capacities, used)]) for _, n, used in self.bins)


class Opening:
    """The choice of the capacity to open for a piece that fits nowhere."""

    def __init__(self, histogram: list[tuple[int, int]], capacities: tuple[int, ...], cost: Callable[[int], float]):
        self.lengths = sorted(n for n, _ in histogram)
        self.spare = dict(histogram)  # pieces that no opened bin claims
        self.capacities, self.price = capacities, [cost(c) for c in capacities]

    def fill(self, capacity: int, length: int) -> dict[int, int]:
        """length -> pieces of it: the piece itself, then the longest unclaimed ones that still fit."""
        taken, room, most = {}, capacity, length
        while room and (at := bisect.bisect_right(self.lengths, min(room, most)) - 1) >= 0:
            most = self.lengths[at]
            n = min(self.spare[most], room // most)
            if n:
                taken[most] = n
                room -= n * most
            most -= 1
        return taken

    def choose(self, length: int) -> tuple[int, int, int]:
        """(capacity, pieces of length in each bin, bins): the cheapest for a token, of equal ones the smallest, and how many
        bins in a row would be opened so; their claims are noted."""
        options = []
        for capacity in self.capacities[bisect.bisect_left(self.capacities, length) :]:
            taken = self.fill(capacity, length)
            used = sum(n * k for n, k in taken.items())
            options.append((self.price[bisect.bisect_left(self.capacities, used)] / used, capacity, taken))
        _, capacity, best = min(options, key=lambda o: o[:2])
        # as long as every option would be filled as now, the choice stays the same
        bins = min((self.spare[n] - taken.get(n, 0)) // k + 1 if taken.get(n) else self.spare[n] // k for _, _, taken in options for n, k in best.items())
        bins = max(1, bins)
        for n, k in best.items():
            self.spare[n] -= k * bins
        return capacity, best[length], bins


def best_plan(histogram: list[tuple[int, int]], capacities: tuple[int, ...], cost: Callable[[int], float] = sequence_cost) -> Plan:
    """Best fit, longest first, of (length, count) rows, with the capacity chosen at each opening."""
    plan, opening = Plan(), Opening(histogram, capacities, cost)
    rooms: list[int] = []  # ascending
    groups: dict[int, list[list[int]]] = {}  # room -> runs of bins (first bin, bins, tokens in each)
    made = 0

    def put(room: int, group: list[int]) -> None:
        if not room:
            plan.bins.append(group)
            return
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append(group)

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                opening.spare[length] = count
                capacity, per, bins = opening.choose(length)
                plan.rows.append((length, rank, per, made, 0))
                rank, count = rank + bins * per, count - bins * per
                put(capacity - per * length, [made, bins, per * length])
                made += bins
                continue
            room = rooms[at]
            bin0, bins, used = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            per = room // length
            full = min(bins, count // per)
            if full:
                plan.rows.append((length, rank, per, bin0, used))
                rank, count = rank + full * per, count - full * per
                put(room - per * length, [bin0, full, used + per * length])
            if full < bins:
                if count and count < per:
                    plan.rows.append((length, rank, per, bin0 + full, used))
                    put(room - count * length, [bin0 + full, 1, used + count * length])
                    rank, count, full = rank + count, 0, full + 1
                if full < bins:
                    put(room, [bin0 + full, bins - full, used])
        opening.spare[length] = 0
    plan.bins += [g for own in groups.values() for g in own]
    return plan


def _assign(runs: np.ndarray):
    """runs: rows (length, first rank, per, bin0, offset), by length and rank."""
    keys = runs[:, 0] * (1 << 44) + runs[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            own = runs[at]
            step = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own[:, 3] + step // own[:, 2]), pa.array(own[:, 4] + step % own[:, 2] * length)], names=["doc_id", "piece", "n_tokens", "bin_id", "bin_offset"])

    return run


def pack_documents(docs: DataFrame, ranks_path: str, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """docs (doc_id, text, ...) -> see pack_lengths; a document's length is the number of its byte-level BPE tokens.

    Null and empty texts have length 0.  Other columns aren't read.
    """
    return pack_lengths(bpe_lengths(docs, ranks_path), capacities)


def pack_lengths(sized: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """sized (doc_id, n_tokens, ...) -> doc_id, piece, n_tokens, bin_id, bin_offset, bin_capacity; a row for each piece.

    A document longer than the largest capacity is cut into pieces of that capacity and a rest; piece p
    holds the tokens from p times the largest capacity on.  Documents without tokens, or with a null length, have one piece of 0
    tokens and no bin.  bin_capacity is the least permitted one that holds the bin's pieces.  Null and repeated
    doc_ids are packed like any.  Other columns aren't read.  No rows: no rows.
    """
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    sized = sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n"))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0)))))
    pieces = stage_table(pieces.select("doc_id", "piece", F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("n_tokens")), "pieces")
    some = pieces.where("n_tokens > 0")
    histogram = [(int(r[0]), int(r[1])) for r in some.groupBy("n_tokens").count().collect()]  # at most top rows
    plan = best_plan(histogram, capacities)
    runs = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)

    # Rank among pieces of a length, counted in salts so that no length is one task's.
    salts = max(RANK_SALTS, sum(c for _, c in histogram) // RANK_ROWS)
    salted = some.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, piece), {salts})"))
    each = salted.groupBy("n_tokens", "salt").count()
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("n_tokens", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank0"))
    own = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["n_tokens", "salt"])
    ranked = ranked.select("doc_id", "piece", "n_tokens", (F.col("rank") + F.col("rank0")).alias("rank"))
    placed = stage_table(ranked.mapInArrow(tidy(_assign(runs)), "doc_id long, piece long, n_tokens long, bin_id long, bin_offset long"), "placed")

    used = placed.groupBy("bin_id").agg(F.sum("n_tokens").alias("used"))
    size = F.lit(None).cast("int")
    for c in reversed(capacities):
        size = F.when(F.col("used") <= c, c).otherwise(size)
    packed = placed.join(used.select("bin_id", size.alias("bin_capacity")), "bin_id")
    empty = pieces.where("n_tokens = 0").selectExpr("doc_id", "piece", "n_tokens", "cast(null as long) as bin_id", "cast(null as long) as bin_offset", "cast(null as int) as bin_capacity")
    return packed.select("doc_id", "piece", "n_tokens", "bin_id", "bin_offset", "bin_capacity").unionByName(empty)
