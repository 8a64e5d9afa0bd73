"""Connected components of a link table: by one task while it is small, else with joins and aggregates only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, stage_table, tidy

FEW_LINKS = 200_000  # different links that one task takes, in about 30 MB


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) -> their ids and of each the smallest id reachable."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return ids, ids[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _solve(batches):
    """All links (a, b) of a table in one task -> (id, component)."""
    links = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    found = _least_reachable(links["a"].to_numpy(), links["b"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "component"])


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (id, component), component the smallest id reachable; ids without links are absent.

    Up to FEW_LINKS different links are one task's.  Rounds over so few rows would cost the driver more, a dozen exchanges and
    broadcasts each, than the links themselves.

    More links alternate large-star and small-star steps: every round points neighbours at the smallest
    one they see, until the table is a set of stars.  A hub's neighbours are reduced by a partial
    min, and the join that follows sends hot hubs by broadcast, the others by shuffle.
    The rounds needed grow with the logarithm of the longest chain; after max_rounds, far more than any table needs, a
    RuntimeError is raised rather than a wrong result returned.  Nulls, self-links and repeated links are dropped.  No links: no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = stage_table(
        links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).distinct(), "edges"
    )
    state = lambda: tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    before = state()
    if before[0] <= FEW_LINKS:
        return stage_table(edges.coalesce(1).mapInArrow(tidy(_solve), "id long, component long"), "components")
    for _ in range(max_rounds):
        both = edges.select("a", "b").unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = stage_table(both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"), F.count("*").alias("n")), "low")
        # staged, as low is: else a round is one plan that holds each of them several times
        large = stage_table(heavy_join(both, low, ["a"], "n").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # after the large star a node's smaller neighbours are few: a hub points at many, few point at many hubs
        tight = large.join(low, "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        edges = stage_table(tight.where(a != b).distinct(), "edges")
        now = state()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(a.alias("id"), b.alias("component")).unionByName(edges.select(b.alias("id"), b.alias("component")).distinct())
