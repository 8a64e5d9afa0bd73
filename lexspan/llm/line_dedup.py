"""Operator 9: cross-site boilerplate lines by distinct-site spread.  DataFrame functions only.

Lines are known by 128 bits of hash.  Each gets a HyperLogLog sketch of the sources it occurs in; sketches merge on the map side,
so a line of a third of all documents is one row for each task.  Lines whose estimate is clear of the
threshold are decided by it; those near it get exact distinct counts.  A boilerplate line stays where it
occurs first and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, heavy_join, stage_table

MIN_SITES = 10
SKETCH_BITS = 10  # 2**10 registers: standard error 1.04 / 32
MARGIN = 0.15  # over four standard errors
_LINE = ["l1", "l2"]
_DOC = ["doc_id", "t1", "t2"]


def hash128(c: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(c), F.xxhash64(F.lit(17), c)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (text), source, at, l1, l2 (line) of every line that isn't blank."""
    t1, t2 = hash128("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    l1, l2 = hash128("line")
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(*_DOC, "source", "at", l1.alias("l1"), l2.alias("l2"))


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines of at least min_sites distinct non-null sources: l1, l2, times, first."""
    first = F.min(F.struct("doc_id", "at", "t1", "t2")).alias("first")
    spread = lines.groupBy(*_LINE).agg(F.hll_sketch_agg("source", F.lit(SKETCH_BITS)).alias("sketch"), F.count("*").alias("times"), first)
    sites = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0))
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    spread = stage_table(spread.where(F.col("times") >= min_sites).select(*_LINE, "times", "first", sites.alias("sites")).where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") <= high)
    # distinct pairs first, so that the rows of a hot line are one for each source and task
    pairs = heavy_join(lines.select(*_LINE, "source"), near.select(*_LINE, "times"), _LINE, "times").select(*_LINE, "source").distinct()
    exact = pairs.groupBy(*_LINE).agg(F.count("source").alias("exact")).where(F.col("exact") >= min_sites)
    return spread.where(F.col("sites") > high).select(*_LINE, "times", "first").unionByName(near.join(exact, _LINE).select(*_LINE, "times", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs (doc_id, text, source, ...) -> docs with text changed, and columns n_lines, n_removed.

    Lines end at \\n; a line counts by its exact content, blank ones never.  A line found under at least min_sites
    distinct sources stays only at its first place (least doc_id, then position; a null doc_id comes first) and is cut elsewhere.
    A null source is no site.  A null text stays null (0 lines), an empty one has 1 line.  A document that loses all its
    lines stays, with an empty text.  Repeated rows are treated alike.  Columns n_lines and n_removed of docs are replaced; other
    columns of any name pass through.  A document is rebuilt in time linear in its lines.  No rows: no rows.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = stage_table(_lines(docs), "lines")
    marks = stage_table(boilerplate_lines(lines, min_sites), "marks")
    here = F.struct("doc_id", "at", "t1", "t2")
    cuts = heavy_join(lines.select(*_DOC, "at", *_LINE), marks, _LINE, "times").where(here != F.col("first"))
    own = fresh_names(docs, ["cut_id", "cut_1", "cut_2", "cut"])
    cuts = cuts.groupBy(*_DOC).agg(F.collect_set("at").alias(own[3])).withColumnsRenamed(dict(zip(_DOC, own)))
    t1, t2 = hash128("text")
    joined = docs.join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col(own[0])) & (t1 == F.col(own[1])) & (t2 == F.col(own[2])), "left")
    cut, parts = F.col(own[3]), F.split("text", "\n")
    # array_except looks positions up in a hash set and keeps their order; the outer transform, over one array, holds the
    # lines so that they aren't split off anew for each position
    left = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), cut)
    kept = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(left(p), lambda i: F.get(p, i)), "\n")), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    n_removed = F.when(cut.isNull(), 0).otherwise(F.size(cut))
    text = F.when(cut.isNull(), F.col("text")).otherwise(kept)
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in names), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
