"""Operator 3: URL filter by the ratio of two character language models.  DataFrame functions only.

Listed rules decide first.  URLs that rules allow and block train one smoothed variable-order Markov model each
(Witten-Bell: every order is blended with the next shorter one in proportion to how many signs followed its
context).  What no rule fits is decided by the log-likelihood difference per sign against a
threshold calibrated on labelled URLs held out of the counts.
Signs are mapped to 32 classes, so the model is a table of at most 33**3 * 32 four-sign rows:
the bound on what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, stage_table

ORDER = 3  # signs of context
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = 32  # letters, 0, / . - ? and * for all other signs
SAME_CLASS = ("123456789_:&#=", "000000000-/???")
HELD_OUT = list("0123")  # labelled URLs whose md5 begins so, a quarter, calibrate and aren't counted


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first :// and / ? # or the end, path from there to ? # or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def sign_classes(url: Column) -> Column:
    s = F.translate(ascii_lower(F.coalesce(url, F.lit(""))), *SAME_CLASS)
    return F.regexp_replace(s, r"[^a-z0/.?\-]", "*")


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each sign of column signs, with the signs before it: column gram, and the columns in keep, which should be small.  The
    string is cut into signs once and left behind, so that the work is linear in its length."""
    cut = F.transform(F.sequence(F.lit(1), F.length("signs")), lambda i: F.concat(*(F.get("_signs", i + k - 1) for k in range(ORDER + 1))))
    signs = F.array_remove(F.split(F.concat(F.lit("^" * ORDER), F.col("signs")), ""), "")
    rows = rows.where(F.length("signs") > 0).withColumn("_signs", signs)
    return rows.select(*keep, F.explode(cut).alias("gram"))


def train_ratio(counts: DataFrame) -> DataFrame:
    """(gram, says, n) with a row for each gram and both verdicts -> gram, ratio: log P(allow) - log P(block)."""
    total = counts.groupBy("says").agg(F.sum("n").alias("total"))
    known = None
    for k in range(1, ORDER + 2):  # k signs: the last one and k - 1 of context
        grams = counts.groupBy("says", F.expr(f"right(gram, {k})").alias("g")).agg(F.sum("n").alias("n"))
        if k == 1:
            followers = grams.groupBy("says").agg(F.count_if(F.expr("n > 0")).alias("d"))
            known = grams.join(total, "says").join(followers, "says").select("says", "g", F.expr(f"case when total = 0 then 1.0D / {CLASSES} else (n + d / {CLASSES}.0D) / (total + d) end").alias("p"))
            continue
        context = grams.groupBy("says", F.expr(f"left(g, {k - 1})").alias("h")).agg(F.sum("n").alias("seen"), F.count_if(F.expr("n > 0")).alias("d"))
        shorter = known.select("says", F.col("g").alias("s"), F.col("p").alias("q"))
        rows = grams.withColumn("h", F.expr(f"left(g, {k - 1})")).withColumn("s", F.expr(f"right(g, {k - 1})"))
        rows = rows.join(context, ["says", "h"]).join(shorter, ["says", "s"])
        known = rows.select("says", "g", F.expr("case when seen = 0 then q else (n + d * q) / (seen + d) end").alias("p"))
    return known.groupBy(F.col("g").alias("gram")).agg(F.sum(F.when(F.col("says") == "allow", F.log("p")).otherwise(-F.log("p"))).alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict; one row for each row of pages.

    A null url or one without :// has empty host and path, so no rule fits; an empty one has ratio 0.
    Without labelled URLs of a verdict its model is uniform; without held-out ones the threshold is 0.
    Ties with the threshold are allowed.  Null and repeated page_ids keep a row each; other columns aren't read.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": verdict, "signs": sign_classes(F.col("url"))})
    held = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1).isin(HELD_OUT)

    # One model row for each distinct gram of the table, with its count under either verdict.
    trains = lambda verdict: (~held & F.col("says").eqNullSafe(F.lit(verdict))).alias(verdict)
    per_gram = _grams(rows.select("signs", trains("allow"), trains("block")), "allow", "block").groupBy("gram").agg(F.count_if("allow").alias("allow"), F.count_if("block").alias("block"))
    per_gram = stage_table(per_gram, "grams")
    counts = per_gram.select("gram", F.expr("stack(2, 'allow', allow, 'block', block) as (says, n)"))
    model = F.broadcast(stage_table(train_ratio(counts), "model"))  # at most 33**3 * 32 rows

    # Equal sign strings have equal scores: score each once.
    need = rows.where(F.col("says").isNull() | held).groupBy("signs").agg(F.count("*").alias("times"))
    need = stage_table(need.withColumn("number", F.monotonically_increasing_id()), "need")
    scores = _grams(need, "number").join(model, "gram").groupBy("number").agg((F.sum("ratio") / F.count("*")).alias("score"))
    scores = stage_table(need.join(scores, "number").drop("number"), "scores")
    scored = heavy_join(rows.withColumn("held", held), scores, ["signs"], "times", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    scored = stage_table(scored.select("page_id", "host", "path", "rule", "says", "held", "score"), "scored")

    known = scored.where(F.col("says").isNotNull() & F.col("held")).groupBy("says").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    both = known.agg(*(F.max(F.when(F.col("says") == v, F.col(c))).alias(f"{c}_{v}") for v in ("allow", "block") for c in "ms"))
    cut = both.select(F.expr("coalesce(case when s_allow + s_block > 0 then (m_allow * s_block + m_block * s_allow) / (s_allow + s_block) else (m_allow + m_block) / 2 end, 0)").alias("cut"))
    says = F.coalesce("says", F.when(F.col("score") >= cut.scalar(), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", says.alias("verdict"))
