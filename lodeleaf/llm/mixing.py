"""Mixing sources to target shares of all tokens, by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, with u from a hash of its id and w its quality weight; the
documents of smallest keys are a weighted sample without replacement.  A source whose budget is e times its
tokens and a rest is used e times whole; the rest is taken in the order of the keys, as long as the prefix sum
stays within it.  Prefix sums are taken in two steps, over sums of key ranges and then inside the one range
that the budget ends in, so no source is in a single task.  Ranges are even in the logarithm of the key, so that
none holds more than some 0.04 % of the documents of a weight, whatever the weight; of the sums only the range that
a budget ends in is sent to all tasks, a row for each target.

Budgets: a source gets its share of the total, at most ``max_repeats`` times its tokens.  The total is by default the
greatest at which every source that has documents gets its share (``feasible``; shares of empty sources
are shared out in proportion).  A greater total can be asked for: what a small source can't fill is then shared out
among the others, until all are at their limit or the total is reached, and the shares are missed, as is
reported.  Sources without a target, null sources and texts without tokens are left out; targets that stand there
several times add up; an empty table draws nothing.

The weight, ``quality``, is a placeholder to be replaced by a measure of one's own: a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

STEP = 1 / 1024  # of a range, in the logarithm of the key
MOST_TARGETS = 10_000


def spelled(source: Column) -> Column:
    """A source in one spelling."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s\-]+", "_")


def quality(text: Column) -> Column:
    """Weight from 0.1 to 1: the share of letters, and less for very short texts."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), letters * F.least(F.lit(1.0), F.length(text) / 400.0))


def feasible(targets: list[tuple[str, float, int]], available: dict[str, int]) -> float:
    """The greatest total at which all sources that have tokens and may be used get their shares."""
    usable = [(x, available.get(s, 0) * max(0, r)) for s, x, r in targets if x > 0 and available.get(s, 0) > 0 and r > 0]
    whole = sum(x for x, _ in usable)
    return min((n * whole / x for x, n in usable), default=0.0)


def fill(targets: list[tuple[str, float, int]], available: dict[str, int], total: float) -> dict[str, float]:
    """Token budget of each source."""
    limit = {s: available.get(s, 0) * max(0, r) for s, _, r in targets}
    share = {s: max(0.0, x) for s, x, _ in targets}
    budget = dict.fromkeys(limit, 0.0)
    free = {s for s in limit if limit[s] and share[s]}
    left = total
    while free and left > 1e-6:
        whole = sum(share[s] for s in free)
        full = {s for s in free if budget[s] + left * share[s] / whole >= limit[s]}
        if not full:
            for s in free:
                budget[s] += left * share[s] / whole
            break
        for s in full:
            left -= limit[s] - budget[s]
            budget[s] = float(limit[s])
        free -= full
    return budget


def sized(documents: DataFrame, tokenizer: str = T.DEFAULT, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, weight, n_tokens)"""
    rows = documents.filter("source is not null and length(text) > 0").select("doc_id", spelled(F.col("source")).alias("source"), F.greatest(F.coalesce(quality(F.col("text")) if weight is None else weight, F.lit(0.1)), F.lit(1e-6)).cast("double").alias("weight"), "text")
    return rows.mapInArrow(lambda b: T.counts(b, tokenizer), "doc_id long, source string, weight double, n_tokens long")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 1, tokenizer: str = T.DEFAULT, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, repeats) of the documents used, and
    (source, target_share, max_repeats, available_tokens, budget_tokens, actual_tokens, actual_share) of each target.

    targets: (source, target_share, max_repeats), a table of fixed size; more than MOST_TARGETS are refused."""
    spark = documents.sparkSession
    goal = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.filter("source is not null").groupBy(spelled(F.col("source")).alias("source")).agg(F.sum("target_share"), F.max("max_repeats")).orderBy("source").limit(MOST_TARGETS + 1).collect()]
    if len(goal) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    named = spark.createDataFrame(goal, "source string, target_share double, max_repeats int")
    wanted = documents.withColumn("s", spelled(F.col("source"))).join(F.broadcast(named.select(F.col("source").alias("s"))), "s", "left_semi")
    items = C.cut(sized(wanted, tokenizer, weight))
    available = {r[0]: r[1] for r in items.groupBy("source").agg(F.sum("n_tokens")).collect()}  # a row for each target
    budget = fill(goal, available, float(total_tokens or feasible(goal, available)))
    plan = []
    for s, _, r in goal:
        n = available.get(s, 0)
        epochs = min(r, int((budget[s] + 1e-6) // n)) if n else 0
        plan.append((s, epochs, max(0.0, budget[s] - epochs * n) if epochs < r else 0.0, float(budget[s])))
    budgets = spark.createDataFrame(plan, "source string, epochs int, rest double, budget double")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = -F.log(u) / F.col("weight")
    keyed = items.filter("n_tokens > 0").withColumn("key", key).withColumn("place", F.floor(F.log("key") / STEP).cast("int"))
    sums = keyed.groupBy("source", "place").agg(F.sum("n_tokens").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)))
    over = upto.join(F.broadcast(budgets), "source").filter(F.col("upto") > F.col("rest"))
    edges = over.groupBy("source").agg(F.min_by(F.struct("place", (F.col("upto") - F.col("n")).alias("before")), "place").alias("edge"))
    joined = keyed.join(F.broadcast(budgets), "source").join(F.broadcast(edges), "source", "left")
    inner = W.partitionBy("source", "place").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = joined.filter(F.col("place") == F.col("edge.place")).withColumn("chosen", (F.col("edge.before") + F.sum("n_tokens").over(inner) <= F.col("rest")).cast("int"))
    rest = joined.filter(F.col("edge").isNull() | (F.col("place") != F.col("edge.place"))).withColumn("chosen", (F.col("edge").isNull() | (F.col("place") < F.col("edge.place"))).cast("int"))
    used = rest.unionByName(edge).withColumn("repeats", F.col("epochs") + F.col("chosen")).filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"))
    have = items.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    shares = named.join(budgets.select("source", F.col("budget").alias("budget_tokens")), "source").join(have, "source", "left").join(got, "source", "left").na.fill(0, ["available_tokens", "actual_tokens"])
    everything = F.sum("actual_tokens").over(W.partitionBy())  # a row for each target
    shares = shares.withColumn("actual_share", F.when(everything > 0, F.col("actual_tokens") / everything).otherwise(F.lit(0.0)))
    return used, shares.select("source", "target_share", "max_repeats", "available_tokens", "budget_tokens", "actual_tokens", "actual_share")
