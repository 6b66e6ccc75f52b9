"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Documents fall into cells of source, language and topic; the cells' token sums are one small aggregation. The
weights of the cells are raked in turn to the three marginals until no marginal is off by more than ``tolerance``: a
cell's weight is its present one times a factor of its source, one of its language and one of its topic, and each step
is one aggregation of the cells that gives the factors of one of the three anew.
A document's ``rate`` is its cell's target weight over its present weight, times a factor that makes the expected
number of sampled tokens ``share`` of all. It is taken ``copies`` times: as often as the rate has wholes, and once more
with the probability of the fraction, so the expected tokens have the target weights. ``p`` and ``kept`` are for those
who take a document once at most: the rate is cut off at 1 and the factor raised until share is met, so the weights
are missed where cells are cut off. Documents are sampled by a hash of their id and text, so a rerun takes the same.

Topics are classes of form (table, marked, shouting, short, long, medium), not of subject, as the documents name none.
Where no targets are given, those of source and language are the present shares to the power ``flatten``, topics keep
their shares. A value that a given target table omits, or has with 0, has the weight 0: its documents get p, rate and
copies 0. Targets that contradict each other (no weights have them all as marginals) raise an error where they were
given; ``off``, the largest difference that is left in a marginal, comes with each document. Null sources and languages
are values of their own. Null and empty texts have no tokens, weigh
nothing in the marginals and are sampled with the rate of their cell (1 if it has no tokens). Repeated rows
share their fate. An empty table gives an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stage, table

DIMS = ("source", "lang", "topic")
#: A dimension with so many values at most has them looked up in a map of the plan: no join, so one small job a step.
FEW = 1_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form_topic(text: Column, tokens: Column) -> Column:
    n_of = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    return (
        F.when(10 * n_of("|") > tokens, "table")
        .when(5 * (n_of("*") + n_of("$") + n_of("%") + n_of("&")) > tokens, "marked")
        .when((tokens > 0) & (F.upper(text) == text), "shouting")
        .when(tokens < 100, "short")
        .when(tokens >= 1000, "long")
        .otherwise("medium")
    )


def targets_of(cells: DataFrame, dim: str, flatten: float) -> DataFrame:
    """Present shares to the power flatten, made to sum to 1: (dim, target)."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).select(dim, F.pow("n", F.lit(flatten)).alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 1.0
    return sums.select(dim, (F.col("n") / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, rounds: int = 60, most: int = 10_000) -> tuple[DataFrame, float]:
    """cells (source, lang, topic, tokens > 0) with w: weights whose marginals are the targets; and how far off they are at most.

    Targets are summed by value and made to sum to 1; values without a target have 0, as have all cells with such a value.
    Tables of a dimension's values are broadcast where it has at most ``most`` of them; larger ones are joined by shuffle.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    now = stage(cells.select(*DIMS, "tokens", (F.col("tokens") / F.lit(total)).alias("w")))
    values = now.agg(*(F.count_distinct(F.coalesce(d, F.lit(""))).alias(d) for d in DIMS)).first()
    small = {d: values[d] <= most for d in DIMS}
    goals = {}
    for d in DIMS:
        t = targets[d].groupBy(F.col(d).alias("k")).agg(F.sum("target").alias("t"))
        whole = t.agg(F.sum("t")).first()[0] or 1.0
        known = now.select(F.col(d).alias("k")).distinct()
        goals[d] = _kept(known.join(t.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k")), "left").select("k", (F.coalesce("t", F.lit(0.0)) / F.lit(whole)).alias("t")), small[d])
    factors: dict[str, Values] = {}
    worst: list[float] = []
    for _ in range(rounds):
        offs = []
        for d in DIMS:
            sums = _weighted(now, {o: f for o, f in factors.items() if o != d}, small).groupBy(d).agg(F.sum("w").alias("s"))
            found = _beside(sums, d, goals[d], "t", small[d])
            found = _beside(found, d, factors[d], "f", small[d]) if d in factors else found.withColumn("f", F.lit(1.0))
            new = F.when(F.col("s") > 0, F.col("t") / F.col("s")).otherwise(0.0)
            step = _kept(found.select(F.col(d).alias("k"), new.alias("f"), F.abs(F.col("s") * F.col("f") - F.col("t")).alias("off")), small[d])
            offs.append(max(r.off for r in step) if isinstance(step, list) else step.agg(F.max("off")).first()[0])
            factors[d] = step
        worst.append(max(offs))
        if worst[-1] <= tolerance:  # no marginal was off when its turn came
            break
        if len(worst) > 10 and worst[-1] > 0.99 * worst[-6]:  # the targets contradict each other
            break
    weighted = stage(_weighted(now, factors, small))
    left = max(_beside(weighted.groupBy(d).agg(F.sum("w").alias("s")), d, goals[d], "t", small[d]).agg(F.max(F.abs(F.col("s") - F.col("t")))).first()[0] for d in DIMS)
    return weighted, left


#: A value of each value k of a dimension: rows where these are few, else a table.
Values = list[Row] | DataFrame


def _kept(values: DataFrame, small: bool) -> Values:
    """A table of the values of one dimension, worked out once: in the plan where they are few, else in the shared folder."""
    if not small:
        return stage(values)
    rows = values.collect()
    if len(rows) <= FEW and isinstance(values.schema["k"].dataType, T.StringType):
        return rows
    made = F.lit(json.dumps([r.asDict() for r in rows], default=str))
    return values.sparkSession.range(1).select(F.inline(F.from_json(made, T.ArrayType(values.schema))))


def _beside(rows: DataFrame, d: str, values: Values, name: str, small: bool) -> DataFrame:
    """rows with the value of their d, 0 where it has none."""
    if isinstance(values, list):
        of = {"" if r.k is None else f"={r.k}": r[name] for r in values}
        key = F.coalesce(F.concat(F.lit("="), d), F.lit(""))
        return rows.withColumn(name, F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(of)), "map<string, double>"), key), F.lit(0.0)))
    v = values.select(F.col("k").alias("_k"), F.col(name).alias("_v"))
    v = F.broadcast(v) if small else v.hint("merge")
    return rows.join(v, F.col(d).eqNullSafe(F.col("_k")), "left").select(*rows.columns, F.coalesce("_v", F.lit(0.0)).alias(name))


def _weighted(cells: DataFrame, factors: dict[str, Values], small: dict[str, bool]) -> DataFrame:
    """cells with w times the factors of their values."""
    for d, f in factors.items():
        cells = _beside(cells, d, f, "f", small[d]).withColumn("w", F.col("w") * F.col("f")).drop("f")
    return cells


def rates(raked: DataFrame, share: float) -> DataFrame:
    """Probabilities p <= 1 and rates in proportion to w / present weight, so that share of all tokens is expected."""
    r = raked.withColumn("ratio", F.col("w") / F.col("tokens"))
    total, least, most = r.agg(F.sum("tokens"), F.min(F.when(F.col("ratio") > 0, F.col("ratio"))), F.max("ratio")).first()
    if not most:  # no cell has a weight
        return r.select(*DIMS, F.lit(0.0).alias("p"), F.lit(0.0).alias("rate"))
    low, high = math.log(1e-9 / most), math.log(1 / least)
    for _ in range(5):  # each pass narrows the factor's bracket to a 32nd
        tries = [low + (high - low) * i / 32 for i in range(33)]
        got = r.agg(*(F.sum(F.least(F.lit(1.0), F.col("ratio") * math.exp(x)) * F.col("tokens")) for x in tries)).first()
        at = next((i for i in range(1, 33) if got[i] >= share * total), 32)
        low, high = tries[at - 1], tries[at]
    p = F.least(F.lit(1.0), F.col("ratio") * math.exp(high))
    return r.select(*DIMS, p.alias("p"), (F.col("ratio") * F.lit(share * total)).alias("rate"))


def _mixed(docs: DataFrame, share: float, flatten: float, targets: dict[str, DataFrame] | None, tolerance: float) -> DataFrame:
    """The struct d of docs' columns and the struct m of the mix, so that no names meet."""
    sized = docs.select(F.struct("*").alias("d"), n_tokens(F.col("text")).alias("tokens"))
    sized = sized.select("d", "tokens", form_topic(F.coalesce("d.text", F.lit("")), F.col("tokens")).alias("topic"))
    cells = stage(sized.groupBy("d.source", "d.lang", "topic").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    off = 0.0
    if cells.isEmpty():
        p = cells.select(*DIMS, F.lit(1.0).alias("p"), F.lit(1.0).alias("rate"))
    else:
        goals = {d: targets[d] if targets and d in targets else targets_of(cells, d, 1.0 if d == "topic" else flatten) for d in DIMS}
        raked, off = rake(cells, goals, tolerance)
        if targets and off > tolerance:
            raise ValueError(f"the targets contradict each other: a marginal is off by {off:.3g}")
        p = stage(rates(raked, share))
    p = p.select(*(F.col(d).alias(f"p_{d}") for d in DIMS), "p", "rate")
    on = F.col("d.source").eqNullSafe(p["p_source"]) & F.col("d.lang").eqNullSafe(p["p_lang"]) & (F.col("topic") == p["p_topic"])
    chance = F.pmod(F.xxhash64("d.doc_id", "d.text"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    prob, rate = F.coalesce("p", F.lit(1.0)), F.coalesce("rate", F.lit(1.0))
    copies = (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
    made = F.struct("topic", "tokens", prob.alias("p"), (chance < prob).alias("kept"), rate.alias("rate"), copies.alias("copies"), F.lit(off).alias("off"))
    return sized.join(p, on, "left").select("d", made.alias("m"))


def mix(docs: DataFrame, share: float = 0.8, flatten: float = 0.7, targets: dict[str, DataFrame] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """docs' columns and the struct _mix (see fresh() for clashing names): topic, tokens, p, kept, rate, copies, off."""
    return _mixed(docs, share, flatten, targets, tolerance).select("d.*", F.col("m").alias(fresh(docs, "_mix")))


def sample(docs: DataFrame, share: float = 0.8, flatten: float = 0.7, targets: dict[str, DataFrame] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows = _mixed(docs, share, flatten, targets, tolerance)
    return rows.select("d", F.explode(F.array_repeat(F.lit(0), F.col("m.copies")))).select("d.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "source", "lang", "_mix.topic", "_mix.tokens", F.round("_mix.p", 6).alias("p"), "_mix.kept", F.round("_mix.rate", 6).alias("rate"), "_mix.copies")
