"""Training-log analytics: keyed entries, EMA smoothing, best checkpoint, early stop.

A log is the long table ``(run, step, metric, value)`` (``explode`` of the
trainer's ``log_history``). Work is parallel over runs and, in a run, over blocks
of points: what a block needs of the points before it comes from a scan over
block summaries, itself done in blocks. So one run may be as long as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def explode_history(df: DataFrame, run: str, history: str = "log_history") -> DataFrame:
    """``log_history array<map<string,double>>`` -> long rows per metric."""
    e = df.select(F.col(run), F.posexplode(history).alias("pos", "entry"))
    return e.select(run, "pos", F.col("entry")["step"].alias("step"),
                    F.explode(F.map_filter("entry", lambda k, v: k != "step")).alias("metric", "value"))


def entries_with_key(entries: DataFrame, key: str, entry: str = "entry") -> DataFrame:
    """Keep log entries (maps) that carry ``key``; empty result if none."""
    return entries.filter(F.map_contains_key(F.col(entry), F.lit(key)))


def ema_weight(n: Column) -> Column:
    """W5 weight: ``1.8 * (sigmoid(0.05 n) - 0.5)`` for a series of length n."""
    return F.lit(1.8) * (F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.05) * n)) - F.lit(0.5))


def ema_smooth(df: DataFrame, keys: list[str], order: str, value: str, block: int = 256) -> DataFrame:
    """TensorBoard-style EMA per series; adds ``smoothed``.

    ``y = last * w + (1 - w) * x`` for every point, starting with ``last = x0``.
    The recurrence is linear: each block of ``block`` steps is folded from zero
    on its own, one summary row per block gives the value it starts from, and
    that value decays through the block. ``keys`` and the integer ``order`` are
    not null.
    """
    s = df.groupBy(*keys, F.floor(F.col(order) / block).alias("_b")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("x")))).alias("s"))
    total = s.groupBy(*keys).agg(F.sum(F.size("s")).alias("_n"))
    s = s.join(total, keys).withColumn("_w", ema_weight(F.col("_n")))
    nothing = F.array().cast("array<double>").alias("out")

    def step(acc, p):
        y = acc["last"] * F.col("_w") + (F.lit(1.0) - F.col("_w")) * p["x"]
        return F.struct(y.alias("last"), F.array_append(acc["out"], y).alias("out"))

    folded = F.aggregate("s", F.struct(F.lit(0.0).alias("last"), nothing), step)["out"]
    blocks = s.select(*keys, "_b", "_w", "s", folded.alias("y"))

    # A block turns what it starts from into decay * start + end; so does a run of blocks.
    chain = blocks.select(*keys, "_b", F.element_at("y", -1).alias("end"), F.pow("_w", F.size("y")).alias("decay"),
                          F.col("s")[0]["x"].alias("x0"))
    starts = _carried(chain, keys, block).withColumnRenamed("start", "_start")
    z = blocks.join(starts, [*keys, "_b"]).select(*keys, "_w", "_start", F.posexplode(
        F.arrays_zip(F.col("s").alias("p"), F.col("y").alias("y"))).alias("_j", "_z"))
    return z.select(*keys, F.col("_z.p.o").alias(order), F.col("_z.p.x").alias(value),
                    (F.col("_z.y") + F.pow("_w", F.col("_j") + 1) * F.col("_start")).alias("smoothed"))


def _carried(chain: DataFrame, keys: list[str], block: int, levels: int = 1) -> DataFrame:
    """``(keys, _b, start)``: what each block of ``chain (keys, _b, end, decay, x0)`` starts from.

    ``block`` neighbours are folded at a time; what each such group starts from is the same
    question about fewer blocks. The last level holds ``1 / block ** (levels + 1)`` of the points.
    """
    group = F.floor(F.col("_b") / block) if levels else F.lit(0).cast("long")
    links = F.array_sort(F.collect_list(F.struct("_b", "end", "decay", "x0")))
    g = chain.groupBy(*keys, group.alias("_g")).agg(links.alias("c"))
    whole = F.struct(F.lit(0.0).alias("end"), F.lit(1.0).alias("decay"))
    total = F.aggregate("c", whole, lambda a, x: F.struct(
        (a["end"] * x["decay"] + x["end"]).alias("end"), (a["decay"] * x["decay"]).alias("decay")))
    if levels:
        upper = g.select(*keys, F.col("_g").alias("_b"), total.alias("t"), F.col("c")[0]["x0"].alias("x0"))
        upper = _carried(upper.select(*keys, "_b", "t.end", "t.decay", "x0"), keys, block, levels - 1)
        g = g.join(upper.withColumnRenamed("_b", "_g"), [*keys, "_g"])
    else:
        g = g.withColumn("start", F.col("c")[0]["x0"])
    none = F.struct(F.col("start").alias("last"), F.array().cast("array<double>").alias("out"))
    out = F.aggregate("c", none, lambda a, x: F.struct(
        (a["last"] * x["decay"] + x["end"]).alias("last"), F.array_append(a["out"], a["last"]).alias("out")))["out"]
    z = g.select(*keys, F.inline(F.arrays_zip(F.col("c").alias("c"), out.alias("start"))))
    return z.select(*keys, F.col("c._b").alias("_b"), "start")


def scan_before(blocks: DataFrame, keys: list[str], order: str, values: dict, fan: int = 4096,
                levels: int = 0) -> DataFrame:
    """``blocks`` with ``<name>_before`` for each of ``values`` (name to ``F.min``, ``F.max`` or
    ``F.sum``): the value over all earlier blocks of the same keys, NULL before the first.

    With ``levels`` the blocks go in groups of ``fan`` (``order`` counts them), which are scanned
    the same way; without, one window holds the blocks of one key, 1 / 4096 of its points.
    """
    group = f"_group{levels}"
    w = Window.partitionBy(*keys, *[group] * bool(levels)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if not levels:
        return blocks.withColumns({f"{n}_before": f(n).over(w) for n, f in values.items()})
    grouped = blocks.withColumn(group, F.floor(F.col(order) / fan))
    upper = grouped.groupBy(*keys, group).agg(*[f(n).alias(n) for n, f in values.items()])
    upper = scan_before(upper, keys, group, values, fan, levels - 1)
    upper = upper.select(*keys, group, *[F.col(f"{n}_before").alias(f"_{n}_up") for n in values])
    inside = grouped.withColumns({f"{n}_before": f(n).over(w) for n, f in values.items()})
    joined = inside.join(upper, [*keys, group])
    both = {F.min: F.least, F.max: F.greatest,
            F.sum: lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)}
    joined = joined.withColumns({f"{n}_before": both[f](F.col(f"{n}_before"), F.col(f"_{n}_up")) for n, f in values.items()})
    return joined.drop(group, *[f"_{n}_up" for n in values])


def best_checkpoint(evals: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Step with the minimum value per run (ties: earliest step)."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s")))
    return evals.groupBy(run).agg(best.alias("b")).select(
        run, F.col("b.s").alias("best_step"), F.col("b.v").alias("best_value"))


def early_stop(evals: DataFrame, run: str, step: str, value: str, patience: int = 2,
               block: int = 4096) -> DataFrame:
    """First evaluation after ``patience`` evaluations without a new minimum.

    Returns ``(run, stop_step)``; runs that never stop get NULL. Evaluations are
    taken in blocks of ``block`` steps (``step`` is a number): a block learns
    from a scan over block summaries how many evaluations came before it, their
    minimum and which of them was the last new one, then goes on by itself.
    """
    ensure_checkpoint_dir(evals.sparkSession)
    w = Window.partitionBy(run, "_b").orderBy("_s")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    x = evals.select(F.col(run), F.col(step).alias("_s"), F.col(value).alias("_v"),
                     F.floor(F.col(step) / block).alias("_b")).withColumn("_i", F.row_number().over(w).cast("long"))
    sums = x.groupBy(run, "_b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_v", "_i")).alias("low"))
    sums = sums.select(run, "_b", "n", F.col("low._v").alias("least"), F.col("low._i").alias("at")).checkpoint()
    sums = scan_before(sums, [run], "_b", {"n": F.sum, "least": F.min})
    # The last new minimum of a block is where its minimum comes first, if that is new at all.
    n_before = F.coalesce("n_before", F.lit(0).cast("long"))
    fresh = F.col("least_before").isNull() | (F.col("least") < F.col("least_before"))
    sums = sums.withColumn("n_before", n_before).withColumn("last", F.when(fresh, F.col("n_before") + F.col("at")))
    sums = scan_before(sums, [run], "_b", {"last": F.max})
    x = x.join(sums.select(run, "_b", "n_before", "least_before", "last_before"), [run, "_b"])
    i = F.col("n_before") + F.col("_i")
    least = F.least(F.min("_v").over(before), F.col("least_before"))
    x = x.withColumn("_new", F.when(least.isNull() | (F.col("_v") < least), i))
    last = F.greatest(F.max("_new").over(upto), F.col("last_before"))
    x = x.withColumn("_stop", F.when(i - last >= patience, F.col("_s")))
    return x.groupBy(run).agg(F.min("_stop").alias("stop_step"))
