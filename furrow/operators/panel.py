"""Unit x period panels: assembly, corrections, descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.ranking import attach_scalar, average_ranks, column_medians, exact_quantiles, join_on
from furrow.functions.scalar import C


def literal_map(d: Mapping) -> Column:
    return F.create_map(*[F.lit(z) for kv in d.items() for z in kv])


def literal_table(df: DataFrame, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A small parameter table; its size is fixed by the caller's code."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def spelling_key(name: Column) -> Column:
    """What spellings of one name share: case, spaces and punctuation do not count."""
    return F.nullif(F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]+", ""), F.lit(""))


def resolve_names(df: DataFrame, name: str, variants: DataFrame, canonical: str, spelling: str, priority: str, fallback: Column | None = None) -> DataFrame:
    """Each row's name as the canonical one of the best candidate spelling it matches.

    ``variants`` holds the candidate spellings of every canonical name; where a spelling belongs to
    several names, the least priority wins and then the first name. Adds ``resolved`` and
    ``match_priority``; a blank, NULL or unknown name has the fallback and a NULL priority.
    """
    best = variants.withColumn("__key", spelling_key(F.col(spelling))).where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min(F.struct(F.col(priority).alias("p"), F.col(canonical).alias("c"))).alias("__best"))
    j = df.withColumn("__key", spelling_key(F.col(name))).join(best, "__key", "left")
    found = F.col("__best.c")
    return j.select(*df.columns, (F.coalesce(found, fallback) if fallback is not None else found).alias("resolved"), F.col("__best.p").alias("match_priority"))


def unpivot_metrics(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def tag(key, groups: Mapping[str, Sequence], default: str | None = None) -> Column:
    """Name of the first list that holds the key."""
    out = F.lit(default)
    for label, members in reversed(list(groups.items())):
        out = F.when(C(key).isin(*members), F.lit(label)).otherwise(out)
    return out


def bucket(v, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """labels[i] where v < edges[i]; the last label otherwise."""
    out = F.lit(labels[-1])
    for e, label in reversed(list(zip(edges, labels))):
        out = F.when(C(v) < e, F.lit(label)).otherwise(out)
    return out


def design_indicators(df: DataFrame, treated: Column, post: Column, year: str = "year", first_event: int | None = None) -> DataFrame:
    out = df.withColumn("treat", treated.cast("int")).withColumn("post", post.cast("int"))
    out = out.withColumn("did", F.col("treat") * F.col("post"))
    if first_event is not None:
        out = out.withColumn("event_k", F.when(F.col("treat") == 1, F.col(year) - first_event))
    return out


def centre_year(df: DataFrame, year: str = "year") -> DataFrame:
    return attach_scalar(df, df.agg(F.min(year).alias("__y0"))).withColumn("year_c", F.col(year) - F.col("__y0")).drop("__y0")


def usable(df: DataFrame, y: str, support: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y)) & (F.coalesce(F.col(support), F.lit(0)) > 0))


def design_grid(units: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every unit with every combination of the given levels, by generators."""
    out = units
    for name, levels in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    return out


def bounded_shift(df: DataFrame, shares: DataFrame, keys: Sequence[str], y: str, metric: str, delta: Mapping[str, float],
                  eligible: Column, min_share: float = 0.001) -> DataFrame:
    """y - f*delta(metric) on eligible rows with a share of at least ``min_share``; audit columns kept."""
    j = join_on(df, shares, keys, "left")
    f = F.coalesce(F.col("share"), F.lit(0.0))
    d = literal_map(delta)[F.col(metric)]
    hit = eligible & (f >= min_share) & F.col(y).isNotNull()
    return j.select(
        *df.columns,
        F.when(hit, F.round(F.col(y) - f * d, 2)).otherwise(F.col(y)).alias("corrected"),
        F.when(hit, F.round(f, 6)).otherwise(0.0).alias("shift_f"),
        F.when(hit, d).otherwise(0.0).alias("shift_delta"),
        F.when(hit, F.round(-f * d, 2)).otherwise(0.0).alias("shift_days"),
        F.coalesce("source", F.lit("none")).alias("share_source"),
    )


def spread_or(df: DataFrame, keys: Sequence[str], v: str, fallback: float, name: str = "sd") -> DataFrame:
    """Sample deviation per group; the constant where it is missing or zero."""
    sd = F.nullif(F.stddev_samp(v), F.lit(0.0))
    return df.groupBy(*keys).agg(F.coalesce(sd, F.lit(fallback)).alias(name))


def envelope(y: Column, sd: Column, support: Column) -> dict[str, Column]:
    se = sd / F.greatest(F.lit(1.0), F.sqrt(F.least(support, F.lit(100000)) / 1000.0))
    return {"p25": y - 0.6745 * sd, "p75": y + 0.6745 * sd, "lo95": y - 1.96 * se, "hi95": y + 1.96 * se}


def deviation(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "_dev") -> DataFrame:
    """Value minus its group mean, by a joined aggregate rather than a group-wide window."""
    m = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    j = join_on(df, m, list(keys))
    return j.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"__m_{c}") for c in cols}).drop(*[f"__m_{c}" for c in cols])


def two_way_deviation(df: DataFrame, unit: Sequence[str], period: Sequence[str], v: str, name: str = "dev2") -> DataFrame:
    """One-pass double demeaning: exact for balanced panels only."""
    a = deviation(df, unit, [v], "__a")
    return deviation(a, period, [f"{v}__a"], "__b").withColumnRenamed(f"{v}__a__b", name).drop(f"{v}__a")


def variance_components(df: DataFrame, cell: Sequence[str], unit: str, period: str, y: str) -> DataFrame:
    """Deviations of unit, period and residual effects on units observed in every period."""
    cell = list(cell)
    t = df.where(F.col(y).isNotNull()).groupBy(*cell, unit, period).agg(F.avg(y).alias("y"))
    n_periods = df.groupBy(*cell).agg(F.count_distinct(period).alias("__t"))
    full = t.groupBy(*cell, unit).agg(F.count(F.lit(1)).alias("__n"), F.avg("y").alias("u_mean"))
    full = join_on(full, n_periods, cell).where("__n = __t").drop("__n", "__t")
    kept = join_on(t, full, [*cell, unit])
    per = kept.groupBy(*cell, period).agg(F.avg("y").alias("p_mean"))
    grand = kept.groupBy(*cell).agg(F.avg("y").alias("mu"), F.count(F.lit(1)).alias("n_cells"))
    eps = join_on(join_on(kept, per, [*cell, period]), grand, cell)
    resid = eps.groupBy(*cell).agg(F.stddev_samp(F.col("y") - F.col("u_mean") - F.col("p_mean") + F.col("mu")).alias("sigma_e"))
    su = full.groupBy(*cell).agg(F.stddev_samp("u_mean").alias("sigma_u"), F.count(F.lit(1)).alias("n_units"))
    st = per.groupBy(*cell).agg(F.stddev_samp("p_mean").alias("sigma_t"), F.count(F.lit(1)).alias("n_periods"))
    out = grand
    for part in (su, st, resid):
        out = join_on(out, part, cell)
    return out


def mode_stats(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Most frequent rounded value (least on ties), its share, and the number of distinct values."""
    c = df.where(F.col(v).isNotNull()).groupBy(*keys, F.round(v).alias("val")).agg(F.count(F.lit(1)).alias("cnt"))
    return c.groupBy(*keys).agg(
        F.min_by("val", F.struct(-F.col("cnt"), F.col("val"))).alias("mode_value"),
        (F.max("cnt") / F.sum("cnt")).alias("mode_share"),
        F.count(F.lit(1)).alias("n_unique"),
        F.sum("cnt").alias("n"),
    )


def correlations(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson and tie-averaged Spearman correlation per group."""
    keys = list(keys)
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b"))
    r = join_on(d, average_ranks(d, keys, "__a", "__ra"), [*keys, "__a"])
    r = join_on(r, average_ranks(d, keys, "__b", "__rb"), [*keys, "__b"])
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr("__a", "__b").alias("pearson"), F.corr("__ra", "__rb").alias("spearman")
    )


def impute_by_class(df: DataFrame, cls: str, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs with the class median, then with the overall median."""
    per_class = column_medians(df, [cls], {c: f"__c_{c}" for c in cols})
    overall = column_medians(df, [], {c: f"__g_{c}" for c in cols})
    j = attach_scalar(join_on(df, per_class, [cls], "left"), overall)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__c_{c}"), F.col(f"__g_{c}")) for c in cols}
    return j.withColumns(filled).select(*df.columns)


def phase_means(df: DataFrame, keys: Sequence[str], doy: str, phases: Sequence[tuple[str, int, int]], cols: Sequence[str]) -> DataFrame:
    """Means over named day ranges; a phase without rows stays, with n = 0."""
    keys = list(keys)
    grid = design_grid(df.select(*keys).distinct(), {"phase": [p[0] for p in phases]})
    hits = [F.when(F.col(doy).between(lo, hi), F.lit(name)) for name, lo, hi in phases]
    tagged = df.withColumn("phase", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    m = tagged.groupBy(*keys, "phase").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    return join_on(grid, m, [*keys, "phase"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def phase_deltas(stats: DataFrame, keys: Sequence[str], base: str, cols: Sequence[str]) -> DataFrame:
    b = stats.where(F.col("phase") == base).select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    j = join_on(stats.where(F.col("phase") != base), b, list(keys), "left")
    return j.select(*keys, "phase", *[(F.col(c) - F.col(f"__{c}")).alias(f"delta_{c}") for c in cols])


def mcnemar(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Paired test on a split at the pooled median, with continuity correction."""
    keys = list(keys)
    pairs = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pooled = pairs.select(*keys, F.explode(F.array(a, b)).alias("v"))
    j = join_on(pairs, exact_quantiles(pooled, keys, "v", {"med": 0.5}), keys)
    la, lb = F.col(a) >= F.col("med"), F.col(b) >= F.col("med")
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(la & ~lb, 1)).alias("b"), F.count(F.when(~la & lb, 1)).alias("c")
    )
    stat = F.try_divide(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)), F.col("b") + F.col("c"))
    return g.withColumn("chi2", stat)


def cohens_d(df: DataFrame, keys: Sequence[str], group: Column, v: str) -> DataFrame:
    """(mean1 - mean0) / pooled deviation; NULL with fewer than two rows on a side."""
    one, two = F.when(group, F.col(v)), F.when(~group, F.col(v))
    g = df.groupBy(*keys).agg(
        F.avg(one).alias("m1"), F.avg(two).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v0"), F.count(one).alias("n1"), F.count(two).alias("n0")
    )
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    ok = (F.col("n1") >= 2) & (F.col("n0") >= 2)
    return g.withColumn("cohens_d", F.when(ok, F.try_divide(F.col("m1") - F.col("m0"), pooled)))


