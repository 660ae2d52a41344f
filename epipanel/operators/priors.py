"""Prior tables: dispersion moments, prior and induced quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DISPERSION_NAMES, PRIOR_QUANTILES, PRIORS
from ..functions.scalars import apply_link, digamma, nb_log_density, trigamma
from .packed import let
from .quantiles import group_quantiles


def fixed_priors(spark: SparkSession) -> DataFrame:
    """(name, link, mean, sd) of the model's own priors."""
    return spark.createDataFrame(
        [(n, link, float(at), sd) for n, link, at, sd in PRIORS],
        "name string, link string, mean double, sd double",
    )


def log_moments(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and standard deviation of the log of positive draws."""
    return (
        df.where(F.col(value) > 0)
        .groupBy(*keys)
        .agg(F.avg(F.ln(value)).alias("mean"), F.stddev_samp(F.ln(value)).alias("sd"))
    )


def dispersion_priors(moments: DataFrame) -> DataFrame:
    """Prior rows of the dispersions from per-stream log moments, with the other columns of ``moments`` ahead."""
    name = F.coalesce(*[F.when(F.col("stream") == s, F.lit(n)) for s, n in DISPERSION_NAMES])
    keys = [c for c in moments.columns if c not in ("stream", "mean", "sd")]
    return moments.select(
        *keys, name.alias("name"), F.lit("exp").alias("link"), "mean", "sd"
    ).where(F.col("name").isNotNull())


def place_chain(dim: DataFrame, region_key: DataFrame) -> DataFrame:
    """(place_id, rank, level, from_id): the place itself, then its region, then the state.

    Regions and the state are places of their own, with the state behind a
    region and nothing behind the state. Names tell a place of each level.
    """
    ids = dim.select("id", "level", "place")
    state = ids.where("level = 'state'").select(F.col("id").alias("state_id"))
    regions = ids.where("level = 'region'").select(F.col("id").alias("region_id"), F.col("place").alias("region"))
    # One state at most, so this adds a column and no rows.
    home = (
        ids.join(region_key.select("place", "region"), "place", "left").join(regions, "region", "left")
        .withColumn("state_id", state.select(F.max("state_id")).scalar())
    )
    own = F.struct(F.lit(0).alias("rank"), F.col("level"), F.col("id").alias("from_id"))
    by_region = F.when(F.col("level") == "place", F.struct(F.lit(1).alias("rank"), F.lit("region").alias("level"), F.col("region_id").alias("from_id")))
    by_state = F.when(F.col("level") != "state", F.struct(F.lit(2).alias("rank"), F.lit("state").alias("level"), F.col("state_id").alias("from_id")))
    steps = F.filter(F.array(own, by_region, by_state), lambda s: s["from_id"].isNotNull())
    return home.select(F.col("id").alias("place_id"), F.inline(steps))


def priors_by_place(fixed: DataFrame, fitted: DataFrame, dim: DataFrame, region_key: DataFrame) -> DataFrame:
    """(place_id, name, link, mean, sd, level): the priors in force at every place.

    ``fitted`` has the rows (place_id, name, link, mean, sd) of some places,
    regions and the state. A place without a row for a name takes its region's,
    then the state's; ``level`` tells where it comes from. Names of ``fixed``
    are the same everywhere, and a fitted one takes the place of a fixed one.
    A fitted row without a mean or deviation counts as none.
    """
    chain = place_chain(dim, region_key)
    known = fitted.where(F.col("mean").isNotNull() & F.col("sd").isNotNull())
    told = (
        chain.join(known.withColumnRenamed("place_id", "from_id"), "from_id")
        .groupBy("place_id", "name")
        .agg(F.min_by(F.struct("link", "mean", "sd", "level"), "rank").alias("p"))
        .select("place_id", "name", "p.*")
    )
    # The fixed priors are those of the model: a few rows a place.
    listed = fixed.agg(F.collect_list(F.struct("name", "link", "mean", "sd")).alias("all")).scalar()
    everywhere = dim.select(F.col("id").alias("place_id"), F.inline(listed)).withColumn("level", F.lit("fixed"))
    return everywhere.join(told.select("place_id", "name"), ["place_id", "name"], "left_anti").unionByName(told)


def dispersion_pivot(moments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sd of each stream's dispersion as eight columns, a row for each of ``keys``."""
    names = [F.when(F.col("stream") == s, F.col(c)) for s, _ in DISPERSION_NAMES for c in ("mean", "sd")]
    labels = [f"{n}_{c}" for _, n in DISPERSION_NAMES for c in ("mean", "sd")]
    return moments.groupBy(*keys).agg(*[F.max(c).alias(n) for c, n in zip(names, labels)])


def prior_quantiles(priors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of each linked normal prior, and of its reciprocal, with ``keys`` ahead."""
    points = F.array(
        *[
            F.struct(F.lit(p).alias("prob"), F.lit(z).alias("z"))
            for p, z in PRIOR_QUANTILES
        ]
    )
    at = priors.select(*keys, "name", "link", "mean", "sd", F.inline(points))
    value = apply_link("link", F.col("mean") + F.col("z") * F.col("sd"))
    return at.select(*keys, "name", "prob", value.alias("value")).withColumn(
        "reciprocal", F.try_divide(F.lit(1.0), F.col("value"))
    )


def induced(params: DataFrame, remaining_share: Column) -> DataFrame:
    """Fatality ratio and susceptible share implied by each draw."""
    return params.withColumns(
        {
            "IFR": F.col("IHR") * F.col("HICUR") * F.col("ICUDR"),
            "S_prop": remaining_share
            - (F.col("E_init_prop") + F.col("I_init_prop") + F.col("R_init_prop")),
        }
    )


def induced_quantiles(
    induced_draws: DataFrame,
    keys: Sequence[str],
    names: Sequence[str] = ("IFR", "S_prop"),
    probs: Sequence[float] = tuple(p for p, _ in PRIOR_QUANTILES),
) -> DataFrame:
    """Quantiles of derived columns, one row per group, name and probability."""
    stacked = induced_draws.select(
        *keys,
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])
        ),
    )
    asked = group_quantiles(stacked, [*keys, "name"], "value", probs, "_q")
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("prob"), F.col("_q")[i].alias("value"))
            for i, p in enumerate(probs)
        ]
    )
    return asked.select(*keys, "name", F.inline(rows))


def nb_dispersion(
    series: DataFrame, keys: Sequence[str], order: str, value: str, reach: int = 2
) -> DataFrame:
    """Moment estimate μ²/(s²-μ) around a centred moving mean.

    Null where the series is no more spread than a Poisson one. A window holds
    one series, whose length is the number of weeks.
    """
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    smoothed = series.where(F.col(value).isNotNull()).withColumn("_m", F.avg(value).over(around))
    fitted = smoothed.groupBy(*keys).agg(
        F.avg("_m").alias("mu"),
        F.avg((F.col(value) - F.col("_m")) * (F.col(value) - F.col("_m"))).alias("s2"),
    )
    excess = F.col("s2") - F.col("mu")
    return fitted.withColumn(
        "phi", F.when(excess > 0, F.try_divide(F.col("mu") * F.col("mu"), excess))
    )


NEWTON_STEPS = 30
WIDEST_STEP = 1.5      # of the logarithm of the dispersion, in one step


def nb_dispersion_ml(
    series: DataFrame, keys: Sequence[str], order: str, value: str, reach: int = 2, steps: int = NEWTON_STEPS
) -> DataFrame:
    """(keys, n, mu, phi, log_likelihood): the dispersion of greatest likelihood around a centred moving mean.

    A series is gathered into one row, whose size is its number of weeks, and
    the logarithm of φ takes a fixed number of Newton steps there, from the
    moment estimate. Score and curvature are sums over the weeks. Null where
    the likelihood rises without end: the counts then vary no more than Poisson
    ones around the mean. Weeks without a value, or with a mean of zero, take no
    part.
    """
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    weeks = series.where(F.col(value).isNotNull()).withColumn("_m", F.avg(value).over(around)).where(F.col("_m") > 0)
    k, m = F.col(value), F.col("_m")
    gathered = weeks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_m").alias("mu"),
        F.avg((k - m) * (k - m)).alias("_s2"), F.sum((k - m) * (k - m) - k).alias("_rises"),
        F.collect_list(F.struct(k.alias("k"), m.alias("m"))).alias("_weeks"),
    )
    moment = F.try_divide(F.col("mu") * F.col("mu"), F.col("_s2") - F.col("mu"))
    start = F.ln(F.when(moment > 0, F.least(moment, F.lit(1e6))).otherwise(F.lit(1e3)))

    def step(theta: Column, _: Column) -> Column:
        def sums(phi: Column) -> Column:
            zero = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("bend"))

            def add(done: Column, w: Column) -> Column:
                whole = phi + w["m"]
                # First and second derivative of a week's log density in φ.
                first = digamma(w["k"] + phi) - digamma(phi) + F.ln(phi) + 1 - F.ln(whole) - (w["k"] + phi) / whole
                second = trigamma(w["k"] + phi) - trigamma(phi) + 1 / phi - 2 / whole + (w["k"] + phi) / (whole * whole)
                return F.struct((done["score"] + first).alias("score"), (done["bend"] + second).alias("bend"))

            def moved(s: Column) -> Column:
                slope, bend = phi * s["score"], phi * phi * s["bend"] + phi * s["score"]      # in ln φ
                # Where the likelihood is not concave the step follows its slope.
                wanted = F.when(bend < 0, -slope / bend).otherwise(F.signum(slope) * WIDEST_STEP)
                return theta + F.least(F.greatest(wanted, F.lit(-WIDEST_STEP)), F.lit(WIDEST_STEP))

            return let(F.aggregate("_weeks", zero, add), moved)

        return let(F.exp(theta), sums)

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    rises = F.coalesce(F.col("_rises") > 0, F.lit(False))
    fitted = gathered.withColumn("phi", F.when(rises, F.exp(theta)))
    density = F.aggregate("_weeks", F.lit(0.0), lambda s, w: s + nb_log_density(w["k"], w["m"], F.col("phi")))
    return fitted.select(*keys, "n", "mu", "phi", F.when(F.col("phi").isNotNull(), density).alias("log_likelihood"))


def share_within(df: DataFrame, within: Sequence[str], value: str, out: str = "prop") -> DataFrame:
    """Share of each row in its group; takes counts that are already summed."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return df.withColumn(out, F.try_divide(F.col(value), total))
