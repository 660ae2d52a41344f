"""Algebra over stored draws: centring, flows, means, Rt, likelihood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    COMPARTMENTS,
    CUMULATIVE_INFECTION_INIT,
    DISPERSION_CEILING,
    DISPERSION_FLOOR,
    MEAN_FLOOR,
    STEP_DAYS,
)
from ..functions.scalars import apply_link, clamp, nb_log_density, nb_success, nb_variance, sum_strict
from .draws import DRAW_KEYS
from .packed import in_force, let, running_sums

DURATIONS = ("dur_latent", "dur_infectious", "dur_hospitalized", "dur_waning", "dur_icu")
# Rate that is the inverse of each duration.
RATES = {
    "γ": "dur_latent",
    "ν": "dur_infectious",
    "η": "dur_hospitalized",
    "κ": "dur_waning",
    "ω": "dur_icu",
}


def centre_params(draws: DataFrame, priors: DataFrame) -> DataFrame:
    """Standard-normal draws on their natural scale; dispersions are clamped.

    ``priors`` has a row per place and name. A name without a prior is an error.
    """
    joined = draws.join(
        priors.select("place_id", "name", "link", "mean", "sd"), ["place_id", "name"], "left"
    ).withColumn("link", F.coalesce("link", _no_prior("name").cast("string")))
    centred = apply_link("link", F.col("value") * F.col("sd") + F.col("mean"))
    bounded = F.when(
        F.col("name").startswith("ϕ_"), clamp(centred, DISPERSION_FLOOR, DISPERSION_CEILING)
    ).otherwise(centred)
    return joined.withColumn("value", bounded).select(*draws.columns)


def centre_packed(packed: DataFrame, priors: DataFrame) -> DataFrame:
    """``centre_params`` on packed draws: the priors of a place are one map, joined by place.

    ``priors`` has a row per place and name, as ``priors.priors_by_place`` gives.
    A name without a prior is an error.
    """
    own = F.map_from_entries(F.collect_list(F.struct("name", F.struct("link", "mean", "sd").alias("prior"))))
    by_place = priors.groupBy("place_id").agg(own.alias("_priors"))

    def centred(name: Column, z: Column) -> Column:
        def linked(p: Column) -> Column:
            value = apply_link(p["link"], z * p["sd"] + p["mean"])
            bounded = clamp(value, DISPERSION_FLOOR, DISPERSION_CEILING)
            return F.when(p.isNull(), _no_prior(name).cast("double")).when(name.startswith("ϕ_"), bounded).otherwise(value)

        return let(F.try_element_at("_priors", name), linked)

    joined = packed.join(by_place, "place_id", "left")
    return joined.withColumn("params", F.transform_values("params", centred)).drop("_priors")


def _no_prior(name: Column | str) -> Column:
    return F.raise_error(F.concat(F.lit("no prior for "), F.coalesce(name, F.lit("null"))))


def param(name: str) -> Column:
    """A parameter of a packed draw."""
    return F.try_element_at("params", F.lit(name))


def with_rates(packed: DataFrame, step: int = STEP_DAYS) -> DataFrame:
    """Adds the rates per step and the durations in days to the parameters of packed draws."""
    entries = [F.struct(F.lit(rate).alias("k"), (F.lit(1.0) / param(d)).alias("v")) for rate, d in RATES.items()]
    entries += [F.struct(F.lit(f"{d}_days").alias("k"), (param(d) * float(step)).alias("v")) for d in DURATIONS]
    return packed.withColumn("params", F.map_concat("params", F.map_from_entries(F.array(*entries))))


def params_wide(packed: DataFrame, names: Sequence[str], keys: Sequence[str] = DRAW_KEYS) -> DataFrame:
    """One column per named parameter."""
    return packed.select(*keys, *[param(n).alias(n) for n in names])


def initial_compartments(params: DataFrame, init: DataFrame) -> DataFrame:
    """Compartments at week 0 of each draw, and their logs."""
    seeds = init.select(
        F.col("id").alias("place_id"), "population", "H", "ICU", "D", "remaining_population"
    )
    joined = params.join(seeds, "place_id")
    filled = joined.withColumns(
        {x: F.col(f"{x}_init_prop") * F.col("population") for x in ("E", "I", "R")}
    ).withColumns(
        {
            "S": clamp(
                F.col("remaining_population") - (F.col("E") + F.col("I") + F.col("R")),
                1.0, float("inf"),
            ),
            "C": F.lit(CUMULATIVE_INFECTION_INIT),
        }
    )
    return filled.select(
        *DRAW_KEYS,
        *COMPARTMENTS,
        *[F.ln(c).alias(f"log_{c}") for c in COMPARTMENTS],
    )


def walked() -> Column:
    """R₀ and β path of a packed draw, (idx, R₀_t, β_t): the initial value, then its log-scale walk.

    The path is missing from the first missing step on.
    """
    steps = F.col("steps")
    at = F.concat(F.array(F.lit(0)), F.transform(steps, lambda s: s["idx"]))
    sums = F.concat(F.array(F.lit(0.0)), running_sums(F.transform(steps, lambda s: s["value"])))

    def place(i: Column, total: Column) -> Column:
        def both(r0: Column) -> Column:
            return F.struct((i + 1).alias("idx"), r0.alias("R₀_t"), (r0 * param("ν")).alias("β_t"))

        return let(F.exp(F.ln(param("R₀_init")) + total * param("σ_R₀")), both)

    return F.zip_with(at, sums, place)


def changes(columns: Sequence[str] = ("C", "D")) -> Column:
    """The weeks of a packed draw with the change of cumulative compartments; week 0 has none."""
    states = F.col("states")

    def week(s: Column, i: Column) -> Column:
        before = F.get(states, i - 1)
        new = [(s[c] - before[c]).alias(f"new_{c}") for c in columns]
        return F.struct(*[s[f].alias(f) for f in ("t", *COMPARTMENTS)], *new)

    return F.transform(states, week)


def log_random_walk(packed: DataFrame, keys: Sequence[str] = DRAW_KEYS) -> DataFrame:
    """(keys, idx, R₀_t, β_t): the path of each packed draw."""
    return packed.select(*keys, F.inline(walked()))


def increments(
    packed: DataFrame, columns: Sequence[str] = ("C", "D"), keys: Sequence[str] = DRAW_KEYS
) -> DataFrame:
    """The states of each packed draw with the change over each week, from week 1 on."""
    later = F.slice(changes(columns), F.lit(2), F.greatest(F.size("states") - 1, F.lit(0)))
    return packed.select(*keys, F.inline(later))


def with_beta() -> Column:
    """The states of a packed draw with the β in force at their weeks; null before the first."""

    def told(path: Column) -> Column:
        return F.transform(
            F.col("states"),
            lambda s: F.struct(
                *[s[f].alias(f) for f in ("t", *COMPARTMENTS)], in_force(path, lambda p: p["idx"] - 1, s["t"])["β_t"].alias("β")
            ),
        )

    return let(walked(), told)


def step_param_lookup(packed: DataFrame, keys: Sequence[str] = DRAW_KEYS, out: str = "value") -> DataFrame:
    """(keys, t, value): the β in force at each stored state, the last one at or before its week."""
    return packed.select(*keys, F.inline(with_beta())).select(*keys, "t", F.col("β").alias(out))


def transition_flows(packed: DataFrame, keys: Sequence[str] = DRAW_KEYS) -> DataFrame:
    """The nine flows at each stored state, and N, with the β in force in that week."""
    rates = ("γ", "ν", "η", "κ", "ω", "IHR", "HICUR", "ICUDR")
    c = packed.select(*keys, *[param(r).alias(r) for r in rates], F.inline(with_beta()))
    alive = [x for x in COMPARTMENTS if x != "C"]
    n = F.col(alive[0])
    for x in alive[1:]:
        n = n + F.col(x)
    # The names of the model's flows.
    flows = {
        "infection": F.col("β") * F.col("I") * F.col("S") / F.col("N"),
        "progression": F.col("γ") * F.col("E"),
        "hospitalization": F.col("ν") * F.col("IHR") * F.col("I"),
        "non_hospitalized_recovery": F.col("ν") * (1 - F.col("IHR")) * F.col("I"),
        "icu_admission": F.col("η") * F.col("HICUR") * F.col("H"),
        "hospitalized_recovery": F.col("η") * (1 - F.col("HICUR")) * F.col("H"),
        "icu_death": F.col("ω") * F.col("ICUDR") * F.col("ICU"),
        "icu_recovery": F.col("ω") * (1 - F.col("ICUDR")) * F.col("ICU"),
        "waned_immunity": F.col("κ") * F.col("R"),
    }
    return c.withColumn("N", n).withColumns(flows).select(*keys, "t", "N", *flows)


def expected_observations(
    packed: DataFrame, populations: DataFrame, keys: Sequence[str] = DRAW_KEYS, carry: Sequence[str] = (),
) -> DataFrame:
    """Expected census and new counts of each draw and week, clamped.

    ``carry`` names parameters to keep beside the means.
    """
    sizes = populations.select(
        F.col("id").alias("place_id"), F.col("population").cast("double").alias("_top")
    )
    detection = ("case_detection_rate", "death_detection_rate", *carry)
    later = F.slice(changes(), F.lit(2), F.greatest(F.size("states") - 1, F.lit(0)))
    weeks = packed.join(sizes, "place_id").select(*keys, "_top", *[param(n).alias(n) for n in detection], F.inline(later))
    week = F.struct("H", "ICU", "new_C", "new_D")
    means = means_of(week, F.col("case_detection_rate"), F.col("death_detection_rate"), F.col("_top"))
    return weeks.select(*keys, "t", *[m.alias(n) for n, m in zip(MEAN_NAMES, means)], *carry)


MEAN_NAMES = ("hospitalizations_mean", "new_cases_mean", "icu_mean", "new_deaths_mean")


def means_of(week: Column, cases: Column, deaths: Column, top: Column) -> list[Column]:
    """Expected census and new counts of a week, in order of ``MEAN_NAMES``, up to ``top``."""
    values = (week["H"], week["new_C"] * cases, week["ICU"], week["new_D"] * deaths)
    return [clamp(v, MEAN_FLOOR, top) for v in values]


def effective_r(packed: DataFrame, populations: DataFrame, keys: Sequence[str] = DRAW_KEYS) -> DataFrame:
    """Rₜ at each position of the R₀ path that has a state: R₀ times the susceptible share."""
    sizes = populations.select(F.col("id").alias("place_id"), "population")
    susceptible = F.map_from_entries(F.transform("states", lambda s: F.struct((s["t"] + 1).alias("idx"), s["S"].alias("S"))))
    path = F.filter(walked(), lambda p: F.exists("states", lambda s: s["t"] + 1 == p["idx"]))
    rows = packed.join(sizes, "place_id").select(*keys, "population", susceptible.alias("_s"), F.inline(path))
    return rows.select(
        *keys, "idx", "R₀_t", "β_t",
        (F.col("R₀_t") * F.try_element_at("_s", F.col("idx")) / F.col("population")).alias("Rₜ_t"),
    )


def nb_params(df: DataFrame, mu: str = "mu", phi: str = "phi") -> DataFrame:
    """Success probability, size and variance of the mean/dispersion form."""
    return df.withColumns(
        {
            "p": nb_success(mu, phi),
            "r": F.col(phi),
            "variance": nb_variance(mu, phi),
        }
    )


def nb_loglik(
    observed: DataFrame, means: DataFrame, keys: Sequence[str] = DRAW_KEYS
) -> DataFrame:
    """Log likelihood of each draw over all observed streams and weeks.

    ``observed``: (place_id, stream, t, value); ``means``: (draw, stream, t,
    mu, phi). Missing observations count nothing; with a missing mean or
    dispersion of an observed week the sum is missing.
    """
    scored = means.join(
        observed.where(F.col("value").isNotNull()), ["place_id", "stream", "t"]
    ).withColumn("_ll", nb_log_density("value", "mu", "phi"))
    return scored.groupBy(*keys).agg(
        sum_strict("_ll").alias("log_likelihood"), F.count(F.lit(1)).alias("n_observed")
    )
