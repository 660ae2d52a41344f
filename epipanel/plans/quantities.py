"""Stored parameters and compartments to generated quantities, as long draws."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COMPARTMENTS, PARAMETER_NAMES, STREAMS
from ..operators import model_tables as M
from ..operators.draws import DRAW_KEYS, wide_to_long
from ..operators.horizon import OBSERVED
from ..operators.packed import let
from ..session import stage

# Scalar quantities of a record, in order.
SCALARS = (
    "σ_R₀", "IHR", "HICUR", "ICUDR", "case_detection_rate", "death_detection_rate",
    "ϕ_hosp", "ϕ_icu", "ϕ_cases", "ϕ_deaths",
    "dur_latent_days", "dur_infectious_days", "dur_hospitalized_days", "dur_waning_days",
    "dur_icu_days",
)
SERIES = ("β_t", "R₀_t", "Rₜ_t")
MEANS = ("hospitalizations_mean", "new_cases_mean", "icu_mean", "new_deaths_mean")


class Quantities:
    """Lazy frames of the draw-level job over all places and draws.

    ``packed`` has a row per draw (``packed.pack_model`` or the draw store), so
    everything but the likelihood's join with the observations is told from one
    row at a time.
    """

    def __init__(self, packed: DataFrame, priors: DataFrame, dim: DataFrame):
        self.packed, self.priors, self.dim = packed, priors, dim

    @cached_property
    def draws(self) -> DataFrame:
        """The packed draws with centred parameters, rates and durations, stored."""
        return stage(M.with_rates(M.centre_packed(self.packed, self.priors)))

    @cached_property
    def centred(self) -> DataFrame:
        """(draw, name, value) of the centred parameters."""
        rows = M.centre_packed(self.packed, self.priors)
        return rows.select(*DRAW_KEYS, F.explode("params").alias("name", "value"))

    @cached_property
    def params(self) -> DataFrame:
        """One row per draw and one column per parameter, rate and duration."""
        return M.params_wide(self.draws, [*PARAMETER_NAMES, *M.RATES, *[f"{d}_days" for d in M.DURATIONS]])

    @cached_property
    def walk(self) -> DataFrame:
        return M.log_random_walk(self.draws)

    @cached_property
    def effective(self) -> DataFrame:
        return M.effective_r(self.draws, self.dim)

    @cached_property
    def means(self) -> DataFrame:
        return M.expected_observations(self.draws, self.dim)

    @cached_property
    def means_long(self) -> DataFrame:
        return wide_to_long(self.means, [*DRAW_KEYS, "t"], MEANS)

    @cached_property
    def stream_means(self) -> DataFrame:
        """(draw, t, stream, mu, phi)."""
        beside = M.expected_observations(self.draws, self.dim, carry=[phi for _, _, _, phi in STREAMS])
        rows = [
            F.struct(
                F.lit(stream).alias("stream"), F.col(mean).alias("mu"), F.col(phi).alias("phi")
            )
            for stream, _, mean, phi in STREAMS
        ]
        return beside.select(*DRAW_KEYS, "t", F.inline(F.array(*rows)))

    @cached_property
    def generated(self) -> DataFrame:
        """(draw, name, idx, value) of all scalars, series, compartments and means, told from each draw's row."""
        sizes = self.dim.select(F.col("id").alias("place_id"), F.col("population").cast("double").alias("_size"))

        def entry(name: str, idx: Column, value: Column) -> Column:
            return F.struct(F.lit(name).alias("name"), idx.cast("int").alias("idx"), value.alias("value"))

        scalars = F.array(*[entry(n, F.lit(None), M.param(n)) for n in SCALARS])
        susceptible = F.map_from_entries(F.transform("states", lambda s: F.struct((s["t"] + 1).alias("i"), s["S"].alias("S"))))

        def on_path(p: Column) -> Column:
            rt = p["R₀_t"] * F.try_element_at("_s", p["idx"]) / F.col("_size")
            values = {"β_t": p["β_t"], "R₀_t": p["R₀_t"], "Rₜ_t": rt}
            return F.array(*[entry(n, p["idx"], values[n]) for n in SERIES])

        def in_week(w: Column) -> Column:
            means = M.means_of(w, M.param("case_detection_rate"), M.param("death_detection_rate"), F.col("_size"))
            states = [entry(c, w["t"] + 1, w[c]) for c in COMPARTMENTS]
            later = [entry(n, w["t"], v) for n, v in zip(MEANS, means)]
            # The first stored week has no change, so no means.
            return F.when(w["new"], F.array(*states, *later)).otherwise(F.array(*states))

        rows = self.draws.join(sizes, "place_id").withColumn("_s", susceptible)
        path = F.filter(M.walked(), lambda p: F.map_contains_key("_s", p["idx"]))
        weeks = let(M.changes(), lambda all_: F.transform(all_, lambda w, i: in_week(_marked(w, i > 0))))
        return rows.select(
            *DRAW_KEYS, F.inline(F.concat(scalars, F.flatten(F.transform(path, on_path)), F.flatten(weeks)))
        )


def _marked(week: Column, new: Column) -> Column:
    fields = ("t", *COMPARTMENTS, "new_C", "new_D")
    return F.struct(*[week[f].alias(f) for f in fields], new.alias("new"))


def observed_streams(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """(place_id, stream, t, value) of a weekly panel."""
    rows = [
        F.struct(F.lit(stream).alias("stream"), F.col(column).alias("value"))
        for stream, column, _, _ in STREAMS
    ]
    assert {column for _, column, _, _ in STREAMS} == set(OBSERVED)
    ids = dim.select(F.col("id").alias("place_id"), "place")
    return panel.join(ids, "place").select(
        "place_id", F.col("time").cast("int").alias("t"), F.inline(F.array(*rows))
    )
