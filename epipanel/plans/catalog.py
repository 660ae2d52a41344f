"""The registered queries: each operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import EXPORT_WIDTH, SCALAR_LABELS, VARIANT_EXCLUDED, VARIANT_TOTALS, VECTOR_LABELS
from ..functions.scalars import clamp, last_by, logistic, logit, sum_strict
from ..operators import draws as D
from ..operators import export as X
from ..operators import horizon as H
from ..operators import intervals as I
from ..operators import model_tables as M
from ..operators import packed as PK
from ..operators import panel as P
from ..operators import priors as R
from ..operators.quantiles import median_qi
from ..operators.ranking import top_n_finite
from ..session import shared_folder, stage, together
from ..sources import readers as S
from ..sources import sinks as W
from .quantities import Quantities, observed_streams
from .surveillance import Surveillance
from .testdata import STATE, TestData

KEYS = D.DRAW_KEYS
MODEL_PARAMS = 52      # positions the fitted model has; the forecast model has all
FIRST_STATE_DAY = "2022-05-25"


class Frames:
    """The jobs of one data folder. Each frame is built when a query asks for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.data = TestData(spark, folder)

    @cached_property
    def ingest(self) -> Surveillance:
        t = self.data
        return Surveillance(
            t.cases, t.census, t.region_key, t.populations, t.delay_events, STATE
        )

    @cached_property
    def packed(self) -> DataFrame:
        """The model's draws, a row each."""
        t = self.data
        return PK.pack_model(t.parameters, t.walk_steps, t.compartments)

    @cached_property
    def model(self) -> Quantities:
        return Quantities(self.packed, self.priors, self.ingest.dim)

    @cached_property
    def moments(self) -> DataFrame:
        return R.log_moments(self.data.stream_draws, ["place_id", "stream"])

    @cached_property
    def priors(self) -> DataFrame:
        """The priors in force at every place, stored: the model's own and the fitted dispersions."""
        return stage(
            R.priors_by_place(
                R.fixed_priors(self.spark), R.dispersion_priors(self.moments), self.ingest.dim, self.data.region_key
            )
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return H.forecast_calendar(self.ingest.panel)

    def prepare(self) -> None:
        """Store the stages of both jobs; the panel's and the model's go side by side."""
        ingest = self.ingest

        def panel() -> None:
            together(lambda: ingest.daily, lambda: ingest.ecdf)
            ingest.rolled

        def model() -> None:
            together(lambda: ingest.dim, lambda: self.packed)
            self.priors
            self.model.draws

        together(panel, model)

    @cached_property
    def gq(self) -> DataFrame:
        self.prepare()
        return I.gq_intervals(self.model.generated, self.calendar)

    @cached_property
    def predicted(self) -> DataFrame:
        """The predictive draws, a row each, as their files have them."""
        return PK.pack_wide(self.data.predictive_wide, KEYS)

    @cached_property
    def predictive(self) -> DataFrame:
        return I.predictive_intervals(self.predicted, self.calendar)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for comparison with another engine's floating-point order."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Frames], DataFrame]) -> Callable[[Frames], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Frames(spark, folder))
    return build


# ---------------------------------------------------------------- feeds and panel

@query
def place_daily_clean(f: Frames) -> DataFrame:
    return P.clean_place_feed(f.data.raw_case_feed)


@query
def census_select(f: Frames) -> DataFrame:
    return P.clean_census_feed(f.data.raw_census_feed)


def _written(f: Frames, parts: list[DataFrame]) -> str:
    """Folder of CSV files, each part with its own columns in its own order."""
    path = f"{shared_folder(f.spark)}/feed-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").csv(path, header=True, nullValue="NA")
    return path


def _two_orders(feed: DataFrame) -> list[DataFrame]:
    early = F.col("date" if "date" in feed.columns else "todays_date") < "2022-07-01"
    return [feed.where(early), feed.where(~early).select(*reversed(feed.columns))]


@query
def read_place_daily(f: Frames) -> DataFrame:
    """The case feed from files whose columns stand in two orders."""
    return S.read_place_daily(f.spark, _written(f, _two_orders(f.data.raw_case_feed)))


@query
def read_census(f: Frames) -> DataFrame:
    return S.read_census(f.spark, _written(f, _two_orders(f.data.raw_census_feed)))


@query
def scan_draw_dir(f: Frames) -> DataFrame:
    """Long draws from wide files of both sources, a folder per place; one place has a column less than the others."""
    names = [f"z[{i}]" for i in range(1, 65)]
    wide = f.data.draw_records.select(
        *KEYS, *[F.element_at("z", i + 1).alias(n) for i, n in enumerate(names)]
    ).withColumnRenamed("place_id", "county_id")
    folder = f"{shared_folder(f.spark)}/draws-{uuid.uuid4().hex}"
    scanned = []
    for source in ("prior", "posterior"):
        mine = wide.where(F.col("source") == source).drop("source")
        # A file's place stands in its path, as county_id=N.
        for part in (mine.where("county_id <> 5"), mine.where("county_id = 5").drop(names[-1])):
            part.write.partitionBy("county_id").mode("append").csv(f"{folder}/{source}", header=True, nullValue="NA")
        scanned.append(S.scan_draw_dir(f.spark, f"{folder}/{source}/*", source))
    return scanned[0].unionByName(scanned[1])


@query
def draw_store(f: Frames) -> DataFrame:
    """Draws of the store after one place was stored anew, of one source: the scan opens that source alone."""
    path = f"{shared_folder(f.spark)}/store-{uuid.uuid4().hex}"
    W.write_store(f.predicted, path)
    again = f.predicted.where("place_id = 2").withColumn(
        "entries", F.transform("entries", lambda e: e.withField("value", e["value"] + 1))
    )
    W.replace_places(again, path)
    return PK.unpack(S.read_store(f.spark, path).where("source = 'posterior'"))


@query
def drop_incomplete(f: Frames) -> DataFrame:
    both = f.data.cases.join(f.data.census, ["place", "date"], "full")
    return P.drop_incomplete(both)


@query
def daily_full_join(f: Frames) -> DataFrame:
    return P.daily_full_join(f.data.cases, f.data.census)


@query
def region_join(f: Frames) -> DataFrame:
    daily = P.place_daily(P.clean_place_feed(f.data.raw_case_feed))
    return P.attach_region(daily, f.data.region_key)


@query
def latest_active_date(f: Frames) -> DataFrame:
    return P.latest_active_date(f.ingest.daily)


@query
def reporting_window(f: Frames) -> DataFrame:
    return f.ingest.window


@query
def ecdf_lookup(f: Frames) -> DataFrame:
    """Shares of all case days; the 13th of a month came without its date."""
    latest = f.ingest.window.select("latest_date").scalar()
    dated = f.data.cases.select("place", F.when(F.dayofmonth("date") != 13, F.col("date")).alias("date"))
    aged = dated.select("place", "date", P.days_between(latest, "date").alias("days_ago"))
    looked = P.ecdf_lookup(aged, f.ingest.ecdf, "cases", "days_ago", "f_cases")
    looked = P.ecdf_lookup(looked, f.ingest.ecdf, "deaths", F.col("days_ago") + 4, "f_deaths")
    return rounded(looked, 9, "f_cases", "f_deaths")


@query
def delay_correct(f: Frames) -> DataFrame:
    return rounded(
        f.ingest.corrected, 6,
        "cases_est_prop_reported", "death_est_prop_reported", "est_cases", "est_deaths",
    )


@query
def sum_strict_by_place(f: Frames) -> DataFrame:
    return f.ingest.daily.groupBy("place").agg(
        *[sum_strict(c).alias(c) for c in ("cases", "deaths", "hospitalized", "icu")]
    )


@query
def last_by_date(f: Frames) -> DataFrame:
    return f.ingest.daily.groupBy("place").agg(
        *[last_by(c, "date").alias(c) for c in ("cumulative_deaths", "hospitalized", "icu")]
    )


@query
def weekly_panel(f: Frames) -> DataFrame:
    return f.ingest.weekly


@query
def rollup_panel(f: Frames) -> DataFrame:
    return f.ingest.rolled


@query
def late_feed(f: Frames) -> DataFrame:
    """The rolled-up panel when the days of some nations in the last three weeks come late.

    The first feed's state and rollup are stored. The late days' state is
    merged into it, and only the weeks that they touch are summed anew.
    """
    ingest, key = f.ingest, f.data.region_key
    first_day, last_day = ingest.bounds.first_day, ingest.bounds.last_date
    late = F.col("place").isin("NATION_4", "NATION_9", "NATION_20") & (F.col("date") > F.date_sub(F.lit(last_day).cast("date"), 21))
    states = [P.panel_state(ingest.corrected.where(which), F.lit(first_day).cast("date")) for which in (~late, late)]
    before, added = together(*[lambda s=s: stage(s) for s in states])
    rolled = stage(P.rollup_places(P.panel_of(before), key, STATE))
    return P.update_rollup(rolled, stage(P.merge_states(before, added)), added, key, STATE)


@query
def place_dimension(f: Frames) -> DataFrame:
    return f.ingest.dim


@query
def initial_values(f: Frames) -> DataFrame:
    return f.ingest.init


@query
def filter_place(f: Frames) -> DataFrame:
    name = P.filter_place(f.ingest.dim, "id", 3).select("place").scalar()
    return P.filter_place(f.ingest.panel, "place", name)


@query
def place_type(f: Frames) -> DataFrame:
    return X.place_type(f.ingest.panel, f.data.region_key)


@query
def headline_text(f: Frames) -> DataFrame:
    types = X.place_type(f.ingest.panel, f.data.region_key)
    return X.headline(types, X.observed_long(f.ingest.panel))


@query
def observed_long(f: Frames) -> DataFrame:
    return X.observed_long(f.ingest.panel)


@query
def forecast_calendar(f: Frames) -> DataFrame:
    return f.calendar


@query
def extend_horizon(f: Frames) -> DataFrame:
    return H.extend_horizon(f.ingest.panel)


@query
def mask_observations(f: Frames) -> DataFrame:
    return H.mask_observations(f.ingest.panel)


@query
def nb_dispersion(f: Frames) -> DataFrame:
    series = D.wide_to_long(
        f.ingest.weekly, ["place", "time"], ["est_cases", "est_deaths", "hospitalized", "icu"]
    )
    return rounded(
        R.nb_dispersion(series, ["place", "name"], "time", "value"), 6, "mu", "s2", "phi"
    )


# ---------------------------------------------------------------- draws

@query
def nb_dispersion_ml(f: Frames) -> DataFrame:
    series = D.wide_to_long(
        f.ingest.weekly, ["place", "time"], ["est_cases", "est_deaths", "hospitalized", "icu"]
    )
    fitted = R.nb_dispersion_ml(series, ["place", "name"], "time", "value")
    return rounded(rounded(fitted, 6, "mu"), 4, "phi", "log_likelihood")


@query
def place_dictionary(f: Frames) -> DataFrame:
    """Ids after a first feed of even nations and a second one of all: those of the first stay."""
    populations, key = f.data.populations, f.data.region_key
    first = populations.where(F.col("population") % 2 == 0)
    dictionary = stage(P.place_dimension(first, key, STATE).select("id", "level", "place"))
    return P.extend_dictionary(dictionary, f.ingest.dim)


@query
def read_dims(f: Frames) -> DataFrame:
    """Dimension, region key and initial values, written as the files that other tools read, then read and joined."""
    folder = f"{shared_folder(f.spark)}/dims-{uuid.uuid4().hex}"
    county = lambda df: df.withColumnRenamed("place", "county")
    W.write_report(county(f.ingest.dim.drop("level")), f"{folder}/dim")
    W.write_report(county(f.data.region_key), f"{folder}/key")
    W.write_report(county(f.ingest.init), f"{folder}/init")
    dim, key, init = S.read_dims(f.spark, f"{folder}/dim", f"{folder}/key", f"{folder}/init")
    return dim.join(key, "place", "left").join(init.drop("id", "population"), "place", "left")


@query
def write_report(f: Frames) -> DataFrame:
    """The panel as a report in order of places and weeks, read back through its manifest."""
    path = f"{shared_folder(f.spark)}/report-{uuid.uuid4().hex}"
    W.write_report(f.ingest.panel.drop("level"), path, ["place", "time", "start_date", "end_date"])
    return S.read_report(f.spark, path, schemas.WEEKLY_PANEL)


@query
def refresh_results(f: Frames) -> DataFrame:
    """Draws of a folder that held the prior ones and was cleared for the posterior ones."""
    path = f"{shared_folder(f.spark)}/results-{uuid.uuid4().hex}"
    W.write_draws(f.data.draws.where("source = 'prior'"), path)
    W.refresh_results(f.data.draws.where("source = 'posterior'"), path)
    return S.read_draws(f.spark, path)


@query
def draws_by_place(f: Frames) -> DataFrame:
    return I.attach_place(f.data.draws, f.ingest.dim)


@query
def wide_to_long(f: Frames) -> DataFrame:
    wide = f.data.draw_records.select(
        *KEYS, *[F.element_at("z", i).alias(f"z[{i}]") for i in range(1, 65)]
    )
    return D.wide_to_long(wide, KEYS)


@query
def long_to_wide(f: Frames) -> DataFrame:
    named = f.data.draws.withColumn("name", F.concat("name", F.lit("_"), "idx"))
    return D.long_to_wide(named, KEYS, [f"z_{i}" for i in range(1, 65)])


@query
def parse_indexed_name(f: Frames) -> DataFrame:
    indexed = f.data.predictive.withColumn(
        "name", D.indexed_name(F.concat(F.lit("data_"), "name"))
    ).select(*KEYS, "name", "value")
    scalars = f.data.parameters
    return D.parse_indexed_name(indexed.unionByName(scalars))


@query
def flatten_record(f: Frames) -> DataFrame:
    record = F.struct(
        F.element_at("z", 1).alias("first"),
        F.slice("z", 2, 31).alias("head"),
        F.slice("z", 33, 32).alias("tail"),
    )
    return D.flatten_record(f.data.draw_records.withColumn("record", record), KEYS, "record")


@query
def reorder_vars(f: Frames) -> DataFrame:
    draws = f.data.draws
    names = draws.select("name", "idx").distinct()
    return D.reorder_vars(draws, stage(names.withColumn("pos", 65 - F.col("idx"))))


@query
def new_param_names(f: Frames) -> DataFrame:
    draws = f.data.draws
    return D.new_names(draws, draws.where(F.col("idx") <= MODEL_PARAMS))


def _chains(f: Frames) -> list[DataFrame]:
    """The draws of the first three labels as chains of their own; the last lacks its last position."""
    mine = [f.data.draws.where(F.col("chain") == c).drop("chain") for c in range(3)]
    return [*mine[:2], mine[2].where("idx < 64")]


@query
def stack_chains(f: Frames) -> DataFrame:
    return D.stack_chains(_chains(f))


@query
def names_missing_in_chains(f: Frames) -> DataFrame:
    return D.names_missing_in_chains(D.stack_chains(_chains(f)))


def _padded(f: Frames, mode: str) -> DataFrame:
    draws = f.data.draws
    model = draws.where(F.col("idx") <= MODEL_PARAMS)
    return H.pad_params(model, D.new_names(draws, model), mode, draw_keys=f.data.draw_keys)


@query
def pad_params_zeros(f: Frames) -> DataFrame:
    return _padded(f, "zeros")


@query
def pad_params_randn(f: Frames) -> DataFrame:
    return rounded(_padded(f, "randn"), 6, "value")


@query
def truncate_chains(f: Frames) -> DataFrame:
    return D.truncate_chains(
        f.data.draw_keys,
        (F.col("iteration") % 4 != 0) & ~((F.col("place_id") == 5) & (F.col("chain") == 3)),
        ["place_id", "source", "chain"],
    )


@query
def median_qi_draws(f: Frames) -> DataFrame:
    asked = median_qi(
        f.data.draws, [*I.GROUP, "name", "idx"], "value", I.INTERVAL_WIDTHS,
    )
    return rounded(asked, 6, "lower", "value", "upper")


@query
def stack_sources(f: Frames) -> DataFrame:
    asked = rounded(f.predictive, 6, "lower", "value", "upper")
    return D.stack_sources(
        asked.where("source = 'posterior'").drop("source"),
        asked.where("source = 'prior'").drop("source"),
    )


@query
def cumulative_intervals(f: Frames) -> DataFrame:
    asked = I.cumulative_intervals(f.predicted)
    return rounded(asked, 6, "lower", "value", "upper")


@query
def predictive_intervals(f: Frames) -> DataFrame:
    return rounded(f.predictive, 6, "lower", "value", "upper")


@query
def gq_intervals(f: Frames) -> DataFrame:
    return rounded(f.gq, 5, "lower", "value", "upper")


@query
def split_scalar_vector(f: Frames) -> DataFrame:
    scalars, series = I.scalar_vector_split(rounded(f.gq, 5, "lower", "value", "upper"))
    return scalars.withColumn("kind", F.lit("scalar")).unionByName(
        series.withColumn("kind", F.lit("vector")), allowMissingColumns=True
    )


@query
def relabel_names(f: Frames) -> DataFrame:
    asked = rounded(f.gq, 5, "lower", "value", "upper")
    return D.relabel(asked, "name", {**SCALAR_LABELS, **VECTOR_LABELS})


@query
def interval_to_quantile(f: Frames) -> DataFrame:
    return rounded(X.interval_to_quantile(f.predictive), 6, "value")


@query
def forecast_export(f: Frames) -> DataFrame:
    """Only what the table shows is summarised: posterior draws, one width, and of the quantities Rₜ alone."""
    f.prepare()
    dim, shown = f.ingest.dim, F.col("source") == "posterior"

    def named(intervals: DataFrame) -> DataFrame:
        return I.attach_place(intervals, dim).drop("place_id", "source")

    predictive = I.predictive_intervals(f.predicted.where(shown), f.calendar, [EXPORT_WIDTH])
    rt = f.model.effective.where(shown).select(
        *KEYS, F.lit(X.RT).alias("name"), "idx", F.col(X.RT).alias("value")
    )
    generated = I.gq_intervals(rt, f.calendar, [EXPORT_WIDTH])
    rows = X.forecast_export(named(predictive), named(generated), f.ingest.init)
    return rounded(
        rows, 5, "hosp_census_with_covid", "icu", "cases", "deaths", "cumulative_deaths", "Rt"
    )


@query
def derive_totals_long(f: Frames) -> DataFrame:
    """Compartments of prior and posterior draws as the two variants."""
    counted = ["S", "E", "I", "H", "R", "ICU", "D"]
    long = D.wide_to_long(f.data.compartments, ["place_id", "source", "t"], counted)
    prior = F.col("source") == "prior"
    variant = F.when(
        F.col("name") == "S", F.when(prior, "S_both").otherwise("S_omicron_only")
    ).otherwise(
        F.concat("name", F.when(prior, "_non_omicron").otherwise("_omicron"))
    )
    dated = long.select(
        "place_id",
        F.date_add(F.lit(FIRST_STATE_DAY).cast("date"), F.col("t") * 7).alias("date"),
        variant.alias("name"),
        "value",
    ).groupBy("place_id", "date", "name").agg(F.sum("value").alias("value"))
    totals = D.derive_totals_long(
        dated, ["place_id", "date"], VARIANT_TOTALS, VARIANT_EXCLUDED, "2022-06-01",
        others=["R_non_omicron", "R_omicron"],
    )
    return rounded(totals, 4, "value")


# ---------------------------------------------------------------- draw-table algebra

@query
def link_functions(f: Frames) -> DataFrame:
    v: Column = F.col("value")
    return rounded(
        f.data.draws.select(
            *KEYS, "idx",
            logistic(v).alias("logistic"), logit(logistic(v)).alias("logit"),
            F.exp(v).alias("exp"), F.ln(F.exp(v)).alias("log"),
            clamp(v, -0.1, 0.1).alias("clamped"),
        ),
        6, "logistic", "logit", "exp", "log", "clamped",
    )


@query
def centre_params(f: Frames) -> DataFrame:
    return rounded(M.centre_params(f.data.parameters, f.priors), 6, "value")


@query
def rates_and_days(f: Frames) -> DataFrame:
    shown = [*M.RATES, *[f"{d}_days" for d in M.DURATIONS]]
    return rounded(f.model.params.select(*KEYS, *shown), 6, *shown)


@query
def log_random_walk(f: Frames) -> DataFrame:
    return rounded(f.model.walk, 6, "R₀_t", "β_t")


@query
def initial_compartments(f: Frames) -> DataFrame:
    f.prepare()
    shown = M.initial_compartments(f.model.params, f.ingest.init)
    return rounded(shown, 5, *[c for c in shown.columns if c not in KEYS])


@query
def increments(f: Frames) -> DataFrame:
    asked = M.increments(f.packed).select(*KEYS, "t", "new_C", "new_D")
    return rounded(asked, 5, "new_C", "new_D")


@query
def expected_observations(f: Frames) -> DataFrame:
    shown = f.model.means
    return rounded(shown, 5, *[c for c in shown.columns if c not in (*KEYS, "t")])


@query
def effective_r(f: Frames) -> DataFrame:
    return rounded(f.model.effective, 6, "R₀_t", "β_t", "Rₜ_t")


@query
def step_param_lookup(f: Frames) -> DataFrame:
    """β in force at each state's week, from the weeks at which it changes."""
    return rounded(M.step_param_lookup(f.model.draws), 6, "value")


@query
def transition_flows(f: Frames) -> DataFrame:
    """Flows at each state, with the β in force in that week."""
    shown = M.transition_flows(f.model.draws)
    return rounded(shown, 4, *[c for c in shown.columns if c not in (*KEYS, "t")])


@query
def nb_params(f: Frames) -> DataFrame:
    asked = rounded(M.nb_params(f.model.stream_means), 5, "mu", "phi", "p", "r")
    return rounded(asked, 2, "variance")      # up to some millions


@query
def nb_loglik(f: Frames) -> DataFrame:
    f.prepare()
    observed = stage(observed_streams(f.ingest.panel, f.ingest.dim))
    return rounded(M.nb_loglik(observed, f.model.stream_means), 4, "log_likelihood")


# ---------------------------------------------------------------- priors and the rest

@query
def log_moments(f: Frames) -> DataFrame:
    return rounded(R.log_moments(f.data.shape_draws, ["stream"]), 6, "mean", "sd")


@query
def dispersion_pivot(f: Frames) -> DataFrame:
    shown = R.dispersion_pivot(f.moments, ["place_id"])
    return rounded(shown, 6, *[c for c in shown.columns if c != "place_id"])


@query
def prior_quantiles(f: Frames) -> DataFrame:
    return rounded(R.prior_quantiles(f.priors, ["place_id", "level"]), 6, "value", "reciprocal")


@query
def induced_quantiles(f: Frames) -> DataFrame:
    f.prepare()
    share = f.ingest.init.select(
        F.col("id").alias("place_id"),
        (F.col("remaining_population") / F.col("population")).alias("_share"),
    )
    draws = R.induced(f.model.params.join(share, "place_id"), F.col("_share"))
    asked = R.induced_quantiles(draws, I.GROUP)
    return rounded(asked, 8, "value")


@query
def top_n_scores(f: Frames) -> DataFrame:
    return top_n_finite(f.data.scores, ["place"], "lp", 3, "seed")


@query
def share_within_date(f: Frames) -> DataFrame:
    counted = P.count_weighted(f.data.shares, ["date", "name"], "value")
    return rounded(R.share_within(counted, ["date"], "n"), 6, "n", "prop")


# Keys of the inventory whose plain name is an operator imported above.
QUERIES["sum_strict"] = QUERIES.pop("sum_strict_by_place")
QUERIES["median_qi"] = QUERIES.pop("median_qi_draws")
QUERIES["top_n_finite"] = QUERIES.pop("top_n_scores")
