"""The given tables as surveillance feeds and draw tables.

Every frame here is a lazy derivation of the parquet tables, so the work of a
query grows with them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import COMPARTMENTS, PARAMETER_NAMES, STREAMS
from ..operators.draws import DRAW_KEYS

STATE = "Nations"
FIRST_DAY = "2022-06-01"
DAYS = 84
WEEKS_PREDICTED = 16
STATES = 8          # weeks of compartments, from week 0
STEPS = 6           # random-walk steps
# event_type that stands for each dispersion stream
PRIOR_PLACES = (1, 2, 27, 31)    # places, a region and the state whose dispersions are fitted
MISSING_STEP = (89, 3)           # every so many draws lack this step of the walk
MISSING_CENSUS = (97, 5)         # every so many draws lack the census of this week
EVENT_STREAMS = {"click": "cases", "view": "cases", "error": "hospitalized", "purchase": "icu", "signup": "deaths"}


class TestData:
    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A table's scan; its footer is read once for the whole job."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # ------------------------------------------------------------ feeds

    @cached_property
    def _daily_base(self) -> DataFrame:
        day = F.pmod(
            F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), F.lit(DAYS)
        )
        owners = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).select("c_custkey", "n_nationkey", F.col("n_name").alias("place"))
        return (
            self.table("orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                "place", "n_nationkey", day.alias("d"),
                F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int")).alias("date"),
                "o_orderstatus", "o_orderpriority",
            )
        )

    @cached_property
    def cases(self) -> DataFrame:
        reported = ~((F.col("n_nationkey") == 3) & (F.col("d") % 17 == 5))
        by_day = (
            self._daily_base.where(reported).groupBy("place", "date")
            .agg(
                F.count(F.lit(1)).cast("double").alias("cases"),
                F.count(F.when(F.col("o_orderstatus") == "F", 1)).cast("double").alias("deaths"),
            )
        )
        upto = Window.partitionBy("place").orderBy("date").rowsBetween(
            Window.unboundedPreceding, 0
        )
        return by_day.withColumn("cumulative_deaths", F.sum("deaths").over(upto))

    @cached_property
    def census(self) -> DataFrame:
        reported = ~((F.col("n_nationkey") == 7) & (F.col("d") % 13 == 2))
        priority = F.col("o_orderpriority")
        return (
            self._daily_base.where(reported).groupBy("place", "date")
            .agg(
                F.count(F.when(priority.isin("1-URGENT", "2-HIGH"), 1)).cast("double")
                .alias("hospitalized"),
                F.count(F.when(priority == "1-URGENT", 1)).cast("double").alias("icu"),
            )
        )

    @cached_property
    def raw_case_feed(self) -> DataFrame:
        """Feed columns, with one area unknown and one that is no county."""
        return self.cases.join(self.populations, "place", "left").select(
            F.when(F.col("place") == "NATION_24", "Unknown").otherwise(F.col("place")).alias("area"),
            F.when(F.col("place") == "NATION_23", "State").otherwise("County").alias("area_type"),
            F.col("population").cast("double").alias("population"),
            "date", "cases", "deaths", "cumulative_deaths",
        )

    @cached_property
    def raw_census_feed(self) -> DataFrame:
        return self.census.select(
            F.col("place").alias("county"),
            F.col("date").alias("todays_date"),
            F.col("hospitalized").alias("hospitalized_covid_confirmed_patients"),
            F.col("icu").alias("icu_covid_confirmed_patients"),
        )

    @cached_property
    def region_key(self) -> DataFrame:
        return self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(F.col("r_name").alias("region"), F.col("n_name").alias("place"))

    @cached_property
    def populations(self) -> DataFrame:
        counts = self.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            F.col("n_name").alias("place"),
            (F.col("n") * 1000 + F.col("n_nationkey")).cast("bigint").alias("population"),
        )

    @cached_property
    def delay_events(self) -> DataFrame:
        gap = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
        gaps = self.table("lineitem").join(
            self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
        ).select(gap.alias("gap"))
        streams = F.array(
            F.struct(F.lit("cases").alias("stream"), (F.col("gap") % 30).alias("delay_days")),
            F.struct(F.lit("deaths").alias("stream"), (F.col("gap") % 45).alias("delay_days")),
        )
        return gaps.select(F.inline(streams))

    # ------------------------------------------------------------ draws

    @cached_property
    def draw_records(self) -> DataFrame:
        """One row per draw with its vector ``z`` of standard-normal values."""
        return self.table("embeddings").select(
            (F.col("vec_id") % 5 + 1).cast("int").alias("place_id"),
            F.when(F.col("vec_id") % 3 == 0, "prior").otherwise("posterior").alias("source"),
            F.col("label").cast("int").alias("chain"),
            F.col("vec_id").cast("int").alias("iteration"),
            F.col("embedding").cast("array<double>").alias("z"),
        )

    @cached_property
    def draw_keys(self) -> DataFrame:
        return self.draw_records.select(*DRAW_KEYS)

    @cached_property
    def draws(self) -> DataFrame:
        return self.draw_records.select(
            *DRAW_KEYS, F.lit("z").alias("name"), F.posexplode("z").alias("_at", "value")
        ).select(*DRAW_KEYS, "name", (F.col("_at") + 1).alias("idx"), "value")

    @cached_property
    def parameters(self) -> DataFrame:
        """Standard-normal draws of the named parameters, positions 1 on."""
        names = F.array(*[F.lit(n) for n in PARAMETER_NAMES])
        return self.draw_records.select(
            *DRAW_KEYS,
            F.posexplode(F.slice("z", 1, len(PARAMETER_NAMES))).alias("_at", "value"),
        ).select(
            *DRAW_KEYS, F.element_at(names, F.col("_at") + 1).alias("name"), "value"
        )

    @cached_property
    def walk_steps(self) -> DataFrame:
        """Random-walk increments, from the positions after the parameters; some draws lack one."""
        every, lacking = MISSING_STEP
        known = (F.col("iteration") % every != 0) | (F.col("idx") != lacking)
        return self.draw_records.select(
            *DRAW_KEYS,
            F.posexplode(F.slice("z", len(PARAMETER_NAMES) + 1, STEPS)).alias("_at", "value"),
        ).select(*DRAW_KEYS, (F.col("_at") + 1).alias("idx"), (F.col("value") * 8).alias("value")).withColumn(
            "value", F.when(known, F.col("value"))
        )

    @cached_property
    def predictive_wide(self) -> DataFrame:
        """Predictive draws as their files have them: a row per draw, a column per stream and week."""
        names = [f"data_{s[0]}[{w}]" for s in STREAMS for w in range(1, WEEKS_PREDICTED + 1)]
        values = [F.floor(F.exp(F.element_at("z", i) * 4 + 3)).cast("double") for i in range(1, len(names) + 1)]
        return self.draw_records.select(*DRAW_KEYS, *[v.alias(n) for v, n in zip(values, names)])

    @cached_property
    def predictive(self) -> DataFrame:
        names = F.array(*[F.lit(s[0]) for s in STREAMS])
        at = self.draws
        zero = F.col("idx") - 1
        return at.select(
            *DRAW_KEYS,
            F.element_at(
                names, F.floor(zero / F.lit(WEEKS_PREDICTED)).cast("int") + 1
            ).alias("name"),
            (F.pmod(zero, F.lit(WEEKS_PREDICTED)) + 1).alias("idx"),
            F.floor(F.exp(F.col("value") * 4 + 3)).cast("double").alias("value"),
        )

    @cached_property
    def compartments(self) -> DataFrame:
        """Compartments of each draw and week; C and D accumulate. Some draws lack a week's census."""
        weeks = self.draw_records.select(
            *DRAW_KEYS, "z", F.explode(F.sequence(F.lit(0), F.lit(STATES - 1))).alias("t")
        )

        def level(x: Column) -> Column:
            return F.exp(x * 4 + 8)

        def at(position: int) -> Column:
            start = position * STATES + 1
            if COMPARTMENTS[position] in ("C", "D"):
                upto = F.slice("z", F.lit(start), F.col("t") + 1)
                return F.aggregate(upto, F.lit(0.0), lambda acc, x: acc + level(x))
            return level(F.element_at("z", F.col("t") + start))

        every, lacking = MISSING_CENSUS
        known = (F.col("iteration") % every != 0) | (F.col("t") != lacking)
        return weeks.select(
            *DRAW_KEYS, "t", *[at(i).alias(c) for i, c in enumerate(COMPARTMENTS)]
        ).withColumn("H", F.when(known, F.col("H")))

    @cached_property
    def shape_draws(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("stream"), "value")

    @cached_property
    def stream_draws(self) -> DataFrame:
        """(place_id, stream, value): shape draws under the places and streams they stand for.

        The first two places have none of deaths.
        """
        stream = F.coalesce(
            *[F.when(F.col("event_type") == e, F.lit(s)) for e, s in EVENT_STREAMS.items()]
        )
        places = F.array(*[F.lit(p) for p in PRIOR_PLACES])
        place = F.element_at(places, (F.col("user_id") % len(PRIOR_PLACES)).cast("int") + 1)
        return self.table("events").select(place.alias("place_id"), stream.alias("stream"), "value").where(
            F.col("stream").isNotNull() & ((F.col("stream") != "deaths") | (F.col("place_id") > PRIOR_PLACES[1]))
        )

    @cached_property
    def shares(self) -> DataFrame:
        return self.table("events").select(
            F.to_date("ts").alias("date"), F.col("event_type").alias("name"), "value"
        )

    @cached_property
    def scores(self) -> DataFrame:
        key = F.col("c_custkey")
        lp = (
            F.when(key % 7 == 0, F.lit(float("nan")))
            .when(key % 11 == 0, F.lit(float("-inf")))
            .otherwise(F.col("c_acctbal"))
        )
        return self.table("customer").select(
            F.col("c_nationkey").alias("place"), key.alias("seed"), lp.alias("lp")
        )
