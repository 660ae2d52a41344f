"""DuckDB statements that state each registered query over the given tables."""

from __future__ import annotations

import re

# Named parts; a statement pulls in the parts it names, and theirs.
PARTS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

KEYS = "place_id, source, chain, iteration"
WIDTHS = (0.5, 0.7, 0.9)

# ---------------------------------------------------------------- feeds

PARTS["daily_base"] = """
  SELECT n_name AS place, n_nationkey, o_orderstatus, o_orderpriority,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 84 AS d,
         DATE '2022-06-01'
           + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 84 AS INTEGER) AS date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

PARTS["fx_cases"] = """
  SELECT place, date, cases, deaths,
         CAST(SUM(deaths) OVER (PARTITION BY place ORDER BY date) AS DOUBLE) AS cumulative_deaths
  FROM (SELECT place, date, CAST(COUNT(*) AS DOUBLE) AS cases,
               CAST(COUNT(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS deaths
        FROM daily_base WHERE NOT (n_nationkey = 3 AND d % 17 = 5) GROUP BY place, date)"""

PARTS["fx_census"] = """
  SELECT place, date,
         CAST(COUNT(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS DOUBLE) AS hospitalized,
         CAST(COUNT(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) AS icu
  FROM daily_base WHERE NOT (n_nationkey = 7 AND d % 13 = 2) GROUP BY place, date"""

PARTS["fx_population"] = """
  SELECT n_name AS place, CAST(1000 * COUNT(*) + n_nationkey AS BIGINT) AS population
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey"""

PARTS["fx_region"] = """
  SELECT r_name AS region, n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey"""

PARTS["clean_feed"] = """
  SELECT place, population, date, cases, deaths, cumulative_deaths
  FROM (SELECT CASE WHEN c.place = 'NATION_24' THEN 'Unknown' ELSE c.place END AS place,
               CASE WHEN c.place = 'NATION_23' THEN 'State' ELSE 'County' END AS area_type,
               CAST(population AS DOUBLE) AS population, date, cases, deaths, cumulative_deaths
        FROM fx_cases c LEFT JOIN fx_population p ON c.place = p.place)
  WHERE area_type = 'County' AND place NOT IN ('Out of state', 'Unknown')"""
QUERIES["place_daily_clean"] = "SELECT * FROM clean_feed"
QUERIES["census_select"] = "SELECT place, date, hospitalized, icu FROM fx_census"
QUERIES["read_place_daily"] = QUERIES["place_daily_clean"]
QUERIES["read_census"] = QUERIES["census_select"]
QUERIES["scan_draw_dir"] = f"""
  SELECT {KEYS}, name, idx, value FROM draws WHERE NOT (place_id = 5 AND idx = 64)"""
QUERIES["draw_store"] = f"""
  SELECT {KEYS}, name, idx, value + CASE WHEN place_id = 2 THEN 1 ELSE 0 END AS value
  FROM predictive WHERE source = 'posterior'"""

PARTS["unfilled"] = """
  SELECT COALESCE(a.place, b.place) AS place, COALESCE(a.date, b.date) AS date,
         cases, deaths, cumulative_deaths, hospitalized, icu
  FROM fx_cases a FULL JOIN fx_census b ON a.place = b.place AND a.date = b.date"""
QUERIES["drop_incomplete"] = """
  SELECT * FROM unfilled
  WHERE cases IS NOT NULL AND deaths IS NOT NULL AND cumulative_deaths IS NOT NULL
    AND hospitalized IS NOT NULL AND icu IS NOT NULL"""

PARTS["full_dat"] = """
  SELECT place, date, cases, deaths, cumulative_deaths,
         COALESCE(hospitalized, 0.0) AS hospitalized, COALESCE(icu, 0.0) AS icu
  FROM unfilled"""
QUERIES["daily_full_join"] = "SELECT * FROM full_dat"
QUERIES["region_join"] = """
  SELECT c.place, date, cases, deaths, cumulative_deaths, region
  FROM clean_feed c LEFT JOIN fx_region r ON c.place = r.place"""

PARTS["latest"] = """
  SELECT MAX(date) AS latest_date
  FROM (SELECT date, SUM(hospitalized) AS n FROM full_dat GROUP BY date) WHERE n > 0"""
QUERIES["latest_active_date"] = "SELECT latest_date FROM latest"

PARTS["bounds"] = """
  SELECT latest_date,
         DATE '2022-06-01' + CAST(
           ((date_diff('day', DATE '2022-06-01', latest_date - 2) % 7) + 7) % 7 + 1 AS INTEGER
         ) AS first_date,
         latest_date - 2 AS last_date
  FROM latest"""
QUERIES["reporting_window"] = "SELECT latest_date, first_date, last_date FROM bounds"

PARTS["delays"] = """
  SELECT 'cases' AS stream, ABS(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 30 AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'deaths', ABS(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 45
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
PARTS["delay_counts"] = "SELECT stream, x, COUNT(*) AS n FROM delays GROUP BY stream, x"
PARTS["delay_totals"] = "SELECT stream, SUM(n) AS total FROM delay_counts GROUP BY stream"


def _share(stream: str, days: str) -> str:
    """Share of delays of at most ``days`` days, from the events themselves."""
    return (
        f"(SELECT CAST(COALESCE(SUM(n) FILTER (x <= {days}), 0) AS DOUBLE) / MAX(total)"
        f" FROM delay_counts JOIN delay_totals USING (stream) WHERE stream = '{stream}')"
    )


PARTS["ages"] = "SELECT CAST(range AS BIGINT) AS age FROM range(0, 4000)"
PARTS["age_shares"] = f"""
  SELECT age, {_share('cases', 'age')} AS f_cases, {_share('deaths', 'age + 4')} AS f_deaths FROM ages"""
QUERIES["ecdf_lookup"] = """
  SELECT place, date, CAST(date_diff('day', date, latest_date) AS INTEGER) AS days_ago,
         ROUND(f_cases, 9) AS f_cases, ROUND(f_deaths, 9) AS f_deaths
  FROM (SELECT place, CASE WHEN day(date) <> 13 THEN date END AS date, latest_date FROM fx_cases, latest)
  LEFT JOIN age_shares ON age = date_diff('day', date, latest_date)"""

PARTS["corrected"] = """
  SELECT f.*, CAST(age AS INTEGER) AS days_ago,
         f_cases AS cases_est_prop_reported, f_deaths AS death_est_prop_reported,
         CASE WHEN f_cases <> 0 THEN cases / f_cases END AS est_cases,
         CASE WHEN f_deaths <> 0 THEN deaths / f_deaths END AS est_deaths
  FROM full_dat f, bounds JOIN age_shares ON age = date_diff('day', date, latest_date)
  WHERE date BETWEEN first_date AND last_date"""
QUERIES["delay_correct"] = """
  SELECT place, date, cases, deaths, cumulative_deaths, hospitalized, icu, days_ago,
         ROUND(cases_est_prop_reported, 6) AS cases_est_prop_reported,
         ROUND(death_est_prop_reported, 6) AS death_est_prop_reported,
         ROUND(est_cases, 6) AS est_cases, ROUND(est_deaths, 6) AS est_deaths
  FROM corrected"""


def strict(c: str, alias: str | None = None) -> str:
    return f"CASE WHEN COUNT({c}) = COUNT(*) THEN SUM({c}) END AS {alias or c}"


QUERIES["sum_strict"] = f"""
  SELECT place, {strict('cases')}, {strict('deaths')}, {strict('hospitalized')}, {strict('icu')}
  FROM full_dat GROUP BY place"""
QUERIES["last_by_date"] = """
  SELECT place, arg_max_null(cumulative_deaths, date) AS cumulative_deaths,
         arg_max_null(hospitalized, date) AS hospitalized, arg_max_null(icu, date) AS icu
  FROM full_dat GROUP BY place"""

# ---------------------------------------------------------------- panel

PARTS["weekly"] = f"""
  SELECT place, time, MIN(date) AS start_date, MAX(date) AS end_date,
         {strict('cases')}, {strict('deaths')},
         CASE WHEN COUNT(est_cases) = COUNT(*) THEN round_even(SUM(est_cases), 0) END AS est_cases,
         CASE WHEN COUNT(est_deaths) = COUNT(*) THEN round_even(SUM(est_deaths), 0) END AS est_deaths,
         arg_max_null(cumulative_deaths, date) AS cumulative_deaths,
         arg_max_null(hospitalized, date) AS hospitalized, arg_max_null(icu, date) AS icu
  FROM (SELECT *, CAST(FLOOR(date_diff('day', (SELECT MIN(date) FROM corrected), date) / 7) AS BIGINT) AS time
        FROM corrected)
  GROUP BY place, time"""
_PANEL = "place, time, start_date, end_date, cases, deaths, est_cases, est_deaths, cumulative_deaths, hospitalized, icu"
QUERIES["weekly_panel"] = f"SELECT {_PANEL} FROM weekly"

_SUMS = ", ".join(
    strict(c) for c in
    ("cases", "deaths", "est_cases", "est_deaths", "cumulative_deaths", "hospitalized", "icu")
)
PARTS["rolled"] = f"""
  SELECT 'place' AS level, {_PANEL} FROM weekly
  UNION ALL BY NAME
  SELECT 'region' AS level, region AS place, time, start_date, end_date, {_SUMS}
  FROM weekly LEFT JOIN fx_region USING (place) GROUP BY region, time, start_date, end_date
  UNION ALL BY NAME
  SELECT 'state' AS level, 'Nations' AS place, time, start_date, end_date, {_SUMS}
  FROM weekly GROUP BY time, start_date, end_date"""
QUERIES["rollup_panel"] = f"SELECT level, {_PANEL} FROM rolled"
QUERIES["late_feed"] = QUERIES["rollup_panel"]
PARTS["panel"] = f"SELECT level, {_PANEL} FROM rolled WHERE time <> 0"

PARTS["dim"] = """
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY o, place) AS INTEGER) AS id,
         ['place', 'region', 'state'][o + 1] AS level, place, CAST(population AS BIGINT) AS population
  FROM (SELECT 0 AS o, place, population FROM fx_population
        UNION ALL
        SELECT 1, region, SUM(population) FROM fx_population LEFT JOIN fx_region USING (place) GROUP BY region
        UNION ALL
        SELECT 2, 'Nations', SUM(population) FROM fx_population)"""
QUERIES["place_dimension"] = "SELECT id, level, place, population FROM dim"

PARTS["init"] = """
  SELECT id, place, population, H, ICU, D, population - (H + ICU + D) AS remaining_population
  FROM (SELECT id, r.place, population, hospitalized + 1 AS H, icu + 1 AS ICU, cumulative_deaths + 1 AS D
        FROM (SELECT * FROM rolled WHERE time = 0
              QUALIFY ROW_NUMBER() OVER (PARTITION BY place ORDER BY start_date, end_date) = 1) r
        LEFT JOIN dim ON dim.place = r.place)"""
QUERIES["initial_values"] = "SELECT * FROM init"
QUERIES["filter_place"] = f"""
  SELECT level, {_PANEL} FROM panel WHERE place = (SELECT place FROM dim WHERE id = 3)"""

PARTS["types"] = """
  SELECT DISTINCT place,
         CASE WHEN place IN (SELECT place FROM fx_region) THEN 'county'
              WHEN place IN (SELECT region FROM fx_region) THEN 'region' ELSE 'state' END AS place_type
  FROM panel"""
QUERIES["place_type"] = "SELECT place, place_type FROM types"
# Title case as Spark's initcap has it: words are split at spaces only.
QUERIES["headline_text"] = """
  SELECT place,
         array_to_string(list_transform(string_split(place || ' ' || place_type, ' '),
           lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title,
         'Data Through ' || CAST((SELECT MAX(end_date) FROM panel) AS VARCHAR) AS subtitle
  FROM types"""
QUERIES["observed_long"] = """
  SELECT place, end_date AS date, 'new_cases' AS name, est_cases AS value FROM panel
  UNION ALL SELECT place, end_date, 'new_deaths', est_deaths FROM panel
  UNION ALL SELECT place, end_date, 'hospitalizations', hospitalized FROM panel
  UNION ALL SELECT place, end_date, 'icu', icu FROM panel"""

PARTS["calendar"] = """
  SELECT DISTINCT time, end_date AS date FROM panel
  UNION ALL
  SELECT 0, MIN(end_date) - 7 FROM panel
  UNION ALL
  SELECT m + k, h + CAST(7 * k AS INTEGER)
  FROM (SELECT MAX(time) AS m, MAX(end_date) AS h FROM panel), (SELECT range AS k FROM range(1, 13))"""
QUERIES["forecast_calendar"] = "SELECT CAST(time AS BIGINT) AS time, date FROM calendar"

PARTS["extended"] = """
  SELECT place, time, est_cases, est_deaths, hospitalized, icu FROM panel
  UNION ALL
  SELECT place, time + k, est_cases, est_deaths, hospitalized, icu
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY place ORDER BY start_date DESC, end_date DESC, time DESC) AS rn
        FROM panel) p, (SELECT range AS k FROM range(1, 13)) WHERE rn = 1"""
QUERIES["extend_horizon"] = "SELECT place, CAST(time AS BIGINT) AS time, est_cases, est_deaths, hospitalized, icu FROM extended"
QUERIES["mask_observations"] = """
  SELECT place, CAST(time AS BIGINT) AS time, CAST(NULL AS DOUBLE) AS est_cases, CAST(NULL AS DOUBLE) AS est_deaths,
         CAST(NULL AS DOUBLE) AS hospitalized, CAST(NULL AS DOUBLE) AS icu FROM extended"""

PARTS["series"] = """
  UNPIVOT (SELECT place, time, est_cases, est_deaths, hospitalized, icu FROM weekly)
  ON est_cases, est_deaths, hospitalized, icu INTO NAME name VALUE value"""
QUERIES["nb_dispersion"] = """
  SELECT place, name, ROUND(mu, 6) AS mu, ROUND(s2, 6) AS s2,
         ROUND(CASE WHEN s2 - mu > 0 THEN mu * mu / (s2 - mu) END, 6) AS phi
  FROM (SELECT place, name, AVG(m) AS mu, AVG((value - m) * (value - m)) AS s2
        FROM (SELECT *, AVG(value) OVER (PARTITION BY place, name ORDER BY time
                                         ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM series)
        GROUP BY place, name)"""

# Digamma and trigamma by their series at x + 8, shifted back.
_DIGAMMA = ("(LN({0} + 8) - 0.5 / ({0} + 8) - 1.0::DOUBLE / 12 / ({0} + 8)^2 + 1.0::DOUBLE / 120 / ({0} + 8)^4"
            " - 1.0::DOUBLE / 252 / ({0} + 8)^6 + 1.0::DOUBLE / 240 / ({0} + 8)^8 - 1.0::DOUBLE / 132 / ({0} + 8)^10"
            + "".join(f" - 1.0::DOUBLE / ({{0}} + {i})" for i in range(8)) + ")")
_TRIGAMMA = ("(1.0::DOUBLE / ({0} + 8) + 0.5 / ({0} + 8)^2 + 1.0::DOUBLE / 6 / ({0} + 8)^3 - 1.0::DOUBLE / 30 / ({0} + 8)^5"
             " + 1.0::DOUBLE / 42 / ({0} + 8)^7 - 1.0::DOUBLE / 30 / ({0} + 8)^9 + 5.0::DOUBLE / 66 / ({0} + 8)^11"
             + "".join(f" + 1.0::DOUBLE / ({{0}} + {i})^2" for i in range(8)) + ")")
_FIRST = f"{_DIGAMMA.format('(k + phi)')} - {_DIGAMMA.format('phi')} + LN(phi) + 1 - LN(phi + m) - (k + phi) / (phi + m)"
_SECOND = f"{_TRIGAMMA.format('(k + phi)')} - {_TRIGAMMA.format('phi')} + 1 / phi - 2 / (phi + m) + (k + phi) / (phi + m)^2"
PARTS["smoothed"] = """
  SELECT place, name, value AS k, m
  FROM (SELECT *, AVG(value) OVER (PARTITION BY place, name ORDER BY time
                                   ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM series) WHERE m > 0"""
QUERIES["nb_dispersion_ml"] = f"""
  WITH RECURSIVE newton(place, name, turn, phi) AS (
    SELECT place, name, 0, CASE WHEN s2 - mu > 0 THEN LEAST(mu * mu / (s2 - mu), 1e6) ELSE 1e3 END
    FROM (SELECT place, name, AVG(m) AS mu, AVG((k - m) * (k - m)) AS s2 FROM smoothed GROUP BY place, name)
    UNION ALL
    SELECT place, name, turn + 1,
           phi * EXP(LEAST(GREATEST(CASE WHEN phi * phi * b + phi * a < 0 THEN -phi * a / (phi * phi * b + phi * a)
                                         ELSE SIGN(a) * 1.5 END, -1.5), 1.5))
    FROM (SELECT place, name, turn, phi, SUM({_FIRST}) AS a, SUM({_SECOND}) AS b
          FROM newton JOIN smoothed USING (place, name) WHERE turn < 30 GROUP BY place, name, turn, phi))
  SELECT place, name, n, ROUND(mu, 6) AS mu, CASE WHEN rises > 0 THEN ROUND(phi, 4) END AS phi,
         CASE WHEN rises > 0 THEN ROUND(ll, 4) END AS log_likelihood
  FROM (SELECT place, name, phi, COUNT(*) AS n, AVG(m) AS mu, SUM((k - m) * (k - m) - k) AS rises,
               SUM(LGAMMA(k + phi) - LGAMMA(phi) - LGAMMA(k + 1) + phi * LN(phi / (phi + m)) + k * LN(m / (phi + m))) AS ll
        FROM newton JOIN smoothed USING (place, name) WHERE turn = 30 GROUP BY place, name, phi)"""
QUERIES["place_dictionary"] = """
  WITH first AS (SELECT * FROM fx_population WHERE population % 2 = 0),
  known AS (
    SELECT ROW_NUMBER() OVER (ORDER BY o, place) AS id, o, place
    FROM (SELECT 0 AS o, place FROM first
          UNION ALL SELECT DISTINCT 1, region FROM first LEFT JOIN fx_region USING (place)
          UNION ALL SELECT DISTINCT 2, 'Nations' FROM first)),
  added AS (
    SELECT ROW_NUMBER() OVER (ORDER BY o, place) + (SELECT MAX(id) FROM known) AS id, o, place
    FROM (SELECT CASE level WHEN 'place' THEN 0 WHEN 'region' THEN 1 ELSE 2 END AS o, place FROM dim) a
    ANTI JOIN known USING (o, place))
  SELECT CAST(id AS INTEGER) AS id, ['place', 'region', 'state'][o + 1] AS level, place
  FROM (SELECT * FROM known UNION ALL SELECT * FROM added)"""
QUERIES["read_dims"] = """
  SELECT place, dim.id, dim.population, region, H, ICU, D, remaining_population
  FROM dim LEFT JOIN fx_region USING (place) LEFT JOIN init USING (place)"""
QUERIES["write_report"] = f"SELECT {_PANEL} FROM panel"

# ---------------------------------------------------------------- draws

PARTS["records"] = """
  SELECT CAST(vec_id % 5 + 1 AS INTEGER) AS place_id,
         CASE WHEN vec_id % 3 = 0 THEN 'prior' ELSE 'posterior' END AS source,
         label AS chain, CAST(vec_id AS INTEGER) AS iteration, CAST(embedding AS DOUBLE[]) AS z
  FROM embeddings"""
PARTS["draws"] = f"""
  SELECT {KEYS}, 'z' AS name, CAST(i AS INTEGER) AS idx, z[i] AS value
  FROM (SELECT *, UNNEST(range(1, len(z) + 1)) AS i FROM records)"""
QUERIES["draws_by_place"] = f"""
  SELECT {KEYS}, name, idx, value, place FROM draws LEFT JOIN dim ON dim.id = place_id"""
QUERIES["wide_to_long"] = f"SELECT {KEYS}, 'z[' || idx || ']' AS name, value FROM draws"
QUERIES["long_to_wide"] = f"SELECT {KEYS}, " + ", ".join(
    f'MAX(value) FILTER (idx = {i}) AS "z_{i}"' for i in range(1, 65)
) + f" FROM draws GROUP BY {KEYS}"

PARAMETERS = (
    "R₀_init", "σ_R₀", "case_detection_rate", "dur_latent", "dur_infectious", "IHR",
    "dur_hospitalized", "dur_waning", "dur_icu", "HICUR", "ICUDR", "death_detection_rate",
    "E_init_prop", "I_init_prop", "R_init_prop", "ϕ_cases", "ϕ_hosp", "ϕ_icu", "ϕ_deaths",
)
PARTS["parameters"] = f"""
  SELECT {KEYS}, {list(PARAMETERS)!r}[idx] AS name, value FROM draws WHERE idx <= {len(PARAMETERS)}"""
PARTS["steps"] = f"""
  SELECT {KEYS}, idx - {len(PARAMETERS)} AS idx,
         CASE WHEN iteration % 89 <> 0 OR idx <> {len(PARAMETERS) + 3} THEN value * 8 END AS value
  FROM draws WHERE idx BETWEEN {len(PARAMETERS) + 1} AND {len(PARAMETERS) + 6}"""
PARTS["predictive"] = f"""
  SELECT {KEYS}, ['new_cases', 'new_deaths', 'hospitalizations', 'icu'][(idx - 1) // 16 + 1] AS name,
         CAST((idx - 1) % 16 + 1 AS INTEGER) AS idx, CAST(FLOOR(EXP(value * 4 + 3)) AS DOUBLE) AS value
  FROM draws"""
QUERIES["parse_indexed_name"] = f"""
  SELECT {KEYS}, name, idx, value FROM predictive
  UNION ALL SELECT {KEYS}, name, CAST(NULL AS INTEGER), value FROM parameters"""
QUERIES["flatten_record"] = f"""
  SELECT {KEYS}, CASE WHEN idx = 1 THEN 'first' WHEN idx <= 32 THEN 'head' ELSE 'tail' END AS name,
         CAST(CASE WHEN idx = 1 THEN NULL WHEN idx <= 32 THEN idx - 1 ELSE idx - 32 END AS INTEGER) AS idx, value
  FROM draws"""
QUERIES["reorder_vars"] = f"SELECT {KEYS}, name, idx, value, CAST(65 - idx AS INTEGER) AS pos FROM draws"
QUERIES["refresh_results"] = f"SELECT {KEYS}, name, idx, value FROM draws WHERE source = 'posterior'"
PARTS["chained"] = """
  SELECT place_id, source, chain + 1 AS chain, iteration, name, idx, value
  FROM draws WHERE chain < 2 OR (chain = 2 AND idx < 64)"""
QUERIES["stack_chains"] = f"SELECT {KEYS}, name, idx, value FROM chained"
QUERIES["names_missing_in_chains"] = """
  SELECT name, idx, COUNT(DISTINCT chain) AS n_chains FROM chained GROUP BY name, idx
  HAVING COUNT(DISTINCT chain) < (SELECT COUNT(DISTINCT chain) FROM chained)"""
QUERIES["new_param_names"] = """
  SELECT DISTINCT name, idx FROM draws
  EXCEPT SELECT DISTINCT name, idx FROM draws WHERE idx <= 52"""
QUERIES["pad_params_zeros"] = f"""
  SELECT {KEYS}, name, idx, value FROM draws WHERE idx <= 52
  UNION ALL
  SELECT {KEYS}, 'z', CAST(i AS INTEGER), 0.0::DOUBLE
  FROM (SELECT DISTINCT {KEYS} FROM draws), (SELECT range AS i FROM range(53, 65))"""
def _uniform(stream: int) -> str:
    told = f"concat_ws('|', place_id, source, chain, iteration, 'z', i, 1, {stream})"
    return f"(CAST(CAST('0x' || substr(md5({told}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"


QUERIES["pad_params_randn"] = f"""
  SELECT {KEYS}, name, idx, ROUND(value, 6) AS value FROM draws WHERE idx <= 52
  UNION ALL
  SELECT {KEYS}, 'z', CAST(i AS INTEGER), ROUND(SQRT(-2 * LN({_uniform(0)})) * COS(2 * PI() * {_uniform(1)}), 6)
  FROM (SELECT DISTINCT {KEYS} FROM draws), (SELECT range AS i FROM range(53, 65))"""
QUERIES["truncate_chains"] = f"""
  WITH marked AS (
    SELECT {KEYS}, iteration % 4 <> 0 AND NOT (place_id = 5 AND chain = 3) AS keep FROM records),
  counted AS (
    SELECT *, COUNT(*) FILTER (keep) OVER (PARTITION BY place_id, source, chain) AS n FROM marked),
  bounded AS (SELECT *, MIN(n) OVER (PARTITION BY place_id, source) AS shortest FROM counted)
  SELECT {KEYS}, CAST(position AS BIGINT) AS position
  FROM (SELECT {KEYS}, shortest,
               ROW_NUMBER() OVER (PARTITION BY place_id, source, chain ORDER BY iteration) AS position
        FROM bounded WHERE keep)
  WHERE position <= shortest"""


def summary(table: str, digits: int | None = None) -> str:
    """Median and intervals of a table of draws, one row per width."""
    def shown(p: float) -> str:
        q = f"quantile_cont(value, {p!r})"
        return f"ROUND({q}, {digits})" if digits is not None else q

    return " UNION ALL ".join(
        f"SELECT place_id, source, name, idx, {w!r}::DOUBLE AS width, {shown((1 - w) / 2)} AS lower,"
        f" {shown(0.5)} AS value, {shown(1 - (1 - w) / 2)} AS upper"
        f" FROM {table} GROUP BY place_id, source, name, idx"
        for w in WIDTHS
    )


QUERIES["median_qi"] = summary("draws", 6)
PARTS["running"] = f"""
  SELECT {KEYS}, 'cumulative_deaths' AS name, idx,
         SUM(value) OVER (PARTITION BY {KEYS} ORDER BY idx) AS value
  FROM predictive WHERE name = 'new_deaths'"""
QUERIES["cumulative_intervals"] = summary("running", 6)
PARTS["predictive_all"] = f"""
  SELECT {KEYS}, name, idx, value FROM predictive UNION ALL SELECT {KEYS}, name, idx, value FROM running"""
PARTS["predictive_summary"] = f"""
  SELECT s.* EXCLUDE (idx), date FROM ({summary('predictive_all')}) s LEFT JOIN calendar ON time = idx"""
_INTERVAL = "place_id, source, name, width, date, ROUND(lower, {0}) AS lower, ROUND(value, {0}) AS value, ROUND(upper, {0}) AS upper"
QUERIES["predictive_intervals"] = f"SELECT {_INTERVAL.format(6)} FROM predictive_summary"
QUERIES["stack_sources"] = f"""
  SELECT * EXCLUDE (source), source AS distribution FROM (SELECT {_INTERVAL.format(6)} FROM predictive_summary)"""

# ---------------------------------------------------------------- draw-table algebra

PARTS["stream_moments"] = """
  SELECT place_id, stream, AVG(LN(value)) AS mean, STDDEV_SAMP(LN(value)) AS sd
  FROM (SELECT CAST([1, 2, 27, 31][user_id % 4 + 1] AS INTEGER) AS place_id,
               CASE event_type WHEN 'click' THEN 'cases' WHEN 'view' THEN 'cases' WHEN 'error' THEN 'hospitalized'
                               WHEN 'purchase' THEN 'icu' WHEN 'signup' THEN 'deaths' END AS stream, value
        FROM events WHERE value > 0)
  WHERE stream IS NOT NULL AND (stream <> 'deaths' OR place_id > 2) GROUP BY place_id, stream"""
PARTS["ladder"] = """
  SELECT id AS place_id, 0 AS rank, level, id AS from_id FROM dim
  UNION ALL
  SELECT p.id, 1, 'region', r.id
  FROM dim p JOIN fx_region k ON p.place = k.place JOIN dim r ON r.level = 'region' AND r.place = k.region
  WHERE p.level = 'place'
  UNION ALL
  SELECT p.id, 2, 'state', s.id FROM dim p JOIN dim s ON s.level = 'state' WHERE p.level <> 'state'"""
PARTS["fitted"] = """
  SELECT l.place_id, CASE stream WHEN 'cases' THEN 'ϕ_cases' WHEN 'hospitalized' THEN 'ϕ_hosp'
                                 WHEN 'icu' THEN 'ϕ_icu' ELSE 'ϕ_deaths' END AS name, mean, sd, level
  FROM ladder l JOIN stream_moments m ON m.place_id = l.from_id
  WHERE mean IS NOT NULL AND sd IS NOT NULL
  QUALIFY ROW_NUMBER() OVER (PARTITION BY l.place_id, stream ORDER BY rank) = 1"""
PARTS["priors"] = """
  SELECT id AS place_id, name, link, mean, sd, 'fixed' AS level FROM dim, (VALUES
    ('R₀_init', 'exp', 0.2::DOUBLE, 0.2::DOUBLE),
    ('σ_R₀', 'exp', -3.0, 0.2),
    ('case_detection_rate', 'logistic', -2.9, 0.3),
    ('dur_latent', 'exp', -1.5, 0.25),
    ('dur_infectious', 'exp', LN(5.0::DOUBLE / 7.0), 0.25),
    ('IHR', 'logistic', -4.3, 0.25),
    ('dur_hospitalized', 'exp', -1.54, 0.1),
    ('dur_waning', 'exp', LN(12.0::DOUBLE), 0.1),
    ('dur_icu', 'exp', LN(0.31::DOUBLE), 0.1),
    ('HICUR', 'logistic', -1.69, 0.2),
    ('ICUDR', 'logistic', -1.59, 0.2),
    ('death_detection_rate', 'logistic', 2.3, 0.2),
    ('E_init_prop', 'logistic', -LN(1 / 0.002::DOUBLE - 1), 0.4),
    ('I_init_prop', 'logistic', -LN(1 / 0.0075::DOUBLE - 1), 0.6),
    ('R_init_prop', 'logistic', -LN(1 / 0.1::DOUBLE - 1), 0.5)) t(name, link, mean, sd)
  UNION ALL
  SELECT place_id, name, 'exp', mean, sd, level FROM fitted"""
PARTS["centred"] = f"""
  SELECT {KEYS}, p.name,
         CASE WHEN link = 'logistic' THEN 1 / (1 + EXP(-(value * sd + mean)))
              WHEN p.name LIKE 'ϕ%' THEN LEAST(GREATEST(EXP(value * sd + mean), 1e-10), 1e10)
              ELSE EXP(value * sd + mean) END AS value
  FROM parameters p JOIN priors USING (place_id, name)"""
QUERIES["centre_params"] = f"SELECT {KEYS}, name, ROUND(value, 6) AS value FROM centred"
PARTS["params"] = f"""
  SELECT *, 1 / dur_latent AS "γ", 1 / dur_infectious AS "ν", 1 / dur_hospitalized AS "η",
         1 / dur_waning AS "κ", 1 / dur_icu AS "ω",
         dur_latent * 7 AS dur_latent_days, dur_infectious * 7 AS dur_infectious_days,
         dur_hospitalized * 7 AS dur_hospitalized_days, dur_waning * 7 AS dur_waning_days,
         dur_icu * 7 AS dur_icu_days
  FROM (SELECT {KEYS}, {", ".join(f"MAX(value) FILTER (name = '{n}') AS " + chr(34) + n + chr(34) for n in PARAMETERS)}
        FROM centred GROUP BY {KEYS})"""
_DAYS = ("dur_latent_days", "dur_infectious_days", "dur_hospitalized_days", "dur_waning_days", "dur_icu_days")
_RATES = ("γ", "ν", "η", "κ", "ω")


def rounded(names, digits: int) -> str:
    return ", ".join(f'ROUND("{n}", {digits}) AS "{n}"' for n in names)


QUERIES["rates_and_days"] = f"SELECT {KEYS}, {rounded((*_RATES, *_DAYS), 6)} FROM params"

_COMPARTMENTS = ("S", "E", "I", "H", "R", "C", "ICU", "D")


def _level(k: int, c: str) -> str:
    if c in ("C", "D"):
        return f'list_sum(list_transform(z[{k * 8 + 1}:{k * 8 + 1} + t], lambda x: EXP(x * 4 + 8))) AS "{c}"'
    known = "CASE WHEN iteration % 97 <> 0 OR t <> 5 THEN {} END" if c == "H" else "{}"
    return known.format(f"EXP(z[{k * 8 + 1} + t] * 4 + 8)") + f' AS "{c}"'


PARTS["states"] = f"""
  SELECT {KEYS}, CAST(t AS INTEGER) AS t, {", ".join(_level(k, c) for k, c in enumerate(_COMPARTMENTS))}
  FROM (SELECT *, UNNEST(range(0, 8)) AS t FROM records)"""
PARTS["walk"] = f"""
  SELECT {KEYS}, CAST(s.idx + 1 AS INTEGER) AS idx,
         EXP(LN("R₀_init") + total * "σ_R₀") AS "R₀_t", EXP(LN("R₀_init") + total * "σ_R₀") * "ν" AS "β_t"
  FROM (SELECT {KEYS}, idx, CASE WHEN COUNT(value) OVER w = COUNT(*) OVER w THEN SUM(value) OVER w END AS total
        FROM (SELECT * FROM steps UNION ALL SELECT {KEYS}, 0, 0.0 FROM records)
        WINDOW w AS (PARTITION BY {KEYS} ORDER BY idx)) s
  JOIN params USING ({KEYS})"""
QUERIES["log_random_walk"] = f"SELECT {KEYS}, idx, {rounded(('R₀_t', 'β_t'), 6)} FROM walk"
PARTS["initial_states"] = f"""
  SELECT {KEYS}, GREATEST(1.0, remaining_population - (E + I + R)) AS "S", E, I, H, R, 1.0::DOUBLE AS "C", ICU, D
  FROM (SELECT {KEYS}, remaining_population, H, ICU, D, E_init_prop * population AS "E",
               I_init_prop * population AS "I", R_init_prop * population AS "R"
        FROM params JOIN init ON init.id = place_id)"""
QUERIES["initial_compartments"] = f"""
  SELECT {KEYS}, {rounded(_COMPARTMENTS, 5)},
         {", ".join(f'ROUND(LN("{c}"), 5) AS "log_{c}"' for c in _COMPARTMENTS)}
  FROM initial_states"""
PARTS["new_counts"] = f"""
  SELECT * FROM (SELECT {KEYS}, t, H, ICU,
    C - LAG(C) OVER (PARTITION BY {KEYS} ORDER BY t) AS "new_C",
    D - LAG(D) OVER (PARTITION BY {KEYS} ORDER BY t) AS "new_D" FROM states) WHERE t > 0"""
QUERIES["increments"] = f"""SELECT {KEYS}, t, {rounded(('new_C', 'new_D'), 5)} FROM new_counts"""
PARTS["means"] = f"""
  SELECT {KEYS}, t,
         CASE WHEN H IS NOT NULL THEN LEAST(GREATEST(H, 1e-4), population) END AS hospitalizations_mean,
         LEAST(GREATEST("new_C" * case_detection_rate, 1e-4), population) AS new_cases_mean,
         CASE WHEN ICU IS NOT NULL THEN LEAST(GREATEST(ICU, 1e-4), population) END AS icu_mean,
         LEAST(GREATEST("new_D" * death_detection_rate, 1e-4), population) AS new_deaths_mean
  FROM new_counts JOIN params USING ({KEYS}) JOIN dim ON dim.id = place_id"""
_MEANS = ("hospitalizations_mean", "new_cases_mean", "icu_mean", "new_deaths_mean")
QUERIES["expected_observations"] = f"SELECT {KEYS}, t, {rounded(_MEANS, 5)} FROM means"
PARTS["effective"] = f"""
  SELECT {KEYS}, idx, "R₀_t", "β_t", "R₀_t" * S / population AS "Rₜ_t"
  FROM walk JOIN (SELECT {KEYS}, t + 1 AS idx, S FROM states) USING ({KEYS}, idx) JOIN dim ON dim.id = place_id"""
QUERIES["effective_r"] = f"SELECT {KEYS}, idx, {rounded(('R₀_t', 'β_t', 'Rₜ_t'), 6)} FROM effective"
PARTS["beta"] = f"""
  SELECT {KEYS}, t, "β_t" AS "β" FROM (SELECT {KEYS}, t FROM states) s
  ASOF JOIN (SELECT {", ".join(f"{k} AS {k}" for k in KEYS.split(", "))}, idx - 1 AS at, "β_t" FROM walk) w
  ON {" AND ".join(f"s.{k} = w.{k}" for k in KEYS.split(", "))} AND s.t >= w.at"""
PARTS["beta"] = PARTS["beta"].replace(f"SELECT {KEYS}, t, \"β_t\"", "SELECT " + ", ".join(f"s.{k}" for k in KEYS.split(", ")) + ", s.t, \"β_t\"")
QUERIES["step_param_lookup"] = f"""SELECT {KEYS}, t, ROUND("β", 6) AS value FROM beta"""
_FLOWS = {
    "infection": '"β" * I * S / "N"',
    "progression": '"γ" * E',
    "hospitalization": '"ν" * IHR * I',
    "non_hospitalized_recovery": '"ν" * (1 - IHR) * I',
    "icu_admission": '"η" * HICUR * H',
    "hospitalized_recovery": '"η" * (1 - HICUR) * H',
    "icu_death": '"ω" * ICUDR * ICU',
    "icu_recovery": '"ω" * (1 - ICUDR) * ICU',
    "waned_immunity": '"κ" * R',
}
QUERIES["transition_flows"] = f"""
  SELECT {KEYS}, t, ROUND("N", 4) AS "N", {rounded(_FLOWS, 4)}
  FROM (SELECT *, {", ".join(f"{e} AS {n}" for n, e in _FLOWS.items())}
        FROM (SELECT *, S + E + I + H + R + ICU + D AS "N"
              FROM states JOIN beta USING ({KEYS}, t) JOIN params USING ({KEYS})))"""
_STREAMS = (
    ("new_cases", "est_cases", "ϕ_cases"), ("new_deaths", "est_deaths", "ϕ_deaths"),
    ("hospitalizations", "hospitalized", "ϕ_hosp"), ("icu", "icu", "ϕ_icu"),
)
PARTS["stream_means"] = " UNION ALL ".join(
    f"""SELECT {KEYS}, t, '{s}' AS stream, {s}_mean AS mu, "{phi}" AS phi FROM means JOIN params USING ({KEYS})"""
    for s, _, phi in _STREAMS
)
QUERIES["nb_params"] = f"""
  SELECT {KEYS}, t, stream, ROUND(mu, 5) AS mu, ROUND(phi, 5) AS phi, ROUND(1 / (1 + mu / phi), 5) AS p,
         ROUND(phi, 5) AS r, ROUND(mu + mu * mu / phi, 2) AS variance
  FROM stream_means"""
PARTS["observed"] = " UNION ALL ".join(
    f"SELECT id AS place_id, '{s}' AS stream, time AS t, {c} AS k FROM panel JOIN dim USING (place)"
    for s, c, _ in _STREAMS
)
QUERIES["nb_loglik"] = f"""
  SELECT {KEYS}, CASE WHEN COUNT(ll) = COUNT(*) THEN ROUND(SUM(ll), 4) END AS log_likelihood, COUNT(*) AS n_observed
  FROM (SELECT *, LGAMMA(k + phi) - LGAMMA(phi) - LGAMMA(k + 1)
                  + phi * LN(phi / (phi + mu)) + k * LN(mu / (phi + mu)) AS ll
        FROM stream_means JOIN observed USING (place_id, stream, t) WHERE k IS NOT NULL)
  GROUP BY {KEYS}"""

PARTS["generated"] = f"""
  SELECT {KEYS}, name, CAST(NULL AS INTEGER) AS idx, value FROM (
    UNPIVOT (SELECT {KEYS}, "σ_R₀", IHR, HICUR, ICUDR, case_detection_rate, death_detection_rate,
                    "ϕ_hosp", "ϕ_icu", "ϕ_cases", "ϕ_deaths", {", ".join(_DAYS)} FROM params)
    ON COLUMNS(* EXCLUDE ({KEYS})) INTO NAME name VALUE value)
  UNION ALL
  SELECT {KEYS}, name, idx, value FROM (
    UNPIVOT effective ON "β_t", "R₀_t", "Rₜ_t" INTO NAME name VALUE value)
  UNION ALL
  SELECT {KEYS}, name, t + 1, value FROM (UNPIVOT states ON S, E, I, H, R, C, ICU, D INTO NAME name VALUE value)
  UNION ALL
  SELECT {KEYS}, name, t, value FROM (UNPIVOT means ON {", ".join(_MEANS)} INTO NAME name VALUE value)"""
PARTS["gq_summary"] = f"""
  SELECT s.* EXCLUDE (idx), date FROM ({summary('generated')}) s
  LEFT JOIN calendar ON time = CASE WHEN s.name LIKE '%\\_mean' ESCAPE '\\' THEN s.idx ELSE s.idx - 1 END"""
QUERIES["gq_intervals"] = f"SELECT {_INTERVAL.format(5)} FROM gq_summary"
QUERIES["split_scalar_vector"] = f"""
  SELECT *, CASE WHEN date IS NULL THEN 'scalar' ELSE 'vector' END AS kind
  FROM (SELECT {_INTERVAL.format(5)} FROM gq_summary)"""
QUERIES["relabel_names"] = f"""
  SELECT * REPLACE (CASE name WHEN 'σ_R₀' THEN 'sigma_R0' WHEN 'ϕ_cases' THEN 'phi_cases'
    WHEN 'ϕ_deaths' THEN 'phi_deaths' WHEN 'ϕ_hosp' THEN 'phi_hosp' WHEN 'ϕ_icu' THEN 'phi_icu'
    WHEN 'R₀_t' THEN 'R0_t' WHEN 'Rₜ_t' THEN 'Rt_t' WHEN 'β_t' THEN 'beta_t' ELSE name END AS name)
  FROM (SELECT {_INTERVAL.format(5)} FROM gq_summary)"""

PARTS["ninety"] = """
  SELECT place_id, source, name, date, 0.5::DOUBLE AS quantile, value FROM predictive_summary WHERE width = 0.9
  UNION ALL SELECT place_id, source, name, date, 0.05, lower FROM predictive_summary WHERE width = 0.9
  UNION ALL SELECT place_id, source, name, date, 0.95, upper FROM predictive_summary WHERE width = 0.9"""
QUERIES["interval_to_quantile"] = "SELECT place_id, source, name, date, quantile, ROUND(value, 6) AS value FROM ninety"
PARTS["rt_rows"] = """
  SELECT place_id, date, 0.5::DOUBLE AS quantile, value AS "Rt" FROM rt_ninety
  UNION ALL SELECT place_id, date, 0.05, lower FROM rt_ninety
  UNION ALL SELECT place_id, date, 0.95, upper FROM rt_ninety"""
PARTS["rt_ninety"] = """
  SELECT * FROM gq_summary WHERE width = 0.9 AND name = 'Rₜ_t' AND source = 'posterior' AND date IS NOT NULL"""
QUERIES["forecast_export"] = """
  SELECT dim.place, w.date, w.quantile, ROUND(hosp, 5) AS hosp_census_with_covid, ROUND(icu_n, 5) AS icu,
         ROUND(cases, 5) AS cases, ROUND(deaths, 5) AS deaths,
         ROUND(cumulative + D, 5) AS cumulative_deaths, ROUND("Rt", 5) AS "Rt"
  FROM (SELECT place_id, date, quantile,
               MAX(value) FILTER (name = 'hospitalizations') AS hosp, MAX(value) FILTER (name = 'icu') AS icu_n,
               MAX(value) FILTER (name = 'new_cases') AS cases, MAX(value) FILTER (name = 'new_deaths') AS deaths,
               MAX(value) FILTER (name = 'cumulative_deaths') AS cumulative
        FROM ninety WHERE source = 'posterior' GROUP BY place_id, date, quantile) w
  JOIN dim ON dim.id = w.place_id LEFT JOIN init ON init.place = dim.place
  LEFT JOIN rt_rows r ON r.place_id = w.place_id AND r.date = w.date AND r.quantile = w.quantile"""

_VARIANTS = ("D", "E", "H", "I", "ICU", "R")
PARTS["variant_sums"] = f"""
  SELECT place_id, DATE '2022-05-25' + 7 * t AS date,
         {", ".join(f"SUM({c}) FILTER (source = 'prior') AS {c}_non_omicron, SUM({c}) FILTER (source <> 'prior') AS {c}_omicron" for c in _VARIANTS)},
         SUM(S) FILTER (source = 'prior') AS "S_both", SUM(S) FILTER (source <> 'prior') AS "S_omicron_only"
  FROM states GROUP BY place_id, t"""
PARTS["variant_totals"] = """
  SELECT place_id, date, E_non_omicron, E_omicron, I_non_omicron, I_omicron, R_non_omicron, R_omicron,
         "S_both", "S_omicron_only", E_non_omicron + E_omicron AS "E_total",
         I_non_omicron + I_omicron AS "I_total", "S_both" + "S_omicron_only" AS "S_total"
  FROM variant_sums WHERE date >= DATE '2022-06-01'"""
QUERIES["derive_totals_long"] = """
  SELECT place_id, date, name, ROUND(value, 4) AS value FROM (
    UNPIVOT variant_totals ON COLUMNS(* EXCLUDE (place_id, date)) INTO NAME name VALUE value)"""
QUERIES["link_functions"] = f"""
  SELECT {KEYS}, idx, ROUND(p, 6) AS logistic, ROUND(-LN(1 / p - 1), 6) AS logit, ROUND(EXP(value), 6) AS exp,
         ROUND(LN(EXP(value)), 6) AS log, ROUND(LEAST(GREATEST(value, -0.1), 0.1), 6) AS clamped
  FROM (SELECT *, 1 / (1 + EXP(-value)) AS p FROM draws)"""

# ---------------------------------------------------------------- priors and the rest

QUERIES["log_moments"] = """
  SELECT event_type AS stream, ROUND(AVG(LN(value)), 6) AS mean, ROUND(STDDEV_SAMP(LN(value)), 6) AS sd
  FROM events WHERE value > 0 GROUP BY event_type"""
QUERIES["dispersion_pivot"] = "SELECT place_id, " + ", ".join(
    f"""ROUND(MAX({c}) FILTER (stream = '{s}'), 6) AS "{n}_{c}\""""
    for s, n in (("cases", "ϕ_cases"), ("hospitalized", "ϕ_hosp"), ("icu", "ϕ_icu"), ("deaths", "ϕ_deaths"))
    for c in ("mean", "sd")
) + " FROM stream_moments GROUP BY place_id"
QUERIES["prior_quantiles"] = """
  SELECT place_id, level, name, prob, ROUND(v, 6) AS value, ROUND(1 / v, 6) AS reciprocal
  FROM (SELECT place_id, level, name, prob, CASE WHEN link = 'exp' THEN EXP(mean + q * sd) ELSE 1 / (1 + EXP(-(mean + q * sd))) END AS v
        FROM priors, (VALUES (0.05::DOUBLE, -1.6448536269514722::DOUBLE), (0.5, 0.0), (0.95, 1.6448536269514722)) t(prob, q))"""
PARTS["induced"] = f"""
  SELECT {KEYS}, IHR * HICUR * ICUDR AS "IFR",
         remaining_population / population - (E_init_prop + I_init_prop + R_init_prop) AS "S_prop"
  FROM params JOIN init ON init.id = place_id"""
QUERIES["induced_quantiles"] = " UNION ALL ".join(
    f"""SELECT place_id, source, '{n}' AS name, {p}::DOUBLE AS prob, ROUND(quantile_cont("{n}", {p}), 8) AS value
        FROM induced GROUP BY place_id, source"""
    for n in ("IFR", "S_prop") for p in (0.05, 0.5, 0.95)
)
QUERIES["top_n_finite"] = """
  SELECT place, seed, lp, CAST(rn AS INTEGER) AS rank
  FROM (SELECT c_nationkey AS place, c_custkey AS seed, c_acctbal AS lp,
               ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn
        FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0) WHERE rn <= 3"""
QUERIES["share_within_date"] = """
  SELECT date, name, ROUND(n, 6) AS n, ROUND(n / SUM(n) OVER (PARTITION BY date), 6) AS prop
  FROM (SELECT CAST(ts AS DATE) AS date, event_type AS name, SUM(value) AS n FROM events GROUP BY 1, 2)"""


def _assemble(body: str) -> str:
    """The statement with every part it needs, each part once, in order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_]+\b", text)):
            if word in PARTS and word not in ordered:
                need(PARTS[word])
                if word not in ordered:
                    ordered.append(word)

    need(body)
    parts = [f"{name} AS ({PARTS[name]})" for name in ordered]
    body = body.strip()
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return opening + ",\n".join([*parts, body.removeprefix(opening)])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


STATEMENTS = {name: _assemble(body) for name, body in QUERIES.items()}
