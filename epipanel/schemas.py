"""Schemas of the stored tables."""

PLACE_FEED = (
    "area string, area_type string, population double, date date, "
    "cases double, deaths double, cumulative_deaths double"
)
CENSUS_FEED = (
    "county string, todays_date date, hospitalized_covid_confirmed_patients double, "
    "icu_covid_confirmed_patients double"
)
PLACE_REGION = "region string, place string"
PLACE_DIM = "id int, place string, population bigint"
INITIAL_VALUES = (
    "id int, place string, population bigint, H double, ICU double, D double, "
    "remaining_population double"
)
WEEKLY_PANEL = (
    "place string, time bigint, start_date date, end_date date, cases double, deaths double, "
    "est_cases double, est_deaths double, cumulative_deaths double, hospitalized double, icu double"
)
PRIORS = "name string, link string, mean double, sd double"
DISPERSIONS = "place_id int, stream string, mean double, sd double"
DRAWS = (
    "place_id int, source string, chain int, iteration int, name string, idx int, value double"
)
PACKED_DRAWS = (
    "place_id int, source string, chain int, iteration int, "
    "entries array<struct<name:string,idx:int,value:double>>"
)
PACKED_MODEL = (
    "place_id int, source string, chain int, iteration int, params map<string,double>, "
    "steps array<struct<idx:int,value:double>>, "
    "states array<struct<t:int,S:double,E:double,I:double,H:double,R:double,C:double,ICU:double,D:double>>"
)
INTERVALS = (
    "place string, name string, date date, width double, lower double, value double, upper double"
)
