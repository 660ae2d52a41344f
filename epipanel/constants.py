"""Fixed values of the forecasting model and its reports."""

import math

# Interval widths, calendar step, forecast horizon.
INTERVAL_WIDTHS = (0.5, 0.7, 0.9)
EXPORT_WIDTH = 0.9
STEP_DAYS = 7
FORECAST_STEPS = 12
EARLIEST_DATE = "2022-06-01"
HOLDBACK_DAYS = 2
DEATH_DELAY_SHIFT = 4
SMOOTHING_OFFSET = 1

# Bounds used when clamping means and dispersions.
MEAN_FLOOR = 1e-4
DISPERSION_FLOOR = 1e-10
DISPERSION_CEILING = 1e10
CUMULATIVE_INFECTION_INIT = 1.0

# Fixed values: (name, link, location, sd) of each non-centred prior.
PRIORS = (
    ("R₀_init", "exp", 0.2, 0.2),
    ("σ_R₀", "exp", -3.0, 0.2),
    ("case_detection_rate", "logistic", -2.9, 0.3),
    ("dur_latent", "exp", -1.5, 0.25),
    ("dur_infectious", "exp", math.log(5 / 7), 0.25),
    ("IHR", "logistic", -4.3, 0.25),
    ("dur_hospitalized", "exp", -1.54, 0.1),
    ("dur_waning", "exp", math.log(12), 0.1),
    ("dur_icu", "exp", math.log(0.31), 0.1),
    ("HICUR", "logistic", -1.69, 0.2),
    ("ICUDR", "logistic", -1.59, 0.2),
    ("death_detection_rate", "logistic", 2.3, 0.2),
    ("E_init_prop", "logistic", math.log(0.002 / 0.998), 0.4),
    ("I_init_prop", "logistic", math.log(0.0075 / 0.9925), 0.6),
    ("R_init_prop", "logistic", math.log(0.1 / 0.9), 0.5),
)

# Dispersion parameter name of each fitted stream.
DISPERSION_NAMES = (
    ("cases", "ϕ_cases"),
    ("hospitalized", "ϕ_hosp"),
    ("icu", "ϕ_icu"),
    ("deaths", "ϕ_deaths"),
)

PARAMETER_NAMES = tuple(p[0] for p in PRIORS) + tuple(n for _, n in DISPERSION_NAMES)

# Compartments in state order.
COMPARTMENTS = ("S", "E", "I", "H", "R", "C", "ICU", "D")

# Observed streams of the likelihood, with the panel column,
# the mean's name and the dispersion of each.
STREAMS = (
    ("new_cases", "est_cases", "new_cases_mean", "ϕ_cases"),
    ("new_deaths", "est_deaths", "new_deaths_mean", "ϕ_deaths"),
    ("hospitalizations", "hospitalized", "hospitalizations_mean", "ϕ_hosp"),
    ("icu", "icu", "icu_mean", "ϕ_icu"),
)

# ASCII labels of the quantities in reports.
SCALAR_LABELS = {
    "σ_R₀": "sigma_R0",
    "ϕ_cases": "phi_cases",
    "ϕ_deaths": "phi_deaths",
    "ϕ_hosp": "phi_hosp",
    "ϕ_icu": "phi_icu",
}
VECTOR_LABELS = {"R₀_t": "R0_t", "Rₜ_t": "Rt_t", "β_t": "beta_t"}

# Names of predictive streams in the export.
EXPORT_LABELS = {
    "hospitalizations": "hosp_census_with_covid",
    "icu": "icu",
    "new_cases": "cases",
    "new_deaths": "deaths",
    "cumulative_deaths": "cumulative_new_deaths",
}

# Areas of the raw feed that are not places.
NOT_PLACES = ("Out of state", "Unknown")

# Previous-model compartments by variant, and those left out of
# the share chart.
VARIANT_TOTALS = {
    "D_total": ("D_non_omicron", "D_omicron"),
    "E_total": ("E_non_omicron", "E_omicron"),
    "H_total": ("H_non_omicron", "H_omicron"),
    "I_total": ("I_non_omicron", "I_omicron"),
    "ICU_total": ("ICU_non_omicron", "ICU_omicron"),
    "S_total": ("S_both", "S_omicron_only"),
}
VARIANT_EXCLUDED = (
    "D_non_omicron", "D_omicron", "D_total",
    "H_non_omicron", "H_omicron", "H_total",
    "ICU_non_omicron", "ICU_omicron", "ICU_total",
)

# Standard-normal quantiles at the reported probabilities.
PRIOR_QUANTILES = ((0.05, -1.6448536269514722), (0.5, 0.0), (0.95, 1.6448536269514722))
