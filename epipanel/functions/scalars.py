"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- links

def logistic(x: ColumnOrName) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def logit(p: ColumnOrName) -> Column:
    return -F.ln(F.lit(1.0) / _col(p) - F.lit(1.0))


def clamp(x: ColumnOrName, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    x = _col(x)
    # greatest and least skip nulls and rank NaN highest; a missing value stays missing.
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, low), high))


def apply_link(link: ColumnOrName, eta: ColumnOrName) -> Column:
    """Inverse link chosen per row: 'exp' or 'logistic'."""
    return F.when(_col(link) == "exp", F.exp(eta)).when(_col(link) == "logistic", logistic(eta))


# ---------------------------------------------------------------- aggregates

def sum_strict(c: ColumnOrName) -> Column:
    """Sum that is null as soon as one input is null."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def last_by(c: ColumnOrName, order: ColumnOrName) -> Column:
    """Value on the row with the greatest ``order``; a null there stays null."""
    return F.max_by(_col(c), _col(order))


def half_even_round(c: ColumnOrName, digits: int = 0) -> Column:
    return F.bround(_col(c), digits)


# ---------------------------------------------------------------- dates

def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return F.datediff(_col(later), _col(earlier))


def week_index(date: ColumnOrName, origin: ColumnOrName, step: int = 7) -> Column:
    return F.floor(days_between(date, origin) / F.lit(step)).cast("bigint")


# ---------------------------------------------------------------- indexed names

# An indexed name is base[position]; predictive bases carry data_.
INDEXED = r"^(.+)\[(\d+)\]$"
PREDICTIVE_PREFIX = "^data_"


def index_of(name: ColumnOrName) -> Column:
    """Position inside the brackets, null for a scalar name."""
    return F.nullif(F.regexp_extract(_col(name), INDEXED, 2), F.lit("")).try_cast("int")


def base_of(name: ColumnOrName) -> Column:
    """Name without brackets and predictive prefix; scalar names stay whole."""
    name = _col(name)
    base = F.regexp_replace(F.regexp_extract(name, INDEXED, 1), PREDICTIVE_PREFIX, "")
    return F.when(name.rlike(INDEXED), base).otherwise(name)


# ---------------------------------------------------------------- log-gamma, negative binomial

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_SHIFT = 8
# Coefficients of 1/y, 1/y^3, ... in Stirling's series.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)

# Coefficients of 1/y^2, 1/y^4, ... in ln y - 1/(2y) - ψ(y), and of 1/y^3, 1/y^5, ... in ψ'(y) - 1/y - 1/(2y^2).
_DIGAMMA = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)
_TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)


def _stirling_tail(y: Column) -> Column:
    inv2 = F.lit(1.0) / (y * y)
    acc = F.lit(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        acc = acc * inv2 + F.lit(c)
    return acc / y


def lgamma(x: ColumnOrName) -> Column:
    """log Γ(x) for x > 0: Stirling's series at x + 8, shifted back."""
    x = _col(x)
    y = x + F.lit(float(_SHIFT))
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + F.lit(float(i)))
    return (
        (y - F.lit(0.5)) * F.ln(y) - y + F.lit(_HALF_LOG_2PI) + _stirling_tail(y) - F.ln(product)
    )


def digamma(x: ColumnOrName) -> Column:
    """ψ(x) for x > 0: its series at x + 8, shifted back."""
    x = _col(x)
    y = x + F.lit(float(_SHIFT))
    inv2 = F.lit(1.0) / (y * y)
    acc = F.lit(_DIGAMMA[-1])
    for c in reversed(_DIGAMMA[:-1]):
        acc = acc * inv2 + F.lit(c)
    back = F.lit(1.0) / x
    for i in range(1, _SHIFT):
        back = back + F.lit(1.0) / (x + F.lit(float(i)))
    return F.ln(y) - F.lit(0.5) / y - acc * inv2 - back


def trigamma(x: ColumnOrName) -> Column:
    """ψ'(x) for x > 0, in the same way."""
    x = _col(x)
    y = x + F.lit(float(_SHIFT))
    inv2 = F.lit(1.0) / (y * y)
    acc = F.lit(_TRIGAMMA[-1])
    for c in reversed(_TRIGAMMA[:-1]):
        acc = acc * inv2 + F.lit(c)
    back = F.lit(1.0) / (x * x)
    for i in range(1, _SHIFT):
        back = back + F.lit(1.0) / ((x + F.lit(float(i))) * (x + F.lit(float(i))))
    return F.lit(1.0) / y + F.lit(0.5) * inv2 + acc * inv2 / y + back


def log_rising_minus_klogr(r: ColumnOrName, k: ColumnOrName) -> Column:
    """log Γ(r+k) - log Γ(r) - k·log r, without cancellation when r is large."""
    r, k = _col(r), _col(k)
    direct = lgamma(r + k) - lgamma(r) - k * F.ln(r)
    stable = (
        (r + k - F.lit(0.5)) * F.log1p(k / r) - k + _stirling_tail(r + k) - _stirling_tail(r)
    )
    return F.when(r < float(_SHIFT), direct).otherwise(stable)


def nb_success(mu: ColumnOrName, phi: ColumnOrName) -> Column:
    """Success probability of the mean/dispersion form."""
    return F.lit(1.0) / (F.lit(1.0) + _col(mu) / _col(phi))


def nb_variance(mu: ColumnOrName, phi: ColumnOrName) -> Column:
    mu = _col(mu)
    return mu + mu * mu / _col(phi)


def nb_log_density(k: ColumnOrName, mu: ColumnOrName, phi: ColumnOrName) -> Column:
    """Negative-binomial log density of count k at mean mu, dispersion phi."""
    k, mu, phi = _col(k), _col(mu), _col(phi)
    return (
        log_rising_minus_klogr(phi, k)
        - lgamma(k + F.lit(1.0))
        + k * F.ln(mu)
        - (k + phi) * F.log1p(mu / phi)
    )


# ---------------------------------------------------------------- reproducible noise

def hashed_normal(*keys: ColumnOrName, seed: int = 1) -> Column:
    """Standard normal that depends only on the row's keys and the seed.

    Its bits are digits of the MD5 of the keys, which other engines have too.

    A retried or re-planned task gives the same value, which a generator
    seeded by partition and row order cannot promise.
    """
    cols = [_col(k) for k in keys]

    def uniform(stream: int) -> Column:
        told = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)), F.lit(str(stream)))
        digits = F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("bigint")
        return (digits.cast("double") + F.lit(0.5)) * F.lit(2.0**-52)

    return F.sqrt(F.lit(-2.0) * F.ln(uniform(0))) * F.cos(F.lit(2.0 * math.pi) * uniform(1))
