"""Black-Scholes as Column expressions; implied volatility by vectorised bisection.

The normal distribution uses the five-term polynomial of Abramowitz and Stegun 7.1.26, so that
prices and Greeks stay inside whole-stage code. Bisection is a pandas UDF on Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the polynomial.
P = 0.3275911
A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + P * z)
    poly = ((((A[4] * t + A[3]) * t + A[2]) * t + A[1]) * t + A[0]) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x == 0, 0.5).when(x > 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def intrinsic(option_type: Column, s: Column, k: Column) -> Column:
    return F.greatest(F.when(option_type == "CE", s - k).otherwise(k - s), F.lit(0.0))


def greeks(option_type: Column, s: Column, k: Column, t: Column, sigma: Column, r: float = 0.065) -> dict[str, Column]:
    """price, delta, gamma, vega (per 1.00) and theta (a year)."""
    root = F.sqrt(t)
    d1 = (F.ln(s / k) + (r + sigma * sigma / 2) * t) / (sigma * root)
    d2 = d1 - sigma * root
    call, sign = option_type == "CE", F.when(option_type == "CE", 1.0).otherwise(-1.0)
    paid = k * F.exp(-r * t)
    delta = F.when(call, normal_cdf(d1)).otherwise(normal_cdf(d1) - 1)
    return {
        "price": sign * (s * normal_cdf(sign * d1) - paid * normal_cdf(sign * d2)),
        "delta": delta,
        "gamma": normal_pdf(d1) / (s * sigma * root),
        "vega": s * normal_pdf(d1) * root,
        "theta": -s * normal_pdf(d1) * sigma / (2 * root) - sign * r * paid * normal_cdf(sign * d2),
    }


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + P * z)
    half = 0.5 * ((((A[4] * t + A[3]) * t + A[2]) * t + A[1]) * t + A[0]) * t * np.exp(-z * z)
    return np.where(x == 0, 0.5, np.where(x > 0, 1 - half, half))


def prices(call: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, sigma: np.ndarray, r: float) -> np.ndarray:
    """The price of ``greeks``, for Arrow batches."""
    root = np.sqrt(t)
    d1 = (np.log(s / k) + (r + sigma * sigma / 2) * t) / (sigma * root)
    sign = np.where(call, 1.0, -1.0)
    return sign * (s * _cdf(sign * d1) - k * np.exp(-r * t) * _cdf(sign * (d1 - sigma * root)))


#: The bracket of the volatility, and what counts as equal in price or volatility.
LOW, HIGH, TOLERANCE = 0.001, 10.0, 1e-8


def implied_vol(option_type: Column, s: Column, k: Column, t: Column, price: Column, r: float = 0.065) -> Column:
    """struct<iv, status> by bisection; iv is null where there is none.

    Status: SUCCESS, EXPIRED, INVALID_PRICE, BELOW_INTRINSIC, ABOVE_MAX (above the spot of a call or
    the strike of a put) or NO_BRACKET. A price equal to the intrinsic value has the lowest volatility.
    """

    @F.pandas_udf("iv double, status string")
    def solve(kind: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, price: pd.Series) -> pd.DataFrame:
        call, s, k, t, p = (kind == "CE").to_numpy(), *(x.to_numpy(float) for x in (s, k, t, price))
        inner = np.maximum(np.where(call, s - k, k - s), 0)
        status = np.select([~(t > 0), ~(p > 0), p < inner - TOLERANCE, p > np.where(call, s, k)], ["EXPIRED", "INVALID_PRICE", "BELOW_INTRINSIC", "ABOVE_MAX"], "SUCCESS")
        iv = np.full(len(p), np.nan)
        at_inner = (status == "SUCCESS") & (np.abs(p - inner) <= TOLERANCE)
        iv[at_inner] = LOW
        go = np.flatnonzero((status == "SUCCESS") & ~at_inner)
        call, s, k, t, p = call[go], s[go], k[go], t[go], p[go]
        low, high = np.full(len(go), LOW), np.full(len(go), HIGH)
        outside = (p < prices(call, s, k, t, low, r) - TOLERANCE) | (p > prices(call, s, k, t, high, r) + TOLERANCE)
        status[go[outside]] = "NO_BRACKET"
        for _ in range(34):  # the half-width is then under the tolerance
            mid = (low + high) / 2
            dear = prices(call, s, k, t, mid, r) > p
            low, high = np.where(dear, low, mid), np.where(dear, mid, high)
        iv[go] = np.where(outside, np.nan, (low + high) / 2)
        return pd.DataFrame({"iv": pd.Series(iv, dtype="Float64").where(~np.isnan(iv)), "status": status})

    return solve(option_type, s, k, t, price)
