"""Reusable column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as V
from ..core import dtype_of, q


def hash_bucket(c: Column, n: int, how: str = "xxhash64") -> Column:
    """Stable bucket in 0..n-1 of a string; md5 gives the same value in any SQL engine."""
    if how == "xxhash64":
        return F.pmod(F.xxhash64(c), F.lit(n))
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint") % F.lit(n)


def hash_rank(key: Column, seed: int) -> Column:
    """52-bit hash of a row key and seed, exact as a double; orders rows the same on every run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(seed)))), 1, 13), 16, 10).cast("bigint")


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    """Clip and keep nulls (greatest and least would skip them)."""
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def parse_timestamp(df: DataFrame, column: str) -> Column:
    """Timestamp of a date, timestamp or string column; unparsable text becomes null."""
    t = dtype_of(df, column)
    if isinstance(t, T.StringType):
        return F.try_to_timestamp(q(column)).cast("timestamp_ntz")
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return q(column).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def date_part(ts: Column, part: str) -> Column:
    monday0 = F.weekday(ts)
    if part in ("dayofweek", "weekday"):
        return monday0
    if part == "is_weekend":
        return (monday0 >= 5).cast("int")
    if part in ("weekofyear", "week"):
        return F.weekofyear(ts)
    if part == "is_month_start":
        return (F.dayofmonth(ts) == 1).cast("int")
    if part == "is_month_end":
        return (F.to_date(ts) == F.last_day(ts)).cast("int")
    if part == "month_name":
        return F.date_format(ts, "MMMM")
    if part == "day_name":
        return F.date_format(ts, "EEEE")
    if part == "season":
        out = F.lit(None).cast("string")
        for name, months in V.SEASONS.items():
            out = F.when(F.month(ts).isin(months), F.lit(name)).otherwise(out)
        return out
    if part == "time_of_day":
        out = F.lit(V.TIME_OF_DAY_ELSE)
        for name, (a, b) in V.TIMES_OF_DAY.items():
            out = F.when(F.hour(ts).between(a, b), F.lit(name)).otherwise(out)
        return F.when(ts.isNotNull(), out)
    direct = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofyear": F.dayofyear,
              "quarter": F.quarter, "hour": F.hour, "minute": F.minute,
              "second": F.second}
    return direct[part](ts)


def haversine(lat1, lon1, lat2, lon2, radius: float) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / 2.0
    half_lon = (F.radians(lon2) - F.radians(lon1)) / 2.0
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def equirectangular(lat1, lon1, lat2, lon2, radius: float) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    x = (F.radians(lon2) - F.radians(lon1)) * F.cos((p1 + p2) / 2.0)
    y = p2 - p1
    return F.lit(radius) * F.sqrt(x * x + y * y)


def cell_geohash(lat: Column, lon: Column, precision: int) -> Column:
    """Geohash text (public base-32 grid): interleaved halvings of longitude and latitude."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2

    def cell(v, lo, hi, n):
        k = F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(2 ** n))).cast("bigint")
        return F.least(F.greatest(k, F.lit(0)), F.lit(2 ** n - 1))

    x, y = cell(lon, -180.0, 180.0, lon_bits), cell(lat, -90.0, 90.0, lat_bits)
    alphabet = "0123456789bcdefghjkmnpqrstuvwxyz"
    chars = []
    for i in range(precision):
        value = F.lit(0)
        for b in range(5):
            pos = 5 * i + b
            src, idx, n = (x, pos // 2, lon_bits) if pos % 2 == 0 else (y, pos // 2, lat_bits)
            bit = F.shiftright(src, n - 1 - idx).bitwiseAND(F.lit(1))
            value = value + bit * (1 << (4 - b))
        chars.append(F.substring(F.lit(alphabet), value.cast("int") + 1, F.lit(1)))
    ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(ok, F.concat(*chars))


def word_tokens(text: Column, lowercase: bool = True, stop_words: list[str] | None = None) -> Column:
    t = F.lower(text) if lowercase else text
    toks = F.regexp_extract_all(t, F.lit(V.WORD_PATTERN), F.lit(0))
    if stop_words:
        stops = F.array(*[F.lit(w) for w in stop_words])
        toks = F.filter(toks, lambda x: ~F.array_contains(stops, x))
    return toks


def token_sort_key(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, "\\s+"), lambda x: x != "")), " ")


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel row update)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common_subsequence(a, b) / total


def _set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    if shared and (not x - y or not y - x):
        return 100.0
    left = (shared + " " + " ".join(sorted(x - y))).strip()
    right = (shared + " " + " ".join(sorted(y - x))).strip()
    best = _ratio(left, right)
    if shared:
        best = max(best, _ratio(shared, left), _ratio(shared, right))
    return best


@F.pandas_udf(T.DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column, method: str = "ratio") -> Column:
    """Text likeness 0..100; both empty 100, one empty 0. ``levenshtein`` stays in the JVM."""
    a, b = F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit(""))
    if method == "levenshtein":
        longest = F.greatest(F.length(a), F.length(b))
        score = F.lit(100.0) * (1.0 - F.levenshtein(a, b) / longest)
    elif method == "token_sort_ratio":
        score = _ratio_udf(token_sort_key(a), token_sort_key(b))
    elif method == "token_set_ratio":
        score = _set_ratio_udf(a, b)
    else:
        score = _ratio_udf(a, b)
    return (F.when((a == "") & (b == ""), F.lit(100.0))
            .when((a == "") | (b == ""), F.lit(0.0)).otherwise(score))
