"""Scalar Column functions: names, keys, geometry of the plane, safe comparison."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a county's official name may end in, in the order they are tried.
COUNTY_SUFFIXES = (" county", " parish", " borough", " census area", " municipality", " city and borough")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_name(c: Column | str) -> Column:
    """A name that can be part of a path: backslash, slash, colon and space become underscores."""
    return F.translate(_col(c), "\\/: ", "____")


def normalize_county(c: Column | str) -> Column:
    """Lower-case county name without its suffix and dots, single spaces."""
    low = F.lower(F.trim(_col(c)))
    cut = reduce(lambda rest, s: F.when(low.endswith(s), F.substring(low, F.lit(1), F.length(low) - len(s))).otherwise(rest), reversed(COUNTY_SUFFIXES), low)
    return F.trim(F.regexp_replace(F.replace(cut, F.lit("."), F.lit(" ")), r"\s+", " "))


def region_id(state: Column | str, county: Column | str) -> Column:
    return F.concat_ws("::", _col(state), _col(county))


def region_parts(region: Column | str) -> tuple[Column, Column]:
    """State and county of a region id; a county may hold the separator itself."""
    parts = F.split(_col(region), "::", 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def job_key(zoom: Column | str, state: Column | str, county: Column | str) -> Column:
    return F.concat_ws(":", F.lower(_col(zoom)), F.upper(_col(state)), F.lower(_col(county)))


def scope_label(zoom: Column | str, state: Column | str, county: Column | str) -> Column:
    zoom, state, county = _col(zoom), _col(state), _col(county)
    return F.when(zoom == "country", F.lit("country")).when(zoom == "state", state).otherwise(F.concat_ws(", ", county, state))


def county_queries(state_code: Column | str, state_name: Column | str, county: Column | str) -> Column:
    """Names under which a geocoder may know a county, best first."""
    code, name, base = _col(state_code), _col(state_name), F.trim(_col(county))
    low = F.lower(base)
    plain = ~reduce(Column.__or__, [F.contains(low, F.lit(s)) for s in COUNTY_SUFFIXES])
    full = lambda kind: F.concat(base, F.lit(kind), F.lit(", "), name, F.lit(", United States"))
    return F.array_compact(
        F.array(
            full(""),
            F.when(plain, full(" County")),
            F.when(plain & (code == "LA"), full(" Parish")),
            F.when(plain & (code == "AK"), full(" Borough")),
            F.when(plain & (code == "AK"), full(" Census Area")),
        )
    )


def route_key(path: str, params: list[tuple[str, Column]]) -> Column:
    """A path and its parameters in their order, encoded as in a query string."""
    pairs = [F.concat(F.lit(f"{name}="), F.url_encode(F.coalesce(value, F.lit("")))) for name, value in params]
    return F.concat(F.lit(f"{path}?"), F.concat_ws("&", *pairs)) if pairs else F.lit(path)


def threshold_text(c: Column | str) -> Column:
    return F.format_string("%.2f", _col(c).cast("double"))


def route_digest(key: Column | str) -> Column:
    """Name of a route's snapshot."""
    return F.substring(F.sha1(_col(key)), 1, 16)


def random_seed(zoom: Column, state: Column, county: Column, percentage: Column, method: str = "random") -> Column:
    """Seed of a scope's random sample: the first 32 bits of the SHA-256 of its parameters as sorted JSON."""
    quoted = lambda c: F.to_json(F.struct(c.alias("x")))
    value = lambda c: F.regexp_extract(quoted(c), r'^\{"x":(.*)\}$', 1)
    text = F.concat(
        F.lit('{"county": '), value(county), F.lit(f', "method": "{method}", "retain_percentage": '), percentage.cast("int").cast("string"),
        F.lit(', "state": '), value(state), F.lit(', "zoom": '), value(zoom), F.lit("}"),
    )
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def is_close(a: Column | str, b: Column | str, relative: float = 1e-12, absolute: float = 1e-15) -> Column:
    a, b = _col(a), _col(b)
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def finite(c: Column | str) -> Column:
    """The number, or 0 where it is null, NaN or infinite."""
    c = _col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def mercator_x(lng: Column | str) -> Column:
    return F.radians(_col(lng))


def mercator_y(lat: Column | str) -> Column:
    """Web Mercator; the poles are cut at the usual 85.05112878 degrees."""
    cut = F.least(F.greatest(_col(lat), F.lit(-85.05112878)), F.lit(85.05112878))
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(cut) / 2))


def n_keep(n: Column | str, percentage: Column | str) -> Column:
    """Points kept of n at a percentage: at least one, half-even rounding."""
    n = _col(n)
    return F.least(n, F.greatest(F.lit(1), F.bround(n * (_col(percentage) / F.lit(100.0).cast("double"))))).cast("int")


def equivalent_percentage(kept: Column | str, total: Column | str) -> Column:
    kept, total = _col(kept).cast("double"), _col(total).cast("double")
    return F.when(total <= 0, 0.0).otherwise(kept / total * 100)


def normalized(value: Column | str, baseline: Column | str) -> Column:
    """A metric relative to its baseline; over a zero baseline, 0 or infinity."""
    value, baseline = _col(value), _col(baseline)
    return F.when(baseline <= 0, F.when(value <= 0, 0.0).otherwise(float("inf"))).otherwise(value / baseline)


def normalized_against_itself(value: Column | str) -> Column:
    return F.when(_col(value) <= 0, 0.0).otherwise(1.0)


def bin_centres(edges: Column | str) -> Column:
    edges = _col(edges)
    return F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), lambda e, i: (e + F.get(edges, i + 1)) / 2)


def progress(rows: Column | str, expected: Column | str) -> Column:
    """Percent of expected rows that are there, 0 to 100."""
    share = F.round(F.lit(100.0) * _col(rows) / F.greatest(_col(expected), F.lit(1)))
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)).cast("int")
