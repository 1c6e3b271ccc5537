"""Column expressions shared by the operators; all run inside Spark's own engine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugewatch.constants import NODE_PREFIX, READING_TIME


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -------------------------------------------------------------------


def epoch_seconds(c: Column | str, zone: str = "UTC", fmt: str = READING_TIME) -> Column:
    """Epoch seconds of a local time text; NULL when the text is no valid time.

    The zone is parsed with the text, so the session zone does not matter. A
    time in the hour that occurs twice in autumn is taken as winter time.
    """
    zoned = F.concat_ws(" ", _col(c), F.when(_col(c).isNotNull(), F.lit(zone)))
    first = F.unix_timestamp(F.try_to_timestamp(zoned, F.lit(f"{fmt} VV")))
    if zone == "UTC":
        return first

    def on_the_clock(seconds: Column) -> Column:
        start = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("SECOND", seconds, start))

    # Clocks only go back between midnight and four; other rows skip the comparison.
    early = F.substring(_col(c), 12, 2) < "04" if fmt == READING_TIME else F.lit(True)
    doubled = early & (on_the_clock(first) == on_the_clock(first + 3600))
    return F.when(doubled, first + 3600).otherwise(first)


def seconds_since(
    c: Column | str, start: str | None = "2025/01/01 00:00:00", zone: str = "America/Chicago"
) -> Column:
    """Seconds between a start and a local time; ``start=None`` means that year's start."""
    start_text = F.lit(start) if start else F.concat(F.substring(_col(c), 1, 4), F.lit("/01/01 00:00:00"))
    return epoch_seconds(c, zone) - epoch_seconds(start_text, zone)


def doy_timestamp(year: Column | str, doy: Column | str, hhmm: Column | str) -> Column:
    """Year, day of year and hhmm (numbers, maybe with a fraction) as a timestamp."""

    def whole(c: Column | str) -> Column:
        return _col(c).try_cast("double").try_cast("bigint").cast("string")

    text = F.concat_ws(" ", whole(year), F.lpad(whole(doy), 3, "0"), F.lpad(whole(hhmm), 4, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy DDD HHmm"))


def month_number(epoch: Column | str) -> Column:
    """Months since year 0 in UTC, an equi-join key for time ranges."""
    day = F.date_from_unix_date(F.floor(_col(epoch) / 86400).cast("int"))
    return F.year(day) * 12 + F.month(day) - 1


# --- codes and ids ----------------------------------------------------------


def recode(c: Column | str, mapping: dict[str, str]) -> Column:
    """Look a value up in a fixed map; unknown values stay."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(c)), _col(c))


def shorten_node_id(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(NODE_PREFIX), F.lit(""))


def label_bucket(c: Column | str, n: int = 100) -> Column:
    """A stable bucket of a label: first 32 bits of its md5, modulo ``n``."""
    head = F.conv(F.substring(F.md5(_col(c).cast("string")), 1, 8), 16, 10)
    return F.pmod(head.cast("bigint"), F.lit(n))


def shuffled_order(c: Column | str, seed: int) -> Column:
    """A seeded order key, the same on every run and every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), _col(c).cast("string")))


def shuffled_number(c: Column | str, seed: int) -> Column:
    """The first 60 bits of ``shuffled_order`` as a number."""
    return F.conv(F.substring(shuffled_order(c, seed), 1, 15), 16, 10).cast("bigint")


# --- values -----------------------------------------------------------------


def parse_values(c: Column | str) -> Column:
    """A number or a comma list of numbers as doubles; NULL when a part is no number.

    Plain numbers, the usual case, never reach the list functions. The list is
    bound to a lambda so that it is worked out once.
    """
    text = _col(c)
    number = text.try_cast("double")
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    numbers = F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.try_cast("double"))
    whole = F.transform(F.array(numbers), lambda n: F.when(~F.exists(n, lambda v: v.isNull()), n))
    return F.when(number.isNotNull(), F.array(number)).when(text.contains(","), F.get(whole, F.lit(0)))


def sensor_group(c: Column | str, rules: dict[str, list[str]]) -> Column:
    """The first group with a term inside the lower-cased name, else ``other``."""
    name = F.lower(_col(c))
    chain = None
    for group, terms in rules.items():
        hit = name.contains(terms[0])
        for term in terms[1:]:
            hit = hit | name.contains(term)
        chain = F.when(hit, group) if chain is None else chain.when(hit, group)
    return chain.otherwise("other")


# --- vectors ----------------------------------------------------------------


def tile_embedding(c: Column | str, dim: int) -> Column:
    """Repeat the features until ``dim`` values are filled; no features give zeros."""
    f = _col(c)
    tiled = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get(f, F.pmod(i, F.size(f)))
    )
    return F.when(F.size(f) > 0, tiled).otherwise(F.array_repeat(F.lit(0.0), dim))


def fit_dim(c: Column | str, dim: int) -> Column:
    """Cut to ``dim`` values or fill up with zeros on the right."""
    v = _col(c)
    missing = F.greatest(F.lit(dim) - F.size(v), F.lit(0))
    return F.concat(F.slice(v, 1, dim), F.array_repeat(F.lit(0.0), missing))


def is_usable(c: Column | str) -> Column:
    """True for a list of finite values, not for NULL, an empty list or one with NULL, NaN or infinity."""
    v = _col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite, F.lit(False))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(
        _col(a), _col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)
    )
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


# --- text -------------------------------------------------------------------


def fixed_text(x: Column | str, digits: int) -> Column:
    """A number with a fixed number of decimals, rounded half away from zero."""
    x = _col(x).cast("double")
    scale = 10**digits
    scaled = F.floor(F.abs(x) * scale + 0.5)
    whole = F.floor(scaled / scale).cast("string")
    part = F.lpad(F.pmod(scaled, F.lit(scale)).cast("string"), digits, "0")
    text = F.concat(F.when(x < 0, "-").otherwise(""), whole, F.lit("."), part)
    return F.when(F.abs(x) < 1e13, text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
