"""Scalar features: pure Column -> Column functions, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6378137.0
DAMPING = 1e5


# ---- arithmetic -------------------------------------------------------------------------------------------------
def difference(a: Column, b: Column) -> Column:
    return a - b


def damped_ratio(a: Column, b: Column, damping: float = DAMPING) -> Column:
    """a / (b + damping); null where the denominator is zero."""
    return F.try_divide(a, b + F.lit(damping))


def product(a: Column, b: Column) -> Column:
    return a * b


def display_decimals(value: Column, low: Column, high: Column, whole: bool = False) -> Column:
    """Decimals (0 to 3) to show ``value`` with, from its own digits: ``whole`` numbers have none.

    With an integer part of several characters (a sign counts) a value that ends in 0 has none if its range's whole part
    is above 10, else two; one that does not has one. With a single character: three if it has over three decimals, else two."""
    if whole:
        return F.when(value.isNotNull(), 0)
    text = value.cast("string")
    integer = F.length(value.cast("long").cast("string"))
    decimals = F.length(text) - integer - 1
    several = F.when(F.right(text, F.lit(1)) == "0", F.when((high - low).cast("long") > 10, 0).otherwise(2)).otherwise(1)
    return F.when(value.isNull() | low.isNull() | high.isNull(), None).when(integer > 1, several).when(decimals > 3, 3).otherwise(2)


def contract(c: Column, limit: float, above: bool = True, to_null: bool = False) -> Column:
    """Values beyond ``limit`` become the limit or null; nulls stay."""
    beyond = c > limit if above else c < limit
    return F.when(beyond, F.lit(None) if to_null else F.lit(float(limit))).otherwise(c)


def finite(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


# ---- geography ----------------------------------------------------------------------------------------------------
def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dy), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dx), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cosine_law_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M / 1000) -> Column:
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return radius * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def azimuth_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Bearing from the first to the second point, 0 to 360 degrees from north."""
    d = F.radians(lon2 - lon1)
    y = F.cos(F.radians(lat1)) * F.tan(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(d)
    deg = F.degrees(F.atan2(F.sin(d), y))
    return F.when(deg < 0, deg + 360).otherwise(deg)


# ---- text -----------------------------------------------------------------------------------------------------------
def safe_value(c: Column) -> Column:
    """``/ ( )`` become underscores, full stops hyphens."""
    return F.translate(c, "/().", "___-")


def file_value(c: Column) -> Column:
    """``/``, colon, blank and full stop become underscores; double quotes go."""
    return F.translate(c, '/: ."', "____")


def safe_name(name: str) -> str:
    return name.translate(str.maketrans("/().", "___-"))


def bracket_free(c: Column) -> Column:
    """``[ ] ,`` become ``-q-``, ``-p-`` and ``-o-``."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (("[", "-q-"), ("]", "-p-"), (",", "-o-")), c)


def bracket_free_name(name: str) -> str:
    return name.replace("[", "-q-").replace("]", "-p-").replace(",", "-o-")


def strip_literal(c: Column) -> Column:
    """Blanks (also no-break and ideographic ones), list brackets and quotes go; ``-2`` becomes ``0``."""
    bare = F.translate(c, "  　[]'\"", "")
    return F.replace(bare, F.lit("-2"), F.lit("0"))


def half_width_digits(c: Column) -> Column:
    return F.translate(c, "".join(chr(0xFF10 + d) for d in range(10)), "0123456789")


def fixed_list(c: Column, separator: str = "、", size: int = 3, pad: str = "0") -> Column:
    """The parts of a delimited string, padded to ``size``; a longer list is all padding; null stays null."""
    parts = F.split(c, separator)
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(pad), size)), 1, size)
    return F.when(c.isNull(), None).when(F.size(parts) > size, F.array_repeat(F.lit(pad), size)).otherwise(padded)


def first_label(c: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """The label of the first (keyword, label) rule whose keyword occurs in ``c``; else ``other``."""
    return F.coalesce(*[F.when(c.contains(k), F.lit(label)) for k, label in rules], F.lit(other))


def ward(c: Column, mark: str = "区", default: str = "港") -> Column:
    """Text before ``mark``; ``default`` without one."""
    return F.when(c.contains(mark), F.split(c, mark)[0]).otherwise(F.lit(default))


def contains_groups(c: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Some group all of whose keys occur in ``c``."""
    each = [reduce(lambda a, b: a & b, [c.contains(k) for k in g]) for g in groups if g]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def page_list(url: Column, pages: int, part: str = "list") -> Column:
    """The addresses of pages 1 to ``pages`` of a paginated list: what stands before ``{part}/<number>/`` in ``url``, or the
    whole of it, with each number in turn."""
    base = F.regexp_replace(url, rf"/?{part}/[0-9]+/.*$", "")
    return F.transform(F.sequence(F.lit(1), F.lit(pages)), lambda n: F.concat(base, F.lit(f"/{part}/"), n.cast("string"), F.lit("/")))


# ---- dates ----------------------------------------------------------------------------------------------------------
def days_between(a: Column, b: Column) -> Column:
    """Whole days from ``b`` to ``a``, rounded down."""
    return F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400)


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_timestamp(a) - F.unix_timestamp(b)


def add_days_text(c: Column, n: int) -> Column:
    return F.date_format(F.date_add(c, n), "yyyyMMdd")


def add_hours_text(c: Column, n: int) -> Column:
    return F.date_format(c + F.make_interval(hours=F.lit(n)), "yyyy-MM-dd-HH")


def japanese_month(c: Column) -> Column:
    """First day of a date like 2015年4月1日 (month and day may lack, digits may be wide); null if it is none."""
    t = half_width_digits(c)
    year, month = F.regexp_extract(t, "([0-9]{4})年", 1), F.regexp_extract(t, "年([0-9]{1,2})月", 1)
    day = F.when(month == "", 1).otherwise(month.try_cast("int"))
    return F.when(year != "", F.try_to_date(F.concat_ws("-", year, F.lpad(day.cast("string"), 2, "0"), F.lit("01"))))


def pattern_fields(c: Column, fields: Mapping[str, str]) -> list[Column]:
    """One column a field: the first group of its pattern, null if absent or empty."""
    return [F.nullif(F.trim(F.regexp_extract(c, p, 1)), F.lit("")).alias(name) for name, p in fields.items()]
