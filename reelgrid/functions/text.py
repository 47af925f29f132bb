"""Text helpers: paths, frame names, sizes and number lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def stem(path: Column, last_dot: bool = True) -> Column:
    """The file name up to its last (or first) dot."""
    return F.regexp_extract(file_name(path), r"^(.*?)(?:\.[^.]*)?$" if last_dot else r"^([^.]*)", 1)


def extension_upper(path: Column) -> Column:
    return F.upper(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def leading_int(text: Column) -> Column:
    """The signed digits at the start, after white space; null if there are none or too many."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def key_from_path(path: Column, mode: str = "last") -> Column:
    """A clip's number from its file name. "last": stem to the last dot, 0 without digits; "first": to the first dot, null (a rejected file) without digits."""
    if mode == "last":
        return F.coalesce(leading_int(stem(path)), F.lit(0))
    return leading_int(stem(path, last_dot=False))


def frame_name(n: Column) -> Column:
    return F.format_string("frame_%04d", n.cast("int"))


def parse_size(text: Column) -> tuple[Column, Column]:
    """(width, height) of text like 640x480; other text is an error."""
    ok = text.rlike(r"^\d+x\d+$")
    number = lambda i: F.when(ok, F.regexp_extract(text, r"^(\d+)x(\d+)$", i).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a size: "), text)))
    return number(1), number(2)


def whole(value: Column) -> Column:
    """The greatest whole number up to a value. NaN and what 64 bits don't hold is an error, where floor() gives 0 or the nearest bound."""
    fits = value.isNull() | ((value >= -(2.0**63)) & (value < 2.0**63))
    return F.when(fits, F.floor(value)).otherwise(F.raise_error(F.concat(F.lit("not a 64-bit number: "), value.cast("string"))))


def number_list(values: Column) -> Column:
    """Numbers joined by commas. Nulls are left out; the list of nulls alone is null, the empty one empty."""
    listed = F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
    return F.when((F.size(values) == 0) | F.exists(values, lambda v: v.isNotNull()), listed)
