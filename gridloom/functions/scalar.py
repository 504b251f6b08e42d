"""Column expressions: nodata, masks, class maps, indices and rounding. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_sentinel(v: Column, sentinel: float = -9999) -> Column:
    """The sentinel as null; convert once, at the scan."""
    return F.nullif(v, F.lit(sentinel))


def to_sentinel(v: Column, sentinel: float = -9999) -> Column:
    return F.coalesce(v, F.lit(sentinel))


def inside(v: Column, mask: Column) -> Column:
    """v where the mask holds, else null."""
    return F.when(mask, v)


def at_least(v: Column, low: float) -> Column:
    return F.when(v >= low, v)


def above(v: Column, low: float) -> Column:
    return F.when(v > low, v)


def in_range(v: Column, low: float, high: float) -> Column:
    """v within the closed range, else null."""
    return F.when(v.between(low, high), v)


def bit_mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in set(bits))


def clear_of(v: Column, bits: Iterable[int]) -> Column:
    """Whether none of the bits is set."""
    return v.bitwiseAND(F.lit(bit_mask(bits))) == 0


def all_within(columns: list[Column], low: float, high: float) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= c.between(low, high)
    return out


def scaled(v: Column, scale: float, offset: float) -> Column:
    return v * scale + offset


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0. Scale and offset go on before, as the offset does not cancel."""
    return F.try_divide(a - b, a + b)


def celsius(v: Column) -> Column:
    return v - 273.15


def class_map(v: Column, classes: Mapping[int, float], default: float | None = 0) -> Column:
    """Lookup of small fixed tables as one map literal; what it lacks becomes the default."""
    pairs = [F.lit(x) for kv in sorted(classes.items()) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), v), F.lit(default)) if pairs else F.lit(default)


def reclass_table(categories: Mapping[int, Iterable[int]]) -> dict[int, int]:
    """{code: category} from {category: codes}."""
    return {code: cat for cat, codes in categories.items() for code in codes}


def reclassify(code: Column, table: Mapping[int, int]) -> Column:
    """Category of a raw code: fractions are cut, codes outside 0..255 or the table become 0."""
    whole = F.when(code.between(0, 255), code.cast("int"))
    return class_map(whole, {k: v for k, v in table.items() if 0 <= k <= 255})


def percent_change(now: Column, before: Column) -> Column:
    return 100 * (F.try_divide(now, before) - 1)


def binned(v: Column, top: int) -> Column:
    return F.least(v, F.lit(top))


def half_even(v: Column, digits: int) -> Column:
    return F.bround(v, digits)


def argmax(values: Column) -> Column:
    """Position from 1 of the first greatest element."""
    return F.array_position(values, F.array_max(values)).cast("int")


def one_hot(v: Column, classes: Iterable[int], prefix: str = "oh_") -> list[Column]:
    return [F.coalesce((v == k).cast("float"), F.lit(0.0).cast("float")).alias(f"{prefix}{k}") for k in classes]


def clean_name(v: Column) -> Column:
    """Upper case, trimmed, with line breaks as spaces."""
    return F.upper(F.trim(F.replace(v, F.lit("\n"), F.lit(" "))))


def starts_with_any(v: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out |= F.coalesce(v, F.lit("")).startswith(p)
    return out


def joined_numbers(v: Column) -> Column:
    return F.concat_ws(",", F.transform(v, lambda x: x.cast("string")))
