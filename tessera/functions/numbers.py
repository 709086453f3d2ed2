"""Rounding of doubles to decimal places by their exact binary value, halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double's 53 bits in two halves whose products are exact.
_SPLIT = float((1 << 27) + 1)
#: From here on doubles have no fraction.
_WHOLE = float(1 << 52)


def half_even(x: Column, places: int) -> Column:
    """x to so many places, as if its exact binary value were rounded once: 0.5075 is a little less than it is written, so it is 0.507 to three.

    The product with the power of ten is kept with its rounding error, which decides where the product looks like a half. A null, a
    NaN, and a number too large to have that many places stay as they are.
    """
    scale = float(10**places)
    product = x * scale
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * scale - product) + (x - high) * scale
    floor = F.floor(product).cast("double")
    rest = product - floor
    odd = F.pmod(floor, F.lit(2.0)) == 1
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return F.when(F.isnan(x) | (F.abs(product) >= _WHOLE), x).otherwise((floor + up.cast("double")) / scale)


def half_even_sql(x: str, places: int) -> str:
    """The same in DuckDB's SQL."""
    scale = f"{10**places}.0::DOUBLE"
    error = f"(((v * {_SPLIT}::DOUBLE - (v * {_SPLIT}::DOUBLE - v)) * {scale} - v * {scale}) + (v - (v * {_SPLIT}::DOUBLE - (v * {_SPLIT}::DOUBLE - v))) * {scale})"
    rest, odd = f"(v * {scale} - floor(v * {scale}))", f"(floor(v * {scale})% 2 <> 0)"
    up = f"({rest} > 0.5::DOUBLE OR ({rest} = 0.5::DOUBLE AND ({error} > 0 OR ({error} = 0 AND {odd}))))"
    return f"list_transform([{x}], lambda v: CASE WHEN isnan(v) OR abs(v * {scale}) >= {_WHOLE}::DOUBLE THEN v ELSE (floor(v * {scale}) + {up}::INT) / {scale} END)[1]"
