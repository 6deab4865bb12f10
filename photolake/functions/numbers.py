"""Rounding and number texts that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column) -> Column:
    """Half up, towards plus infinity: -2.5 to -2. Spark's ``round`` gives -3."""
    return F.floor(x + F.lit(0.5))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def fixed(x: Column, places: int) -> Column:
    """A decimal text with ``places`` digits, halves up; texts differ from an exact decimal
    expansion only where the scaled value is within an ulp of a half."""
    unit = 10**places
    whole = rnd(F.abs(x) * F.lit(float(unit))).cast("long")
    sign = F.when((x < 0) & (whole > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(
        sign, F.floor(whole / F.lit(unit)).cast("long").cast("string"), F.lit("."), F.lpad((whole % F.lit(unit)).cast("string"), places, "0")
    )


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB with one decimal, or MB with two."""
    kb, mb = n.cast("double") / F.lit(1024.0), n.cast("double") / F.lit(1048576.0)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(fixed(kb, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed(mb, 2), F.lit(" MB")))
    )
