"""Comparison of field values: by kind, then as money, then as cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwork.functions.text import clean_text, parse_money, strip, to_float

EPSILON = 1e-9


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.NumericType):
        return "num"
    return "str" if isinstance(data_type, T.StringType) else "other"


def money_of(kind: Column, text: Column) -> Column:
    """Amount of a tagged value; flags and others have none."""
    return F.when(kind.isin("num", "str"), parse_money(text))


def field_equal(kind_a: Column, a: Column, kind_b: Column, b: Column, volatile: bool | Column = False, strict: bool = False, money: tuple[Column, Column] | None = None) -> Column:
    """Whether two tagged values (kind and text) are equal.

    Nulls equal nulls only. A flag equals a flag, or the number it stands for. Where both read as
    money, amounts decide: exactly, or for volatile fields within a relative 1e-9 of the left one.
    Two strings that hold numbers thus compare by their first number; strict=True compares strings
    as text unless both are wholly numbers. Other strings compare with white space collapsed. `money`: both amounts, where they
    are columns already.
    """
    flag = lambda k, v: F.when(k == "bool", F.when(v == "true", F.lit(1.0)).otherwise(F.lit(0.0))).when(k == "num", v.try_cast("double"))
    ma, mb = money or (money_of(kind_a, a), money_of(kind_b, b))
    if strict:
        whole = r"^\s*[^\w\s]?\s*[-+]?\d[\d,]*\.?\d*\s*$"
        ma = F.when((kind_a == "num") | a.rlike(whole), ma)
        mb = F.when((kind_b == "num") | b.rlike(whole), mb)
    near = F.abs(ma.cast("double") - mb.cast("double")) / F.greatest(F.abs(ma.cast("double")), F.lit(EPSILON)) <= EPSILON
    loose = volatile if isinstance(volatile, Column) else F.lit(volatile)
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when((kind_a == "bool") | (kind_b == "bool"), F.coalesce(flag(kind_a, a) == flag(kind_b, b), F.lit(False)))
        .when(ma.isNotNull() & mb.isNotNull(), F.when(loose, near).otherwise(ma == mb))
        .when((kind_a == "str") & (kind_b == "str"), clean_text(a) == clean_text(b))
        .otherwise((kind_a == kind_b) & (a == b))
    )


def columns_equal(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType, volatile: bool = False, strict: bool = False, money: tuple[Column, Column] | None = None) -> Column:
    """field_equal of two typed columns."""
    return field_equal(F.lit(kind_of(a_type)), a.cast("string"), F.lit(kind_of(b_type)), b.cast("string"), volatile, strict, money)


def values_agree(got: Column, want: Column) -> Column:
    """Two texts agree if both are equal numbers, or are equal without outer white space."""
    g, w = to_float(got), to_float(want)
    return F.when(g.isNotNull() & w.isNotNull(), g == w).otherwise(strip(got) == strip(want))
