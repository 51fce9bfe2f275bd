"""Strict conversion of CSV cells. Each function gives (value, error): a null error means success."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skyloom.schema import NA_TEXTS


def _failed(text: Column, what: str) -> Column:
    return F.concat(F.lit(f"{what}: "), F.coalesce(text, F.lit("")))


def strict_int(text: Column) -> tuple[Column, Column]:
    """64-bit integer; ``3.0``, an empty cell or a value out of range fails."""
    value = text.try_cast("bigint")
    return value, F.when(value.isNull(), _failed(text, "not an integer"))


def int_or_none(text: Column, allow_empty: bool = True) -> tuple[Column, Column]:
    """Integer or the word ``None``. With ``allow_empty`` an empty cell is a null as well."""
    cell = F.trim(F.coalesce(text, F.lit("")))
    missing = (cell == "None") | (cell == "") if allow_empty else cell == "None"
    value = F.when(~missing, text.try_cast("bigint"))
    return value, F.when(~missing & value.isNull(), _failed(text, "not an integer"))


def number(text: Column) -> tuple[Column, Column]:
    """Floating point number; the usual texts for a missing value give null."""
    cell = F.trim(F.coalesce(text, F.lit("")))
    parsed = cell.try_cast("double")
    value = F.when(~cell.isin(NA_TEXTS) & ~F.isnan(parsed), parsed)
    wrong = ~cell.isin(NA_TEXTS) & parsed.isNull()
    return value, F.when(wrong, _failed(text, "not a number"))


def plain_text(text: Column) -> tuple[Column, Column]:
    return F.coalesce(text, F.lit("")), F.lit(None).cast("string")


def text_or_missing(text: Column) -> tuple[Column, Column]:
    return F.when(~text.isin(NA_TEXTS), text), F.lit(None).cast("string")
