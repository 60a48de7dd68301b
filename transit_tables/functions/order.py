"""Sort keys of services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def service_sort_key(no: Column, ord_: Column | None = None) -> list[Column]:
    """Numbers that start with a digit first, by first digit, then leading integer; others keep their input order."""
    digit = no.rlike(r"^\d")
    first = F.when(digit, F.substring(no, 1, 1).try_cast("int"))
    number = F.when(digit, F.regexp_extract(no, r"^\d+", 0).try_cast("long"))
    return [F.when(digit, 0).otherwise(1), first, number, *([ord_] if ord_ is not None else []), no]


def schedule_sort_key(no: Column) -> list[Column]:
    """All-digit numbers by value, then the rest as text."""
    number = F.when(no.rlike(r"^\d+$"), no.try_cast("double"))
    return [F.coalesce(number, F.lit(float("inf"))), no]


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays taken as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def route_key(service: Column, destination: Column, variant: Column) -> Column:
    return F.concat_ws("|", service, destination, variant.cast("string"))


def split_route_key(key: Column) -> Column:
    """Struct of service, destination and variant; parts that a key lacks are null."""
    part = lambda i: F.get(F.split(key, r"\|"), F.lit(i))
    return F.struct(part(0).alias("service"), part(1).alias("destination"), part(2).try_cast("int").alias("variant_idx"))
