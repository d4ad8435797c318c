"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored  # noqa: F401  for the operators

#: What separates words: space and the ASCII controls 0x09-0x0D, as bytes.split() has it.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: What a Python worker keeps between tasks, as functions that let it go.
CACHES: list = []


def drop_caches() -> None:
    """For tasks that need memory themselves: a worker that goes on to other work lets its caches go."""
    for drop in CACHES:
        drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: A sorted array is looked through one by one up to so many values, by halves beyond.
_FEW = 8


def place_in(values: str, value: str) -> str:
    """SQL: the place (from 1) of `value` in the sorted array `values`, 0 where it is not there."""
    middle = "shiftright(r.a + r.b, 1)"
    halves = f"""aggregate(sequence(0, 31), named_struct('a', 0, 'b', size({values})), (r, k) -> CASE
        WHEN r.a >= r.b THEN r
        WHEN {values}[{middle}] < {value} THEN named_struct('a', {middle} + 1, 'b', r.b)
        ELSE named_struct('a', r.a, 'b', {middle}) END,
        r -> CASE WHEN r.a < size({values}) AND {values}[least(r.a, size({values}) - 1)] = {value} THEN r.a + 1 ELSE 0 END)"""
    return f"CASE WHEN {value} IS NULL THEN 0 WHEN size({values}) <= {_FEW} THEN int(array_position({values}, {value})) ELSE {halves} END"
