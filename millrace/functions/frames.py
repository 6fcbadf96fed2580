"""Python functions for columns, groups and tables; all take whole batches or groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf


@pandas_udf(T.DoubleType())
def charge(price: pd.Series, discount: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 - discount) * (1 + tax)


@pandas_udf(T.DoubleType())
def mean(values: pd.Series) -> float:
    return float(values.mean())


def distance_from_mean(group: pd.DataFrame) -> pd.DataFrame:
    return group.assign(distance=(group.c_acctbal - group.c_acctbal.mean()).round(4))[["c_custkey", "c_nationkey", "distance"]]


def group_sizes(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n_nationkey": [key[0]], "customers": [len(left)], "suppliers": [len(right)]})


def double_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        large = batch.filter(pc.greater(batch.column(1), 200_000))
        yield pa.RecordBatch.from_arrays([large.column(0), pc.multiply(large.column(1), 2)], names=["o_orderkey", "doubled"])


@udtf(returnType=T.StructType([T.StructField("step", T.LongType())]))
class Steps:
    """The numbers below n, a row each."""

    def eval(self, n: int):
        for step in range(n):
            yield (step,)
