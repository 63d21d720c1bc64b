"""Arrow-batched UDFs that need no session when their module is imported."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


def vectorized(return_type: str):
    """Decorator: a pandas UDF of the given type, created when it is first applied to columns."""

    def make(fn):
        @wraps(fn)
        def apply(*columns):
            return F.pandas_udf(fn, return_type)(*columns)

        return apply

    return make
