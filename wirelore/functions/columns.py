"""Small column helpers shared by all modules."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(name: str) -> Column:
    """A column by its literal name; ECS names contain dots."""
    return F.col(f"`{name}`")


def optional(columns: Collection[str], name: str, dtype: str = "string") -> Column:
    """The column when it is among ``columns``, otherwise a typed NULL."""
    return c(name) if name in columns else F.lit(None).cast(dtype)


def bound(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with ``col`` evaluated once, for expressions that a lambda would evaluate again per element."""
    return F.transform(F.array(col), use)[0]


def computed(df: DataFrame, name: str, col: Column) -> DataFrame:
    """Add a column whose expression is evaluated once per row, however often it is used later.

    The optimizer merges projections and would copy a long expression into every use; an outer
    generator of one element is a step that it keeps and infers no filter from.
    """
    return df.select("*", F.explode_outer(F.array(col)).alias(name))


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def first_rule(col: Column, rules: Iterable[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first rule whose condition holds, in the order given."""
    chain = None
    for condition, value in rules:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    if chain is None:
        return otherwise if otherwise is not None else F.lit(None)
    return chain if otherwise is None else chain.otherwise(otherwise)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def epoch_seconds(ts: Column) -> Column:
    """Fractional epoch seconds of a timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def time_bucket(t: Column, seconds: Column | int | float) -> Column:
    """Start of the ``seconds``-wide bucket that epoch time ``t`` falls into."""
    width = F.lit(seconds) if not isinstance(seconds, Column) else seconds
    return (F.floor(t / width) * width).cast("long")
