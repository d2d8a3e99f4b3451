"""Keep an expensive column computed once.

Catalyst pushes filters below projections by copying the column's expression into the filter (and infers such a
filter for every explode), so a long text expression would run twice or more per row. A guard that is not
deterministic stops the copy; it is always true and costs nothing.
"""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def settle(column: Column) -> Column:
    return F.when(F.spark_partition_id() >= 0, column)


def worked_out(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use(column)`` with the column worked out once, however often it is used there: it is an element of an array of one, and a
    lambda's variable is a value."""
    return F.get(F.transform(F.array(column), use), 0)


def place_number(seq: Column | str, pos: Column | str) -> Column:
    """A post's number and a place in it (up to 2**20) as one decimal: its minimum is the first place, kept in a hash table, where the
    minimum of a struct would need a sort."""
    seq, pos = (F.col(c) if isinstance(c, str) else c for c in (seq, pos))
    return seq.cast("decimal(19,0)") * F.lit(1 << 20) + F.least(pos, F.lit((1 << 20) - 1))
