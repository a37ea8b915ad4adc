"""Expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once, so that a lambda in ``body`` does not compute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with both norms kept away from zero."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def unit(a: Column) -> Column:
    """Divide by the norm; a zero vector stays zero."""
    return let(
        norm(a), lambda length: F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a)
    )


def normalised(a: Column) -> Column:
    """Divide by the sum."""
    return let(total(a), lambda whole: F.transform(a, lambda x: x / whole))


def argmax(a: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def fold(a: Column, steps: int) -> Column:
    """Reshape a vector into ``steps`` consecutive rows; its length must divide evenly."""

    def rows(v: Column) -> Column:
        width = (F.size(v) / steps).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.slice(v, i * width + 1, width)
        )

    checked = F.when(F.size(a) % steps == 0, a).otherwise(
        F.raise_error(F.lit(f"vector length is not a multiple of {steps}"))
    )
    return let(checked, rows)


def pool_over_steps(steps: Column) -> Column:
    """Average over the steps followed by maximum over the steps, per position."""

    def pooled(rows: Column) -> Column:
        first = F.get(rows, F.lit(0))
        rest = F.slice(rows, 2, F.size(rows))
        sums = F.aggregate(rest, first, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
        largest = F.aggregate(
            rest, first, lambda acc, row: F.zip_with(acc, row, lambda x, y: F.greatest(x, y))
        )
        return F.concat(F.transform(sums, lambda x: x / F.size(rows)), largest)

    return let(steps, pooled)


def moving_average(a: Column, width: int) -> Column:
    """Centred moving average with zero padding, same length as the input."""
    half = width // 2

    def smooth(v: Column) -> Column:
        padded = F.concat(F.array_repeat(F.lit(0.0), half), v, F.array_repeat(F.lit(0.0), half))
        return let(
            padded,
            lambda p: F.transform(
                F.sequence(F.lit(1), F.size(p) - 2 * half), lambda i: total(F.slice(p, i, width)) / width
            ),
        )

    return let(a, smooth)


def adaptive_average(a: Column, cells: int) -> Column:
    """Average pooling to a fixed number of cells; cell borders follow the input length."""

    def pool(v: Column) -> Column:
        size = F.size(v)

        def cell(i: Column) -> Column:
            start = F.floor(i * size / cells).cast("int")
            stop = F.ceil((i + 1) * size / cells).cast("int")
            return total(F.slice(v, start + 1, stop - start)) / (stop - start)

        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), cell)

    return let(a, pool)
