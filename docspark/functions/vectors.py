"""Vector expressions on array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.basics import col

# Above this width the unrolled sum no longer compiles to one small method.
_UNROLL_LIMIT = 128


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(
        a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: str | Column, b: str | Column, epsilon: float = 1e-8) -> Column:
    x, y = col(a), col(b)
    return dot(x, y) / (norm(x) * norm(y) + F.lit(epsilon))


def cosine_literal(
    vector: str, query: Sequence[float], epsilon: float = 0.0
) -> Column:
    """Cosine between an array column and a literal vector; null for a
    vector of another length.

    Short vectors are unrolled into plain arithmetic, which stays inside
    whole-stage code generation; long ones use a higher-order function.
    """
    size = float(sum(float(q) ** 2 for q in query)) ** 0.5
    if len(query) > _UNROLL_LIMIT:
        literal = F.array(*[F.lit(float(q)) for q in query])
        product, length = dot(F.col(vector), literal), norm(F.col(vector))
    else:
        cells = [f"CAST(get({vector}, {i}) AS DOUBLE)" for i in range(len(query))]
        product = F.expr(" + ".join(
            f"{c} * {float(q)!r}D" for c, q in zip(cells, query)))
        length = F.sqrt(F.expr(" + ".join(f"{c} * {c}" for c in cells)))
    value = F.try_divide(product, length * F.lit(size) + F.lit(epsilon))
    return F.when(F.size(F.col(vector)) == len(query), value)
