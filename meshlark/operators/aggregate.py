"""Counts, statistics, tag reduction and group integrals."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, total, least, mean, rms, greatest and population deviation of a measure."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(v).alias("greatest"), F.stddev_pop(v).alias("deviation"))


def reduce_op(op: str, value: Column) -> Column:
    """Aggregate that joins the copies of a tag value: sum, prod, max, min, land, lor, lxor."""
    if op == "prod":  # by logarithms: signs and zeros apart, so it has partial sums
        zero, negative = F.max((value == 0).cast("int")), F.sum((value < 0).cast("int"))
        size = F.exp(F.sum(F.when(value != 0, F.log(F.abs(value.cast("double"))))))
        return F.when(zero == 1, F.lit(0.0)).otherwise(F.when(negative % 2 == 1, -size).otherwise(size))
    true = (value != 0).cast("int")
    return {
        "sum": F.sum(value),
        "max": F.max(value),
        "min": F.min(value),
        "land": F.min(true),
        "lor": F.max(true),
        "lxor": F.sum(true) % 2,
    }[op]


def reduce_tags(copies: DataFrame, op: str, key: list[str], value: str = "value") -> DataFrame:
    """One value an entity from the values of its copies; every copy then has it."""
    return copies.groupBy(*key).agg(reduce_op(op, F.col(value)).alias(value))


def exchange_tags(copies: DataFrame, key: list[str], owner: str = "part_id", value: str = "value") -> DataFrame:
    """All copies take the value of the owner, the smallest part."""
    own = copies.groupBy(*key).agg(F.min_by(value, owner).alias(value))
    return copies.drop(value).join(own, key)


def counts(df: DataFrame, by: list[str], pivot: str | None = None, values: list | None = None) -> DataFrame:
    g = df.groupBy(*by)
    return (g.pivot(pivot, values).count() if pivot else g.count()).na.fill(0)


def bounding_box(df: DataFrame, by: list[str], coords: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return df.groupBy(*by).agg(*[f(c).alias(f"{c}{n}") for c in coords for f, n in ((F.min, "min"), (F.max, "max"))])


def covariance(points: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population covariance of the points of each group."""
    pairs = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    return points.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in pairs])


def oriented_box(points: DataFrame, by: list[str]) -> DataFrame:
    """by, center, axes (three unit vectors), half (extent along each) and variance (along each, falling) of each group.

    The axes are the eigenvectors of the covariance, their signs such that the largest component is positive; the box is the
    tight one along them.  Groups' rows alone go to numpy, in Arrow batches; extents are one more aggregation.
    """
    import numpy as np
    import pandas as pd

    def turn(batches):  # noqa: ANN001, ANN202
        for b in batches:
            m = b[["cov_xx", "cov_xy", "cov_xz", "cov_xy", "cov_yy", "cov_yz", "cov_xz", "cov_yz", "cov_zz"]].to_numpy(float).reshape(-1, 3, 3)
            w, q = np.linalg.eigh(m)
            w, q = w[:, ::-1], q[:, :, ::-1].transpose(0, 2, 1)
            top = np.take_along_axis(q, np.abs(q).argmax(axis=2)[..., None], 2)
            out = b[by].copy()
            out["axes"], out["variance"] = list((q * np.sign(top)).reshape(-1, 9)), list(np.maximum(w, 0))
            yield pd.DataFrame(out)

    c = covariance(points, by)
    fields = ", ".join(f"`{n}` {points.schema[n].dataType.simpleString()}" for n in by)
    axes = c.mapInPandas(turn, f"{fields}, axes array<double>, variance array<double>")
    along = [sum((F.col("axes")[3 * k + j] * F.col(x) for j, x in ((1, "y"), (2, "z"))), F.col("axes")[3 * k] * F.col("x")) for k in range(3)]
    ends = points.join(axes, by).groupBy(*by).agg(F.first("axes").alias("axes"), F.first("variance").alias("variance"), *[f(along[k]).alias(f"{n}{k}") for k in range(3) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    mid = [(F.col(f"lo{k}") + F.col(f"hi{k}")) / 2 for k in range(3)]
    center = F.array(*[sum((F.col("axes")[3 * k + j] * mid[k] for k in (1, 2)), F.col("axes")[j] * mid[0]) for j in range(3)])
    return ends.select(*by, center.alias("center"), F.array(*[F.slice("axes", 3 * k + 1, 3) for k in range(3)]).alias("axes"), F.array(*[(F.col(f"hi{k}") - F.col(f"lo{k}")) / 2 for k in range(3)]).alias("half"), "variance")


def tag_counts(entities: DataFrame, tag: DataFrame) -> DataFrame:
    """(etype, value, n): entities by their tag's value; a null value counts those without the tag."""
    return entities.select("etype", "id").join(tag.select("etype", "id", "value"), ["etype", "id"], "left").groupBy("etype", "value").agg(F.count("*").alias("n"))


def group_integral(df: DataFrame, by: list[str], integral: str) -> DataFrame:
    """Integral of each group, and the factor that normalises it to one: 0 where it is 1e-8 or less."""
    total = df.groupBy(*by).agg(F.sum(integral).alias("integral"))
    return total.withColumn("factor", F.when(F.abs("integral") > 1e-8, 1 / F.col("integral")).otherwise(0.0))


def normalise(df: DataFrame, by: list[str], integral: str, value: str) -> DataFrame:
    f = group_integral(df, by, integral).select(*by, "factor")
    return df.join(f, by).withColumn(value, F.col(value) * F.col("factor")).drop("factor")


def distinct_tuples(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def metric_range(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Least and greatest of each metric, one row a group and metric."""
    pairs = fold(lambda s, m: f"{s}, '{m}', cast({m} as double)", metrics, "")
    long = df.selectExpr(*by, f"stack({len(metrics)}{pairs}) as (metric, value)")
    return long.where(F.col("value").isNotNull()).groupBy(*by, "metric").agg(F.min("value").alias("least"), F.max("value").alias("greatest"))


def volume(triangles: DataFrame, by: list[str]) -> DataFrame:
    """Signed volume and area by the divergence theorem: triangles (x0..z2) with ``sense`` for each solid.

    A triangle with sense 0, on both sides, adds nothing to the volume.
    """
    a, b, c = ([F.col(f"{k}{n}") for k in "xyz"] for n in "012")
    cross = [b[1] * c[2] - b[2] * c[1], b[2] * c[0] - b[0] * c[2], b[0] * c[1] - b[1] * c[0]]
    u, v = [q - p for p, q in zip(a, b, strict=True)], [q - p for p, q in zip(a, c, strict=True)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    six = sum((p * q for p, q in zip(a[1:], cross[1:], strict=True)), a[0] * cross[0])
    return triangles.groupBy(*by).agg((F.sum(F.col("sense") * six) / 6).alias("volume"), (F.sum(F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])) / 2).alias("area"))
