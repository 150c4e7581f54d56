"""Linear fits and prediction from sums, and summaries with exact quantiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from skysift.operators.ordering import exact_quantiles


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str, degenerate: str = "zeros") -> DataFrame:
    """Slope, intercept, R² and end points of the line through (x, y) per key.

    zeros: below two points all are 0; constant x gives slope 0, the mean of y
    and R² 0. drop: such keys have no row. Constant y has R² 0. End points are
    null for a degenerate fit.
    """
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    points = df.filter(px.isNotNull() & py.isNotNull())
    sums = points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(px).alias("x_min"), F.max(px).alias("x_max"),
        F.min(py).alias("_ylo"), F.max(py).alias("_yhi"), F.avg(py).alias("_ym"),
        F.regr_slope(py, px).alias("_s"), F.regr_intercept(py, px).alias("_i"), F.regr_r2(py, px).alias("_r"),
    )
    flat = (F.col("n") < 2) | (F.col("x_min") == F.col("x_max"))
    slope = F.when(flat, 0.0).otherwise(F.col("_s"))
    intercept = F.when(F.col("n") < 2, 0.0).when(flat, F.col("_ym")).otherwise(F.col("_i"))
    r2 = F.when(flat | (F.col("_ylo") == F.col("_yhi")), 0.0).otherwise(F.col("_r"))
    fit = sums.select(
        *keys, "n", slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"), flat.alias("_flat"),
        F.when(~flat, F.col("x_min")).alias("x_min"), F.when(~flat, F.col("x_max")).alias("x_max"),
    )
    if degenerate == "drop":
        fit = fit.filter(~F.col("_flat"))
    ends = [(F.col("slope") * F.col(f"x_{e}") + F.col("intercept")).alias(f"y_{e}") for e in ("min", "max")]
    return fit.select(*keys, "n", "slope", "intercept", "r2", "x_min", "x_max", *ends)


@dataclass
class LinearModel:
    """Fitted coefficients, the medians that stand in for missing features, and the target's top."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    medians: list[float]
    upper: float

    def predict(self, df: DataFrame) -> Column:
        """Prediction for rows of `df`, clipped to the scale of the target."""
        total = F.lit(self.intercept)
        for name, beta, median in zip(self.features, self.coefficients, self.medians):
            total = total + F.coalesce(_number(df, name), F.lit(median)) * F.lit(beta)
        return F.least(F.greatest(total, F.lit(0.0)), F.lit(self.upper))


def _number(df: DataFrame, name: str) -> Column:
    """A column as a number, null where its text is none."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, NumericType):
        value = value.cast("double")
    else:
        value = F.trim(value.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def fit_linear(train: DataFrame, features: list[str], target: str) -> LinearModel:
    """Least squares with median imputation. Rows without a target are not used.

    Only sums of products come to the driver: one row, whatever the data.
    """
    require = {target, *features} - set(train.columns)
    if require:
        raise ValueError(f"training data lacks columns: {', '.join(sorted(require))}")
    names = [f"x{i}" for i in range(len(features))]
    rows = train.select(*[_number(train, f).alias(n) for f, n in zip(features, names)], _number(train, target).alias("y"))
    rows = rows.filter(F.col("y").isNotNull())
    # The mean of each column, first, so that products are summed around it.
    means_row = rows.agg(F.count("*").alias("n"), F.max("y").alias("top"), *[F.avg(c).alias(c) for c in [*names, "y"]]).first()
    if not means_row["n"]:
        raise ValueError("no training row has a target")
    medians = []
    for f, n in zip(features, names):
        found = exact_quantiles(rows.withColumn("_whole", F.lit(1)), ["_whole"], n, {"median": 0.5}).first()
        if found is None:
            raise ValueError(f"feature {f!r} is missing on every training row")
        medians.append(found["median"])
    filled = rows.select(
        *[(F.coalesce(n, F.lit(m)) - F.lit(means_row[n])).alias(n) for n, m in zip(names, medians)],
        (F.col("y") - F.lit(means_row["y"])).alias("y"),
    )
    k = len(names)
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    products += [F.sum(F.col(names[i]) * F.col("y")).alias(f"q{i}") for i in range(k)]
    products += [F.sum(c).alias(f"s_{c}") for c in [*names, "y"]]
    s = filled.agg(*products).first()
    n = means_row["n"]
    mean = np.array([s[f"s_{c}"] / n for c in names])
    ybar = s["s_y"] / n
    cov = np.array([[s[f"p{min(i, j)}_{max(i, j)}"] - n * mean[i] * mean[j] for j in range(k)] for i in range(k)])
    rhs = np.array([s[f"q{i}"] - n * mean[i] * ybar for i in range(k)])
    # The least-norm solution settles features that depend on each other.
    beta = np.linalg.pinv(cov, hermitian=True) @ rhs
    centre = mean + np.array([means_row[c] for c in names])
    intercept = ybar + means_row["y"] - float(beta @ centre)
    return LinearModel(features, [float(b) for b in beta], intercept, medians, 1.0 if means_row["top"] <= 1.0 else 100.0)


def fit_predict(train: DataFrame, target: DataFrame, features: list[str], y: str, out: str = "expert_score") -> DataFrame:
    """Target rows with the clipped prediction appended."""
    missing = set(features) - set(target.columns)
    if missing:
        raise ValueError(f"target data lacks columns: {', '.join(sorted(missing))}")
    return target.withColumn(out, fit_linear(train, features, y).predict(target))


def describe(df: DataFrame, col: str, keys: list[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max of a column."""
    keyed, by = (df, list(keys)) if keys else (df.withColumn("_k", F.lit(1)), ["_k"])
    basic = keyed.groupBy(*by).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"),
    )
    marks = exact_quantiles(keyed, by, col, {"q25": 0.25, "q50": 0.50, "q75": 0.75})
    joined = basic.join(marks, by, "left")
    return joined.select(*keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max")
