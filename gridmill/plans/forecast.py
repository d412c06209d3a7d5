"""Day-ahead forecast: leak-free features, a previous-day baseline, ridge regression and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_avg, exact_sum
from ..functions.timebucket import bucket, local
from ..sources.scratch import new_path

KEYS = ["region", "hour_start"]
LAGS = (24, 48, 168)
TARGET = "energy_kwh"
NUMERIC = ("lag_24h", "lag_48h", "lag_168h", "prev_day_mean", "prev_week_same_hour_mean")
CATEGORIES = ["region", "hour", "dow"]
ALPHAS = (0.1, 1.0, 10.0, 100.0)
WEIGHTS = "part string, name string, value string, mean double, weight double, alpha double"


def hourly(readings: DataFrame, meters: DataFrame) -> DataFrame:
    """Energy by region and local hour."""
    hour = bucket(local(F.col("event_time")), "1 hour")
    r = readings.join(meters.select("meter_id", "region"), "meter_id")
    return r.groupBy("region", hour.alias("hour_start")).agg(exact_sum("energy_kwh").alias("energy_kwh"), F.count(F.lit(1)).alias("readings"))


def on_grid(totals: DataFrame, start: str, end: str) -> DataFrame:
    """All regions at all hours; hours without readings are null."""
    times = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") - F.expr("interval 1 hour"), F.expr("interval 1 hour"))
    return totals.select("region").distinct().select("region", F.explode(times).alias("hour_start")).join(totals, KEYS, "left")


def lag(hours: int) -> Column:
    """The value exactly ``hours`` before, null if that hour is absent."""
    seconds = F.timestamp_diff("SECOND", F.lit("2000-01-01").cast("timestamp_ntz"), F.col("hour_start"))
    w = Window.partitionBy("region").orderBy(seconds).rangeBetween(-3600 * hours, -3600 * hours)
    return F.first("energy_kwh").over(w)


def features(grid: DataFrame) -> DataFrame:
    """Lags by time, the previous day's mean and the same hour's mean over the previous week."""
    day = F.date_trunc("day", "hour_start").cast("timestamp_ntz")
    df = grid.select("*", *[lag(24 * d).alias(f"_{d}") for d in range(1, 8)])
    week = sum((F.col(f"_{d}") for d in range(2, 8)), F.col("_1")) / 7
    df = df.select(
        "region", "hour_start", "energy_kwh", "readings", day.alias("origin"), F.hour("hour_start").alias("hour"), F.weekday("hour_start").alias("dow"),
        F.col("_1").alias("lag_24h"), F.col("_2").alias("lag_48h"), F.col("_7").alias("lag_168h"), week.alias("prev_week_same_hour_mean"),
    )
    means = grid.groupBy("region", (day + F.expr("interval 1 day")).alias("origin")).agg(F.when(F.count("energy_kwh") >= 24, exact_avg("energy_kwh")).alias("prev_day_mean"))
    return df.join(means, ["region", "origin"], "left")


def split(df: DataFrame, validation: str, test: str) -> DataFrame:
    """Chronological split, and whether all predictors are there."""
    t = F.col("hour_start")
    name = F.when(t < F.lit(validation).cast("timestamp_ntz"), "train").when(t < F.lit(test).cast("timestamp_ntz"), "validation").otherwise("test")
    whole = F.col("energy_kwh").isNotNull()
    for c in NUMERIC:
        whole = whole & F.col(c).isNotNull()
    return df.withColumn("split", name).withColumn("complete", whole)


def leakage(df: DataFrame) -> DataFrame:
    """Per feature: does every source hour end no later than the origin of the target's day?"""
    # A source hour h hours before the target starts there and ends one hour later.
    ends = {"lag_24h": 23, "lag_48h": 47, "lag_168h": 167, "prev_week_same_hour_mean": 23}
    shifted = {k: F.timestamp_add("HOUR", F.lit(-h), F.col("hour_start")) for k, h in ends.items()} | {"prev_day_mean": F.col("origin")}
    safe = [F.bool_and(end <= F.col("origin")).alias(k) for k, end in shifted.items()]
    return df.agg(*safe).unpivot([], list(shifted), "feature", "leak_free")


def availability(df: DataFrame) -> DataFrame:
    """The earliest target hour with a value, per feature."""
    first = [F.min(F.when(F.col(c).isNotNull(), F.col("hour_start"))).alias(c) for c in NUMERIC]
    return df.agg(*first).unpivot([], list(NUMERIC), "feature", "first_hour")


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("complete").alias("usable_rows"), F.min("hour_start").alias("first_target"), F.max("hour_start").alias("last_target"),
        F.count_if(~F.col("complete")).alias("rows_missing"),
    )


def previous_day(df: DataFrame) -> DataFrame:
    """The baseline: the same hour of the day before."""
    kept = df.where("energy_kwh IS NOT NULL AND lag_24h IS NOT NULL")
    return kept.select(*KEYS, "hour", "dow", "energy_kwh", F.col("lag_24h").alias("prediction"))


def metrics(predictions: DataFrame, *keys: str | Column, actual: str = "energy_kwh") -> DataFrame:
    """MAE, RMSE and bias (predicted minus actual), overall or by group."""
    error = F.col("prediction") - F.col(actual)
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), exact_avg(F.abs(error)).alias("mae"), F.sqrt(exact_avg(error * error)).alias("rmse"), exact_avg(error).alias("bias")
    )


def peak_hours(predictions: DataFrame) -> DataFrame:
    """Each region's hour of most energy, the earliest on ties."""
    w = Window.partitionBy("region").orderBy(F.desc("energy_kwh"), "hour_start")
    return predictions.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("region", "hour_start", "energy_kwh", "prediction", F.date_format("hour_start", "EEE HH:mm").alias("label"))


def _products(numbers: tuple[str, ...]) -> list[tuple[str, str]]:
    names = (*numbers, TARGET)
    return [(a, b) for k, a in enumerate(names) for b in names[k:]]


def moments(train: DataFrame, numbers: tuple[str, ...] = NUMERIC) -> DataFrame:
    """What a ridge of any penalty needs of ``train``: counts, sums and sums of products in each cell of the categories.

    One partial aggregate; the result has a row a cell, so at most regions * 24 * 7, however many rows there are.  Sums are
    decimals, so they don't depend on the order of rows.
    """
    sums = [exact_sum(c).alias(f"sum_{c}") for c in (*numbers, TARGET)]
    crossed = [F.sum((F.col(a) * F.col(b)).cast("decimal(28,8)")).cast("double").alias(f"sum_{a}_{b}") for a, b in _products(numbers)]
    return train.groupBy(*CATEGORIES).agg(F.count(F.lit(1)).alias("n"), *sums, *crossed)


@dataclass(frozen=True)
class Ridge:
    """A fitted ridge as plain weights: by number its mean and weight a unit, by category its values' weights."""

    alpha: float
    intercept: float
    numbers: dict[str, tuple[float, float]]
    categories: dict[str, dict[str, float]]

    def prediction(self) -> Column:
        """The prediction as an expression, so scoring stays in the scan's own stage; unknown categories add nothing, a null number gives null."""
        out = F.lit(self.intercept)
        for c, (mean, weight) in self.numbers.items():
            out = out + (F.col(c) - F.lit(mean)) * F.lit(weight)
        for c, weights in self.categories.items():
            if weights:
                known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
                out = out + F.coalesce(F.try_element_at(known, F.col(c).cast("string")), F.lit(0.0))
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a weight."""
        rows = [("intercept", None, None, None, self.intercept, self.alpha)]
        rows += [("number", c, None, mean, weight, self.alpha) for c, (mean, weight) in self.numbers.items()]
        rows += [("category", c, value, None, weight, self.alpha) for c, weights in self.categories.items() for value, weight in weights.items()]
        spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ridge:
        rows = spark.read.schema(WEIGHTS).parquet(path).collect()  # a row a weight
        first = next(r for r in rows if r["part"] == "intercept")
        categories: dict = {}
        for r in rows:
            if r["part"] == "category":
                categories.setdefault(r["name"], {})[r["value"]] = r["weight"]
        return Ridge(first["alpha"], first["weight"], {r["name"]: (r["mean"], r["weight"]) for r in rows if r["part"] == "number"}, categories)


def solved(cells: list, alphas: tuple[float, ...], numbers: tuple[str, ...] = NUMERIC) -> list[Ridge]:
    """A ridge for each penalty (above 0) from the collected cells of ``moments``.

    Numbers are scaled by their mean and sample deviation (a constant one counts as 0), categories are one column a value, the intercept
    has no penalty.  The matrix has a column a number and a category's value, whatever the rows were.
    """
    import numpy as np

    k = len(numbers)
    cells = sorted(cells, key=lambda r: [str(r[c]) for c in CATEGORIES])  # the order they came in doesn't reach the last digit
    n = np.array([r["n"] for r in cells], dtype=float)
    sums = np.array([[r[f"sum_{c}"] for c in (*numbers, TARGET)] for r in cells], dtype=float)
    values = {c: sorted({str(r[c]) for r in cells if r[c] is not None}) for c in CATEGORIES}
    hot = np.array([[float(r[c] is not None and str(r[c]) == v) for c in CATEGORIES for v in values[c]] for r in cells])
    crossed = np.zeros((k + 1, k + 1))
    at = {c: i for i, c in enumerate((*numbers, TARGET))}
    for a, b in _products(numbers):
        crossed[at[a], at[b]] = crossed[at[b], at[a]] = sum(r[f"sum_{a}_{b}"] for r in cells)

    rows = n.sum()
    gram = np.block([[crossed[:k, :k], sums[:, :k].T @ hot], [hot.T @ sums[:, :k], hot.T @ (n[:, None] * hot)]])
    by_target = np.concatenate((crossed[:k, k], hot.T @ sums[:, k]))
    means = np.concatenate((sums[:, :k].sum(0), hot.T @ n)) / rows
    target = sums[:, k].sum() / rows
    gram -= rows * np.outer(means, means)
    by_target -= rows * means * target
    # Differences of the sums' own rounding aren't a spread.
    spread = np.diag(gram)[:k] / max(rows - 1, 1)
    flat = spread <= 1e-12 * np.maximum(np.diag(crossed)[:k] / rows, 1e-300)
    unit = np.concatenate((np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, spread))), np.ones(hot.shape[1])))
    gram, by_target = gram * np.outer(unit, unit), by_target * unit

    out = []
    for alpha in alphas:
        w = unit * np.linalg.solve(gram + alpha * np.eye(len(gram)), by_target)
        weights = iter(w[k:].tolist())
        categories = {c: {v: next(weights) for v in values[c]} for c in CATEGORIES}
        by_number = {c: (float(means[i]), float(w[i])) for i, c in enumerate(numbers)}
        out.append(Ridge(float(alpha), float(target - means[k:] @ w[k:]), by_number, categories))
    return out


def ridge(train: DataFrame, alpha: float, numbers: tuple[str, ...] = NUMERIC) -> Ridge:
    """Scaled numbers and one-hot categories with an L2 penalty ``alpha``; unknown categories are all zeros."""
    return solved(moments(train, numbers).collect(), (alpha,), numbers)[0]


def predict(model: Ridge, df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.col("hour").cast("int").alias("hour"), F.col("dow").cast("int").alias("dow"), TARGET, model.prediction().alias("prediction"))


def select_ridge(df: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> tuple[Ridge, float, list[dict]]:
    """(model, alpha, validation metrics) of the alpha with the least validation MAE.

    One pass over the training part gives the moments all penalties share, and one over the validation part scores all of them.
    """
    models = solved(moments(df.where("split = 'train' AND complete")).collect(), alphas)
    scores = F.array(*[F.struct(F.lit(m.alpha).alias("alpha"), m.prediction().alias("prediction")) for m in models])
    tried = df.where("split = 'validation' AND complete").select(TARGET, F.explode(scores).alias("_")).select(TARGET, "_.alpha", "_.prediction")
    rows = sorted((r.asDict() for r in metrics(tried, "alpha").collect()), key=lambda r: r["alpha"])  # a row an alpha
    best = min(rows, key=lambda r: (r["mae"], r["alpha"]))["alpha"]
    return next(m for m in models if m.alpha == best), best, rows


def ridge_metrics(df: DataFrame, path: str | None = None) -> DataFrame:
    """Metrics and alpha of the selected ridge over the complete test rows; n = 0 and nulls if a part has no complete row.

    The model is chosen on the validation part, frozen in a folder (``path``, or a new one), read back, and only then
    sees the test part.  The features (a row a region and hour) are written once, as four passes read them.
    """
    spark, made = df.sparkSession, new_path(df.sparkSession, "features")
    df.write.parquet(made)
    df = spark.read.schema(df.schema).parquet(made)
    test = df.where("split = 'test' AND complete")
    usable = {r["split"]: r["usable_rows"] for r in split_summary(df).select("split", "usable_rows").collect()}  # three rows
    if not all(usable.get(part) for part in ("train", "validation", "test")):
        empty = test.select(*KEYS, TARGET, F.lit(None).cast("double").alias("prediction")).where(F.lit(False))
        return metrics(empty).withColumn("alpha", F.lit(None).cast("double"))
    model, alpha, _ = select_ridge(df)
    path = path or new_path(spark, "model")
    model.save(spark, path)
    return metrics(predict(Ridge.load(spark, path), test)).withColumn("alpha", F.lit(alpha))
