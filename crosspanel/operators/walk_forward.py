"""Walk-forward ridge scores: features of the pool in force, training dates of the same market state, and a second model within the first one's pool.

The normal equations of a date are sums over its rows, so the rows are read once; a fold's are sums over its dates, of which there are as many as the look back has. Each fold's
system, one row, is solved in a small helper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import series
from ..sources.store import written
from . import selection


def pooled_rows(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """rows(factor, date, ...) of the factors in the pool in force: of the last decision of schedule(date, factor) on or before the row's date; none before the first."""
    return rows.join(selection.active_pool(schedule, rows.select("date")), ["date", "factor"], "left_semi")


def feature_table(rows: DataFrame, schedule: DataFrame, factors: list[str]) -> DataFrame:
    """date, code and a column for each factor, null on dates on which it isn't in the pool; from rows(factor, date, code, x)."""
    kept = pooled_rows(rows, schedule)
    return kept.groupBy("date", "code").agg(*(F.first(F.when(F.col("factor") == f, F.col("x")), ignorenulls=True).alias(f) for f in factors))


def training_dates(dates: DataFrame, lookback: int, gap: int, state: str | None = None, least: int = 4) -> DataFrame:
    """date, train: for each date the dates to train on, the last `lookback` of those before it, the `gap` nearest left out.

    state: a column of dates; training dates are then those of the date's own state, or all where there are fewer than `least` of these or the state is null. Dates with fewer than
    `least` training dates have none. One row for each date and training date.
    """
    at = dates.withColumn("_k", F.row_number().over(Window.orderBy("date")))  # one row for each date
    until = F.col("_k") - gap - 1
    spans = at.where(until >= 1).select("date", *([F.col(state).alias("_s")] if state else []), F.explode(F.sequence(F.greatest(F.lit(1), until - lookback + 1), until)).alias("_k"))
    known = at.select("_k", F.col("date").alias("train"), *([F.col(state).alias("_t")] if state else []))
    pairs = spans.join(F.broadcast(known), "_k").withColumn("_n", F.count("*").over(Window.partitionBy("date"))).where(F.col("_n") >= least)
    if not state:
        return pairs.select("date", "train")
    own = F.coalesce(F.col("_s") == F.col("_t"), F.lit(False))
    same = F.count_if(own).over(Window.partitionBy("date"))
    return pairs.withColumns({"_same": same, "_is": own}).where((F.col("_same") < least) | F.col("_is")).select("date", "train")


def ridge_scores(panel: DataFrame, features: list[str], label: str, folds: DataFrame, penalty: float = 1.0, least_rows: int = 1) -> DataFrame:
    """date, code, score by ridge regression on the folds' training dates; the constant isn't penalised, a null feature counts as 0.

    folds(date, train); dates whose training rows (those with a label) are fewer than least_rows have no scores.
    """
    names = ["_one", *features]
    k = len(names)
    rows = panel.withColumns({"_one": F.lit(1.0), **{f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}})
    known = rows.where(F.col(label).isNotNull())
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col(names[i]) * F.col(label)).alias(f"y{i}") for i in range(k)]
    daily = known.groupBy(F.col("date").alias("train")).agg(*sums)
    total = folds.join(daily, "train").groupBy("date").agg(*(F.sum(c).alias(c) for c in daily.columns if c != "train")).where(F.col("s0_0") >= least_rows)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = np.zeros((len(b), k, k))
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = b[f"s{i}_{j}"]
            y = np.stack([b[f"y{i}"] for i in range(k)], axis=1)
            a += penalty * np.diag([0.0] + [1.0] * (k - 1))
            beta = np.einsum("nij,nj->ni", np.linalg.pinv(a, hermitian=True), y) if len(b) else y
            yield pd.DataFrame({"date": b["date"], "beta": beta.tolist()})

    beta = total.mapInPandas(solve, "date date, beta array<double>")
    score = sum((F.col(n) * F.get("beta", F.lit(i)) for i, n in enumerate(names)), F.lit(0.0))
    return rows.join(beta, "date").select("date", "code", score.alias("score"))


def first_pool(score: Column, share: float = 0.2) -> Column:
    """Whether a row is in the date's best share by score (at least one row, ties by code)."""
    known = Window.partitionBy("date", score.isNull())
    most = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(known) * share))
    return score.isNotNull() & (F.row_number().over(known.orderBy(score.desc(), "code")) <= most)


def standardised_in_pool(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each column clipped at the date's outer hundredths and standardised among the rows given."""
    made = series.with_series(rows, {f"_z{i}": ("winsorz", (n,), (0.01, None)) for i, n in enumerate(names)}, "date", "code")
    return made.select(*[n for n in rows.columns if n not in names], *[F.col(f"_z{i}").alias(n) for i, n in enumerate(names)])


def two_stage(panel: DataFrame, first: str, features: list[str], label: str, lookback: int = 24, gap: int = 1, share: float = 0.2, least_rows: int = 200, least_pool: int = 30, penalty: float = 1.0) -> DataFrame:
    """date, code, in_pool, score: a ridge fitted and applied within the pool of the best first scores.

    Only dates with first scores count. Features and label are standardised within the pool. On dates with a second model codes outside the pool have minus infinity, so that they stay in the ranking;
    dates with a smaller pool than least_pool, or too little to train on, have no rows.
    """
    # Both are read several times: they are written, so that the panel and its sections are made once.
    scored = written(panel.where(F.col(first).isNotNull()).withColumn("in_pool", first_pool(F.col(first), share)), "first_pool")
    pool = written(standardised_in_pool(scored.where("in_pool"), [*features, label]), "second_pool")
    folds = training_dates(scored.select("date").distinct(), lookback, gap)
    large = pool.groupBy("date").count().where(F.col("count") >= least_pool).select("date")
    second = ridge_scores(pool, features, label, folds.join(large, "date", "left_semi"), penalty, least_rows)
    fitted = second.select("date").distinct()
    out = scored.join(fitted, "date", "left_semi").select("date", "code", "in_pool").join(second, ["date", "code"], "left")
    return out.withColumn("score", F.when(F.col("in_pool"), F.col("score")).otherwise(F.lit(float("-inf"))))
