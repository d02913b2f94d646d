"""Factors chosen by what they add to those chosen before, groups of features that move together, and what a model loses without a group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.series import average_ranks, rank_correlation
from . import ic, pure_ic


def residual_stats(rows: DataFrame, names: list[str], basis: list[str], least: int = 30) -> DataFrame:
    """Statistics of the coefficients of the named factors, freed of the basis factors date by date (a code needs a value of each); of the factors as they are without a basis.

    rows: factor, date, code, x, fwd. A section needs `least` codes and five more than the basis has factors. All names are regressed in one pass.
    """
    wanted = rows.where(F.col("factor").isin(names)).select("factor", "date", "code", "x", "fwd")
    if basis:
        wide = rows.where(F.col("factor").isin(basis)).groupBy("date", "code").agg(*(F.first(F.when(F.col("factor") == b, F.col("x")), ignorenulls=True).alias(f"_basis{i}") for i, b in enumerate(basis))).dropna()
        columns = [f"_basis{i}" for i in range(len(basis))]
        freed = pure_ic.residuals(wanted.join(wide, ["date", "code"]), ["x"], columns, least=max(least, len(basis) + 5))
        wanted = freed.select("factor", "date", "code", F.round("x_res", 9).alias("x"), "fwd")
    return ic.ic_stats(ic.ic_series(wanted, "x", "fwd", least, ("factor", "date")), "factor")


def gram_schmidt_selection(rows: DataFrame, stats: DataFrame, most: int = 30, least_ic: float = 0.015, least_icir: float = 0.15, first_ic: float = 0.02, first_icir: float = 0.2, first_t: float = 2.0, least: int = 30, batch: int = 16) -> DataFrame:
    """factor, place, ic_mean, icir, verdict of every factor of stats(factor, ic_mean, icir, t_stat).

    Those that pass the first limits are tried by falling |ICIR|, then |mean|, then name: a factor is kept if its coefficients, freed of all kept
    before it, are above the second limits; at most `most` are kept. ic_mean and icir are those of the residual, null where it wasn't tried. Verdicts: kept, weak (first limits), redundant, full.

    Which factors come next depends on those kept, so there is a job for each kept factor and each batch without one, over all rows; the driver holds names and statistics only.
    """
    listed = stats.select("factor", "ic_mean", "icir", "t_stat").toPandas()  # a row for each factor of the registry
    strong = listed[(listed.ic_mean.abs() >= first_ic) & (listed.icir.abs() >= first_icir) & ((listed.t_stat.abs() >= first_t) | listed.t_stat.isna())]
    order = strong.assign(a=-strong.icir.abs(), b=-strong.ic_mean.abs()).sort_values(["a", "b", "factor"])["factor"].tolist()
    verdicts = {f: (None, None, None, "weak") for f in listed.factor if f not in set(order)}
    kept: list[str] = []
    while order and len(kept) < most:
        tried = order[:batch]
        found = {r["factor"]: r for r in residual_stats(rows, tried, kept, least).collect()}
        for f in tried:
            order.remove(f)
            r = found.get(f)
            if r is not None and abs(r["ic_mean"]) > least_ic and abs(r["icir"]) > least_icir:
                kept.append(f)
                verdicts[f] = (len(kept), r["ic_mean"], r["icir"], "kept")
                break  # those behind it meet a larger basis
            verdicts[f] = (None, *((r["ic_mean"], r["icir"]) if r is not None else (None, None)), "redundant")
    verdicts |= {f: (None, None, None, "full") for f in order}
    return rows.sparkSession.createDataFrame([(f, *v) for f, v in verdicts.items()], "factor string, place int, ic_mean double, icir double, verdict string")


def feature_correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """a, b, corr of every two features over all rows that have both; 0 where it isn't defined. One pass of sums for all pairs."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    both = lambda i, j: F.col(features[i]).isNotNull() & F.col(features[j]).isNotNull()
    corr = lambda i, j: F.corr(F.when(both(i, j), F.col(features[i])), F.when(both(i, j), F.col(features[j])))
    cells = F.array(*(F.struct(F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"), F.col(f"_{i}_{j}").alias("corr")) for i, j in pairs))
    sums = rows.agg(*(corr(i, j).alias(f"_{i}_{j}") for i, j in pairs)) if pairs else None
    if sums is None:
        return rows.sparkSession.createDataFrame([], "a string, b string, corr double")
    return sums.select(F.explode(cells).alias("o")).select("o.a", "o.b", F.when(F.isnan("o.corr"), 0.0).otherwise(F.coalesce("o.corr", F.lit(0.0))).alias("corr"))


def average_linkage(names: list[str], distance: np.ndarray, limit: float) -> list[list[str]]:
    """Groups of names joined as long as the mean distance between two groups isn't above the limit, the nearest two first (of equally near ones the first by name).

    Groups come by falling size, then by their names.
    """
    groups = [[n] for n in names]
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        if d[i, j] > limit:
            break
        a, b = len(groups[i]), len(groups[j])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        groups[i] += groups.pop(j)
    return sorted((sorted(g) for g in groups), key=lambda g: (-len(g), g))


def clustered_features(rows: DataFrame, features: list[str], threshold: float = 0.7) -> DataFrame:
    """cluster (C01, C02, ...), feature: average linkage by 1 - |corr|; only the small matrix goes to the driver."""
    names = sorted(features)
    at = {n: i for i, n in enumerate(names)}
    distance = np.ones((len(names), len(names)))
    for r in feature_correlations(rows, names).collect():
        distance[at[r["a"]], at[r["b"]]] = distance[at[r["b"]], at[r["a"]]] = 1 - min(abs(r["corr"]), 1.0)
    groups = average_linkage(names, distance, 1 - threshold)
    return rows.sparkSession.createDataFrame([(f"C{k:02d}", f) for k, g in enumerate(groups, 1) for f in g], "cluster string, feature string")


def cluster_importance(rows: DataFrame, betas: dict[str, float], clusters: DataFrame, label: str, repeats: int = 10, seed: int = 42, least: int = 30) -> DataFrame:
    """cluster, importance, n_features: how far the mean rank correlation of a linear score with the label falls if the cluster's features are taken from another code of the date.

    A cluster's part of the score moves as a whole: rows of a date are put in an order by a seeded hash of their code, the same for all clusters
    in a repeat, and each takes the part of the row at its place by code. A run again gives the same result. rows: date, code, label, features; a null feature counts as 0.
    """
    groups: dict[str, list[str]] = {}
    for r in clusters.collect():  # a row for each feature
        groups.setdefault(r["cluster"], []).append(r["feature"])
    part = lambda names: sum((F.coalesce(F.col(f), F.lit(0.0)) * betas[f] for f in names if f in betas), F.lit(0.0))
    names = sorted(groups)
    turns = [F.xxhash64(F.lit(seed), F.lit(t), "code").alias(f"_h{t}") for t in range(1, repeats + 1)]
    known = rows.where(F.col(label).isNotNull() & F.col("code").isNotNull()).select("date", "code", F.col(label).cast("double").alias("y"), part(sorted(betas)).alias("score"), *(part(groups[n]).alias(f"_p{i}") for i, n in enumerate(names)), *turns)

    def correlate(section: pa.Table) -> pa.Table:
        """A date's rows, moved once for each cluster and turn: so many coefficients leave the task, and no row is copied."""
        section = section.take(pc.sort_indices(section, sort_keys=[("code", "ascending")]))
        column = lambda n: section.column(n).to_numpy()
        y, score = average_ranks(column("y")), column("score")
        out = [(None, 0, rank_correlation(average_ranks(score), y))] if len(y) >= least else []
        for t in range(1, repeats + 1 if out else 1):
            order = np.argsort(column(f"_h{t}"), kind="stable")
            for i, n in enumerate(names):
                own = column(f"_p{i}")
                given = np.empty_like(own)
                given[order] = own
                out.append((n, t, rank_correlation(average_ranks(score - own + given), y)))
        return pa.table({"cluster": pa.array([o[0] for o in out], pa.string()), "turn": pa.array([o[1] for o in out], pa.int32()), "ic": pa.array([o[2] for o in out], pa.float64())})

    ics = known.groupBy("date").applyInArrow(correlate, "cluster string, turn int, ic double")
    means = ics.groupBy("cluster", "turn").agg(F.coalesce(F.avg("ic"), F.lit(0.0)).alias("left")).groupBy("cluster").agg(F.avg("left").alias("left"))
    found = {r["cluster"]: r["left"] for r in means.collect()}  # a row for each cluster, and one for all as they are
    base = found.get(None, 0.0)
    out = [(n, base - found[n] if n in found else 0.0, sum(f in betas for f in groups[n])) for n in names]
    return rows.sparkSession.createDataFrame(out, "cluster string, importance double, n_features long")
