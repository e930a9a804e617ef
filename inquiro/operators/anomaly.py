"""Isolation forest over the eight features, and latest results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inquiro.functions import normalize as N
from inquiro.operators.features import FEATURES, with_reasons
from inquiro.storage import materialize

TREES, SAMPLE, MODEL = 100, 256, "isolation-forest-v1"


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int = 0, most: int = 8):
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth < most else []
    if not len(spread):
        return len(x)
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return f, cut, _grow(x[left], rng, depth + 1, most), _grow(x[~left], rng, depth + 1, most)


def _depths(tree, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), depth + _path(tree))
    f, cut, low, high = tree
    out, left = np.empty(len(x)), x[:, f] < cut
    if left.any():
        out[left] = _depths(low, x[left], depth + 1)
    if not left.all():
        out[~left] = _depths(high, x[~left], depth + 1)
    return out


def _samples(features: DataFrame, trees: int, sample: int, seed: int) -> list[np.ndarray]:
    """The rows of each tree: those whose hash with the tree's number is least,
    out of all rows. Hash thresholds leave about 4 x sample rows a tree for
    the driver to choose from, whatever the number of rows."""
    n = features.count()
    if not n:
        return []
    share = min(1.0, 4 * sample / n)
    draw = F.pmod(F.xxhash64("person", F.col("tree"), F.lit(seed)), F.lit(1 << 30))
    near = features.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("draw", draw).filter(F.col("draw") < int(share * (1 << 30)))
    rows = near.select("tree", "draw", "person", *FEATURES).toPandas().sort_values(["tree", "draw", "person"])
    return [g[list(FEATURES)].to_numpy(dtype=float)[:sample] for _, g in rows.groupby("tree")]


def isolation_forest(features: DataFrame, *, trees: int = TREES, sample: int = SAMPLE, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """(person, anomaly, severity, reasons, model_version) of each row of
    features(person, the eight features).

    Each tree grows on `sample` rows drawn from all; every row is scored
    where it lies, min-max over all. With one row, or all rows equal, scores
    are 0 and the reason says so. Contamination bounds are checked; it does
    not change scores.
    """
    if not 0.0 < contamination <= 0.5:
        raise ValueError("INVALID_CONTAMINATION")
    features = materialize(features.select("person", *[F.when(F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == float("inf")), 0.0).otherwise(F.col(f)).alias(f) for f in FEATURES]))
    ends = features.agg(F.count("*").alias("n"), *[(F.max(f) - F.min(f)).alias(f) for f in FEATURES]).first()
    why = "single entity" if ends.n == 1 else "constant features" if ends.n and not any(ends[f] for f in FEATURES) else None
    if why:
        return features.select("person", F.lit(0.0).alias("anomaly"), F.lit("LOW").alias("severity"), F.array(F.lit(f"Insufficient data for anomaly detection ({why})")).alias("reasons"), F.lit(MODEL).alias("model_version"))
    rng = np.random.default_rng(seed)
    drawn = _samples(features, trees, sample, seed)
    size = max(map(len, drawn), default=0)
    most = max(1, math.ceil(math.log2(max(2, size))))
    forest = [_grow(x, rng, 0, most) for x in drawn]
    sent = features.sparkSession.sparkContext.broadcast((forest, _path(size)))

    def score(frames):
        forest, usual = sent.value
        for pdf in frames:
            x = pdf[list(FEATURES)].to_numpy(dtype=float)
            d = sum((_depths(t, x) for t in forest), np.zeros(len(x))) / max(1, len(forest))
            yield pd.DataFrame({"person": pdf.person, "raw": 2 ** (-d / usual)})

    raw = materialize(features.mapInPandas(score, "person string, raw double"))
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    spread = (ends.hi - ends.lo) if ends.hi is not None else 0.0
    scored = raw.select("person", N.score((F.col("raw") - F.lit(ends.lo or 0.0)) / F.lit(spread) if spread else F.lit(0.0)).alias("anomaly"))
    return with_reasons(features).select("person", "reasons").join(scored, "person").select("person", "anomaly", N.severity(F.col("anomaly")).alias("severity"), "reasons", F.lit(MODEL).alias("model_version"))


def latest(results: DataFrame) -> DataFrame:
    """The newest row of each entity; later id wins a tie."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), F.desc("id"))
    return results.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def filtered(results: DataFrame, *, entity_id: str | None = None, severity: str | None = None, min_score: float | None = None) -> DataFrame:
    """Of the latest results(entity_id, created_at, id, score, severity,
    reason) those that fit, with the reasons as a list, by score and id."""
    if severity not in (None, "LOW", "MEDIUM", "HIGH"):
        raise ValueError("INVALID_FILTER: severity")
    rows = latest(results.filter(F.col("entity_id") == entity_id) if entity_id else results)
    rows = rows.filter(F.col("severity") == severity) if severity else rows
    rows = rows.filter(F.col("score") >= min_score) if min_score is not None else rows
    reasons = F.when(F.coalesce("reason", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("reason", "; "))
    return rows.withColumn("reasons", reasons).drop("reason").orderBy(F.desc("score"), "entity_id")
