"""Ranking formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sessionlens import constants as K


def recency_multiplier(
    last: Column, now: Column, weight: float = K.RECENCY_WEIGHT, decay_days: float = K.RECENCY_DECAY_DAYS
) -> Column:
    """1 + weight * exp(-age / decay); no bonus without an activity time."""
    if weight <= 0 or decay_days <= 0:
        return F.lit(1.0)
    days = (F.unix_micros(now) - F.unix_micros(last)) / F.lit(86_400_000_000.0)
    boost = F.lit(1.0) + F.lit(weight) * F.exp(-F.greatest(F.lit(0.0), days) / F.lit(decay_days))
    return F.when(last.isNull(), F.lit(1.0)).otherwise(boost)


def kind_weight(kind: Column, weights: dict[int, float] | None = None) -> Column:
    expression = None
    for code, weight in (weights or K.KIND_WEIGHTS).items():
        hit = kind == code
        expression = F.when(hit, F.lit(weight)) if expression is None else expression.when(hit, F.lit(weight))
    return expression.otherwise(F.lit(K.OTHER_WEIGHT))


def idf(n_chunks: Column, df: Column) -> Column:
    """Inverse document frequency, floored so that a frequent term never scores negative."""
    return F.greatest(F.ln((n_chunks - df + 0.5) / (df + 0.5)), F.lit(K.IDF_FLOOR))


def bm25(tf: Column, length: Column, mean_length: Column, idf_value: Column) -> Column:
    norm = F.lit(K.BM25_K1) * (F.lit(1.0 - K.BM25_B) + F.lit(K.BM25_B) * length / mean_length)
    return idf_value * tf * (K.BM25_K1 + 1.0) / (tf + norm)
