"""Composite insight of a company from its partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.functions import constants as K


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def signal(rows: DataFrame) -> DataFrame:
    """Adds signal_score, signal and signal_confidence to rows with
    forecast_confidence, sharpe_ratio, sentiment, severity and alpha; what is
    missing counts as neutral."""
    c = F.col
    sev = F.lit(0.5)
    for s, v in K.SEVERITY_SCORES.items():
        sev = F.when(c("severity") == s, v).otherwise(sev)
    w = K.SIGNAL_WEIGHTS
    score = (
        w["forecast"] * F.coalesce(c("forecast_confidence"), F.lit(0.5))
        + w["risk"] * clip((F.coalesce(c("sharpe_ratio"), F.lit(0.0)) + 2) / 4)
        + w["sentiment"] * (F.coalesce(c("sentiment"), F.lit(0.0)) + 1) / 2
        + w["anomaly"] * sev
        + w["factor"] * clip(F.coalesce(c("alpha"), F.lit(0.0)) + 0.5)
    )
    r = rows.withColumn("signal_score", score)
    s = c("signal_score")
    kind = F.when(s > 0.65, "BUY").when(s > 0.35, "HOLD").otherwise("SELL")
    confidence = F.when(s > 0.65, s).when(s > 0.35, 1 - F.abs(s - 0.5) * 2).otherwise(1 - s)
    return r.withColumns({"signal": kind, "signal_confidence": clip(confidence)})


def drivers(rows: DataFrame) -> DataFrame:
    """Up to five texts of what drives the signal, in a fixed order."""
    c = F.col
    texts = F.array(
        F.when(c("forecast_growth") > 0.1, F.concat(F.lit("Strong growth forecast: "), F.format_string("%.1f%%", c("forecast_growth") * 100))),
        F.when(c("sharpe_ratio") > 1, F.concat(F.lit("Attractive risk-adjusted returns: Sharpe "), F.format_string("%.2f", c("sharpe_ratio")))),
        F.when(c("sentiment") > 0.3, F.lit("Positive sentiment in filings")),
        F.when(F.abs("alpha") > 0.05, F.concat(F.lit("Expected alpha "), F.format_string("%.1f%%", c("alpha") * 100))),
        F.when(c("percentile") > 75, F.lit("Top quartile among peers")),
    )
    return rows.withColumn("key_drivers", F.slice(F.array_compact(texts), 1, 5))


def warnings(rows: DataFrame) -> DataFrame:
    """Up to five texts of what to watch; the worst stress is the greatest loss."""
    c = F.col
    texts = F.array(
        F.when(c("var_95") > 0.05, F.concat(F.lit("High value at risk: "), F.format_string("%.1f%%", c("var_95") * 100))),
        F.when(c("max_drawdown") > 0.3, F.concat(F.lit("Severe drawdown: "), F.format_string("%.1f%%", c("max_drawdown") * 100))),
        F.when(c("severity").isin("high", "critical"), F.concat(F.lit("Anomalies of severity "), c("severity"))),
        F.when(c("sentiment") < -0.3, F.lit("Negative sentiment in filings")),
        F.when(c("worst_stress") > 0.5, F.concat(F.lit("Worst stress loss "), F.format_string("%.1f%%", c("worst_stress") * 100))),
    )
    return rows.withColumn("risk_warnings", F.slice(F.array_compact(texts), 1, 5))


def insights(parts: list[DataFrame], key: str = "ticker") -> DataFrame:
    """Partial results (one row per key each) as one record per key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "left")
    for name, kind in (("forecast_confidence", "double"), ("forecast_growth", "double"), ("sharpe_ratio", "double"), ("sentiment", "double"), ("severity", "string"), ("alpha", "double"), ("percentile", "double"), ("var_95", "double"), ("max_drawdown", "double"), ("worst_stress", "double")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return warnings(drivers(signal(out)))
