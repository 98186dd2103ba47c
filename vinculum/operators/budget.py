"""Output budgets: the linear size model, its fit, and the estimate."""

from __future__ import annotations

import json
import math
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The size model without calibration, and the limits.
FALLBACK = {"intercept": 500.0, "slope": 60.0}
MARGIN, FLOOR, CEILING = 1.4, 256, 8192


def calibration(path: str | None) -> dict:
    """intercept, slope and source of a calibration file; the fallback where it is missing or malformed."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
        return {**got, "intercept": float(got["intercept"]), "slope": float(got["slope"]), "source": str(path)}
    except (OSError, TypeError, ValueError, KeyError):
        return {**FALLBACK, "source": "fallback"}


def estimate(n: int, model: dict = FALLBACK, margin: float = MARGIN, floor: int = FLOOR, ceiling: int = CEILING) -> int:
    """Budget for n tokens; ValueError for a negative n."""
    if n < 0:
        raise ValueError(f"num_tokens must be >= 0, got {n}")
    return max(floor, min(ceiling, math.ceil((model["intercept"] + model["slope"] * n) * margin)))


def budget(n: Column, model: dict = FALLBACK, margin: float = MARGIN, floor: int = FLOOR, ceiling: int = CEILING) -> Column:
    """Budget for a column of token counts; null for null or negative counts."""
    raw = F.ceil((F.lit(model["intercept"]) + F.lit(model["slope"]) * n) * F.lit(margin))
    return F.when(n >= 0, F.greatest(F.lit(floor), F.least(F.lit(ceiling), raw)).cast("int"))


def usable(samples: DataFrame, ceiling: int = 8000) -> DataFrame:
    """Samples fit for calibration: no error, usage reported, not truncated at the ceiling (error, completion_tokens)."""
    return samples.where(F.col("error").isNull() & (F.col("completion_tokens") > 0) & (F.col("completion_tokens") < ceiling))


def fit_line(samples: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """intercept, slope, sample_size, max_residual by least squares; null where there are fewer than two different x."""
    keys = by or []
    fit = samples.groupBy(*keys).agg(F.regr_intercept(y, x).alias("i"), F.regr_slope(y, x).alias("s"), F.count(F.lit(1)).alias("sample_size"), F.count_distinct(x).alias("xs"))
    fit = fit.withColumn("intercept", F.when(F.col("xs") >= 2, F.col("i"))).withColumn("slope", F.when(F.col("xs") >= 2, F.col("s"))).drop("i", "s", "xs")
    joined = samples.join(fit, keys) if keys else samples.join(F.broadcast(fit))  # without keys it is one row
    worst = joined.groupBy(*keys, "intercept", "slope", "sample_size").agg(F.max(F.abs(F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x)))).alias("max_residual"))
    return worst


def calibrate(samples: DataFrame, path: str, model: str, x: str = "num_tokens", y: str = "completion_tokens") -> dict:
    """Fits the usable samples and writes the record with the time it was made; ValueError for fewer than two usable samples."""
    rows = usable(samples)
    if rows.limit(2).count() < 2:
        raise ValueError("calibration needs at least 2 usable samples")
    fit = fit_strict(rows, x, y)
    record = {"intercept": fit["intercept"], "slope": fit["slope"], "sample_size": fit["sample_size"], "model": model, "calibrated_at": datetime.now().isoformat()}
    Path(path).write_text(json.dumps(record, indent=2) + "\n", encoding="utf-8")
    return record


def fit_strict(samples: DataFrame, x: str, y: str) -> dict:
    """The fit as a calibration record; ValueError for fewer than two different x."""
    row = fit_line(samples, x, y).first()
    if row is None or row.slope is None:
        raise ValueError("need at least 2 distinct sizes to fit a line")
    return row.asDict()
