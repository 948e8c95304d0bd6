"""News arrival: durations, autoregressive conditional durations, and intensities by firm and year."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIER_1_EVENTS, TIER_2_EVENTS, MOST_PERSISTENT = 200, 50, 0.99
EVENTS = "cik string, session string, trading_day date, intensity double, tier int"


def firm_day_counts(articles: DataFrame) -> DataFrame:
    """(cik, session, trading_day, daily_article_count): articles by firm, session and day, each article once a firm."""
    each = articles.where("trading_day is not null and session is not null").select("article_id", "session", "trading_day", F.explode(F.array_distinct("cik_list")).alias("cik"))
    return each.where("cik is not null").distinct().groupBy("cik", "session", "trading_day").agg(F.count("*").alias("daily_article_count"))


def selection_panel(counts: DataFrame, universe: DataFrame) -> DataFrame:
    """Every (cik, trading_day) of the universe twice, by session, with its article count, 0 if none, and the days since the last article day."""
    from panelforge.operators.temporal import days_since_last

    durations = days_since_last(counts, ["cik", "session"], "trading_day")
    sessions = universe.select("cik", "trading_day").distinct().withColumn("session", F.explode(F.array(F.lit("intraday"), F.lit("overnight"))))
    return sessions.join(durations, ["cik", "session", "trading_day"], "left").withColumn("daily_article_count", F.coalesce("daily_article_count", F.lit(0)))


def expected_durations(x: np.ndarray, omega: float, alpha: float, beta: float, first: float) -> np.ndarray:
    """psi[0] = first, psi[t] = omega + alpha x[t-1] + beta psi[t-1]."""
    psi = np.empty(len(x))
    now = first
    for t in range(len(x)):
        psi[t] = now
        now = omega + alpha * x[t] + beta * now
    return psi


def _loss(theta: np.ndarray, x: np.ndarray, with_beta: bool) -> float:
    omega, alpha, beta = _parameters(theta, with_beta)
    psi = expected_durations(x, omega, alpha, beta, omega / max(1e-9, 1 - alpha - beta))
    return float(np.mean(np.log(psi) + x / psi)) if np.all(psi > 0) else np.inf


def _parameters(theta: np.ndarray, with_beta: bool) -> tuple[float, float, float]:
    """Positive omega, and alpha, beta with a sum below 1, from free numbers."""
    omega = float(np.exp(np.clip(theta[0], -20, 10)))
    parts = np.exp(np.clip(theta[1:], -20, 20))
    shares = parts / (1 + parts.sum())
    return omega, float(shares[0]), float(shares[1]) if with_beta else 0.0


def fit_durations(x: np.ndarray, with_beta: bool, start: tuple[float, float, float] = (0.1, 0.3, 0.6), steps: int = 200) -> tuple[float, float, float] | None:
    """(omega, alpha, beta) of the exponential quasi-likelihood by a quasi-Newton search on free parameters; None if it doesn't settle."""
    omega, alpha, beta = start
    theta = np.array([np.log(omega), np.log(alpha / 0.1), np.log(beta / 0.1)] if with_beta else [np.log(1 - alpha), np.log(alpha / (1 - alpha))])

    def gradient(at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for i in range(len(at)):
            step = np.zeros(len(at))
            step[i] = 1e-5
            out[i] = (_loss(at + step, x, with_beta) - _loss(at - step, x, with_beta)) / 2e-5
        return out

    inverse, now, slope = np.eye(len(theta)), _loss(theta, x, with_beta), gradient(theta)
    for _ in range(steps):
        if np.linalg.norm(slope) < 1e-4:
            return _parameters(theta, with_beta)
        direction = -inverse @ slope
        if direction @ slope >= 0:
            inverse, direction = np.eye(len(theta)), -slope
        length = 1.0
        while length > 1e-8 and not _loss(theta + length * direction, x, with_beta) <= now + 1e-4 * length * (direction @ slope):
            length /= 2
        if length <= 1e-8:
            return _parameters(theta, with_beta) if np.linalg.norm(slope) < 1e-2 else None
        step = length * direction
        theta = theta + step
        fresh = gradient(theta)
        change = fresh - slope
        if step @ change > 1e-12:
            rho, unit = 1 / (step @ change), np.eye(len(theta))
            inverse = (unit - rho * np.outer(step, change)) @ inverse @ (unit - rho * np.outer(change, step)) + rho * np.outer(step, step)
        slope, now = fresh, _loss(theta, x, with_beta)
    return None


def firm_intensities(group: pd.DataFrame) -> pd.DataFrame:
    """Intensity of a firm's session on every event day by the richest model that its events allow; without one, 0 on every row."""
    group = group.sort_values("trading_day")
    events = group[group["duration_days"].notna() & (group["duration_days"] > 0)]
    x = events["duration_days"].to_numpy(dtype=float)
    for tier, least, with_beta in ((1, TIER_1_EVENTS, True), (2, TIER_2_EVENTS, False)):
        if len(x) < least:
            continue
        mean = x.mean()
        fitted = fit_durations(x / mean, with_beta)
        if fitted and fitted[1] + fitted[2] < MOST_PERSISTENT:
            omega, alpha, beta = fitted[0] * mean, fitted[1], fitted[2]
            psi = expected_durations(x, omega, alpha, beta, omega / (1 - alpha - beta))
            return events[["cik", "session", "trading_day"]].assign(intensity=1 / psi, tier=tier)
    return group[["cik", "session", "trading_day"]].assign(intensity=0.0, tier=3)


def event_intensities(panel: DataFrame) -> DataFrame:
    """One row for each event of a firm's session; a group has at most one row for each trading day."""
    return panel.select("cik", "session", "trading_day", "duration_days").groupBy("cik", "session").applyInPandas(firm_intensities, EVENTS)


def firm_year_intensity(events: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean intensity, rows and true events by firm, session and year."""
    year = F.year("trading_day").alias("year")
    fitted = events.groupBy("cik", "session", year).agg(F.avg("intensity").alias("mean_intensity"), F.count("*").alias("n_events_year"))
    real = panel.groupBy("cik", "session", year).agg(F.count(F.when(F.col("duration_days") > 0, 1)).alias("n_true_events"))
    return fitted.join(real, ["cik", "session", "year"], "left")


def recursion_by_aggregate(durations: DataFrame, keys: list[str], order: str, x: str, omega: float, alpha: float, beta: float) -> DataFrame:
    """(keys, order, psi) of the recursion with given parameters, inside the JVM: the ordered durations of a key are folded once."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"))))
    fold = F.expr(f"""aggregate(_rows, named_struct('now', {omega / (1 - alpha - beta)}D, 'psi', cast(array() as array<double>)),
        (s, r) -> named_struct('now', {omega}D + {alpha}D * r.x + {beta}D * s.now, 'psi', concat(s.psi, array(s.now))), s -> s.psi)""")
    folded = durations.where(F.col(x) > 0).groupBy(*keys).agg(rows.alias("_rows")).withColumn("_psi", fold)
    return folded.select(*keys, F.explode(F.arrays_zip("_rows", "_psi")).alias("z")).select(*keys, F.col("z._rows.o").alias(order), F.col("z._psi").alias("psi"))
