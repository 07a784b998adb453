"""A plain model of a backtest on small panels, used to check the Spark plan. It walks over days and keeps one book."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np

START = datetime(2023, 1, 1)


def random_panel(seed: int, n_days: int = 70, n_assets: int = 8, midday: bool = False):
    """Prices and predictions with gaps, ties, stale assets, a NaN and a stretch without any listed asset."""
    rng = random.Random(seed)
    shift = timedelta(hours=12) if midday else timedelta()
    prices, scores = [], []
    for asset in (f"A{i}" for i in range(n_assets)):
        level = 100.0
        for day in range(n_days):
            level *= 1 + rng.uniform(-0.2, 0.2)
            dark = 30 <= day < 34 and seed % 2 == 0
            if rng.random() < 0.8 and not dark:
                prices.append((START + timedelta(days=day) + shift, asset, level))
            if rng.random() < 0.3:
                scores.append((START + timedelta(days=day), asset, float(rng.randint(0, 5))))
    when, asset, _ = prices[len(prices) // 2]
    prices[len(prices) // 2] = (when, asset, float("nan"))
    return prices, scores


def side_shares(ranked: list[str], power: float) -> dict[str, float]:
    ladder = np.power(np.arange(len(ranked), 0, -1) / max(len(ranked), 1), max(power, 1e-6))
    return dict(zip(ranked, ladder / ladder.sum())) if ranked else {}


def target_book(scores: dict[str, float], n_long: int, n_short: int, gross: float, power: float) -> dict[str, float]:
    order = [a for _, a in sorted((-s, a) for a, s in scores.items())]
    longs = order[:n_long]
    shorts = order[max(len(longs), len(order) - n_short):][::-1]
    held = len(longs) + len(shorts)
    if not held or gross <= 0:
        return {}
    book = {a: gross * len(longs) / held * s for a, s in side_shares(longs, power).items()}
    book.update({a: -gross * len(shorts) / held * s for a, s in side_shares(shorts, power).items()})
    return book


def expected_daily(prices, scores, n_long, n_short, gross, every, power, lag=1, cost=0.0054, capital=100_000.0,
                   start=None, end=None):
    """``(rows, books)``: rows of date, returns, equity, drawdown, turnover; books by rebalance date."""
    returns: dict[datetime, dict[str, float]] = {}
    last: dict[str, float] = {}
    for when, asset, close in sorted(prices):
        today = returns.setdefault(when, {})
        if asset in last and last[asset] != 0 and np.isfinite(close) and np.isfinite(last[asset]):
            today[asset] = close / last[asset] - 1
        last[asset] = close
    opening = min(w for w, _, _ in scores) + timedelta(days=lag)
    calendar = [w for w in sorted(returns) if w >= opening and (start is None or w >= start) and (end is None or w <= end)]

    equity = high = capital
    book: dict[str, float] = {}
    rows, books = [], {}
    for today in calendar:
        earned = sum(w * returns[today].get(a, 0.0) for a, w in book.items())
        equity *= 1 + earned
        high = max(high, equity)
        fall, moved = (equity - high) / high, 0.0
        gap = today - calendar[0]
        if gap.seconds == 0 and gap.days % every == 0:
            newest: dict[str, tuple] = {}
            for when, asset, score in scores:
                if when <= today - timedelta(days=lag) and asset in returns[today]:
                    newest[asset] = max(newest.get(asset, (when, score)), (when, score))
            fresh = target_book({a: s for a, (_, s) in newest.items()}, n_long, n_short, gross, power)
            moved = sum(abs(fresh.get(a, 0.0) - book.get(a, 0.0)) for a in {*fresh, *book})
            equity *= 1 - moved * cost
            book = books[today] = fresh
        rows.append((today, earned, equity, fall, moved))
    return rows, books
