"""Polite requests with retries, for the driver or a Python data source; outside Catalyst."""

from __future__ import annotations

import datetime as dt
import email.utils
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

RETRIABLE = frozenset((429, 500, 502, 503, 504))


def url(base: str, **query: str | int | list[str]) -> str:
    """`base` with a query; lists are joined by commas."""
    flat = {k: ",".join(v) if isinstance(v, list) else v for k, v in query.items() if v is not None}
    return f"{base}?{urllib.parse.urlencode(flat)}" if flat else base


def inclusive_end(end: dt.date, cursor: dt.date | None = None) -> str:
    """Last day of a half-open window, or of the page before `cursor`."""
    return ((cursor or end) - dt.timedelta(days=1)).isoformat()


def retry_after(value: str | None, default: float, now: dt.datetime | None = None) -> float:
    """Seconds that a Retry-After header asks for: a number, or a date, never below 0."""
    if not value:
        return default
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        when = email.utils.parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return default
    return max(0.0, (when - (now or dt.datetime.now(dt.UTC))).total_seconds())


def pause(status: int | None, headers: dict[str, str], attempt: int, factor: float) -> float:
    """Seconds to wait before the next attempt: what 429 asks for, else doubling with jitter; another status can't be retried."""
    if status is not None and status not in RETRIABLE:
        raise ValueError(f"status {status}")
    backoff = factor * 2**attempt * (1 + random.random() / 4)
    return retry_after({k.lower(): v for k, v in headers.items()}.get("retry-after"), backoff) if status == 429 else backoff


def get(address: str, *, headers: dict[str, str] | None = None, attempts: int = 5, factor: float = 0.5, timeout: float = 10.0, sleep: float = 0.0,
        expect: str = "json", opener: Callable = urllib.request.urlopen, wait: Callable[[float], None] = time.sleep) -> bytes:
    """Body of a response of the expected type, after up to `attempts` tries."""
    last: Exception | None = None
    for attempt in range(attempts):
        if sleep:
            wait(sleep)
        try:
            with opener(urllib.request.Request(address, headers=headers or {}), timeout=timeout) as response:
                if expect and expect not in response.headers.get("Content-Type", ""):
                    raise ValueError(f"not {expect}: {response.headers.get('Content-Type')}")
                return response.read()
        except urllib.error.HTTPError as error:
            last = error
            wait(pause(error.code, dict(error.headers or {}), attempt, factor))
        except (urllib.error.URLError, TimeoutError) as error:
            last = error
            wait(pause(None, {}, attempt, factor))
    raise RuntimeError(f"no answer from {address}") from last


def pages_backwards(fetch: Callable[[dt.date], list], oldest_of: Callable[[list], dt.date], start: dt.date, end: dt.date):
    """Pages of entries from the newest on: the next ends the day before the oldest entry, until a page is empty or reaches before `start`."""
    cursor = end
    while True:
        page = fetch(cursor)
        if not page:
            return
        yield page
        oldest = oldest_of(page)
        if oldest < start or oldest >= cursor and oldest <= start:
            return
        cursor = min(oldest, cursor - dt.timedelta(days=1))
