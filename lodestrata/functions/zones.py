"""Versioned zone transition tables and vectorised conversion of wall-clock times to UTC."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import TZPATH, ZoneInfo

import numpy as np

FIRST_YEAR, LAST_YEAR = 1800, 2501
#: From 2038 on a zone's rules are periodic, and the calendar repeats every 400 years to the weekday.
PERIOD = 146_097 * 86_400
PERIODIC_FROM = int((datetime(LAST_YEAR - 402, 1, 1) - datetime(1970, 1, 1)).total_seconds())


@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone: ``offsets[i]`` holds from wall second ``starts[i - 1]`` on; times beyond the table are read in its last 400 years.

    A wall time that occurs twice falls before the boundary (its first occurrence) and one that
    is skipped keeps the old offset, which moves it forward by the length of the gap.
    """

    name: str
    version: str
    starts: np.ndarray
    offsets: np.ndarray
    abbreviations: dict[str, int]

    def to_utc(self, wall_seconds: np.ndarray) -> np.ndarray:
        later = np.maximum(0, -((PERIODIC_FROM + PERIOD - 1 - wall_seconds) // PERIOD)) if len(wall_seconds) else wall_seconds
        return wall_seconds - self.offsets[np.searchsorted(self.starts, wall_seconds - later * PERIOD, side="right")]


def tzdata_version() -> str:
    """The version of the zone database in use."""
    for folder in TZPATH:
        try:
            with open(f"{folder}/tzdata.zi") as f:
                return f.readline().split()[-1]
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=1024)
def zone_table(name: str) -> ZoneTable | None:
    """The transition table of a zone, None if there is no such zone."""
    try:
        zone = ZoneInfo(name)
    except Exception:  # unknown or malformed key
        return None
    utc = timezone.utc

    def state(t: datetime) -> tuple[int, str]:
        local = t.astimezone(zone)
        return int(local.utcoffset().total_seconds()), local.tzname() or ""

    at, end = datetime(FIRST_YEAR, 1, 1, tzinfo=utc), datetime(LAST_YEAR, 1, 1, tzinfo=utc)
    step, now = timedelta(days=7), state(at)
    starts, offsets, names = [], [now[0]], {now[1]: now[0]}
    while at < end:
        after = at + step
        later = state(after)
        if later != now:
            low, high = at, after
            while high - low > timedelta(seconds=1):
                middle = (low + (high - low) / 2).replace(microsecond=0)
                if state(middle) == now:
                    low = middle
                else:
                    high = middle
            later = state(high)
            if later[0] != now[0]:
                starts.append(int(high.timestamp()) + max(now[0], later[0]))
                offsets.append(later[0])
            names[later[1]] = later[0]
            now, after = later, high
        at = after
    return ZoneTable(name, tzdata_version(), np.array(starts, "i8"), np.array(offsets, "i8"), names)
