"""Mixed timestamp texts to UTC microseconds.

Method: every value is tokenised into a character-class shape mask; each distinct mask is mapped
to a parser once per worker; all values of one mask are then converted together with numpy through
versioned zone transition tables (``functions.zones``).

Defined results: null, blank and unparsable values and impossible dates give null; a zone in the
value wins over the feed's zone; an unknown or missing feed zone counts as UTC; a missing date
order counts as YMD; wall times that occur twice mean the first occurrence and skipped ones move
forward by the gap; digits beyond microseconds are dropped; absent parts are zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.zones import ZoneTable, zone_table
from lodestrata.session import bounded_broadcast

MONTHS = {
    name: number
    for number, names in enumerate(
        (
            "january jan januar jänner janvier janv enero ene",
            "february feb februar février févr febrero",
            "march mar märz mär mrz mars marzo",
            "april apr avril avr abril abr",
            "may mai mayo",
            "june jun juni juin junio",
            "july jul juli juillet juil julio",
            "august aug août agosto ago",
            "september sep sept septembre septiembre",
            "october oct oktober okt octobre octubre",
            "november nov novembre noviembre",
            "december dec dezember dez décembre déc diciembre dic",
        ),
        1,
    )
    for name in names.split()
}
WEEKDAYS = {
    w
    for w in (
        "mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday "
        "mo di mi do fr sa so montag dienstag mittwoch donnerstag freitag samstag sonntag "
        "lundi mardi mercredi jeudi vendredi samedi dimanche lun mar mer jeu ven sam dim "
        "lunes martes miércoles jueves viernes sábado domingo mié jue vie sáb dom"
    ).split()
}
#: Offsets in seconds of zone abbreviations, used where the feed's own zone doesn't know one.
ABBREVIATIONS = {
    name: int(hours * 3600)
    for name, hours in {
        "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "MEZ": 1, "CEST": 2, "MESZ": 2, "EET": 2, "EEST": 3, "MSK": 3,
        "IST": 5.5, "PKT": 5, "NPT": 5.75, "ICT": 7, "WIB": 7, "HKT": 8, "SGT": 8, "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
        "BRT": -3, "ART": -3, "NST": -3.5, "NDT": -2.5, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
    }.items()
}
#: Unit of a bare number by its count of digits: microseconds a unit, or for nanoseconds a divisor.
EPOCH_UNITS = ((10, 11, 1_000_000, 1), (12, 14, 1_000, 1), (15, 17, 1, 1), (18, 20, 1, 1_000))

_TIME = r"(?P<time>(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?)"
_AMPM = r"(?: ?(?P<ap>a\.?a?\.?))"
_ZONE = r"(?: ?(?P<zw>a)(?P<zwo>[+-]99?(?::?99)?)?| ?(?P<zo>[+-]9999|[+-]99:99|[+-]99?))"
_TAIL = r"(?: ?\[(?P<zn>a(?:[_/+-]a)*)\]| ?\(a\))?"
_CLOCK = rf"(?:(?:[ ,]+| ?a ?){_TIME}(?P<rest>.*))?"
_WD = r"(?:a\.?,? )?"
#: Layouts of masks. Roles of digit runs and words follow from the named groups.
LAYOUTS = (
    ("ymd", re.compile(rf"(?P<y>9999)(?P<sep>[-/.])(?P<m>99?)(?P=sep)(?P<d>99?){_CLOCK}")),
    ("compact", re.compile(r"(?P<y>9999)(?P<m>99)(?P<d>99)(?:(?: |a)(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?(?P<rest>[^9].*)?)?")),
    ("dmy_name", re.compile(rf"{_WD}(?P<d>99?)(?:\.|a)?[ -](?:a )?(?P<mon>a)\.?,?[ -](?:a )?(?P<y>9999){_CLOCK}")),
    ("mdy_name", re.compile(rf"{_WD}(?P<mon>a)\.? (?P<d>99?)(?:a)?,? (?P<y>9999){_CLOCK}")),
    ("numeric", re.compile(rf"(?P<n1>99?)(?P<sep>[-/.])(?P<n2>99?)(?P=sep)(?P<n3>9999|99){_CLOCK}")),
    ("epoch", re.compile(r"(?P<e>9{10,20})(?:[.](?P<f>9+))?")),
)
_REST = (re.compile(rf"{_AMPM}?(?: (?P<uhr>a))?{_ZONE}?{_TAIL}"), re.compile(rf"{_ZONE}?{_TAIL}"))


class _Masks(dict):
    """A translation table that maps every letter to ``a`` and every ASCII digit to ``9``."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "9" if c in "0123456789" else "a" if c.isalpha() else " " if c.isspace() else c
        return out


_TABLE, _RUNS = _Masks(), re.compile(r"a{2,}| {2,}")


def shape_mask(value: str) -> str:
    """``9`` for each digit, ``a`` for each run of letters, one blank for each run of white space, other characters as they are."""
    return _RUNS.sub(lambda m: m[0][0], value.translate(_TABLE))


@lru_cache(maxsize=65536)
def parser_of(mask: str) -> tuple[str, re.Pattern, tuple[str, ...]] | None:
    """The layout of a mask and a pattern whose groups are its parts, made once for each mask; None if it names no time."""
    for kind, layout in LAYOUTS:
        m = layout.fullmatch(mask)
        if not m:
            continue
        spans = {k: m.span(k) for k in m.groupdict() if k not in ("time", "rest", "sep") and m[k] is not None}
        if rest := m.groupdict().get("rest"):
            at = m.start("rest")
            r = next((x for x in (p.fullmatch(rest) for p in _REST) if x), None)
            if r is None:
                continue
            spans |= {k: (r.start(k) + at, r.end(k) + at) for k in r.groupdict() if r[k] is not None}
        parts, done, names = [], 0, []
        for k, (a, b) in sorted(spans.items(), key=lambda x: x[1]):
            parts += [_as_pattern(mask[done:a]), f"(?P<{k}>{_as_pattern(mask[a:b])})"]
            names.append(k)
            done = b
        return kind, re.compile("".join(parts) + _as_pattern(mask[done:])), tuple(names)
    return None


def _as_pattern(mask: str) -> str:
    return "".join({"9": "[0-9]", "a": r"[^\W\d_]+", " ": r"\s+"}.get(c, re.escape(c)) for c in mask)


def _offset(text: pd.Series) -> np.ndarray:
    """Seconds of offsets such as +05:45, -0400, +9; impossible ones are nan."""
    digits = text.str[1:].str.replace(":", "", regex=False)
    hours = pd.to_numeric(digits.str[:2].where(digits.str.len() != 3, digits.str[:1]), errors="coerce").to_numpy(float)
    minutes = pd.to_numeric(digits.str[-2:].where(digits.str.len() > 2, "0"), errors="coerce").to_numpy(float)
    out = np.where((hours <= 18) & (minutes < 60), hours * 3600 + minutes * 60, np.nan)
    return np.where(text.str[0] == "-", -out, out)


def _convert(kind: str, parts: pd.DataFrame, zone: np.ndarray, order: np.ndarray, tables: dict[str, ZoneTable]) -> np.ndarray:
    n = len(parts)
    number = lambda k, default=0: parts[k].astype("int64").to_numpy() if k in parts else np.full(n, default, "i8")
    micros = np.zeros(n, "i8")
    if "f" in parts:
        micros = parts["f"].str[:6].str.ljust(6, "0").astype("int64").to_numpy()
    if kind == "epoch":
        digits, out = parts["e"].str.len().to_numpy(), np.full(n, np.nan, object)
        for low, high, unit, divisor in EPOCH_UNITS:
            at = np.flatnonzero((digits >= low) & (digits <= high))
            if len(at):  # digits below a microsecond are cut off the text, so that every value fits 64 bits
                whole = parts["e"].iloc[at] if divisor == 1 else parts["e"].iloc[at].str[: -len(str(divisor)) + 1]
                out[at] = (whole.astype("int64").to_numpy() * unit + micros[at] * unit // 1_000_000).astype(object)
        return out
    ok = np.ones(n, bool)
    if kind == "numeric":
        n1, n2, n3 = (number(k) for k in ("n1", "n2", "n3"))
        short = parts["n3"].str.len().to_numpy() == 2
        dmy, mdy = order == "DMY", order == "MDY"
        ymd = ~dmy & ~mdy
        year = np.where(ymd & short, n1, n3)
        month = np.where(mdy, n1, n2)
        day = np.where(mdy, n2, np.where(ymd & short, n3, n1))
        year = np.where(short, 2000 + year, year)
    else:
        year, day = number("y"), number("d")
        if "mon" in parts:
            found = parts["mon"].str.lower().map(MONTHS)
            ok &= found.notna().to_numpy()
            month = found.fillna(1).astype("int64").to_numpy()
        else:
            month = number("m")
    hour, minute, second = (number(k) for k in ("h", "mi", "s"))
    if "ap" in parts:
        half = parts["ap"].str.lower().str.replace(".", "", regex=False)
        known = half.isin(["am", "pm"]).to_numpy()
        if "zw" in parts:
            ok &= known
        else:  # a lone word after the time is a zone unless it is am or pm; an offset after that zone adds to it
            parts = parts.assign(zw=parts["ap"].where(~known))
            if "zo" in parts:
                parts = parts.assign(zwo=parts["zo"].where(~known), zo=parts["zo"].where(known))
        ok &= ~known | ((hour >= 1) & (hour <= 12))
        hour = np.where(known, hour % 12 + np.where(half == "pm", 12, 0), hour)
    if "uhr" in parts:
        words = parts["uhr"].str.lower()
        hours_word = words.isin(["uhr", "h", "hrs", "heures", "horas"]).to_numpy()
        if "zw" not in parts and "zo" not in parts:
            parts = parts.assign(zw=parts["uhr"].where(~hours_word))
        else:
            ok &= hours_word
    ok &= (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31) & (hour <= 23) & (minute <= 59) & (second <= 59) & (year >= 1)
    safe = np.where(ok, month, 1)
    months = (np.where(ok, year, 1970) - 1970).astype("M8[Y]").astype("M8[M]") + (safe - 1)
    days = months.astype("M8[D]") + (np.where(ok, day, 1) - 1)
    ok &= days.astype("M8[M]") == months
    wall = days.astype("i8") * 86400 + hour * 3600 + minute * 60 + second
    fixed = np.full(n, np.nan)
    names = zone.copy()
    if "zw" in parts:
        words = parts["zw"]
        upper = words.str.upper()
        special = upper.isin(["UHR", "H"])
        given = words.notna().to_numpy() & ~special.to_numpy()
        at = np.flatnonzero(given)
        pairs, rows = {}, np.zeros(len(at), np.int64)  # each zone and word is looked up once
        for j, i in enumerate(at.tolist()):
            rows[j] = pairs.setdefault((zone[i], upper.iat[i]), len(pairs))
        seconds = np.full(len(pairs), np.nan)
        for (name, word), k in pairs.items():
            own = tables.get(name)
            value = own.abbreviations.get(word) if own is not None else None
            value = ABBREVIATIONS.get(word) if value is None else value
            seconds[k] = np.nan if value is None else value
        fixed[at] = seconds[rows] if len(at) else fixed[at]
        ok[at] &= ~np.isnan(fixed[at])
        if "zwo" in parts:
            extra = np.where(parts["zwo"].isna(), 0, _offset(parts["zwo"].fillna("+0")))
            fixed = np.where(given, fixed + extra, fixed)
            ok &= ~given | ~np.isnan(fixed)
    if "zo" in parts:
        direct = parts["zo"].notna().to_numpy()
        fixed = np.where(direct, _offset(parts["zo"].fillna("+0")), fixed)
        ok &= ~direct | ~np.isnan(fixed)
    if "zn" in parts and "zo" not in parts and "zw" not in parts:
        names = parts["zn"].to_numpy(object)
    utc = np.zeros(n, "i8")
    has = ~np.isnan(fixed)
    utc[has] = wall[has] - fixed[has].astype("i8")
    for name in set(names[~has & ok].tolist()):
        rows = (names == name) & ~has
        t = tables.get(name) if name in tables else zone_table(name) if name else None
        if t is None:
            if name and "zn" in parts:
                ok &= ~rows
                continue
            utc[rows] = wall[rows]
        else:
            utc[rows] = t.to_utc(wall[rows])
    out = (utc * 1_000_000 + micros).astype(object)
    out[~ok] = np.nan
    return out


def to_utc_us(values: pd.Series, zones: pd.Series, orders: pd.Series, tables: dict[str, ZoneTable]) -> pd.Series:
    """UTC microseconds of timestamp texts (nullable integers)."""
    out = np.full(len(values), np.nan, object)
    stripped = values.fillna("").astype(object).map(lambda v: v.strip(" \t\r\n\f\v ​﻿"))
    zone, order = zones.fillna("").to_numpy(object), orders.fillna("").str.upper().to_numpy(object)
    codes, masks = pd.factorize(stripped.map(shape_mask).to_numpy(object))
    by_mask = np.argsort(codes, kind="stable")
    for mask, at in zip(masks, np.split(by_mask, np.cumsum(np.bincount(codes, minlength=len(masks)))[:-1]), strict=True):
        made = parser_of(mask)
        if made is None:
            continue
        kind, pattern, _ = made
        parts = stripped.iloc[at].str.extract(pattern)
        out[at] = _convert(kind, parts.reset_index(drop=True), zone[at], order[at], tables)
    return pd.Series(out, index=values.index).astype("Int64")


def utc_micros(value: Column, zone: Column, order: Column, tables: dict[str, ZoneTable]) -> Column:
    """The operator as a Column: Arrow batches in, bigint out. tables: the feeds' transition tables, bounded by the number of zones."""

    @F.pandas_udf("bigint")
    def convert(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, z, o in batches:
            yield to_utc_us(v, z, o, tables)

    return convert(value, zone, order)


def normalise_timestamps(rows: DataFrame, feeds: DataFrame, key: str, feed_key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, text, utc_us) of each non-null text in fields.

    feeds: id, time_zone, date_order. Each zone that it names and the zone database knows is made
    into a table on the driver; there are some 600 in the database, whatever feeds holds. Rows
    without a feed are kept (UTC, YMD). Extra columns are ignored.
    """
    dim = feeds.select(F.col("id").alias("_feed"), F.col("time_zone").alias("_zone"), F.col("date_order").alias("_order")).dropDuplicates(["_feed"])
    names = [r[0] for r in dim.select("_zone").where(F.col("_zone").isin(*sorted(available_timezones()))).distinct().collect()]
    tables = {n: t for n in names if (t := zone_table(n)) is not None}
    stacked = rows.select(F.col(key), F.col(feed_key).alias("_feed"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("_v"))
    stacked = stacked.select(key, "_feed", "_v.field_name", "_v.text").where(F.col("text").isNotNull())
    joined = stacked.join(bounded_broadcast(dim), "_feed", "left")
    return joined.select(key, "field_name", "text", utc_micros(F.col("text"), F.col("_zone"), F.col("_order"), tables).alias("utc_us"))
