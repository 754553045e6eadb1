"""Timestamps in mixed notations, precisions and zones, brought to one unambiguous form.

Each text is parsed once into every valid reading: one calendar date for each order of day, month and year that the
digits allow, the clock time and the zone as written.  A source is a mixture of formats, a format being a notation (its
separator and the place and width of its year) with an order, fitted by expectation-maximisation: a value contributes
likelihood under each format that is valid for it, a declared order and the orders of the source's other notations enter
as a fixed number of prior values, and the posterior picks the reading.  Values thus outweigh a wrong declaration where
they are many, and decide where nothing is declared.  Only counts by source, notation and set of valid orders go through
the fit, so that its cost doesn't follow the number of values.

A value without reading, with an unknown zone or with orders that stay equally likely is marked unresolved with the
reason.  Nulls are left out, equal rows count once.  Sources without a declared convention are read in UTC and by year,
month, day.  A local time that occurs twice means its first pass; one that was skipped moves forward by the skipped span.
"""

from __future__ import annotations

import re
from datetime import date
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.joins import lookup_join
from factloom.plans.staging import Stage

ORDERS = ("DMY", "MDY", "YMD")
#: Tasks over which the values of one source are spread where its table is too large to broadcast.
SALTS = 8
#: Convention of a source that declares none.
DEFAULT_ZONE, DEFAULT_ORDER = "UTC", "YMD"
#: A declared order counts as so many values of the source, the orders of its other notations as so many together.
DECLARED, SHARED = 50.0, 10.0
#: A posterior below this marks a reading as unresolved.
RESOLVED = 0.9

_MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
_MONTH = r"(?P<mon>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?\s*(?P<half>[ap]\.?m\b\.?)?"
_ZONE = r"\s*(?:(?P<off>(?:UTC|GMT)?\s?[+\-−]\d{1,2}(?::?\d{2})?)\b)?\s*[\[(]?(?P<name>[A-Za-z]+/[A-Za-z_/+\-]+|[A-Za-z]{1,12})?[\])]?"
_DATES = (
    r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
    r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{4}|\d{2})",
    rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s\-]*{_MONTH}\.?,?[\s\-]*(?P<y>\d{{4}}|['’]?\d{{2}})",
    rf"{_MONTH}\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}|['’]\d{{2}})",
)
_READERS = [re.compile(rf"{day}(?:(?:T|,?\s+(?:at\s+)?){_TIME}{_ZONE})?", re.I) for day in _DATES] + [re.compile(rf"{_TIME}{_ZONE}\s+on\s+{day}", re.I) for day in _DATES]
_COMPACT = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?:T?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,]\d+)?(?P<off>Z|[+\-]\d{2}:?\d{2})?)?", re.I)
_EPOCH = re.compile(r"\d{10}|\d{13}")
_LEAD = re.compile(r"^(?:(?:as\s+(?:on|at|of)|position\s+(?:at|on)|dated|on|at)\s+)*(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?", re.I)
_PLACES = {z.lower(): z for z in available_timezones() if "/" in z}
_EPOCH_DAY = date(1970, 1, 1).toordinal()

READING = T.StructType([T.StructField(n, t) for n, t in (("dmy", T.IntegerType()), ("mdy", T.IntegerType()), ("ymd", T.IntegerType()), ("clock", T.LongType()), ("zone", T.StringType()), ("shift", T.IntegerType()), ("notation", T.StringType()))])


def _day(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01, or none where there is no such day."""
    try:
        return date(y, m, d).toordinal() - _EPOCH_DAY
    except ValueError:
        return None


def _offset(text: str) -> int | None:
    """Seconds east of UTC."""
    m = re.fullmatch(r"(?:utc|gmt)?\s?([+\-−])(\d{1,2}):?(\d{2})?", text.strip(), re.I)
    if m is None or int(m[2]) > 14:
        return None
    return (1 if m[1] == "+" else -1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60)


def read(text: str | None) -> tuple | None:
    """All valid readings: day by each order, seconds of the day, zone as written, seconds east of UTC, notation.

    A fixed date has the same day under all orders and no notation.  Instants have the zone UTC and an offset of 0.
    """
    if not text:
        return None
    t = " ".join(text.split())
    if _EPOCH.fullmatch(t):
        s = int(t) // (1000 if len(t) == 13 else 1)
        return (s // 86400,) * 3 + (s % 86400, None, 0, None)
    t = _LEAD.sub("", t)
    m = _COMPACT.fullmatch(t)
    if m is None:
        m = next((x for r in _READERS if (x := r.fullmatch(t))), None)
    if m is None:
        return None
    g = m.groupdict()
    notation = f"{g['sep']}{len(g['c'])}" if g.get("a") else None
    if g.get("a"):
        a, b, c, full = int(g["a"]), int(g["b"]), int(g["c"]), len(g["c"]) == 4
        late = c if full else 2000 + c
        days = (_day(late, b, a), _day(late, a, b), None if full else _day(2000 + a, b, c))
    else:
        y = g["y"].lstrip("'’")
        month = _MONTHS[g["mon"][:3].lower()] if g.get("mon") else int(g["m"])
        days = (_day(int(y) + (2000 if len(y) == 2 else 0), month, int(g["d"])),) * 3
    if all(x is None for x in days):
        return None
    if g.get("h") is None:
        return (*days, None, None, None, notation)
    h, minute, second = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
    if half := (g.get("half") or "").lower():
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half[0] == "p" else 0)
    if h > 24 or minute > 59 or second > 60 or (h == 24 and (minute or second)):
        return None
    clock, off, name = h * 3600 + minute * 60 + min(second, 59), (g.get("off") or "").strip(), g.get("name")
    if off.upper() == "Z" or (name or "").upper() == "Z":
        return (*days, clock, None, 0, notation)
    if off:
        shift = _offset(off)
        return None if shift is None else (*days, clock, None, shift, notation)
    if name and "/" in name:
        place = _PLACES.get(name.lower())
        return None if place is None else (*days, clock, place, None, notation)
    return (*days, clock, name.upper() if name else None, None, notation)


@F.pandas_udf(READING)
def readings(texts: pd.Series) -> pd.DataFrame:
    rows = [read(t) or (None,) * 7 for t in texts]
    out = pd.DataFrame(rows, columns=["dmy", "mdy", "ymd", "clock", "zone", "shift", "notation"])
    return out.astype({"dmy": "Int32", "mdy": "Int32", "ymd": "Int32", "clock": "Int64", "shift": "Int32"})


def fit_orders(counts: np.ndarray, valid: np.ndarray, prior: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the orders and their posteriors for each set of valid orders, by expectation-maximisation.

    counts: values by set; valid: sets by orders, 0 or 1; prior: pseudo-counts by order.
    """
    weights = prior / prior.sum()
    for _ in range(steps):
        post = valid * weights
        post = post / np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
        new = (counts[:, None] * post).sum(axis=0) + prior
        new = new / new.sum()
        if np.abs(new - weights).max() < 1e-12:
            break
        weights = new
    post = valid * weights
    return weights, post / np.maximum(post.sum(axis=1, keepdims=True), 1e-300)


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """The order chosen for each notation and set of valid orders of one source, its posterior and that of the next best."""
    declared = rows["date_order"].iloc[0]
    valid = lambda masks: np.array([[(mask >> k) & 1 for k in range(3)] for mask in masks], float)
    prior = np.array([DECLARED if o == declared else 1.0 for o in ORDERS])
    whole, _ = fit_orders(rows["n"].to_numpy(float), valid(rows["mask"]), prior)
    out = []
    for _, part in rows.groupby("notation", sort=True):
        _, post = fit_orders(part["n"].to_numpy(float), valid(part["mask"]), prior + SHARED * whole)
        ranked = np.sort(post, axis=1)
        # of equally likely orders the declared one, else the first
        best = (post + np.array([1e-12 if o == declared else 0.0 for o in ORDERS])).argmax(axis=1)
        out.append(pd.DataFrame({"source": part["source"], "notation": part["notation"], "mask": part["mask"], "chosen": [ORDERS[k] for k in best], "posterior": ranked[:, -1]}))
    return pd.concat(out)


def normalise_times(values: DataFrame, conventions: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """One row for each distinct value: its moment, or why it has none.

    values: id, source, text.  conventions: source (unique), time_zone, date_order.  abbreviations: abbreviation
    (unique), utc_offset_minutes.  Returns id, source, text, moment, posterior, resolved, reason; ``moment`` is
    ``YYYY-MM-DD`` or, in UTC, ``YYYY-MM-DDTHH:MM:SSZ``, null where ``reason`` is ``no_day`` or ``unknown_zone``; a value
    of reason ``ambiguous_order`` has its likeliest moment.
    """
    stage = Stage(values.sparkSession, "times")
    mask = sum((F.when(F.col(o.lower()).isNotNull(), 1 << k).otherwise(0) for k, o in enumerate(ORDERS)), F.lit(0))
    given = values.where(F.col("text").isNotNull()).select("id", F.coalesce("source", F.lit("")).alias("source"), "text").distinct()
    read_ = stage.cut(given.withColumn("r", readings("text")).select("id", "source", "text", "r.*").withColumn("mask", F.when(F.col("notation").isNotNull(), mask).otherwise(0).cast("int")), "readings")
    known = conventions.select(F.coalesce("source", F.lit("")).alias("source"), "time_zone", "date_order")
    counts = read_.where("mask > 0").groupBy("source", "notation", "mask").agg(F.count("*").alias("n"))
    chosen = (
        lookup_join(counts, known.select("source", "date_order"), "source")
        .withColumn("date_order", F.coalesce("date_order", F.lit(DEFAULT_ORDER)))
        .groupBy("source")
        .applyInPandas(_choose, "source string, notation string, mask int, chosen string, posterior double")
    )
    chosen = stage.cut(chosen, "chosen")
    placed = lookup_join(lookup_join(read_, chosen, ["source", "notation", "mask"], salts=SALTS), known.select("source", "time_zone"), "source", salts=SALTS)
    placed = lookup_join(placed, abbreviations.select(F.col("abbreviation").alias("zone"), (F.col("utc_offset_minutes") * 60).alias("known_shift")), "zone", salts=SALTS)
    day = F.when(F.col("mask") == 0, F.col("dmy")).when(F.col("chosen") == "DMY", F.col("dmy")).when(F.col("chosen") == "MDY", F.col("mdy")).otherwise(F.col("ymd"))
    local = day.cast("long") * 86400 + F.col("clock")
    shift = F.coalesce("shift", "known_shift")
    place = F.when(F.col("zone").contains("/"), F.col("zone")).when(F.col("zone").isNull(), F.coalesce("time_zone", F.lit(DEFAULT_ZONE)))
    utc = F.when(shift.isNotNull(), local - shift).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_seconds(local), place)) / 1000000).cast("long")
    moment = F.when(F.col("clock").isNull(), _date(day)).otherwise(_instant(utc))
    posterior = F.when(day.isNotNull(), F.coalesce("posterior", F.lit(1.0)))
    reason = F.when(day.isNull(), "no_day").when(moment.isNull(), "unknown_zone").when(posterior < RESOLVED, "ambiguous_order")
    return placed.select("id", "source", "text", moment.alias("moment"), posterior.alias("posterior"), reason.isNull().alias("resolved"), reason.alias("reason"))


def _date(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")


def _instant(seconds: Column) -> Column:
    """ISO form of an instant, whatever the session's zone."""
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    clock = F.pmod(seconds, F.lit(86400))
    return F.concat(_date(F.floor(seconds / 86400)), F.lit("T"), two(F.floor(clock / 3600)), F.lit(":"), two(F.floor(F.pmod(clock, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(clock, F.lit(60))), F.lit("Z"))
