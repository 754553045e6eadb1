"""Quantities in different units and scales, brought to one unit a family.

A grammar reads sign, currency, number, magnitude and unit expression.  Unit expressions are products, quotients and
powers of atoms with prefixes; each atom has a vector of exponents over length, mass, time, ratio, item, temperature and
current, a scale and an offset, so families follow from the dimension and need no list of spellings.  Symbols are read
by their exact case first (``mW`` is milli, ``MW`` mega) and by folded case only where that leaves one reading.  Values
are exact decimals until they are rounded.

A value whose own text has no unit takes the unit that the evidence states beside it.  What cannot be brought to a
common unit comes out with the reason; null and empty texts do too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_EXACT = Context(prec=60)
D = Decimal
_NONE = (0, 0, 0, 0, 0, 0, 0)

# Exponents over (length, mass, time, ratio, item, temperature, current) of each family.
DIMENSIONS = {
    (0, 0, 0, 0, 1, 0, 0): "count", (0, 0, 0, 1, 0, 0, 0): "ratio", (0, 1, 0, 0, 0, 0, 0): "mass", (2, 1, -2, 0, 0, 0, 0): "energy", (2, 1, -3, 0, 0, 0, 0): "power", (1, 0, 0, 0, 0, 0, 0): "distance", (2, 0, 0, 0, 0, 0, 0): "area",
    (3, 0, 0, 0, 0, 0, 0): "volume", (0, 0, 1, 0, 0, 0, 0): "duration", (0, 0, 0, 0, 0, 1, 0): "temperature", (0, 0, 0, 0, 0, 0, 1): "current", (2, 1, -3, 0, 0, 0, -1): "voltage", (0, 0, -1, 0, 0, 0, 0): "frequency", (-1, 1, -2, 0, 0, 0, 0): "pressure",
    (1, 1, -2, 0, 0, 0, 0): "force", (1, 0, -1, 0, 0, 0, 0): "speed", (3, 0, -1, 0, 0, 0, 0): "flow", (-3, 1, 0, 0, 0, 0, 0): "density", (-2, 1, 0, 0, 0, 0, 0): "yield",
}
_L, _M, _T, _R, _I, _K, _A = (tuple(int(i == k) for i in range(7)) for k in range(7))
_POWER, _ENERGY, _AREA, _VOLUME, _PRESSURE, _FORCE, _VOLT, _HZ, _SPEED = (2, 1, -3, 0, 0, 0, 0), (2, 1, -2, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0), (-1, 1, -2, 0, 0, 0, 0), (1, 1, -2, 0, 0, 0, 0), (2, 1, -3, 0, 0, 0, -1), (0, 0, -1, 0, 0, 0, 0), (1, 0, -1, 0, 0, 0, 0)

# Symbols in their proper case, as scale in metre, kilogram, second, basis point, kelvin, ampere, and exponents; all take prefixes.
SYMBOLS = {
    "m": (D(1), _L), "g": (D("0.001"), _M), "t": (D(1000), _M), "s": (D(1), _T), "l": (D("0.001"), _VOLUME), "L": (D("0.001"), _VOLUME), "W": (D(1), _POWER), "Wh": (D(3600), _ENERGY), "J": (D(1), _ENERGY), "V": (D(1), _VOLT), "A": (D(1), _A),
    "K": (D(1), _K), "Hz": (D(1), _HZ), "Pa": (D(1), _PRESSURE), "N": (D(1), _FORCE), "bar": (D(100000), _PRESSURE), "cal": (D("4.184"), _ENERGY), "eV": (D("1.602176634E-19"), _ENERGY),
}
PREFIX_SYMBOLS = {"P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "d": -1, "c": -2, "m": -3, "µ": -6, "μ": -6, "u": -6, "n": -9}
# Words, singular; those of the second table take prefixes.
WORDS = {
    "ft": (D("0.3048"), _L), "foot": (D("0.3048"), _L), "feet": (D("0.3048"), _L), "mi": (D("1609.344"), _L), "mile": (D("1609.344"), _L), "inch": (D("0.0254"), _L), "inche": (D("0.0254"), _L), "yard": (D("0.9144"), _L), "yd": (D("0.9144"), _L), "nautical mile": (D(1852), _L),
    "mt": (D(1000), _M), "gm": (D("0.001"), _M), "quintal": (D(100), _M), "lb": (D("0.45359237"), _M), "pound": (D("0.45359237"), _M), "short ton": (D("907.18474"), _M), "long ton": (D("1016.0469088"), _M), "metric tonne": (D(1000), _M), "metric ton": (D(1000), _M), "ton": (D(1000), _M), "oz": (D("0.028349523125"), _M),
    "ounce": (D("0.028349523125"), _M), "carat": (D("0.0002"), _M), "stone": (D("6.35029318"), _M), "sec": (D(1), _T), "min": (D(60), _T), "minute": (D(60), _T), "h": (D(3600), _T), "hr": (D(3600), _T), "hour": (D(3600), _T), "d": (D(86400), _T), "day": (D(86400), _T), "week": (D(604800), _T),
    "month": (D("2629800"), _T), "year": (D("31557600"), _T), "yr": (D("31557600"), _T), "decade": (D("315576000"), _T), "ha": (D(10000), _AREA), "hectare": (D(10000), _AREA), "acre": (D("4046.8564224"), _AREA), "sqm": (D(1), _AREA), "sqft": (D("0.09290304"), _AREA), "sqkm": (D(1000000), _AREA),
    "gal": (D("0.003785411784"), _VOLUME), "gallon": (D("0.003785411784"), _VOLUME), "bbl": (D("0.158987294928"), _VOLUME), "barrel": (D("0.158987294928"), _VOLUME), "cum": (D(1), _VOLUME), "cbm": (D(1), _VOLUME), "pint": (D("0.000473176473"), _VOLUME), "bushel": (D("0.03523907016688"), _VOLUME),
    "hp": (D("745.69987158227022"), _POWER), "horsepower": (D("745.69987158227022"), _POWER), "btu": (D("1055.05585262"), _ENERGY), "psi": (D("6894.757293168"), _PRESSURE), "knot": (D(1852) / D(3600), _SPEED), "kmh": (D(1000) / D(3600), _SPEED), "kph": (D(1000) / D(3600), _SPEED), "mph": (D("0.44704"), _SPEED),
    "cusec": (D("0.028316846592"), (3, 0, -1, 0, 0, 0, 0)), "cumec": (D(1), (3, 0, -1, 0, 0, 0, 0)),
    "bp": (D(1), _R), "basis point": (D(1), _R), "%": (D(100), _R), "pct": (D(100), _R), "percent": (D(100), _R), "per cent": (D(100), _R), "percentage point": (D(100), _R), "‰": (D(10), _R), "per mille": (D(10), _R), "permille": (D(10), _R), "ppm": (D("0.01"), _R),
    "people": (D(1), _I), "staff": (D(1), _I), "person": (D(1), _I), "capita": (D(1), _I), "unit": (D(1), _I), "piece": (D(1), _I), "dozen": (D(12), _I),
}
LONG = {
    "metre": (D(1), _L), "meter": (D(1), _L), "gram": (D("0.001"), _M), "gramme": (D("0.001"), _M), "tonne": (D(1000), _M), "second": (D(1), _T), "litre": (D("0.001"), _VOLUME), "liter": (D("0.001"), _VOLUME), "watt": (D(1), _POWER), "watt hour": (D(3600), _ENERGY), "joule": (D(1), _ENERGY), "volt": (D(1), _VOLT),
    "ampere": (D(1), _A), "amp": (D(1), _A), "hertz": (D(1), _HZ), "pascal": (D(1), _PRESSURE), "newton": (D(1), _FORCE), "calorie": (D("4.184"), _ENERGY), "kelvin": (D(1), _K), "wh": (D(3600), _ENERGY), "w": (D(1), _POWER), "j": (D(1), _ENERGY), "l": (D("0.001"), _VOLUME), "g": (D("0.001"), _M), "t": (D(1000), _M), "m": (D(1), _L), "hz": (D(1), _HZ), "v": (D(1), _VOLT), "pa": (D(1), _PRESSURE),
}
PREFIX_WORDS = {"kilo": 3, "mega": 6, "giga": 9, "tera": 12, "peta": 15, "hecto": 2, "deci": -1, "centi": -2, "milli": -3, "micro": -6, "nano": -9}
# Units with an offset: value * scale + offset is in kelvin.
OFFSETS = {"°c": (D(1), D("273.15")), "celsius": (D(1), D("273.15")), "degree celsius": (D(1), D("273.15")), "deg c": (D(1), D("273.15")), "°f": (D(5) / D(9), D("459.67") * D(5) / D(9)), "fahrenheit": (D(5) / D(9), D("459.67") * D(5) / D(9)), "degree fahrenheit": (D(5) / D(9), D("459.67") * D(5) / D(9)), "deg f": (D(5) / D(9), D("459.67") * D(5) / D(9))}
# Plural words that name a measure of no known scale, so they are not what is counted.
NO_COUNTS = frozenset("degrees points times basis lakhs crores millions billions thousands dollars rupees pounds euros cents shares levels indices standards decibels bytes bits radians moles lumens".split())
# Magnitudes; a lone k counts as one only where a unit or a currency stands beside it.
MAGNITUDES = {"hundred": D(100), "thousand": D(1000), "k": D(1000), "lakh": D(100000), "lakhs": D(100000), "lac": D(100000), "million": D(10) ** 6, "mn": D(10) ** 6, "mln": D(10) ** 6, "crore": D(10) ** 7, "crores": D(10) ** 7, "cr": D(10) ** 7, "billion": D(10) ** 9, "bn": D(10) ** 9, "trillion": D(10) ** 12, "tn": D(10) ** 12}
CURRENCIES = {"US$": "USD", "$": "USD", "USD": "USD", "₹": "INR", "Rs.": "INR", "Rs": "INR", "INR": "INR", "€": "EUR", "EUR": "EUR", "£": "GBP", "GBP": "GBP", "¥": "JPY", "JPY": "JPY", "S$": "SGD", "SGD": "SGD"}
# Canonical unit of a family as a scale in the atoms' base.
CANONICAL = {"count": D(1), "bps": D(1), "g": D("0.001"), "kg": D(1), "t": D(1000), "Wh": D(3600), "kWh": D(3600000), "J": D(1), "W": D(1), "kW": D(1000), "m": D(1), "km": D(1000), "sqm": D(1), "ha": D(10000), "l": D("0.001"), "m3": D(1), "s": D(1), "h": D(3600), "K": D(1), "A": D(1), "V": D(1), "Hz": D(1), "Pa": D(1), "N": D(1), "m/s": D(1), "m3/s": D(1), "kg/m3": D(1), "kg/sqm": D(1)}

_MAG = "|".join(sorted(map(re.escape, MAGNITUDES), key=len, reverse=True))
_CUR = "|".join(sorted(map(re.escape, CURRENCIES), key=len, reverse=True))
_NUM = r"\d(?:[\d.,   ' ’]*\d)?"
_VALUE = re.compile(rf"\s*(?P<neg>[-−–])?\s*(?P<open>\()?\s*(?P<neg2>[-−–])?\s*(?P<cur>{_CUR})?\s*(?P<neg3>[-−–])?\s*(?P<open2>\()?\s*(?P<num>{_NUM})\s*(?P<close>\))?\s*(?:(?P<mag>{_MAG})(?![^\W\d_]))?\s*(?P<unit>[^()]*?)\s*(?P<close2>\))?\s*", re.I)
_STATED = re.compile(rf"^(?:(?P<mag>{_MAG})\s+)?(?P<unit>\S.*)$", re.I)


Unit = tuple[Decimal, tuple[int, ...], Decimal]
_FACTOR = re.compile(r"\s*(?P<op>/|·|\*|×|\bper\b(?!\s*(?:cent|mille)\b)|-(?=[^\W\d]))\s*", re.I)
_POWERED = re.compile(r"(.*?[^\W\d])\s*(?:\^\s*)?(-?[1-3])$")


def _times(a: Decimal, n: int) -> Decimal:
    out = D(1)
    for _ in range(abs(n)):
        out = _EXACT.multiply(out, a)
    return out if n >= 0 else _EXACT.divide(D(1), out)


@lru_cache(maxsize=1 << 14)
def unit_vector(text: str) -> Unit | None:
    """Scale, exponents and offset of a unit expression, or none.  Words that name no measure but are plural count items."""
    for a, b in (("²", "2"), ("³", "3"), ("⁻", "-"), ("¹", "1")):
        text = text.replace(a, b)
    t = " ".join(text.split()).strip(" .")
    if not t:
        return None
    if (whole := _offset_or_atom(t)) is not None:
        return whole
    parts, ops, at = [], ["*"], 0
    for m in _FACTOR.finditer(t):
        parts.append(t[at : m.start()])
        ops.append("/" if m["op"] == "/" or m["op"].lower() == "per" else "*")
        at = m.end()
    parts.append(t[at:])
    if len(parts) > 1 and all(parts):
        scale, dims = D(1), _NONE
        for op, part in zip(ops, parts):
            found = _offset_or_atom(part.strip())
            if found is None or found[2]:
                return _counted(t)
            sign = 1 if op == "*" else -1
            scale = _EXACT.multiply(scale, _times(found[0], sign))
            dims = tuple(d + sign * x for d, x in zip(dims, found[1]))
        return (scale, dims, D(0)) if any(dims) else None
    return _counted(t)


def _counted(t: str) -> Unit | None:
    low = t.lower()
    return (D(1), _I, D(0)) if re.fullmatch(r"[^\W\d_]{3,}s(?:\s[^\W\d_]+)?", low) and low.split()[0] not in NO_COUNTS else None


def _offset_or_atom(t: str) -> Unit | None:
    """One atom with its prefix and power."""
    low = t.lower().replace(".", "") if not re.search(r"\d", t) else t.lower()
    for form in (low, low[:-1] if low.endswith("s") else low, re.sub(r"^degrees ", "degree ", low)):
        if form in OFFSETS:
            return OFFSETS[form][0], _K, OFFSETS[form][1]
    power, word = 1, t
    for lead, p in (("square ", 2), ("sq. ", 2), ("sq ", 2), ("cubic ", 3), ("cu. ", 3), ("cu ", 3)):
        if word.lower().startswith(lead):
            power, word = p, word[len(lead) :].strip()
    if power == 1 and (m := _POWERED.fullmatch(word)):
        power, word = int(m[2]), m[1]
    found = _atom(word.replace(".", "").strip())
    return None if found is None else (_times(found[0], power), tuple(x * power for x in found[1]), D(0))


def _atom(word: str) -> tuple[Decimal, tuple[int, ...]] | None:
    if word in SYMBOLS:
        return SYMBOLS[word]
    low = word.lower()
    names = (low, low[:-1] if low.endswith("s") and len(low) > 2 else low)
    for name in names:
        if name in WORDS:
            return WORDS[name]
    for p, e in PREFIX_SYMBOLS.items():  # a prefix and a symbol in their proper case
        if word.startswith(p) and word[len(p) :] in SYMBOLS:
            scale, dims = SYMBOLS[word[len(p) :]]
            return _EXACT.multiply(scale, D(10) ** e), dims
    for name in names:
        if name in LONG:
            return LONG[name]
        for p, e in PREFIX_WORDS.items():
            if name.startswith(p) and name[len(p) :] in LONG:
                return _EXACT.multiply(LONG[name[len(p) :]][0], D(10) ** e), LONG[name[len(p) :]][1]
    folded = {}
    for name in names:
        for p, e in PREFIX_SYMBOLS.items():
            for a, (scale, dims) in SYMBOLS.items():
                if len(a) < 4 and (p + a).lower() == name:
                    folded[_EXACT.multiply(scale, D(10) ** e), dims] = (p, a)
    if len(folded) > 1:  # milli and mega: a capital M is mega, a small m before a symbol that is a capital of right too
        lower_right = all(a[0].islower() for _, a in folded.values())
        want = "M" if (word[0] == "M" and not word.isupper()) or not lower_right else "m"
        folded = {k: v for k, v in folded.items() if v[0] == want} or folded
    return next(iter(folded)) if len(folded) == 1 else None


def number(text: str, mark: str) -> Decimal | None:
    """A numeral by its decimal mark; every other separator groups digits."""
    other = "." if mark == "," else ","
    t = re.sub(r"[\s   '’]", "", text).replace(other, "").replace(mark, ".")
    try:
        return D(t)
    except ArithmeticError:
        return None


def _evidence_unit(quote: str, raw: str) -> str | None:
    """The unit expression stated nearest to a bare value, in the words before or after it."""
    best, at = None, quote.find(raw)
    while at >= 0:
        edge = at + len(raw)
        alone = not (at and re.match(r"[\w.,]", quote[at - 1]) and re.match(r"\d", quote[at - 1])) and not re.match(r"[.,]?\d", quote[edge:])
        if alone:
            before, after = quote[:at], quote[edge:]
            for m in re.finditer(r"\((?:[^()]*\s)?in\s+([^()]+)\)|\bin\s+([^,;()]+),", before):
                stated = (m[1] or m[2]).strip()
                if _whole_unit(stated) and (best is None or at - m.end() < best[0]):
                    best = (at - m.end(), stated)
            if m := re.match(r"[^.;]*?\bin\s+([^,;()\[\]]+)", after):
                stated = m[1].rstrip()
                while stated and not _whole_unit(stated):  # the text may run on behind a full stop
                    stated = stated.rpartition(".")[0].rstrip()
                if stated and (best is None or m.start(1) < best[0]):
                    best = (m.start(1), stated)
        at = quote.find(raw, at + 1)
    return best[1] if best else None


@lru_cache(maxsize=1 << 14)
def _whole_unit(text: str) -> tuple[Decimal, str | None, Unit | None] | None:
    """Magnitude with currency or unit, if the whole text is one."""
    m = _STATED.match(text)
    if m is None:
        return None
    mag, unit = MAGNITUDES[m["mag"].lower()] if m["mag"] else D(1), m["unit"].strip()
    for form, code in CURRENCIES.items():
        if unit.lower() == form.lower():
            return mag, code, None
    vector = unit_vector(unit)
    if vector is None or (vector[1] == _I and " " in unit):
        return None
    return mag, None, vector


class Unread(NamedTuple):
    """Why a value has no common unit."""

    reason: str


def quantity(raw: str | None, unit: str | None, quote: str | None, mark: str) -> tuple[str, str | None, Decimal] | Unread:
    """Family, currency code and value in the base of the family, or the reason why not."""
    if not raw or not raw.strip():
        return Unread("no_value")
    if (m := _VALUE.fullmatch(raw)) is None or (n := number(m["num"], mark)) is None:
        return Unread("no_number")
    if m["neg"] or m["neg2"] or m["neg3"] or ((m["open"] or m["open2"]) and (m["close"] or m["close2"])):
        n = -n
    mag = MAGNITUDES[m["mag"].lower()] if m["mag"] else D(1)
    code, said, vector = CURRENCIES.get(m["cur"]) or CURRENCIES.get((m["cur"] or "").upper()), m["unit"].strip(), None
    if m["cur"] and code is None:
        code = next((c for f, c in CURRENCIES.items() if f.lower() == m["cur"].lower()), None)
    if code is None and said:
        whole = _whole_unit(said)
        if whole:
            code, vector, mag = whole[1], whole[2], _EXACT.multiply(mag, whole[0])
        else:
            vector = unit_vector(said)
        if code is None and vector is None:
            return Unread("unknown_unit")
    if code is None and vector is None:
        stated = _evidence_unit(quote, raw.strip()) if quote else None
        whole = _whole_unit(stated or (unit or ""))
        if whole is None:
            return Unread("no_unit")
        code, vector, mag = whole[1], whole[2], _EXACT.multiply(mag, whole[0])
    value = _EXACT.multiply(n, mag)
    if code:
        return "currency", code, value
    if (family := DIMENSIONS.get(vector[1])) is None:
        return Unread("unknown_dimension")
    return family, None, _EXACT.add(_EXACT.multiply(value, vector[0]), vector[2])


_read = lru_cache(maxsize=1 << 16)(lambda raw, unit, mark: quantity(raw, unit, None, mark))


def _convert(batches: Iterator[pd.DataFrame], targets: dict[str, str], keep: list[str]) -> Iterator[pd.DataFrame]:
    names = ["unit_family", "common_unit", "quantity", "value_common", "reason"]
    for pdf in batches:
        rows = []
        for raw, unit, quote, mark in zip(pdf["value_raw"], pdf["unit"], pdf["evidence_quote"], pdf["decimal_mark"]):
            got = quantity(raw, unit, quote, mark or ".") if quote else _read(raw, unit, mark or ".")
            if isinstance(got, Unread):
                rows.append((None, None, None, None, got.reason))
                continue
            family, code, base = got
            common = code or targets.get(family)
            if common is None:
                rows.append((family, None, None, None, "no_common_unit"))
                continue
            exact = base if code else _EXACT.divide(base, CANONICAL[common])
            rounded = int(exact.to_integral_value(ROUND_HALF_UP))
            large = abs(rounded) >= 1 << 63
            rows.append((family, common, float(exact), None if large else rounded, "beyond_64_bits" if large else None))
        out = pd.DataFrame(rows, columns=names, index=pdf.index).astype({"value_common": "Int64"})
        yield pd.concat([pdf[keep], out], axis=1)


def to_common_units(values: DataFrame, targets: dict[str, str], keep: list[str]) -> DataFrame:
    """Every value in the common unit of its family, or the reason why not.

    values: value_raw, unit, evidence_quote, decimal_mark, any of them null, and the columns to keep.  targets: common
    unit by family, from ``CANONICAL``; currencies keep the stated code.  Returns the kept columns, unit_family,
    common_unit, quantity (double), value_common (rounded, half away from zero; null beyond 64 bits) and reason, null
    where the value is in its common unit.
    """
    if unknown := {u for u in targets.values() if u is not None} - set(CANONICAL):
        raise ValueError(f"no canonical scale for {sorted(unknown)}")
    wanted = {f: u for f, u in targets.items() if u is not None}
    read = ["value_raw", "unit", "evidence_quote", "decimal_mark"]
    fields = T.StructType([*[T.StructField(c, values.schema[c].dataType) for c in keep], T.StructField("unit_family", T.StringType()), T.StructField("common_unit", T.StringType()), T.StructField("quantity", T.DoubleType()), T.StructField("value_common", T.LongType()), T.StructField("reason", T.StringType())])
    return values.select(*keep, *[c for c in read if c not in keep]).mapInPandas(lambda b: _convert(b, wanted, keep), fields)
