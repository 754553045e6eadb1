"""Normalisers of names, metrics, quantities and periods, as native Column expressions.

Every function takes Columns and returns a Column, so that all of them work inside ``transform`` and ``filter`` too and
stay in the JVM.  Nulls and empty texts give null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.vocabulary import CURRENCIES, FAMILIES, LEGAL_FORMS, MAGNITUDES, MONTHS, NO_UNITS, STOPWORDS, SYMBOLS, UNIT_WORDS

TOLERANCE = 0.015


def _lookup(table: dict, key: Column) -> Column:
    """The value of a key in a literal table, or null."""
    return F.get(F.array(*[F.lit(v) for v in table.values()]), F.array_position(F.array(*[F.lit(k) for k in table]), key).cast("int") - 1)


def _among(words: list[str], key: Column) -> Column:
    return key.isin(list(words))


def clean(text: Column) -> Column:
    """A text without control and format characters; line feeds and tabs stay."""
    return F.regexp_replace(text, r"[\p{Cf}\p{Cs}]|[\p{Cc}&&[^\n\t]]", "")


# names


def entity_display(name: Column) -> Column:
    """A name without repeated blanks, surrounding punctuation and possessive endings; ``Unknown`` for none."""
    once = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"^[,;:.]+|[,;:.]+$", "")
    shown = F.trim(F.regexp_replace(once, r"[‘’']s\b", ""))
    return F.coalesce(F.when(shown != "", shown), F.lit("Unknown"))


def entity_key(name: Column) -> Column:
    """The words of a name without articles and legal forms at its end, joined by ``_``; ``unknown`` for none."""
    low = F.lower(entity_display(name))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9&]+)"), 1), lambda w: ~w.isin("the", "a", "an"))
    places = F.transform(words, lambda w, i: F.when(~_among(LEGAL_FORMS, w), i + 1).otherwise(0))
    kept = F.slice(words, 1, F.coalesce(F.array_max(places), F.lit(0)))
    plain = F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), 1)
    chosen = F.when(F.size(kept) > 0, kept).when(F.size(plain) > 0, plain).otherwise(F.array(F.lit("unknown")))
    return F.when(name.isNull() | (name == ""), F.lit("unknown")).otherwise(F.array_join(chosen, "_"))


def _words(key: Column) -> Column:
    return F.filter(F.split(key, "_"), lambda w: w != "")


def entities_compatible(a: Column, b: Column) -> Column:
    """Whether two keys are equal or the words of one are all in the other; false for null and empty keys."""
    x, y = F.split(a, "_"), F.split(b, "_")
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.coalesce((a != "") & (b != "") & ((a == b) | inside), F.lit(False))


# metrics


def singular(word: Column) -> Column:
    """A word without the ending of its plural."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when((n > 4) & word.endswith("sses"), F.left(word, n - 2))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1))
        .otherwise(word)
    )


def predicate_label(label: Column) -> Column:
    """A metric's name without repeated blanks and surrounding punctuation."""
    return F.regexp_replace(F.regexp_replace(label, r"\s+", " "), r"^[ \-–—:;,.]+|[ \-–—:;,.]+$", "")


def predicate_key(label: Column, acronyms: Column | None = None) -> Column:
    """The words of a metric's name, singular, without stopwords and repeats, joined by ``_``; acronyms: a map, or none."""
    pattern = F.lit(r"([a-zA-Z][a-zA-Z0-9-]*)")
    words = F.regexp_extract_all(predicate_label(label), pattern, 1)
    if acronyms is not None:
        meant = lambda w: F.when(w == F.upper(w), F.try_element_at(acronyms, F.upper(w)))
        words = F.flatten(F.transform(words, lambda w: F.coalesce(F.regexp_extract_all(meant(w), pattern, 1), F.array(w))))
    lower = F.filter(F.transform(words, F.lower), lambda w: ~_among(STOPWORDS, w))
    return F.coalesce(F.array_join(F.array_distinct(F.transform(lower, singular)), "_"), F.lit(""))


def predicate_match(a: Column, b: Column) -> Column:
    """struct(tier, overlap) of two metric keys: ``exact``, ``phrase``, ``head`` or null."""
    x, y = F.array_distinct(_words(a)), F.array_distinct(_words(b))
    shared = F.size(F.array_intersect(x, y))
    least = F.least(F.size(x), F.size(y))
    overlap = F.when(least > 0, F.bround(shared / least, 3)).otherwise(0.0)
    last = F.element_at(_words(a), -1)
    same_head = last == F.element_at(_words(b), -1)
    tier = (
        F.when((a == "") | (b == "") | (least == 0) | (shared == 0), None)
        .when(a == b, "exact")
        .when((shared >= 2) & (shared >= 0.75 * least) & (same_head | (shared >= 3)), "phrase")
        .when(same_head & (shared == least) & (F.length(last) >= 5), "head")
    )
    return F.struct(tier.alias("tier"), F.when((a == b) & (a != ""), 1.0).otherwise(F.coalesce(overlap, F.lit(0.0))).alias("overlap"))


def predicates_related(a: Column, b: Column) -> Column:
    """Whether two metric keys share a word without meaning the same metric."""
    return F.coalesce((a != "") & (b != "") & (a != b) & predicate_match(a, b)["tier"].isNull() & F.arrays_overlap(F.split(a, "_"), F.split(b, "_")), F.lit(False))


# quantities


def measurement(token: Column) -> Column:
    """struct(unit, family) where a word after a number names what is measured, else null: a symbol, a unit or a plural noun."""
    raw = F.regexp_replace(F.trim(token), r"^[.,;:]+|[.,;:]+$", "")
    low = F.lower(raw)
    family = F.coalesce(_lookup(SYMBOLS, low), _lookup(UNIT_WORDS, low))
    ruled_out = sorted({*NO_UNITS, *STOPWORDS, *MAGNITUDES, *MONTHS, *(c for c, _ in CURRENCIES), *LEGAL_FORMS})
    plural = raw.rlike(r"^\p{Ll}{4,}$") & ~_among(ruled_out, low) & ~low.rlike(r"(?:ly|ing|ed)$") & low.rlike(r"[^su]s$")
    known = F.coalesce(family, F.when(plural, "count"))
    return F.when(raw.rlike(r"^\p{L}") & known.isNotNull(), F.struct(low.alias("unit"), known.alias("family")))


def detect_unit(text: Column) -> Column:
    """The unit of a quantity's text: a share, basis points, a currency, or the first word that is a measurement."""
    low = F.lower(text)
    share = text.contains("%") | low.rlike(r"\bper\s*cent\b|\bpercent\b|\bpercentage\b")
    found = F.when(share & low.rlike(r"\bof\s+gdp\b"), "% of GDP").when(share, "%").when(low.rlike(r"\bbps\b|basis points"), "bps")
    for sign, code in CURRENCIES:
        found = found.when(low.rlike(rf"\b{sign}\b") if sign.isalpha() else low.contains(sign), code)
    words = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9]*)"), 1), lambda w: measurement(w)["unit"])
    return found.otherwise(F.get(F.filter(words, lambda u: u.isNotNull()), F.lit(0)))


def magnitude(tail: Column) -> Column:
    """The factor that one of the first two words after a number names, else 1."""
    words = F.slice(F.regexp_extract_all(F.lower(F.left(tail, F.lit(24))), F.lit(r"([a-z]+)"), 1), 1, 2)
    factors = F.filter(F.transform(words, lambda w: _lookup(MAGNITUDES, w)), lambda f: f.isNotNull())
    return F.coalesce(F.get(factors, F.lit(0)), F.lit(1.0))


def parse_quantity(raw: Column) -> Column:
    """struct(mantissa, unit, normalized) of a quantity's text; brackets around the numeral or a leading minus make it negative."""
    text = F.trim(clean(raw))
    negative = text.rlike(r"^\s*[-−]") | text.rlike(r"\(\s*[^()a-zA-Z]*\d[\d,.\s]*[a-zA-Z%.]{0,8}\s*\)")
    numeral = F.regexp_extract(text, r"(\d[\d, ']*(?:\.\d+)?)", 1)
    size = F.regexp_replace(numeral, "[, ']", "").try_cast("double")
    mantissa = F.when(negative, -size).otherwise(size)
    tail = F.substring_index(F.concat(F.lit("\u0001"), F.regexp_replace(text, r"^[^\d]*\d[\d, ']*(?:\.\d+)?", "\u0001")), "\u0001", -1)
    unit = detect_unit(text)
    value = F.when(unit.isin("%", "% of GDP", "bps"), mantissa).otherwise(mantissa * magnitude(tail))
    return F.when(raw.isNotNull() & (raw != ""), F.struct(mantissa.alias("mantissa"), unit.alias("unit"), value.alias("normalized")))


def unit_family(unit: Column) -> Column:
    """The family of a unit; ``unknown`` for none, ``other`` for one without family."""
    return F.when(unit.isNull() | (unit == ""), "unknown").otherwise(F.coalesce(_lookup(FAMILIES, unit), measurement(unit)["family"], F.lit("other")))


def units_comparable(a: Column, b: Column) -> Column:
    """Whether quantities of two units may be compared: one has none, or the families agree and currencies are the same."""
    x, y = unit_family(a), unit_family(b)
    return (x == "unknown") | (y == "unknown") | ((x == y) & ((x != "currency") | (a == b)))


def general(value: Column, digits: int) -> Column:
    """A number with so many significant digits, in scientific form outside 1e-4 to 1e``digits``."""
    sci = F.format_string(f"%.{digits - 1}e", value)
    power = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    plain = F.regexp_replace(F.regexp_replace(sci.cast("double").cast(f"decimal(38,{digits + 3})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(F.regexp_extract(sci, r"^([-\d.]+)e", 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(value == 0, "0").when((power < -4) | (power >= digits), F.concat(short, F.lit("e"), exponent)).otherwise(plain)


def describe_value(value: Column, unit: Column) -> Column:
    """A value with its unit for readers: shares as they are, others in T, B, M or K with four digits; ``n/a`` for null."""
    size, named = F.abs(value), F.coalesce(unit, F.lit(""))
    shown = F.when(unit.isin("%", "% of GDP"), F.concat(general(value, 6), F.lit("%"))).when(unit == "bps", F.concat(general(value, 6), F.lit(" bps")))
    for step, letter in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")):
        shown = shown.when(size >= step, F.trim(F.concat(general(value / step, 4), F.lit(f"{letter} "), named)))
    return F.when(value.isNull(), "n/a").otherwise(shown.otherwise(F.trim(F.concat(general(value, 4), F.lit(" "), named))))


# periods


def _year(token: Column) -> Column:
    """A year of two or four digits; two digits under 80 are of this century."""
    n = token.try_cast("int")
    return F.when(F.length(token) == 4, n).when(n < 80, n + 2000).otherwise(n + 1900)


def period_key(text: Column) -> Column:
    """A period as ``YYYY-YYYY``, ``YYYY-Qn``, ``YYYY-MM-DD`` (months by their last day) or ``YYYY``, or null."""
    low = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    group = lambda pattern, n: F.regexp_extract(low, pattern, n)
    four = lambda n: F.lpad(n.cast("string"), 4, "0")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    quarter = r"\bq([1-4])\s*[:\-]?\s*(?:fy)?\s*(\d{4}|\d{2})(?:\s*[-/]\s*(\d{2,4}))?"
    by_quarter = F.when(group(quarter, 1) != "", F.concat(_year(group(quarter, 2)).cast("string"), F.lit("-Q"), group(quarter, 1)))
    day_first, month_first = r"\b(\d{1,2})\s+([a-z]+)\s+(\d{4})\b", r"\b([a-z]+)\s+(\d{1,2}),?\s+(\d{4})\b"

    def day(pattern: str, d: int, m: int) -> Column:
        month = _lookup(MONTHS, group(pattern, m))
        return F.when(month.isNotNull(), F.concat_ws("-", four(group(pattern, 3).try_cast("int")), two(month), two(group(pattern, d).try_cast("int"))))

    monthly = r"\b(?:end[\s-]*(?:of\s+)?)?([a-z]+)[\s-]+(\d{4})\b"
    month, year = _lookup(MONTHS, group(monthly, 1)), group(monthly, 2).try_cast("int")
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    by_month = F.when(month.isNotNull(), F.concat_ws("-", four(year), two(month), two(last)))
    span = r"\b(?:fy\s*)?(\d{4}|\d{2})\s*[-/–]\s*(\d{4}|\d{2})\b"
    first, end = _year(group(span, 1)), group(span, 2)
    near = F.floor(first / 100) * 100 + end.try_cast("int")
    second = F.when(F.length(end) == 4, end.try_cast("int")).when(near < first, near + 100).otherwise(near)
    by_span = F.when((group(span, 1) != "") & first.between(1900, 2100) & (second == first + 1), F.concat_ws("-", first.cast("string"), second.cast("string")))
    fiscal = r"\bfy\s*(\d{4}|\d{2})\b"
    ends = _year(group(fiscal, 1))
    by_fiscal = F.when(group(fiscal, 1) != "", F.concat_ws("-", (ends - 1).cast("string"), ends.cast("string")))
    calendar = group(r"\b(19\d{2}|20\d{2})\b", 1)
    return F.coalesce(by_quarter, day(day_first, 1, 2), day(month_first, 2, 1), by_month, by_span, by_fiscal, F.when(calendar != "", calendar))


def periods_overlap(a: Column, b: Column) -> Column:
    """Whether two period keys are the same; a span does not hold its days."""
    return F.coalesce((a != "") & (a == b), F.lit(False))
