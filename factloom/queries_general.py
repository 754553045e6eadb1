"""Queries of the general operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.quantities import to_common_units
from factloom.operators.timestamps import normalise_times
from factloom.plans.joins import lookup_join
from factloom.sources.tables import table

#: Tasks over which the rows of one document are spread where its category is looked up by a shuffle.
SALTS = 8


def document_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id and its category; repeated rows of a document count once."""
    return table(spark, sf_dir, "source_documents").where("id is not null").groupBy(F.col("id").alias("document_id")).agg(F.max("dataset_category").alias("source"))


def p4_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moment of each fact without a normalised time, with its posterior and, where it is not resolved, the reason."""
    facts = table(spark, sf_dir, "facts").where("time_period_normalized is null and time_period is not null").select("id", "document_id", F.col("time_period").alias("text")).distinct()
    values = lookup_join(facts, document_categories(spark, sf_dir), "document_id", salts=SALTS).drop("document_id")
    conventions = table(spark, sf_dir, "publisher_conventions").select(F.col("dataset_category").alias("source"), "time_zone", "date_order")
    return normalise_times(values, conventions, table(spark, sf_dir, "zone_abbreviations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without a normalised time whose text states a day or a moment."""
    return p4_times(spark, sf_dir).where("moment is not null").select("id", "moment").distinct()


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = ~F.col("value_raw").rlike(r"[\p{L}\p{Sc}%‰]")
    facts = table(spark, sf_dir, "facts").select(
        "id", "document_id", "value_raw", "unit", "value_numeric", F.when(bare, F.col("evidence_quote")).alias("evidence_quote")
    )
    placed = lookup_join(facts, document_categories(spark, sf_dir), "document_id", salts=SALTS)
    values = lookup_join(placed, table(spark, sf_dir, "publisher_conventions").select(F.col("dataset_category").alias("source"), "decimal_mark"), "source", salts=SALTS)
    # a table of one row for each of the families, whose number is fixed
    targets = {r["unit_family"]: r["common_unit"] for r in table(spark, sf_dir, "common_units").collect()}
    return to_common_units(values, targets, ["id", "value_raw", "value_numeric"])


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of ``facts`` in the common unit beside what the table holds, or the reason why there is none."""
    return _values(spark, sf_dir).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose number is missing or differs from the stated quantity in the common unit by more than a thousandth."""
    wrong = F.col("value_numeric").isNull() | F.isnan("value_numeric") | (F.abs(F.col("value_numeric") - F.col("quantity")) > F.abs(F.col("quantity")) * 0.001)
    return _values(spark, sf_dir).where("value_common is not null").where(wrong).select("id", "common_unit", "value_common").distinct()


QUERIES = {"p4_found": p4_found, "p4_times": p4_times, "p6_found": p6_found, "p6_values": p6_values}


# Units as they are written, lower-cased, with what one of them is in the family's common unit, as a fraction.
_UNITS = """
ratio bps 1 1: bps, basis points, basis point
ratio bps 10 1: ‰, per mille, permille
ratio bps 100 1: %, per cent, percent, pct
mass g 1000 1: kg, kgs, kilogram, kilograms
mass g 1 1: g, gram, grams
mass g 1000000 1: t, mt, tonne, tonnes, metric tonnes, metric tonne
mass g 1000000000 1: kt, kilotonne, kilotonnes
mass g 100000 1: quintal, quintals
mass g 45359237 100000: lb, lbs, pound, pounds
mass g 90718474 100: short ton, short tons
energy Wh 1000 1: kwh, kilowatt-hour, kilowatt-hours
energy Wh 1000000 1: mwh, megawatt-hour, megawatt-hours
energy Wh 1000000000 1: gwh, gigawatt-hour, gigawatt-hours
energy Wh 1000000000000 1: twh, terawatt-hour, terawatt-hours
energy Wh 1000000000 3600: gj, gigajoule, gigajoules
power W 1000 1: kw, kilowatt, kilowatts
power W 1000000 1: mw, megawatt, megawatts
power W 1000000000 1: gw, gigawatt, gigawatts
distance m 1 1: m, metre, metres, meter, meters
distance m 1000 1: km, kms, kilometre, kilometres, kilometer, kilometers
distance m 1609344 1000: mi, mile, miles
distance m 3048 10000: ft, foot, feet
area sqm 1 1: sqm, sq. m, sq m, m², m2, square metre, square metres
area sqm 9290304 100000000: sqft, sq. ft., sq. ft, sq ft, square foot, square feet
area sqm 10000 1: ha, hectare, hectares
area sqm 40468564224 10000000: acre, acres
area sqm 1000000 1: sq km, km², km2, square kilometres
volume l 1 1: l, litre, litres, liter, liters
volume l 1000 1: kl, kilolitre, kilolitres, cu m, m³, m3, cubic metre, cubic metres
volume l 1000000 1: ml, megalitre, megalitres
volume l 3785411784 1000000000: gal, gallon, gallons
volume l 158987294928 1000000000: bbl, barrel, barrels
duration s 60 1: min, minute, minutes
duration s 3600 1: h, hr, hrs, hour, hours
duration s 86400 1: d, day, days
duration s 604800 1: week, weeks
count count 1 1: parcels, lamps, visits, policies, vehicles, students
"""
_UNIT_ROWS = ", ".join(f"('{u.strip()}', '{common}', {num}::HUGEINT, {den}::HUGEINT)" for line in _UNITS.strip().splitlines() for head, names in [line.split(":")] for _, common, num, den in [head.split()] for u in names.split(","))
_CODES = "CASE upper(rtrim({0}, '.')) WHEN 'US$' THEN 'USD' WHEN '$' THEN 'USD' WHEN 'USD' THEN 'USD' WHEN '₹' THEN 'INR' WHEN 'RS' THEN 'INR' WHEN 'INR' THEN 'INR' WHEN '€' THEN 'EUR' WHEN 'EUR' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN 'GBP' THEN 'GBP' WHEN '¥' THEN 'JPY' WHEN 'JPY' THEN 'JPY' WHEN 'S$' THEN 'SGD' WHEN 'SGD' THEN 'SGD' END"
_GROUP = "[\\d.,\\s\\x{00a0}\\x{202f}\\x{2009}''’]"
_NUM = f"\\d(?:{_GROUP}*\\d)?"
_MAGNITUDE = "(hundred|thousand|k|lakhs?|lac|million|mn|mln|crores?|cr|billion|bn|trillion|tn)"
_VALUES_SQL = f"""WITH units(u, common, num, den) AS (VALUES {_UNIT_ROWS}),
    placed AS (SELECT id, max(dataset_category) AS category FROM source_documents WHERE id IS NOT NULL GROUP BY id),
    raws AS (SELECT DISTINCT f.id, value_raw AS raw, value_numeric, f.unit, evidence_quote AS q, coalesce(decimal_mark, '.') AS mark FROM facts f LEFT JOIN placed ON placed.id = document_id LEFT JOIN publisher_conventions ON dataset_category = category WHERE value_raw IS NOT NULL),
    cut AS (SELECT *, regexp_extract(raw, '^[\\s(−–-]*(US\\$|S\\$|Rs\\.?|USD|INR|EUR|GBP|JPY|SGD|[$₹€£¥])', 1, 'i') AS cur, regexp_extract(raw, '{_NUM}') AS numeral, regexp_matches(raw, '^[^\\d]*[(−–-]') AS minus,
            trim(regexp_replace(raw, '^[^\\d]*{_NUM}', ''), ' )') AS tail FROM raws),
    said AS (SELECT *, CASE WHEN cur = '' AND tail = '' THEN trim(coalesce(nullif(regexp_extract(q, '\\((?:figures )?in ([^()]+)\\) as ' || regexp_escape(raw) || '(?:[^\\d.,]|[.,][^\\d]|[.,]?$)', 1), ''), nullif(regexp_extract(q, ', in ([^,;()]+),[^,;()]*? ' || regexp_escape(raw) || '(?:[^\\d.,]|[.,][^\\d]|[.,]?$)', 1), ''),
            nullif(regexp_extract(q, '[ ]' || regexp_escape(raw) || ', all amounts being stated in ((?:sq\\. ft|sq\\. m|[^.,(\\[])+)', 1), ''), unit)) ELSE tail END AS words FROM cut),
    parted AS (SELECT *, lower(regexp_extract(words, '^{_MAGNITUDE}\\b', 1, 'i')) AS mag, trim(regexp_replace(words, '^{_MAGNITUDE}\\b', '', 'i')) AS said_unit FROM said),
    counted AS (SELECT *, coalesce({_CODES.format("nullif(cur, '')")}, {_CODES.format("said_unit")}) AS code, replace(regexp_replace(regexp_replace(numeral, '[\\s\\x{{00a0}}\\x{{202f}}\\x{{2009}}''’]', '', 'g'), CASE mark WHEN ',' THEN '\\.' ELSE ',' END, '', 'g'), mark, '.') AS plain,
            CASE rtrim(mag, 's') WHEN 'hundred' THEN 100 WHEN 'thousand' THEN 1000 WHEN 'k' THEN 1000 WHEN 'lakh' THEN 100000 WHEN 'lac' THEN 100000 WHEN 'million' THEN 1000000 WHEN 'mn' THEN 1000000 WHEN 'mln' THEN 1000000 WHEN 'crore' THEN 10000000 WHEN 'cr' THEN 10000000
                 WHEN 'billion' THEN 1000000000 WHEN 'bn' THEN 1000000000 WHEN 'trillion' THEN 1000000000000 WHEN 'tn' THEN 1000000000000 ELSE 1 END::HUGEINT AS factor FROM parted),
    scaled AS (SELECT c.id, value_numeric, coalesce(code, common) AS common_unit, (try_cast(plain AS DECIMAL(30, 6)) * 1000000)::HUGEINT * factor * CASE WHEN code IS NULL THEN num ELSE 1 END * CASE WHEN minus THEN -1 ELSE 1 END AS p, CASE WHEN code IS NULL THEN den ELSE 1 END * 1000000::HUGEINT AS d
            FROM counted c LEFT JOIN units ON code IS NULL AND u = lower(said_unit) WHERE code IS NOT NULL OR common IS NOT NULL)
    SELECT DISTINCT id, value_numeric, common_unit, (CASE WHEN p < 0 THEN -1 ELSE 1 END * ((2 * abs(p) + d) // (2 * d)))::BIGINT AS value_common, p::DOUBLE / d::DOUBLE AS quantity FROM scaled WHERE p IS NOT NULL"""
ORACLE = {"p6_found": f"SELECT DISTINCT id, common_unit, value_common FROM ({_VALUES_SQL}) WHERE value_numeric IS NULL OR isnan(value_numeric) OR abs(value_numeric - quantity) > abs(quantity) * 0.001"}

_MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH_NUMBER = lambda t: "CASE lower(left(" + t + ", 3)) " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(_MONTH_NAMES, 1)) + " END"
_MONTH_WORD = "((?:" + "|".join(_MONTH_NAMES) + ")[a-z]*)"
_DAY = lambda y, m, d: f"try_cast(printf('%04d-%02d-%02d', ({y})::INT, ({m})::INT, ({d})::INT) AS DATE)"
_X = lambda pattern, n, what="t": f"regexp_extract({what}, '{pattern}', {n}, 'i')"
_YMD, _ABC = "^(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})(.*)$", "^(\\d{1,2})[-/.](\\d{1,2})[-/.](\\d{4}|\\d{2})(\\D.*)?$"
_DMON, _MOND = f"^(\\d{{1,2}})(?:st|nd|rd|th)?[ -]*{_MONTH_WORD}\\.?,?[ -]*[''’]?(\\d{{4}}|\\d{{2}})(.*)$", f"^{_MONTH_WORD} (\\d{{1,2}})(?:st|nd|rd|th)?, (\\d{{4}})(.*)$"
_CLOCK = "^(?:T|,? (?:at )?)(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:[.,]\\d+)?)?(?: ?([ap])[.]?m\\b[.]?)? ?(.*)$"
_FULL = lambda y: f"CASE WHEN len({y}) = 2 THEN 2000 + ({y})::INT ELSE ({y})::INT END"
_TIMES_SQL = f"""WITH placed AS (SELECT id, max(dataset_category) AS category FROM source_documents WHERE id IS NOT NULL GROUP BY id),
    texts AS (SELECT DISTINCT f.id, trim(regexp_replace(time_period, '\\s+', ' ', 'g')) AS whole, coalesce(time_zone, 'UTC') AS home, coalesce(date_order, 'YMD') AS ord FROM facts f LEFT JOIN placed ON placed.id = document_id LEFT JOIN publisher_conventions ON dataset_category = category
              WHERE time_period_normalized IS NULL AND time_period IS NOT NULL),
    led AS (SELECT *, regexp_replace(regexp_replace(whole, '^(as (on|at|of)|position (at|on)|dated|on|at) ', '', 'i'), '^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ', '', 'i') AS x FROM texts),
    turned AS (SELECT *, CASE WHEN regexp_matches(x, '^\\d{{1,2}}:\\d{{2}} on ') THEN regexp_extract(x, ' on (.*)$', 1) || ' ' || regexp_extract(x, '^(\\d{{1,2}}:\\d{{2}}) on ', 1)
               WHEN regexp_full_match(x, '\\d{{8}}(T?\\d{{6}}Z?)?') THEN regexp_replace(regexp_replace(x, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})', '\\1-\\2-\\3'), '(\\d-\\d\\d)T?(\\d{{2}})(\\d{{2}})(\\d{{2}})(Z?)$', '\\1T\\2:\\3:\\4\\5') ELSE x END AS t FROM led),
    dated AS (SELECT *, CASE WHEN regexp_full_match(t, '\\d{{10}}|\\d{{13}}') THEN 'epoch' WHEN regexp_matches(t, '{_YMD}') THEN 'ymd' WHEN regexp_matches(t, '{_ABC}') THEN 'abc' WHEN regexp_matches(t, '{_DMON}', 'i') THEN 'dmon' WHEN regexp_matches(t, '{_MOND}', 'i') THEN 'mond' END AS kind FROM turned),
    days AS (SELECT *, CASE kind WHEN 'ymd' THEN {_DAY(_X(_YMD, 1), _X(_YMD, 2), _X(_YMD, 3))} WHEN 'dmon' THEN {_DAY(_FULL(_X(_DMON, 3)), _MONTH_NUMBER(_X(_DMON, 2)), _X(_DMON, 1))} WHEN 'mond' THEN {_DAY(_X(_MOND, 3), _MONTH_NUMBER(_X(_MOND, 1)), _X(_MOND, 2))}
             WHEN 'abc' THEN CASE WHEN ord = 'YMD' AND len({_X(_ABC, 3)}) = 2 THEN {_DAY("2000 + (" + _X(_ABC, 1) + ")::INT", _X(_ABC, 2), _X(_ABC, 3))} WHEN ord = 'MDY' THEN coalesce({_DAY(_FULL(_X(_ABC, 3)), _X(_ABC, 1), _X(_ABC, 2))}, {_DAY(_FULL(_X(_ABC, 3)), _X(_ABC, 2), _X(_ABC, 1))})
                  ELSE coalesce({_DAY(_FULL(_X(_ABC, 3)), _X(_ABC, 2), _X(_ABC, 1))}, {_DAY(_FULL(_X(_ABC, 3)), _X(_ABC, 1), _X(_ABC, 2))}) END END AS day,
             CASE kind WHEN 'ymd' THEN {_X(_YMD, 4)} WHEN 'abc' THEN {_X(_ABC, 4)} WHEN 'dmon' THEN {_X(_DMON, 4)} WHEN 'mond' THEN {_X(_MOND, 4)} ELSE '' END AS rest FROM dated),
    clocks AS (SELECT *, {_X(_CLOCK, 1, "rest")} AS h, {_X(_CLOCK, 2, "rest")} AS mi, coalesce(nullif({_X(_CLOCK, 3, "rest")}, ''), '0') AS s, lower({_X(_CLOCK, 4, "rest")}) AS half, trim({_X(_CLOCK, 5, "rest")}, ' ()[]') AS zone FROM days),
    locals AS (SELECT c.*, CASE WHEN h <> '' THEN day::TIMESTAMP + to_hours(CASE WHEN half = '' THEN h::INT ELSE h::INT % 12 + CASE half WHEN 'p' THEN 12 ELSE 0 END END) + to_minutes(mi::INT) + to_seconds(s::INT) END AS here,
               CASE WHEN upper(zone) = 'Z' THEN 0 WHEN regexp_full_match(zone, '(UTC|GMT)?[+-]\\d{{1,2}}(:?\\d{{2}})?') THEN (CASE WHEN contains(zone, '-') THEN -1 ELSE 1 END) * (regexp_extract(zone, '[+-](\\d{{1,2}})', 1)::INT * 60 + coalesce(nullif(regexp_extract(zone, '[+-]\\d{{1,2}}:?(\\d{{2}})$', 1), ''), '0')::INT) ELSE utc_offset_minutes END AS east
               FROM clocks c LEFT JOIN zone_abbreviations ON upper(zone) = abbreviation),
    moments AS (SELECT *, CASE WHEN east IS NOT NULL THEN here - to_minutes(east) WHEN zone = '' OR contains(zone, '/') THEN timezone('UTC', CASE WHEN timezone(CASE WHEN zone = '' THEN home ELSE zone END, timezone(CASE WHEN zone = '' THEN home ELSE zone END, here) - INTERVAL 1 HOUR) = here
                THEN timezone(CASE WHEN zone = '' THEN home ELSE zone END, here) - INTERVAL 1 HOUR ELSE timezone(CASE WHEN zone = '' THEN home ELSE zone END, here) END) END AS utc FROM locals)
    SELECT DISTINCT id, CASE WHEN kind = 'epoch' THEN strftime(make_timestamp(left(t, 10)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') WHEN rest = '' THEN strftime(day, '%Y-%m-%d') ELSE strftime(utc, '%Y-%m-%dT%H:%M:%SZ') END AS moment FROM moments"""
ORACLE["p4_found"] = f"SELECT id, moment FROM ({_TIMES_SQL}) WHERE moment IS NOT NULL"
