"""The reference's queries over the stored tables, each beside SQL that says the same.

Repeated rows of an id count once.  Where an order of the reference leaves ties open, the id decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.functions import normalise as N
from factloom.functions.vocabulary import CURRENCIES, FAMILIES, LEGAL_FORMS, MAGNITUDES, MONTHS, NO_UNITS, STOPWORDS, SYMBOLS, UNIT_WORDS
from factloom.operators import compare as C
from factloom.operators import extract as X
from factloom.operators import pages as P
from factloom.operators.profile import profile_documents
from factloom.plans.joins import lookup_join
from factloom.plans.staging import Stage
from factloom.session import small_methods
from factloom.sources.tables import table

TOP, PAGE, MAX_ISSUES, SHOWN_ISSUES, SHOWCASE, WEAK = 6, 100, 200, 50, 60, 0.6
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with the SQL that says the same."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE[run.__name__] = sql
        return run

    return add


def _facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "facts").select("id", *columns).distinct()


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fact_relationships").where("id is not null").select("id", "fact_a_id", "fact_b_id", "relationship_type", "comparison_summary", "confidence", F.col("reconciliation_factors").alias("f")).distinct()


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships without the wide columns."""
    return table(spark, sf_dir, "fact_relationships").where("id is not null").select("id", "fact_a_id", "fact_b_id", "relationship_type", "confidence").distinct()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_documents").where("id is not null").distinct()


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _case(key: str, values: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


_F = "(SELECT DISTINCT id, document_id, subject, subject_normalized, predicate, predicate_label, value_raw, value_text, value_numeric, unit, unit_family, time_period, time_period_normalized, scope, qualifier, confidence, evidence_quote, evidence_page, char_start, char_end, coalesce(extraction_metadata.period_inferred_from_document, false) AS inferred FROM facts WHERE id IS NOT NULL)"
_E = "(SELECT DISTINCT id, fact_a_id, fact_b_id, relationship_type, confidence FROM fact_relationships WHERE id IS NOT NULL)"
_R = "(SELECT DISTINCT id, fact_a_id, fact_b_id, relationship_type, comparison_summary, confidence, reconciliation_factors AS f FROM fact_relationships WHERE id IS NOT NULL)"


# ---- normalisers over the tables' own texts

_SUBJECT_SQL = f"""
    SELECT subject, coalesce(nullif(shown, ''), 'Unknown') AS display,
           array_to_string(CASE WHEN len(kept) > 0 THEN kept WHEN len(plain) > 0 THEN plain ELSE ['unknown'] END, '_') AS key
    FROM (SELECT *, words[1:coalesce(list_max(list_transform(words, lambda w, i: CASE WHEN w IN {_list(LEGAL_FORMS)} THEN 0 ELSE i END)), 0)] AS kept
          FROM (SELECT subject, shown, regexp_extract_all(lower(coalesce(nullif(shown, ''), 'Unknown')), '[a-z0-9]+') AS plain,
                       list_filter(regexp_extract_all(lower(coalesce(nullif(shown, ''), 'Unknown')), '[a-z0-9&]+'), lambda w: w NOT IN ('the', 'a', 'an')) AS words
                FROM (SELECT subject, trim(regexp_replace(regexp_replace(trim(regexp_replace(subject, '\\s+', ' ', 'g')), '^[,;:.]+|[,;:.]+$', '', 'g'), '[‘’'']s\\b', '', 'g')) AS shown
                      FROM (SELECT DISTINCT subject FROM facts WHERE subject <> ''))))"""


@query(_SUBJECT_SQL)
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject with its display form and key."""
    names = table(spark, sf_dir, "facts").where("subject <> ''").select("subject").distinct()
    return names.select("subject", N.entity_display(F.col("subject")).alias("display"), N.entity_key(F.col("subject")).alias("key"))


_SINGULAR = "CASE WHEN len(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN len(w) > 4 AND w LIKE '%sses' THEN w[:-3] WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"
_LABEL_WORDS = "regexp_extract_all(regexp_replace(label, '\\s+', ' ', 'g'), '[a-zA-Z][a-zA-Z0-9-]*')"
_KEY_SQL = f"array_to_string(list_transform(list_filter(list_transform({_LABEL_WORDS}, lambda w: lower(w)), lambda w: w NOT IN {_list(STOPWORDS)}), lambda w: {_SINGULAR}), '_')"


@query(f"SELECT label, {_KEY_SQL} AS key FROM (SELECT DISTINCT predicate_label AS label FROM facts WHERE predicate_label IS NOT NULL)")
def predicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric's name with its key."""
    names = table(spark, sf_dir, "facts").where("predicate_label is not null").select(F.col("predicate_label").alias("label")).distinct()
    return names.select("label", N.predicate_key(F.col("label")).alias("key"))


def _year_sql(t: str) -> str:
    return f"(CASE WHEN len({t}) = 4 THEN try_cast({t} AS INT) WHEN try_cast({t} AS INT) < 80 THEN try_cast({t} AS INT) + 2000 ELSE try_cast({t} AS INT) + 1900 END)"


_MONTH_SQL = lambda t: _case(t, MONTHS)
_G = lambda p, n: f"regexp_extract(low, '{p}', {n})"
_Q, _D1, _D2 = r"\bq([1-4])\s*[:\-]?\s*(?:fy)?\s*(\d{4}|\d{2})(?:\s*[-/]\s*(\d{2,4}))?", r"\b(\d{1,2})\s+([a-z]+)\s+(\d{4})\b", r"\b([a-z]+)\s+(\d{1,2}),?\s+(\d{4})\b"
_M, _S, _FY, _CY = r"\b(?:end[\s-]*(?:of\s+)?)?([a-z]+)[\s-]+(\d{4})\b", r"\b(?:fy\s*)?(\d{4}|\d{2})\s*[-/–]\s*(\d{4}|\d{2})\b", r"\bfy\s*(\d{4}|\d{2})\b", r"\b(19\d{2}|20\d{2})\b"
_PERIOD_SQL = f"""
    SELECT time_period, coalesce(
        CASE WHEN {_G(_Q, 1)} <> '' THEN {_year_sql(_G(_Q, 2))} || '-Q' || {_G(_Q, 1)} END,
        CASE WHEN ({_MONTH_SQL(_G(_D1, 2))}) IS NOT NULL THEN printf('%04d-%02d-%02d', {_G(_D1, 3)}::INT, {_MONTH_SQL(_G(_D1, 2))}, {_G(_D1, 1)}::INT) END,
        CASE WHEN ({_MONTH_SQL(_G(_D2, 1))}) IS NOT NULL THEN printf('%04d-%02d-%02d', {_G(_D2, 3)}::INT, {_MONTH_SQL(_G(_D2, 1))}, {_G(_D2, 2)}::INT) END,
        CASE WHEN ({_MONTH_SQL(_G(_M, 1))}) IS NOT NULL THEN strftime(last_day(make_date({_G(_M, 2)}::INT, {_MONTH_SQL(_G(_M, 1))}, 1)), '%Y-%m-%d') END,
        CASE WHEN {_G(_S, 1)} <> '' AND y1 BETWEEN 1900 AND 2100 AND
             CASE WHEN len({_G(_S, 2)}) = 4 THEN {_G(_S, 2)}::INT WHEN y1 // 100 * 100 + {_G(_S, 2)}::INT < y1 THEN y1 // 100 * 100 + {_G(_S, 2)}::INT + 100 ELSE y1 // 100 * 100 + {_G(_S, 2)}::INT END = y1 + 1
             THEN y1 || '-' || (y1 + 1) END,
        CASE WHEN {_G(_FY, 1)} <> '' THEN ({_year_sql(_G(_FY, 1))} - 1) || '-' || {_year_sql(_G(_FY, 1))} END,
        nullif({_G(_CY, 1)}, '')) AS period
    FROM (SELECT *, {_year_sql(_G(_S, 1))} AS y1 FROM (SELECT DISTINCT time_period, lower(trim(regexp_replace(time_period, '\\s+', ' ', 'g'))) AS low FROM facts WHERE time_period <> ''))"""


@query(_PERIOD_SQL)
def period_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated period with its key."""
    return table(spark, sf_dir, "facts").where("time_period <> ''").select("time_period").distinct().select("time_period", N.period_key(F.col("time_period")).alias("period"))


_RULED_OUT = sorted({*NO_UNITS, *STOPWORDS, *MAGNITUDES, *MONTHS, *(c for c, _ in CURRENCIES), *LEGAL_FORMS})


def _measure_sql(w: str, what: str) -> str:
    low = f"lower({w})"
    known = SYMBOLS | UNIT_WORDS
    plural = f"regexp_full_match({w}, '[a-z]{{4,}}') AND {low} NOT IN {_list(_RULED_OUT)} AND NOT regexp_matches({low}, '(ly|ing|ed)$') AND regexp_matches({low}, '[^su]s$')"
    if what == "unit":
        return f"(CASE WHEN {low} IN {_list(known)} OR ({plural}) THEN {low} END)"
    return f"coalesce({_case(low, {k: v for k, v in known.items()})}, CASE WHEN {plural} THEN 'count' END)"


_FAMILY_SQL = lambda u: f"CASE WHEN {u} IS NULL OR {u} = '' THEN 'unknown' ELSE coalesce({_case(u, FAMILIES)}, {_measure_sql(u, 'family')}, 'other') END"


@query(f"SELECT unit, {_FAMILY_SQL('unit')} AS family FROM (SELECT DISTINCT unit FROM facts)")
def unit_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with its family."""
    return table(spark, sf_dir, "facts").select("unit").distinct().select("unit", N.unit_family(F.col("unit")).alias("family"))


_CURRENCY_SQL = " ".join(f"WHEN regexp_matches(low, '\\b{s}\\b') THEN '{c}'" if s.isalpha() else f"WHEN contains(low, '{s}') THEN '{c}'" for s, c in CURRENCIES)
_QUANTITY_SQL = f"""
    SELECT value_raw, mantissa, unit, CASE WHEN unit IN ('%', '% of GDP', 'bps') THEN mantissa ELSE mantissa * factor END AS normalized
    FROM (SELECT value_raw, CASE WHEN regexp_matches(s, '^\\s*[-−]') OR regexp_matches(s, '\\(\\s*[^()a-zA-Z]*\\d[\\d,.\\s]*[a-zA-Z%.]{{0,8}}\\s*\\)') THEN -size ELSE size END AS mantissa,
            CASE WHEN share AND regexp_matches(low, '\\bof\\s+gdp\\b') THEN '% of GDP' WHEN share THEN '%' WHEN regexp_matches(low, '\\bbps\\b|basis points') THEN 'bps' {_CURRENCY_SQL}
                 ELSE list_filter(list_transform(regexp_extract_all(s, '[A-Za-z][A-Za-z0-9]*'), lambda w: {_measure_sql('w', 'unit')}), lambda u: u IS NOT NULL)[1] END AS unit,
            coalesce(list_filter(list_transform(regexp_extract_all(lower(left(tail, 24)), '[a-z]+')[1:2], lambda w: {_case('w', MAGNITUDES)}), lambda x: x IS NOT NULL)[1], 1.0)::DOUBLE AS factor
          FROM (SELECT *, lower(s) AS low, contains(s, '%') OR regexp_matches(lower(s), '\\bper\\s*cent\\b|\\bpercent\\b|\\bpercentage\\b') AS share,
                       try_cast(regexp_replace(regexp_extract(s, '\\d[\\d, '']*(?:\\.\\d+)?'), '[, '']', '', 'g') AS DOUBLE) AS size, regexp_replace(s, '^[^\\d]*\\d[\\d, '']*(?:\\.\\d+)?', '') AS tail
                FROM (SELECT DISTINCT value_raw, trim(value_raw) AS s FROM facts WHERE value_raw <> '')))"""


@query(_QUANTITY_SQL)
def quantity_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value's text as mantissa, unit and number."""
    values = table(spark, sf_dir, "facts").where("value_raw <> ''").select("value_raw").distinct()
    return values.withColumn("q", N.parse_quantity(F.col("value_raw"))).select("value_raw", "q.mantissa", "q.unit", "q.normalized")


@query()
def value_renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value and unit as shown to readers; the last digit rounds half up by the decimal form, so SQL engines differ on ties."""
    values = table(spark, sf_dir, "facts").where("value_numeric is null or (not isnan(value_numeric) and abs(value_numeric) < double('Infinity'))").select("value_numeric", "unit").distinct()
    return values.select("value_numeric", "unit", N.describe_value(F.col("value_numeric"), F.col("unit")).alias("shown"))


# ---- pairing and comparison

_TOKENS = f"(SELECT predicate, t AS token, n FROM (SELECT predicate, count(*) AS n FROM {_F} GROUP BY predicate), unnest(list_distinct(list_filter(string_split(predicate, '_'), lambda w: w <> ''))) AS u(t))"
_FREQUENCY = f"SELECT token, sum(n)::BIGINT AS facts FROM {_TOKENS} GROUP BY token"
_BLOCKS = f"SELECT DISTINCT k.predicate, k.token FROM {_TOKENS} k JOIN ({_FREQUENCY}) c USING (token) WHERE c.facts <= greatest(2, floor((SELECT count(*) FROM {_F}) * 0.15)) OR k.token = list_filter(string_split(k.predicate, '_'), lambda w: w <> '')[-1]"
_TIERS = f"""
    SELECT predicate_a, predicate_b, CASE WHEN predicate_a = predicate_b THEN 'exact' WHEN n >= 2 AND n >= 0.75 * least(len(x), len(y)) AND (x[-1] = y[-1] OR n >= 3) THEN 'phrase'
           WHEN x[-1] = y[-1] AND n = least(len(x), len(y)) AND len(x[-1]) >= 5 THEN 'head' END AS tier, CASE WHEN predicate_a = predicate_b THEN 1.0 ELSE round_even(n / least(len(x), len(y)), 3) END::DOUBLE AS overlap
    FROM (SELECT *, len(list_intersect(x, y)) AS n FROM (SELECT DISTINCT a.predicate AS predicate_a, b.predicate AS predicate_b, string_split(a.predicate, '_') AS x, string_split(b.predicate, '_') AS y FROM ({_BLOCKS}) a JOIN ({_BLOCKS}) b USING (token)))"""
_SUBJECTS = "(SELECT DISTINCT lower(subject_normalized) AS s, string_split(lower(subject_normalized), '_') AS w FROM facts WHERE subject_normalized <> '')"
_COMPATIBLE = f"SELECT a.s AS subject_a, b.s AS subject_b FROM {_SUBJECTS} a, {_SUBJECTS} b WHERE list_has_all(a.w, b.w) OR list_has_all(b.w, a.w)"


@query(_FREQUENCY)
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of metrics with the facts that hold them."""
    return C.token_frequency(C.facts_once(table(spark, sf_dir, "facts")))


@query(_BLOCKS)
def blocking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words by which each metric is indexed."""
    return C.blocking_keys(C.facts_once(table(spark, sf_dir, "facts")))


@query(f"SELECT * FROM ({_TIERS}) WHERE tier IS NOT NULL AND (tier <> 'phrase' OR overlap >= 0.8)")
def predicate_match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of metrics that may carry a verdict."""
    return C.metric_pairs(C.facts_once(table(spark, sf_dir, "facts")))


@query(_COMPATIBLE)
def entity_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of subjects of which one's words are all in the other's."""
    return C.subject_pairs(C.facts_once(table(spark, sf_dir, "facts")))


_PAIRS = f"""
    SELECT a.id AS ia, b.id AS ib, t.tier, t.overlap, a.* RENAME (id AS _x), b.* RENAME (id AS _y) FROM {_F} a JOIN ({_TIERS}) t ON a.predicate = t.predicate_a JOIN ({_COMPATIBLE}) c ON lower(a.subject_normalized) = c.subject_a
    JOIN {_F} b ON b.predicate = t.predicate_b AND lower(b.subject_normalized) = c.subject_b
    WHERE a.id < b.id AND a.document_id <> b.document_id AND t.tier IS NOT NULL AND (t.tier <> 'phrase' OR t.overlap >= 0.8) AND a.confidence >= 0.65 AND b.confidence >= 0.65"""
_SIDES = ", ".join(f"{s}.{c} AS {c}_{s}" for s in "ab" for c in ("value_numeric", "value_raw", "value_text", "unit", "time_period_normalized", "scope", "qualifier", "confidence", "inferred", "predicate_label", "subject"))
_PAIRS = _PAIRS.replace("a.* RENAME (id AS _x), b.* RENAME (id AS _y)", _SIDES)
_FACTORS = f"""
    SELECT *, CASE WHEN value_numeric_a IS NULL OR value_numeric_b IS NULL OR greatest(abs(value_numeric_a), abs(value_numeric_b)) = 0 THEN 0.0 ELSE abs(value_numeric_a - value_numeric_b) / greatest(abs(value_numeric_a), abs(value_numeric_b)) END AS gap,
           coalesce(time_period_normalized_a <> '' AND time_period_normalized_b <> '', false) AND NOT inferred_a AND NOT inferred_b AS stated, coalesce(time_period_normalized_a = time_period_normalized_b, false) AS same,
           coalesce(scope_a <> '' AND scope_b <> '' AND scope_a <> scope_b, false) AS scopes, coalesce(qualifier_a <> '' AND qualifier_b <> '' AND qualifier_a <> qualifier_b, false) AS qualifiers,
           {_FAMILY_SQL('unit_a')} AS fa, {_FAMILY_SQL('unit_b')} AS fb, round_even(least(confidence_a, confidence_b), 3) AS c0 FROM ({_PAIRS})"""
_VERDICTS = f"""
    SELECT *, CASE WHEN NOT (fa = 'unknown' OR fb = 'unknown' OR (fa = fb AND (fa <> 'currency' OR unit_a = unit_b))) THEN 'Incompatible units'
           WHEN (value_numeric_a IS NULL OR value_numeric_b IS NULL) THEN CASE WHEN lower(trim(coalesce(nullif(value_text_a, ''), value_raw_a, ''))) = lower(trim(coalesce(nullif(value_text_b, ''), value_raw_b, ''))) AND trim(coalesce(nullif(value_text_a, ''), value_raw_a, '')) <> '' THEN 'Corroborated' ELSE 'Not numerically comparable' END
           WHEN gap <= 0.015 AND stated AND NOT same THEN NULL WHEN gap <= 0.015 THEN 'Corroborated' WHEN stated AND NOT same THEN 'Different periods' WHEN scopes THEN 'Different scope'
           WHEN NOT (stated AND same) THEN CASE WHEN tier = 'exact' AND conf >= 0.7 THEN 'Period not established' END
           WHEN tier = 'head' THEN NULL WHEN qualifiers THEN 'Revision conflict' ELSE 'Direct conflict' END AS title
    FROM (SELECT *, CASE WHEN tier = 'head' THEN round_even(c0 * 0.8, 3) ELSE c0 END AS conf FROM ({_FACTORS}))"""
_TYPE = "CASE title WHEN 'Incompatible units' THEN 'RELATED_BUT_NOT_COMPARABLE' WHEN 'Not numerically comparable' THEN 'RELATED_BUT_NOT_COMPARABLE' WHEN 'Period not established' THEN 'RELATED_BUT_NOT_COMPARABLE' WHEN 'Corroborated' THEN 'CORROBORATED' WHEN 'Different periods' THEN 'CONTEXTUALLY_DIFFERENT' WHEN 'Different scope' THEN 'CONTEXTUALLY_DIFFERENT' ELSE 'CONTRADICTED' END"
_RELATED = f"""
    SELECT 'rel_' || left(sha1(ia || '|' || ib), 20) AS id, ia AS fact_a_id, ib AS fact_b_id, {_TYPE} AS relationship_type, left(title || ': ' || coalesce(predicate_label_a, ''), 255) AS comparison_summary, conf::DOUBLE AS confidence,
           round_even(gap, 4)::DOUBLE AS relative_difference, stated AND NOT same AS temporal_divergence, scopes AS scope_divergence, qualifiers AS qualifier_divergence, tier AS predicate_match_basis
    FROM ({_VERDICTS}) WHERE title IS NOT NULL"""


@query(f"SELECT ia AS fact_a_id, ib AS fact_b_id, tier, overlap FROM ({_PAIRS})")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of facts of different documents that are worth judging."""
    pairs = C.candidate_pairs(C.facts_once(table(spark, sf_dir, "facts")))
    return pairs.select(F.col("id_a").alias("fact_a_id"), F.col("id_b").alias("fact_b_id"), "tier", "overlap")


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_methods(spark)
    return C.compare_all(table(spark, sf_dir, "facts"))


@query(_RELATED)
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of facts that gets a verdict, with what decides it; the rebuild of all relationships."""
    f = F.col("reconciliation_factors")
    return _related(spark, sf_dir).select("id", "fact_a_id", "fact_b_id", "relationship_type", "comparison_summary", "confidence", *[f[c].alias(c) for c in ("relative_difference", "temporal_divergence", "scope_divergence", "qualifier_divergence", "predicate_match_basis")])


@query()
def relationship_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that says what each verdict rests on."""
    return _related(spark, sf_dir).select("id", "reasoning")


@query(f"SELECT relationship_type, count(*) AS pairs FROM ({_RELATED}) GROUP BY 1")
def rebuilt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the rebuild by kind."""
    return _related(spark, sf_dir).groupBy("relationship_type").agg(F.count("*").alias("pairs"))


@query(f"SELECT comparison_summary, count(*) AS pairs FROM ({_RELATED.replace('gap <= 0.015 AND stated', 'gap <= 0.015 AND stated')}) WHERE comparison_summary LIKE 'Not numerically%' OR comparison_summary LIKE 'Corroborated%' GROUP BY 1")
def textual_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs judged by their numbers' or their texts' agreement, by summary."""
    small_methods(spark)
    return C.count_agreement(table(spark, sf_dir, "facts"))


_NEW = "(SELECT arg_max(id, (coalesce(created_at, TIMESTAMP '1900-01-01'), id)) FROM source_documents)"


@query(f"SELECT r.id, r.relationship_type FROM ({_RELATED}) r JOIN {_F} a ON r.fact_a_id = a.id JOIN {_F} b ON r.fact_b_id = b.id WHERE {_NEW} IN (a.document_id, b.document_id)")
def folded_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships that the latest document's facts bring to all the others."""
    facts = table(spark, sf_dir, "facts")
    latest = table(spark, sf_dir, "source_documents").agg(F.max_by("id", F.struct(F.coalesce("created_at", F.lit("1900-01-01").cast("timestamp_ntz")), "id")).alias("document_id"))
    new = facts.join(F.broadcast(latest), "document_id", "left_semi")  # one row
    old = facts.join(F.broadcast(latest), "document_id", "left_anti")
    return C.fold_in(old, new).select("id", "relationship_type")


# ---- stored facts, relationships and documents


@query("""
        SELECT predicate, min(predicate_label) AS label, count(id) AS fact_count, count(DISTINCT document_id) AS document_count,
               min(unit_family) AS unit_family, round(coalesce(avg(confidence), 0), 3) AS mean_confidence
        FROM (SELECT DISTINCT id, predicate, predicate_label, document_id, unit_family, confidence FROM facts) GROUP BY predicate""")
def metric_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric with its label, facts, documents, family and mean confidence."""
    facts = _facts(spark, sf_dir, "predicate", "predicate_label", "document_id", "unit_family", "confidence")
    return facts.groupBy("predicate").agg(
        F.min("predicate_label").alias("label"),
        F.count("id").alias("fact_count"),
        F.countDistinct("document_id").alias("document_count"),
        F.min("unit_family").alias("unit_family"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("mean_confidence"),
    )


@query("SELECT count(*) AS total_predicates, count(*) FILTER (WHERE n > 1) AS shared_across_documents FROM (SELECT predicate, count(DISTINCT document_id) AS n FROM facts GROUP BY predicate)")
def vocabulary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many metrics there are, and how many more than one document names."""
    spread = table(spark, sf_dir, "facts").groupBy("predicate").agg(F.countDistinct("document_id").alias("n"))
    return spread.agg(F.count("*").alias("total_predicates"), F.count_if(F.col("n") > 1).alias("shared_across_documents"))


def _top(spark: SparkSession, sf_dir: str, column: str, name: str) -> DataFrame:
    counts = _facts(spark, sf_dir, column).groupBy(F.col(column).alias(name)).agg(F.count("id").alias("facts"))
    return counts.orderBy(F.desc("facts"), F.asc_nulls_last(name)).limit(TOP)


_TOP_SQL = "SELECT {0} AS {1}, count(id) AS facts FROM (SELECT DISTINCT id, {0} FROM facts) GROUP BY {0} ORDER BY facts DESC, {1} ASC NULLS LAST LIMIT 6"


@query(_TOP_SQL.format("subject", "subject"))
def top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects with the most facts, ties by name."""
    return _top(spark, sf_dir, "subject", "subject")


@query(_TOP_SQL.format("predicate_label", "metric"))
def top_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics with the most facts, ties by name."""
    return _top(spark, sf_dir, "predicate_label", "metric")


@query("""
        SELECT f.id, p.document_id IS NOT NULL AS page_available, coalesce(contains(p.body, f.evidence_quote), false) AS quote_found_in_page,
               coalesce(substring(p.body, f.char_start + 1, f.char_end - f.char_start) = f.evidence_quote, false) AS offsets_match
        FROM (SELECT DISTINCT id, document_id, evidence_page, evidence_quote, char_start, char_end FROM facts) f
        LEFT JOIN (SELECT DISTINCT document_id, page_number, coalesce(text, '') AS body FROM document_pages) p
        ON f.document_id = p.document_id AND f.evidence_page = p.page_number""")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fact: whether its page is stored, holds the quote, and holds it at the stored offsets."""
    facts = _facts(spark, sf_dir, "document_id", "evidence_page", "evidence_quote", "char_start", "char_end")
    pages = table(spark, sf_dir, "document_pages").select("document_id", F.col("page_number").alias("evidence_page"), F.coalesce("text", F.lit("")).alias("_text"), F.lit(True).alias("_page")).distinct()
    at = F.substring(F.col("_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("evidence_quote")
    return facts.join(pages, ["document_id", "evidence_page"], "left").select(
        "id",
        F.coalesce("_page", F.lit(False)).alias("page_available"),
        F.coalesce(F.contains("_text", "evidence_quote"), F.lit(False)).alias("quote_found_in_page"),
        F.coalesce(at, F.lit(False)).alias("offsets_match"),
    )


_LISTED = ("id", "document_id", "subject", "subject_normalized", "predicate", "predicate_label", "value_raw", "value_numeric", "unit_family", "time_period_normalized", "confidence", "evidence_quote")


def filter_facts(facts: DataFrame, document_id: str | None = None, subject: str | None = None, predicate: str | None = None, unit_family: str | None = None, min_confidence: float = 0.0, search: str | None = None) -> DataFrame:
    """Facts that pass all given filters; texts match anywhere, without regard to case, ``%`` and ``_`` as wildcards."""
    like = lambda c, t: F.col(c).ilike(f"%{t}%")
    if document_id:
        facts = facts.where(F.col("document_id") == document_id)
    if subject:
        facts = facts.where(like("subject_normalized", subject))
    if predicate:
        facts = facts.where(like("predicate", predicate))
    if unit_family:
        facts = facts.where(F.col("unit_family") == unit_family)
    if min_confidence > 0:
        facts = facts.where(F.col("confidence") >= min_confidence)
    if search:
        facts = facts.where(like("subject", search) | like("predicate_label", search) | like("value_raw", search) | like("evidence_quote", search))
    return facts


ORDERS = {"confidence": ("confidence", False), "value": ("value_numeric", False), "metric": ("predicate_label", True), "period": ("time_period_normalized", False)}


def sort_facts(facts: DataFrame, sort: str = "confidence", limit: int = PAGE, offset: int = 0) -> DataFrame:
    """One page of facts in an order; an unknown order is that by confidence; nulls come last, ties by id."""
    column, up = ORDERS.get(sort, ORDERS["confidence"])
    return facts.orderBy(F.asc_nulls_last(column) if up else F.desc_nulls_last(column), F.asc("id")).offset(offset).limit(limit)


@query(f"SELECT id, confidence FROM {_F} WHERE unit_family = 'currency' AND confidence >= 0.7 AND predicate ILIKE '%income%' AND subject_normalized ILIKE '%energy%' AND (subject ILIKE '%en%' OR predicate_label ILIKE '%en%' OR value_raw ILIKE '%en%' OR evidence_quote ILIKE '%en%')")
def facts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts through all filters at once."""
    return filter_facts(_facts(spark, sf_dir, *_LISTED[1:]), subject="energy", predicate="income", unit_family="currency", min_confidence=0.7, search="en").select("id", "confidence")


def _page_query(sort: str, column: str, order: str):
    @query(f"SELECT id, {column} FROM {_F} ORDER BY {column} {order} NULLS LAST, id LIMIT 100 OFFSET 20")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sort_facts(_facts(spark, sf_dir, *_LISTED[1:]), sort, PAGE, 20).select("id", column)

    return run


for _sort, (_column, _up) in ORDERS.items():
    _run = _page_query(_sort, _column, "ASC" if _up else "DESC")
    QUERIES[f"facts_by_{_sort}"], ORACLE[f"facts_by_{_sort}"] = QUERIES.pop("run"), ORACLE.pop("run")


@query(f"""SELECT f.id, count(DISTINCT r.id) AS relationships, any_value(p.document_id) IS NOT NULL AS page_available FROM {_F} f
    LEFT JOIN (SELECT id, fact_a_id AS fact FROM {_E} UNION SELECT id, fact_b_id FROM {_E}) r ON r.fact = f.id
    LEFT JOIN (SELECT DISTINCT document_id, page_number FROM document_pages) p ON p.document_id = f.document_id AND p.page_number = f.evidence_page GROUP BY f.id""")
def fact_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact with the number of its relationships and whether its page is stored."""
    facts = _facts(spark, sf_dir, "document_id", F.col("evidence_page").alias("page_number"))
    links = _ends(spark, sf_dir)
    ends = links.select("id", F.col("fact_a_id").alias("fact")).union(links.select("id", F.col("fact_b_id").alias("fact"))).distinct().groupBy(F.col("fact").alias("id")).agg(F.count("*").alias("relationships"))
    pages = table(spark, sf_dir, "document_pages").select("document_id", "page_number", F.lit(True).alias("_page")).distinct()
    out = facts.join(ends, "id", "left").join(pages, ["document_id", "page_number"], "left")
    return out.select("id", F.coalesce("relationships", F.lit(0).cast("long")).alias("relationships"), F.coalesce("_page", F.lit(False)).alias("page_available"))


@query(f"SELECT id, relationship_type, confidence FROM {_E} WHERE relationship_type = 'CONTRADICTED' AND confidence >= 0.7 ORDER BY confidence DESC, id LIMIT 50")
def relationships_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of relationships of one kind above a confidence, surest first."""
    return _ends(spark, sf_dir).where((F.col("relationship_type") == "contradicted".upper()) & (F.col("confidence") >= 0.7)).orderBy(F.desc("confidence"), "id").limit(50).select("id", "relationship_type", "confidence")


@query(f"SELECT relationship_type, count(*) AS n FROM {_E} GROUP BY 1")
def relationship_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored relationships by kind, as written."""
    return _ends(spark, sf_dir).groupBy("relationship_type").agg(F.count("*").alias("n"))


@query(f"SELECT r.id, r.relationship_type, a.value_raw AS value_a, b.value_raw AS value_b, a.document_id AS document_a, b.document_id AS document_b FROM {_E} r LEFT JOIN {_F} a ON r.fact_a_id = a.id LEFT JOIN {_F} b ON r.fact_b_id = b.id")
def relationships_with_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored relationship with both of its facts, null where one is not stored."""
    facts = _facts(spark, sf_dir, "value_raw", "document_id")
    side = lambda s: facts.select(F.col("id").alias(f"fact_{s}_id"), F.col("value_raw").alias(f"value_{s}"), F.col("document_id").alias(f"document_{s}"))
    out = _ends(spark, sf_dir).join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left")
    return out.select("id", "relationship_type", "value_a", "value_b", "document_a", "document_b")


_D = "(SELECT DISTINCT * FROM source_documents WHERE id IS NOT NULL)"


@query(f"SELECT d.id, d.title, d.status, coalesce(c.n, 0)::BIGINT AS fact_count FROM {_D} d LEFT JOIN (SELECT document_id, count(*) AS n FROM {_F} GROUP BY 1) c ON c.document_id = d.id")
def documents_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its facts."""
    counts = _facts(spark, sf_dir, "document_id").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("fact_count"))
    return lookup_join(_documents(spark, sf_dir), counts, "id").select("id", "title", "status", F.coalesce("fact_count", F.lit(0).cast("long")).alias("fact_count"))


@query(f"SELECT document_id, evidence_page, count(*) AS facts, max(confidence) AS surest FROM {_F} GROUP BY ALL")
def facts_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each page of each document."""
    return _facts(spark, sf_dir, "document_id", "evidence_page", "confidence").groupBy("document_id", "evidence_page").agg(F.count("*").alias("facts"), F.max("confidence").alias("surest"))


_I = "(SELECT DISTINCT id, document_id, page_number, candidate_text, context_snippet, reason_code, detail, is_routine_filter FROM extraction_issues WHERE id IS NOT NULL)"


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "extraction_issues").where("id is not null").select("id", "document_id", "page_number", "candidate_text", "context_snippet", "reason_code", "detail", "is_routine_filter").distinct()


@query(f"SELECT id, document_id, reason_code FROM {_I} WHERE is_routine_filter = false QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY id) <= 50")
def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first issues of each document that are no routine."""
    ranked = _issues(spark, sf_dir).where("is_routine_filter = false").withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("id")))
    return ranked.where(F.col("_n") <= SHOWN_ISSUES).select("id", "document_id", "reason_code")


@query("SELECT DISTINCT document_id, page_number, char_length, text FROM document_pages WHERE page_number = 1")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored text of one page of each document."""
    return table(spark, sf_dir, "document_pages").where("page_number = 1").select("document_id", "page_number", "char_length", "text").distinct()


_GONE = "(SELECT min(id) FROM source_documents WHERE status = 'processed')"


def delete_document(document_id: DataFrame, facts: DataFrame, pages: DataFrame, issues: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table without one document: its facts, pages and issues go, and the links of its facts."""
    gone = facts.join(F.broadcast(document_id), "document_id", "left_semi").select("id").distinct()  # one id
    kept = links.join(gone.withColumnRenamed("id", "fact_a_id"), "fact_a_id", "left_anti").join(gone.withColumnRenamed("id", "fact_b_id"), "fact_b_id", "left_anti")
    left = {n: t.join(F.broadcast(document_id), "document_id", "left_anti") for n, t in (("facts", facts), ("pages", pages), ("issues", issues))}
    return left | {"links": kept}


@query(f"""SELECT 'facts' AS what, count(*) AS n FROM {_F} WHERE document_id IS DISTINCT FROM {_GONE} UNION ALL SELECT 'pages', count(*) FROM (SELECT DISTINCT id FROM document_pages WHERE document_id IS DISTINCT FROM {_GONE})
    UNION ALL SELECT 'issues', count(*) FROM {_I} WHERE document_id IS DISTINCT FROM {_GONE} UNION ALL SELECT 'links', count(*) FROM {_E} WHERE coalesce(fact_a_id NOT IN (SELECT id FROM {_F} WHERE document_id = {_GONE}), true) AND coalesce(fact_b_id NOT IN (SELECT id FROM {_F} WHERE document_id = {_GONE}), true)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stay in each table when the first processed document is deleted."""
    gone = table(spark, sf_dir, "source_documents").where("status = 'processed'").agg(F.min("id").alias("document_id"))
    pages = table(spark, sf_dir, "document_pages").select("id", "document_id").distinct()
    left = delete_document(gone, _facts(spark, sf_dir, "document_id"), pages, _issues(spark, sf_dir), _ends(spark, sf_dir))
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n") for n, t in left.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query(f"""SELECT (SELECT count(*) FROM {_D}) AS documents, (SELECT coalesce(sum(pages_processed), 0)::BIGINT FROM {_D}) AS pages, count(*) AS facts, count(DISTINCT predicate) AS distinct_metrics,
    (SELECT count(*) FROM {_E}) AS relationships, round(coalesce(avg(confidence), 0), 3) AS mean_fact_confidence, (SELECT count(*) FROM {_I} WHERE is_routine_filter = false) AS rejected_candidates FROM {_F}""")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the store in one row."""
    facts = _facts(spark, sf_dir, "predicate", "confidence").agg(F.count("*").alias("facts"), F.countDistinct("predicate").alias("distinct_metrics"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("mean_fact_confidence"))
    documents = _documents(spark, sf_dir).agg(F.count("*").alias("documents"), F.coalesce(F.sum("pages_processed"), F.lit(0).cast("long")).alias("pages"))
    links = _ends(spark, sf_dir).agg(F.count("*").alias("relationships"))
    issues = _issues(spark, sf_dir).where("is_routine_filter = false").agg(F.count("*").alias("rejected_candidates"))
    return documents.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(links)).crossJoin(F.broadcast(issues))  # one row each


@query("SELECT 'ok' AS status")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the engine answers."""
    return spark.range(1).select(F.lit("ok").alias("status"))


# ---- showcase

_VERDICT_KINDS = ("CORROBORATED", "CONTRADICTED", "CONTEXTUALLY_DIFFERENT")
_POINTS = "CASE WHEN a.id IS NULL OR b.id IS NULL THEN -1 ELSE (a.value_raw IS DISTINCT FROM b.value_raw)::INT + coalesce(a.time_period <> '' AND b.time_period <> '', false)::INT + coalesce(r.f.predicate_match_basis = 'exact', false)::INT + 2 * (coalesce(r.f.qualifier_divergence, false) OR coalesce(r.f.qualifier_one_sided, false))::INT + 2 * coalesce(r.f.scope_divergence, false)::INT + (a.document_id IS DISTINCT FROM b.document_id)::INT END"
_BEST = f"""
    SELECT relationship_type, id, points, confidence, alternatives, f FROM (SELECT r.relationship_type, r.id, r.f, {_POINTS} AS points, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 0.0 ELSE r.confidence END AS weight, r.confidence, r.alternatives
        FROM (SELECT *, count(*) OVER (PARTITION BY relationship_type) AS alternatives FROM {_R} WHERE relationship_type IN {_list(_VERDICT_KINDS)} QUALIFY row_number() OVER (PARTITION BY relationship_type ORDER BY confidence DESC NULLS LAST, id) <= 60) r
        LEFT JOIN {_F} a ON a.id = r.fact_a_id LEFT JOIN {_F} b ON b.id = r.fact_b_id)
    QUALIFY row_number() OVER (PARTITION BY relationship_type ORDER BY points DESC, weight DESC NULLS LAST, id) = 1"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clearest example of each verdict: of its surest ones that with the most to learn from."""
    links = _links(spark, sf_dir).where(F.col("relationship_type").isin(*_VERDICT_KINDS))
    sizes = links.groupBy("relationship_type").agg(F.count("*").alias("alternatives"))
    # at most sixty rows a verdict; Spark limits each task to its own sixty before the shuffle
    surest = links.withColumn("_n", F.row_number().over(Window.partitionBy("relationship_type").orderBy(F.desc_nulls_last("confidence"), "id"))).where(F.col("_n") <= SHOWCASE)
    facts = _facts(spark, sf_dir, "value_raw", "time_period", "document_id")
    side = lambda s: facts.select(F.col("id").alias(f"fact_{s}_id"), F.lit(True).alias(f"_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("value_raw", "time_period", "document_id")])
    x = surest.join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    points = (
        one(~F.col("value_raw_a").eqNullSafe(F.col("value_raw_b")))
        + one((F.col("time_period_a") != "") & (F.col("time_period_b") != ""))
        + one(F.col("f.predicate_match_basis") == "exact")
        + 2 * one(F.coalesce("f.qualifier_divergence", F.lit(False)) | F.coalesce("f.qualifier_one_sided", F.lit(False)))
        + 2 * one(F.col("f.scope_divergence"))
        + one(~F.col("document_id_a").eqNullSafe(F.col("document_id_b")))
    )
    scored = x.withColumn("points", F.when(both, points).otherwise(-1)).withColumn("_w", F.when(both, F.col("confidence")).otherwise(0.0))
    first = scored.withColumn("_k", F.row_number().over(Window.partitionBy("relationship_type").orderBy(F.desc("points"), F.desc_nulls_last("_w"), "id"))).where("_k = 1")
    return lookup_join(first, sizes, "relationship_type")


@query(f"SELECT * EXCLUDE (f) FROM ({_BEST})")
def best_case_per_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clearest stored example of each verdict, and how many there are."""
    return _best(spark, sf_dir).select("relationship_type", "id", "points", "confidence", "alternatives")


@query(f"""SELECT c.relationship_type, x.label, x.value FROM ({_BEST}) c, unnest([
    {{'label': 'Metric names', 'value': CASE f.predicate_match_basis WHEN 'exact' THEN 'identical' WHEN 'phrase' THEN 'overlap ' || round_even(coalesce(f.predicate_word_overlap, 0) * 100, 0)::INT || '%' WHEN 'head' THEN 'same head noun only' ELSE 'matched' END}},
    {{'label': 'Units', 'value': coalesce(nullif(f.unit_a, ''), 'none') || ' and ' || coalesce(nullif(f.unit_b, ''), 'none') || CASE WHEN coalesce(f.units_comparable, true) THEN '' ELSE ', not comparable' END}},
    {{'label': 'Values agree', 'value': CASE WHEN f.values_match THEN 'yes' ELSE 'no' END}}, {{'label': 'Same period', 'value': CASE WHEN f.temporal_match THEN 'yes' ELSE 'no' END}},
    {{'label': 'Period A', 'value': coalesce(f.fact_a_period, 'None')}}, {{'label': 'Period B', 'value': coalesce(f.fact_b_period, 'None')}},
    {{'label': 'Basis', 'value': CASE WHEN f.scope_divergence THEN coalesce(f.fact_a_scope, 'None') || ' against ' || coalesce(f.fact_b_scope, 'None') END}},
    {{'label': 'Reporting basis', 'value': CASE WHEN f.qualifier_divergence THEN coalesce(f.fact_a_qualifier, 'None') || ' against ' || coalesce(f.fact_b_qualifier, 'None') END}}]) AS u(x) WHERE x.value IS NOT NULL""")
def case_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decided each of the clearest examples, as labelled rows."""
    f = F.col("f")
    yes = lambda c: F.when(f[c], "yes").otherwise("no")
    text = lambda c: F.coalesce(f[c], F.lit("None"))
    unit = lambda c: F.coalesce(F.when(f[c] != "", f[c]), F.lit("none"))
    basis = f["predicate_match_basis"]
    rows = [
        ("Metric names", F.when(basis == "exact", "identical").when(basis == "phrase", F.concat(F.lit("overlap "), F.bround(F.coalesce(f["predicate_word_overlap"], F.lit(0.0)) * 100, 0).cast("int").cast("string"), F.lit("%"))).when(basis == "head", "same head noun only").otherwise("matched")),
        ("Units", F.concat(unit("unit_a"), F.lit(" and "), unit("unit_b"), F.when(F.coalesce(f["units_comparable"], F.lit(True)), "").otherwise(", not comparable"))),
        ("Values agree", yes("values_match")), ("Same period", yes("temporal_match")), ("Period A", text("fact_a_period")), ("Period B", text("fact_b_period")),
        ("Basis", F.when(f["scope_divergence"], F.concat(text("fact_a_scope"), F.lit(" against "), text("fact_b_scope")))),
        ("Reporting basis", F.when(f["qualifier_divergence"], F.concat(text("fact_a_qualifier"), F.lit(" against "), text("fact_b_qualifier")))),
    ]
    listed = F.array(*[F.struct(F.lit(n).alias("label"), v.alias("value")) for n, v in rows])
    return _best(spark, sf_dir).select("relationship_type", F.inline(listed)).where("value is not null")


@query(f"SELECT reason_code, count(*) AS n, min(struct_pack(id := id, candidate := candidate_text)).candidate AS example FROM {_I} WHERE is_routine_filter = false GROUP BY 1")
def issues_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that are no routine by reason, with the first one's candidate."""
    kept = _issues(spark, sf_dir).where("is_routine_filter = false")
    return kept.groupBy("reason_code").agg(F.count("*").alias("n"), F.min_by("candidate_text", "id").alias("example"))


@query(f"SELECT id, confidence, left(evidence_quote, 400) AS quote FROM {_F} WHERE confidence < 0.6 ORDER BY confidence, id LIMIT 5")
def weakest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least sure facts."""
    return _facts(spark, sf_dir, "confidence", "evidence_quote").where(F.col("confidence") < WEAK).orderBy("confidence", "id").limit(5).select("id", "confidence", F.left("evidence_quote", F.lit(400)).alias("quote"))


@query(f"SELECT (SELECT coalesce(sum(routine_filters), 0)::BIGINT FROM {_D}) AS routine_filter_count, count(*) AS facts_without_period FROM {_F} WHERE time_period_normalized IS NULL")
def failure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates dropped as routine, and facts without a period."""
    routine = _documents(spark, sf_dir).agg(F.coalesce(F.sum("routine_filters"), F.lit(0).cast("long")).alias("routine_filter_count"))
    return routine.crossJoin(F.broadcast(_facts(spark, sf_dir, "time_period_normalized").where("time_period_normalized is null").agg(F.count("*").alias("facts_without_period"))))  # one row


# ---- page text


_DOC_LINES = "list_transform(string_split(regexp_replace(regexp_replace(text, '[\\p{Cf}\\p{Cs}]', '', 'g'), '[ \t\u00a0]+', ' ', 'g'), chr(10)), lambda x: trim(x))"
_CLEAN_DOCS = "(SELECT DISTINCT id, text FROM document_pages WHERE id IS NOT NULL AND text IS NOT NULL)"
_WIDTH_SQL = "coalesce(list_sort(list_filter(list_transform(lines, lambda x: len(x)), lambda n: n > 10))[least(floor(len(list_filter(lines, lambda x: len(x) > 10)) * 0.9)::INT, len(list_filter(lines, lambda x: len(x) > 10)) - 1) + 1], 45)::DOUBLE"


def _stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_pages").where("id is not null and text is not null").select("id", "document_id", "page_number", "text").distinct()


@query(f"SELECT id, {_WIDTH_SQL} AS width FROM (SELECT id, {_DOC_LINES} AS lines FROM {_CLEAN_DOCS})")
def wrap_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual width of each page's lines."""
    lines = P.trimmed_lines(P.collapse_blanks(N.clean(F.col("text"))))
    return _stored_pages(spark, sf_dir).select("id", P.wrap_width(lines).alias("width"))


_END = "'[.!?:;][\"''’”)]?$'"
_HEADING_SQL = lambda x: f"(NOT regexp_matches({x}, {_END}) AND len(regexp_extract_all({x}, '[A-Za-z][A-Za-z''-]*')) >= 2 AND len(list_filter(regexp_extract_all({x}, '[A-Za-z][A-Za-z''-]*'), lambda w: regexp_matches(w, '^[A-Z]'))) >= len(regexp_extract_all({x}, '[A-Za-z][A-Za-z''-]*')) * 0.6)"


@query(f"SELECT id, len(list_filter(lines, lambda x: {_HEADING_SQL('x')})) AS headings FROM (SELECT id, {_DOC_LINES} AS lines FROM {_CLEAN_DOCS})")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page that read as headings."""
    lines = P.trimmed_lines(P.collapse_blanks(N.clean(F.col("text"))))
    return _stored_pages(spark, sf_dir).select("id", F.size(F.filter(lines, P.is_heading)).cast("long").alias("headings"))


_BULLET_SQL = "'^\\s*([-•‣▪*·]|\\(?\\d{1,2}[.)]|[a-z][.)])\\s+'"
_FIGURE_SQL = "'^\\s*[-−(]?\\s*(US\\$|Rs\\.?|INR|USD|EUR|GBP|[₹$€£¥])?\\s*\\d'"
_JOIN_SQL = f"line <> '' AND coalesce(before, '') <> '' AND NOT {_HEADING_SQL('before')} AND NOT regexp_matches(line, {_BULLET_SQL}) AND NOT (regexp_matches(line, {_FIGURE_SQL}) AND len(line) < 45) AND len(before) >= width * 0.72 AND NOT regexp_matches(before, {_END})"
_REFLOW_SQL = f"""
    SELECT id, coalesce(string_agg(piece, '' ORDER BY pos), '') AS reflowed FROM (
        SELECT id, pos, CASE WHEN pos = first THEN '' WHEN j THEN CASE WHEN before LIKE '%-' AND regexp_matches(line, '^[\\p{{Ll}}\\d]') THEN '' ELSE ' ' END ELSE chr(10) END ||
               CASE WHEN line LIKE '%-' AND nj AND regexp_matches(after, '^[\\p{{Ll}}\\d]') THEN line[:-2] ELSE line END AS piece
        FROM (SELECT *, lead(j) OVER w AS nj, lead(line) OVER w AS after, min(pos) FILTER (WHERE line <> '') OVER (PARTITION BY id) AS first
              FROM (SELECT *, {_JOIN_SQL} AS j FROM (SELECT id, width, pos, line, lag(line) OVER (PARTITION BY id ORDER BY pos) AS before
                    FROM (SELECT id, {_WIDTH_SQL} AS width, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT id, {_DOC_LINES} AS lines FROM {_CLEAN_DOCS}))))
              WINDOW w AS (PARTITION BY id ORDER BY pos)) WHERE line <> '') GROUP BY id"""


@query(f"SELECT i.id, coalesce(r.reflowed, '') AS reflowed, len(coalesce(r.reflowed, ''))::INT AS char_length FROM {_CLEAN_DOCS} i LEFT JOIN ({_REFLOW_SQL}) r USING (id)")
def canonical_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the lines that its width broke joined again."""
    return P.canonical_pages(_stored_pages(spark, sf_dir)).select("id", F.col("text").alias("reflowed"), "char_length")


@query(f"""SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::INT AS line_no, line, start::INT AS line_start, coalesce(lag(line) OVER (PARTITION BY id ORDER BY pos), '') AS prev_line, coalesce(lead(line) OVER (PARTITION BY id ORDER BY pos), '') AS next_line
    FROM (SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {_CLEAN_DOCS})) WHERE trim(line, ' ') <> ''""")
def line_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every page with their offsets and neighbours."""
    return P.lines_with_offsets(_stored_pages(spark, sf_dir), ["id"])


@query(f"""SELECT id, pos::INT AS line_no, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {_CLEAN_DOCS})
    WHERE regexp_matches(line, '(?i)(\\.{{3,}}|…{{2,}}|_{{3,}}|-{{4,}})\\s*([ivxlcdm]+|\\d+)\\s*$')""")
def leader_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table of contents, with leaders and a page."""
    lines = _stored_pages(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n", -1)).alias("_at", "line"))
    return lines.where(F.col("line").rlike(P.LEADER_LINE)).select("id", (F.col("_at") + 1).alias("line_no"), "line")


@query()
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each page: tables of two rows or more, and single lines."""
    return P.table_blocks(_stored_pages(spark, sf_dir), ["id"])


# ---- what readers are shown


@query(f"SELECT id, CASE WHEN value_raw <> '' AND contains(evidence_quote, value_raw) THEN (strpos(evidence_quote, value_raw) - 1)::INT ELSE -1 END AS place FROM {_F} WHERE evidence_quote IS NOT NULL")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each quote states its value, -1 for nowhere."""
    at = F.expr("locate(value_raw, evidence_quote) - 1")
    return _facts(spark, sf_dir, "value_raw", "evidence_quote").where("evidence_quote is not null").select("id", F.when(F.coalesce(F.col("value_raw") != "", F.lit(False)), at).otherwise(-1).cast("int").alias("place"))


@query(f"SELECT document_id, evidence_page, count(*) AS facts FROM {_F} WHERE NOT coalesce(regexp_matches(evidence_quote, '(?i)(\\.{{3,}}|…{{2,}}|_{{3,}}|-{{4,}})\\s*([ivxlcdm]+|\\d+)\\s*$'), false) GROUP BY ALL")
def shown_facts_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each page without those quoted from a table of contents."""
    facts = _facts(spark, sf_dir, "document_id", "evidence_page", "evidence_quote").where(~F.coalesce(F.col("evidence_quote").rlike(P.LEADER_LINE), F.lit(False)))
    return facts.groupBy("document_id", "evidence_page").agg(F.count("*").alias("facts"))


@query(f"SELECT sum(n)::BIGINT AS total, max(n) AS largest FROM (SELECT relationship_type, count(*) AS n FROM {_E} GROUP BY 1)")
def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relationships and the largest kind, for the scale of a chart."""
    return _ends(spark, sf_dir).groupBy("relationship_type").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.max("n").alias("largest"))


# Labels that compare and say nothing of what, and those that are notes.
_VAGUE = ("yoy", "qoq", "mom", "yoy yoy", "y-o-y", "q-o-q", "performance", "growth", "change", "figure", "addition", "000 tons", "tons", "mn")
_NOTES = ("note", "disclaimer", "source", "footnote")


def title(facts: DataFrame) -> DataFrame:
    """Facts with a readable ``title``: lead-ins, tails and auxiliaries cut off; a vague label takes the last telling label
    of its page before it, else the first words of its quote, else its subject.

    facts: id, document_id, evidence_page, subject, predicate_label, unit, unit_family, char_start, evidence_quote.
    """
    raw = F.trim(F.coalesce("predicate_label", F.lit("")))
    raw = F.regexp_replace(F.regexp_replace(raw, r"(?i)^s\s+", ""), r"(?i)^(?:contrast|notably|similarly|subsequently)\s+", "")
    head = F.trim(F.regexp_extract(raw, r"(?i)^(.*?)\s+(?:excludes?|excluding|excl\.?|due to|as per|rounded to)\b", 1))
    raw = F.when(F.length(head) >= 4, head).otherwise(raw)
    raw = F.regexp_replace(raw, r"(?i)\s+(?:has|have|is|are|was|were)$", "")
    low = F.lower(F.trim(F.coalesce("predicate_label", F.lit(""))))
    telling = (F.length(low) >= 4) & ~low.rlike("yoy|qoq|^note|^source") & (low != "performance")
    before = Window.partitionBy("document_id", "evidence_page").orderBy("char_start", "id").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(telling, F.trim(F.regexp_replace(F.trim("predicate_label"), r"(?i)\s+(?:excludes?|due to).*$", ""))), ignorenulls=True).over(before)
    x = facts.withColumn("_raw", raw).withColumn("_parent", parent)
    said = F.lower("_raw")
    kind = F.when(said.contains("qoq"), "QoQ").when(said.contains("mom"), "MoM").otherwise("YoY")
    named = F.when(F.col("subject").isNotNull() & ~F.col("subject").isin("", "Unspecified"), F.concat("subject", F.lit(" "))).otherwise("")
    subject = F.when(F.coalesce(F.col("subject") != "", F.lit(False)), F.col("subject"))
    note = said.rlike("^(?:" + "|".join(_NOTES) + ")")
    share = F.coalesce((F.col("unit") == "%") | (F.col("unit_family") == "ratio"), F.lit(False))
    words = F.coalesce("evidence_quote", F.lit(""))
    for pattern in (r"(?i)\(\d+\)|Note:.*$", r"[-−(]?\s*[\d,]+(?:\.\d+)?%?\)?", r"(?i)(?:YoY|QoQ|MoM)[:\s]*", "[₹$€£¥]"):
        words = F.regexp_replace(words, pattern, "")
    pieces = F.filter(F.transform(F.split(F.trim(words), r"[;\n/]"), F.trim), lambda w: F.length(w) >= 4)
    quoted = F.regexp_replace(F.get(pieces, F.lit(0)), r"^[-–—:,\s]+|[-–—:,\s]+$", "")
    quoted = F.when(F.length(quoted).between(4, 50) & ~F.lower(quoted).startswith("note"), quoted)
    shown = (
        F.when(note & share, F.coalesce(F.concat(subject, F.lit(" Segment Share (%)")), F.lit("Segment Distribution (%)")))
        .when(note, F.coalesce(F.concat(subject, F.lit(" Distribution Share")), F.lit("Distribution Share")))
        .when(said.isin(*_VAGUE), F.coalesce(F.concat(F.coalesce("_parent", quoted), F.lit(" ("), kind, F.lit(")")), F.trim(F.concat(named, kind, F.lit(" Growth")))))
        .when((F.length("_raw") <= 3) & ~F.col("_raw").rlike(r"\d"), F.coalesce(F.concat(subject, F.lit(" Metric")), F.col("_raw")))
        .otherwise(F.col("_raw"))
    )
    return x.withColumn("title", shown).drop("_raw", "_parent")


@query()
def repaired_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable titles of all facts."""
    return title(_facts(spark, sf_dir, "document_id", "evidence_page", "subject", "predicate_label", "unit", "unit_family", "char_start", "evidence_quote")).select("id", "title")


# ---- sources and sinks


@query(f"SELECT id, sha256(text) AS content_hash FROM {_CLEAN_DOCS}")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every page's content."""
    return _stored_pages(spark, sf_dir).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("SELECT document_id, count(*) AS pages_read, coalesce(sum(len(text)), 0)::BIGINT AS total_chars, count(*) FILTER (WHERE coalesce(trim(text, ' ' || chr(10)), '') = '') AS empty_pages FROM (SELECT DISTINCT id, document_id, text FROM document_pages WHERE id IS NOT NULL) GROUP BY 1")
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, characters and empty pages of each document."""
    pages = table(spark, sf_dir, "document_pages").where("id is not null").select("id", "document_id", "text").distinct()
    blank = F.coalesce(F.regexp_replace("text", r"^[ \n]+|[ \n]+$", "") == "", F.lit(True))
    return pages.groupBy("document_id").agg(F.count("*").alias("pages_read"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("total_chars"), F.count_if(blank).alias("empty_pages"))


@query(f"SELECT id, CASE WHEN first <> id THEN first END AS duplicate_of FROM (SELECT id, min(id) OVER (PARTITION BY coalesce(file_hash, id)) AS first FROM {_D})")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first one of the same content, if that is another."""
    documents = _documents(spark, sf_dir).withColumn("_key", F.coalesce("file_hash", "id"))
    first = documents.groupBy("_key").agg(F.min("id").alias("_first"))
    return lookup_join(documents, first, "_key").select("id", F.when(F.col("_first") != F.col("id"), F.col("_first")).alias("duplicate_of"))


@query(f"""SELECT id, filename, CASE WHEN len(trim(title)) > 3 THEN trim(title) ELSE coalesce(nullif(array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(regexp_replace(filename, '\\.[^.]*$', ''), '^\\d+[-_\\s]*', ''), '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), ''), filename) END AS title FROM {_D}""")
def derived_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title for every document: its own, else from its file's name."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace("filename", r"\.[^.]*$", ""), r"^\d+[-_\s]*", ""), "[-_]+", " ")
    made = F.initcap(F.trim(stem))
    return _documents(spark, sf_dir).select("id", "filename", F.when(F.length(F.trim("title")) > 3, F.trim("title")).otherwise(F.coalesce(F.when(made != "", made), F.col("filename"))).alias("title"))


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows with those of the same key replaced; of new rows with one key the last by all columns stays."""
    latest = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("_r")).select(key, "_r.*").select(*new.columns)
    return stored.join(latest.select(key), key, "left_anti").select(*new.columns).unionByName(latest)


@query(f"SELECT id, left(subject, 255) AS subject, left(value_raw, 255) AS value_raw, left(coalesce(value_text, ''), 512) AS value_text, left(nullif(unit, ''), 64) AS unit, left(nullif(time_period, ''), 128) AS time_period, CASE WHEN confidence >= 0.8 THEN 1.0 ELSE confidence END AS confidence FROM {_F}")
def fact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table after the surest facts are written again with full confidence, texts cut to the columns' widths."""
    cut = lambda c, n: F.left(F.when(F.col(c) != "", F.col(c)), F.lit(n)).alias(c)
    facts = _facts(spark, sf_dir, "subject", "value_raw", "value_text", "unit", "time_period", "confidence")
    facts = facts.select("id", F.left("subject", F.lit(255)).alias("subject"), F.left("value_raw", F.lit(255)).alias("value_raw"), F.left(F.coalesce("value_text", F.lit("")), F.lit(512)).alias("value_text"), cut("unit", 64), cut("time_period", 128), "confidence")
    return upsert(facts, facts.where("confidence >= 0.8").withColumn("confidence", F.lit(1.0)), "id")


@query(f"SELECT document_id, count(*) AS stored FROM {_I} GROUP BY 1 HAVING count(*) <= 200 UNION ALL SELECT document_id, 200 FROM {_I} GROUP BY 1 HAVING count(*) > 200")
def issue_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each document that are stored: the first so many."""
    ranked = _issues(spark, sf_dir).withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("id")))
    return ranked.where(F.col("_n") <= MAX_ISSUES).groupBy("document_id").agg(F.count("*").alias("stored"))


@query(f"SELECT DISTINCT 'rel_' || left(sha1(least(fact_a_id, fact_b_id) || '|' || greatest(fact_a_id, fact_b_id)), 20) AS id, least(fact_a_id, fact_b_id) AS a, greatest(fact_a_id, fact_b_id) AS b FROM {_E} WHERE fact_a_id IS NOT NULL AND fact_b_id IS NOT NULL")
def relationship_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id for each pair of facts, in whichever order and however often it was stored."""
    pairs = _ends(spark, sf_dir).where("fact_a_id is not null and fact_b_id is not null").select(F.least("fact_a_id", "fact_b_id").alias("a"), F.greatest("fact_a_id", "fact_b_id").alias("b")).distinct()
    return pairs.select(C.relationship_id(F.col("a"), F.col("b")).alias("id"), "a", "b")


@query()
def facts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact as a JSON object."""
    return _facts(spark, sf_dir, *_LISTED[1:]).select("id", F.to_json(F.struct(*_LISTED)).alias("json"))


# ---- extraction


@query(f"""SELECT id FROM (SELECT id, list_filter(list_transform(string_split(trim(text), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines, text FROM {_CLEAN_DOCS}),
    (SELECT '(?i)(\\.{{3,}}|…{{2,}}|_{{3,}}|-{{4,}})\\s*([ivxlcdm]+|\\d+)\\s*$' AS leader)
    WHERE len(trim(text)) >= 20 AND (len(list_filter(lines, lambda x: regexp_matches(x, leader))) >= 3 OR (len(list_filter(lines[1:6], lambda x: regexp_full_match(lower(x),
    '(table\\s+of\\s+contents|contents|index(\\s+of\\s+[\\w\\s]+)?|list\\s+of\\s+(tables|figures|boxes|charts|illustrations|exhibits|appendices|abbreviations)|appendix\\s+tables|brief\\s+contents)\\s*'))) > 0
    AND (len(lines) <= 50 OR len(list_filter(lines, lambda x: regexp_matches(x, leader))) >= 1)))""")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that list contents."""
    return _stored_pages(spark, sf_dir).where(X.is_contents(F.col("text"))).select("id")


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts and issues of all stored pages; what the kernel read is written once for both."""
    stage = Stage(spark, "extract")
    pages = stage.cut(P.canonical_pages(_stored_pages(spark, sf_dir)), "pages")
    profiles = stage.cut(profile_documents(pages, _documents(spark, sf_dir).groupBy(F.col("id").alias("document_id")).agg(F.max("title").alias("title"))), "profiles")
    facts, issues = X.facts_and_issues(stage.cut(X.read_pages(pages, profiles), "read"))
    return facts, issues.unionByName(X.contents_issues(pages))


@query()
def facts_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read off all stored pages."""
    return _read(spark, sf_dir)[0]


@query()
def extraction_issues_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on all stored pages that became no facts, by reason."""
    return _read(spark, sf_dir)[1].groupBy("reason_code", "is_routine_filter").agg(F.count("*").alias("n"))


@query()
def facts_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted facts whose quote is not in its page at its offsets; there are none."""
    stage = Stage(spark, "grounded")
    pages = stage.cut(P.canonical_pages(_stored_pages(spark, sf_dir)), "pages")
    facts, _ = X.facts_and_issues(X.read_pages(pages, profile_documents(pages)))
    texts = pages.select("document_id", F.col("page_number").alias("evidence_page"), F.col("text").alias("_text"))
    at = F.substring(F.col("_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return facts.join(texts, ["document_id", "evidence_page"]).groupBy("id", "char_start", "char_end").agg(F.max(at == F.col("evidence_quote")).alias("ok")).where("not ok")


@query()
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, period, threshold and acronyms of every document."""
    return profile_documents(P.canonical_pages(_stored_pages(spark, sf_dir)), _documents(spark, sf_dir).groupBy(F.col("id").alias("document_id")).agg(F.max("title").alias("title")))


_SUMS = "(SELECT r_name, year(o_orderdate) AS y, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"


@query(f"""SELECT r_name AS document_id, y::INT AS evidence_page, 'order_revenue' AS predicate, 'USD' AS unit, (((cents + 5000000)::BIGINT // 10000000) / 10::DOUBLE) * 1e6::DOUBLE AS value_numeric, y::VARCHAR AS time_period_normalized, 0.86::DOUBLE AS confidence FROM {_SUMS}
    UNION ALL SELECT r_name, y::INT, 'average_order_backlog', 'days', ((cents // 100) % 90 + 1)::DOUBLE, y::VARCHAR, 0.86::DOUBLE FROM {_SUMS}""")
def facts_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read off reports that are written from the order tables, one page a year."""
    t = lambda n: table(spark, sf_dir, n)
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sums = joined.groupBy(F.col("r_name").alias("document_id"), F.year("o_orderdate").alias("page_number")).agg(cents)
    tenths, days = F.expr("(cents + 5000000) div 10000000"), F.expr("(cents div 100) % 90 + 1")
    text = F.concat(
        F.lit("Order revenue reached USD "), F.expr("cast(((cents + 5000000) div 10000000) div 10 as string)"), F.lit("."), (tenths % 10).cast("string"), F.lit(" million in "), F.col("page_number").cast("string"), F.lit(".\nSee section 4 on page 17 for details.\nAverage order backlog stood at "),
        days.cast("string"), F.lit(" days in "), F.col("page_number").cast("string"), F.lit("."),
    )
    pages = sums.select("document_id", "page_number", text.alias("text"))
    subject = pages.select("document_id").distinct().select("document_id", F.col("document_id").alias("default_subject"), F.lit(None).cast("string").alias("default_period"), F.lit(3).alias("subject_threshold"), F.expr("cast(map() as map<string,string>)").alias("acronyms"), F.expr("cast(map() as map<string,int>)").alias("subject_counts"))
    facts, _ = X.facts_and_issues(X.read_pages(pages, subject))
    return facts.select("document_id", "evidence_page", "predicate", "unit", "value_numeric", "time_period_normalized", "confidence")


@query()
def proposals_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored facts taken as proposals, each with its span in its page, its number, metric and period, or the reason why it is none."""
    proposals = _facts(spark, sf_dir, "document_id", F.col("evidence_page").alias("page_number"), F.col("evidence_quote").alias("quote"), F.col("value_raw").alias("value"), F.col("predicate_label").alias("metric"), F.col("time_period").alias("period"), "confidence")
    return X.facts_from_proposals(X.grounded_proposals(proposals, _stored_pages(spark, sf_dir))).select("id", "char_start", "char_end", "predicate", "value_numeric", "unit", "time_period_normalized", "confidence", "reason")


# What the rules are known not to do.
_LIMITS = [
    ("scanned pages", "pages without a text layer give no facts"), ("tables", "a cell is read with the caption of its line or a neighbour, not by row and column heads"), ("currencies", "there are no exchange rates, so amounts in two currencies are never compared"),
    ("languages", "the words between a metric and its value are English"), ("inferred periods", "a period taken from the document never supports a conflict"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _LIMITS) + ") t(area, detail)")
def known_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules are known not to do."""
    return spark.createDataFrame(_LIMITS, "area string, detail string")
