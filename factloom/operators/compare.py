"""Pairing facts across documents and judging each pair.

Facts are never paired with each other directly.  Metrics are paired by the words of their keys, subjects by their
rarest word, each over distinct keys; facts then meet by equality of (metric, subject) with a compatible one, so that
every pair comes once, and only pairs that can carry a verdict leave the join.  A (metric, subject) that holds very many
facts is split over tasks.

Facts with a null id, document, metric or subject are in no pair.  Rows of one id count once.  An empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.normalise import TOLERANCE, describe_value, entities_compatible, predicate_match, unit_family
from factloom.plans.joins import lookup_join

# Verdicts and thresholds.
CORROBORATED, CONTRADICTED, CONTEXTUAL, RELATED = "CORROBORATED", "CONTRADICTED", "CONTEXTUALLY_DIFFERENT", "RELATED_BUT_NOT_COMPARABLE"
MIN_CONFIDENCE, MIN_OVERLAP, COMMON_SHARE, HEAD_FACTOR, ESTABLISHED_CONFIDENCE = 0.65, 0.8, 0.15, 0.8, 0.7
#: The steps of the decision: verdict and title of the summary, null where the pair is dropped.
STEPS = [
    (RELATED, "Incompatible units"), (CORROBORATED, "Corroborated"), (RELATED, "Not numerically comparable"), (None, None), (CORROBORATED, "Corroborated"), (CONTEXTUAL, "Different periods"),
    (CONTEXTUAL, "Different scope"), (None, None), (RELATED, "Period not established"), (None, None), (CONTRADICTED, "Revision conflict"), (CONTRADICTED, "Direct conflict"),
]
#: Facts of one metric and subject from which on they are split, one part for each so many; rows repeated are fewer than pairs by this factor.
HOT = 500

_FIELDS = ["subject", "predicate_label", "value_raw", "value_text", "value_numeric", "unit", "time_period", "time_period_normalized", "scope", "qualifier", "confidence", "inferred", "family"]


def facts_once(facts: DataFrame) -> DataFrame:
    """The columns that comparison reads, one row a fact."""
    inferred = F.coalesce(F.col("extraction_metadata.period_inferred_from_document"), F.lit(False)).alias("inferred")
    once = facts.where("id is not null").select("id", "document_id", "subject_normalized", "predicate", *_FIELDS[:-2], inferred).distinct()
    return once.withColumn("family", unit_family(F.col("unit")))


def _prepared() -> dict[str, Column]:
    """What judging works out once a fact: numbers and a short key only, since they are shuffled with it."""
    c = F.col
    # units of two facts compare if these are equal or one is null
    scale = F.when(c("family") == "currency", F.concat(F.lit("currency "), c("unit"))).when(c("family") != "unknown", c("family"))
    return {"_scale": scale, "_sure": F.bround("confidence", 3)}


def _derived(s: str) -> dict[str, Column]:
    """What judging reads of one side of a pair besides its fields."""
    c = lambda k: F.col(f"{k}_{s}")
    stated = lambda k: F.coalesce(c(k) != "", F.lit(False))
    shown = lambda k: F.coalesce(F.when(c(k) != "", c(k)), F.lit("unstated"))
    return {
        "_dated": stated("time_period_normalized") & ~c("inferred"), "_based": stated("qualifier"), "_period": shown("time_period"), "_scope": shown("scope"), "_qualifier": shown("qualifier"), "_raw": F.coalesce(c("value_raw"), F.lit("none")),
    }


def _text(s: str) -> Column:
    """The text of a value as it is compared."""
    text, raw = F.col(f"value_text_{s}"), F.col(f"value_raw_{s}")
    return F.lower(F.trim(F.coalesce(F.when(text != "", text), raw, F.lit(""))))


def _words(key: str) -> Column:
    return F.filter(F.split(key, "_"), lambda w: w != "")


def token_frequency(facts: DataFrame) -> DataFrame:
    """token and the number of facts whose metric holds it; counted by metric first."""
    metrics = facts.groupBy("predicate").agg(F.count("*").alias("n"))
    return metrics.select("n", F.explode(F.array_distinct(_words("predicate"))).alias("token")).groupBy("token").agg(F.sum("n").alias("facts"))


def blocking_keys(facts: DataFrame) -> DataFrame:
    """predicate and each word it is indexed by: its last word, and those that are not too common."""
    cutoff = facts.agg(F.greatest(F.lit(2), F.floor(F.count("*") * COMMON_SHARE)).alias("cutoff"))
    metrics = facts.select("predicate").distinct().where(F.size(_words("predicate")) > 0)
    each = metrics.select("predicate", F.element_at(_words("predicate"), -1).alias("_last"), F.explode(F.array_distinct(_words("predicate"))).alias("token"))
    known = lookup_join(each, token_frequency(facts), "token").crossJoin(F.broadcast(cutoff))  # one row
    return known.where("facts <= cutoff or token = _last").select("predicate", "token")


def metric_pairs(facts: DataFrame) -> DataFrame:
    """predicate_a, predicate_b, tier and overlap of all ordered pairs of metrics, a metric with itself included, that may carry a verdict."""
    keys = blocking_keys(facts)
    near = keys.select(F.col("predicate").alias("predicate_a"), "token").join(keys.select(F.col("predicate").alias("predicate_b"), "token"), "token").select("predicate_a", "predicate_b").distinct()
    low = lambda c: F.lower(F.col(c))
    matched = near.withColumn("_m", predicate_match(low("predicate_a"), low("predicate_b"))).select("predicate_a", "predicate_b", F.col("_m.tier").alias("tier"), F.col("_m.overlap").alias("overlap"))
    return matched.where((F.col("tier").isNotNull()) & ((F.col("tier") != "phrase") | (F.col("overlap") >= MIN_OVERLAP)))


def subject_pairs(facts: DataFrame) -> DataFrame:
    """subject_a, subject_b of all ordered pairs of subjects of which one's words are all in the other's.

    The words of the shorter are all in the longer, its rarest among them, so subjects meet on that word only.
    """
    subjects = facts.select(F.lower("subject_normalized").alias("subject")).where("subject <> ''").distinct()
    words = subjects.select("subject", F.explode(F.array_distinct(F.split("subject", "_"))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    rarest = lookup_join(words, counts, "word").groupBy("subject").agg(F.min(F.struct("n", "word")).alias("r")).select(F.col("subject").alias("subject_a"), F.col("r.word").alias("word"))
    inside = rarest.join(words.withColumnRenamed("subject", "subject_b"), "word").where(entities_compatible(F.col("subject_a"), F.col("subject_b"))).select("subject_a", "subject_b")
    return inside.unionByName(inside.select(F.col("subject_b").alias("subject_a"), F.col("subject_a").alias("subject_b"))).distinct()


def candidate_pairs(facts: DataFrame, min_confidence: float = MIN_CONFIDENCE, new: DataFrame | None = None) -> DataFrame:
    """Pairs of facts of different documents about one metric and subject: the fields of both and what is prepared of them with ``_a`` and ``_b``, tier and overlap.

    The pair's first fact is that with the smaller id.  Facts under the confidence are dropped after words are counted,
    since they count there.  With ``new`` (id) only pairs that hold one of these are looked for, each from its new fact.
    """
    sure = facts.where((F.col("confidence") >= min_confidence) & F.col("document_id").isNotNull() & F.col("predicate").isNotNull()).withColumn("_subject", F.lower("subject_normalized")).where("_subject <> ''")
    metrics, subjects = metric_pairs(facts), subject_pairs(facts)

    def side(rows: DataFrame, s: str) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{s}") for c in ("id", "document_id", "predicate", *[f for f in _FIELDS if f != "subject"])]
        named += [c.alias(f"{k}_{s}") for k, c in _prepared().items()]
        return rows.select(F.col("_subject").alias(f"subject_{s}"), *named, F.col("subject").alias(f"name_{s}"))

    def meet(first: DataFrame, second: DataFrame) -> DataFrame:
        keys = ["predicate_b", "subject_b"]
        left = side(first, "a").join(metrics, "predicate_a").join(subjects, "subject_a")
        hot = second.groupBy(F.col("predicate").alias("predicate_b"), F.col("_subject").alias("subject_b")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(*keys, F.ceil(F.col("_n") / HOT).cast("int").alias("_parts"))
        spread = lookup_join(left, hot, keys).withColumn("_part", F.pmod(F.xxhash64("id_a"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        repeated = lookup_join(side(second, "b"), hot, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        return spread.join(repeated, [*keys, "_part"]).drop("_part").where("id_a < id_b and document_id_a <> document_id_b")

    if new is None:
        return meet(sure, sure)
    ids = new.select("id").distinct()
    fresh, old = sure.join(ids, "id", "left_semi"), sure.join(ids, "id", "left_anti")
    return meet(fresh, sure).unionByName(meet(old, fresh))


def factors(pairs: DataFrame) -> DataFrame:
    """Pairs with what decides about them: flags, the relative difference and both sides' stated contexts."""
    both = lambda c, f: f(F.col(f"{c}_a"), F.col(f"{c}_b"))
    differ = lambda c: both(c, lambda a, b: F.coalesce((a != "") & (b != "") & (a != b), F.lit(False)))
    scale = both("value_numeric", lambda a, b: F.greatest(F.abs(a), F.abs(b)))
    gap = both("value_numeric", lambda a, b: F.coalesce(F.when(scale > 0, F.abs(a - b) / scale), F.lit(0.0)))
    period = F.col("_dated_a") & F.col("_dated_b")
    same = both("time_period_normalized", lambda a, b: F.coalesce(a == b, F.lit(False)))
    pairs = pairs.withColumns({f"{k}_{s}": c for s in "ab" for k, c in _derived(s).items()})
    out = pairs.withColumn("_gap", gap).withColumns({
        "period_stated_in_both": period, "temporal_match": period & same, "temporal_divergence": period & ~same, "units_comparable": both("_scale", lambda a, b: F.coalesce(a == b, F.lit(True))), "values_match": F.col("_gap") <= TOLERANCE,
        "relative_difference": F.bround("_gap", 4), "scope_divergence": differ("scope"), "qualifier_divergence": differ("qualifier"), "qualifier_one_sided": F.col("_based_a") != F.col("_based_b"),
    })
    return out.withColumn("period_established", F.col("temporal_match")).withColumns({f"fact_{s}_{n}": F.col(f"_{n}_{s}") for n in ("period", "scope", "qualifier") for s in "ab"})


def decide(pairs: DataFrame) -> DataFrame:
    """Pairs that get a verdict with their factors, the ``_step`` of the decision and the confidence."""
    x = factors(pairs)
    c = F.col
    head = c("tier") == "head"
    least = F.least("_sure_a", "_sure_b")
    confidence = F.when(head, F.bround(least * HEAD_FACTOR, 3)).otherwise(least)
    unread = c("value_numeric_a").isNull() | c("value_numeric_b").isNull()
    textual = F.when((_text("a") != "") & (_text("a") == _text("b")), 1).otherwise(2)
    unjudged = (c("tier") != "exact") | (confidence < ESTABLISHED_CONFIDENCE)
    numeric = (
        F.when(c("values_match"), F.when(c("temporal_divergence"), 3).otherwise(4))
        .when(c("temporal_divergence"), 5)
        .when(c("scope_divergence"), 6)
        .when(~c("period_established"), F.when(unjudged, 7).otherwise(8))
        .when(head, 9)
        .otherwise(F.when(c("qualifier_divergence"), 10).otherwise(11))
    )
    step = F.when(~c("units_comparable"), 0).otherwise(F.when(unread, textual).otherwise(numeric))
    return x.withColumn("_step", step).where(~c("_step").isin([i for i, (verdict, _) in enumerate(STEPS) if verdict is None])).withColumn("_confidence", confidence)


def summary(step: Column, label: Column) -> Column:
    """The title of a step of the decision with the metric's name."""
    return F.left(F.concat(F.get(F.array(*[F.lit(title) for _, title in STEPS]), step), F.lit(": "), F.coalesce(label, F.lit(""))), F.lit(255))


def classify(pairs: DataFrame) -> DataFrame:
    """One row for each pair that gets a verdict: fact_a_id, fact_b_id, relationship_type, comparison_summary, reasoning, reconciliation_factors, confidence."""
    c = F.col
    basis = F.struct(
        F.lit(True).alias("subject_match"), F.lit(True).alias("predicate_match"), "period_established", "period_stated_in_both", "units_comparable", "unit_a", "unit_b", "values_match", "relative_difference", "temporal_match", "temporal_divergence",
        "scope_divergence", "qualifier_divergence", "qualifier_one_sided", "fact_a_period", "fact_b_period", "fact_a_scope", "fact_b_scope", "fact_a_qualifier", "fact_b_qualifier", c("tier").alias("predicate_match_basis"), c("overlap").alias("predicate_word_overlap"),
    )
    return decide(pairs).select(
        c("id_a").alias("fact_a_id"), c("id_b").alias("fact_b_id"), F.get(F.array(*[F.lit(verdict) for verdict, _ in STEPS]), c("_step")).alias("relationship_type"), summary(c("_step"), c("predicate_label_a")).alias("comparison_summary"),
        _reasoning().alias("reasoning"), basis.alias("reconciliation_factors"), c("_confidence").alias("confidence"),
    )


def _reasoning() -> Column:
    """A sentence for each step of the decision, with what it rests on; only that of the pair's own step is put together."""
    c, say = F.col, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    what = say(F.coalesce("predicate_label_a", F.lit("The metric")), " of ", F.coalesce("name_a", F.lit("the subject")))
    gap = F.format_string("%.1f", c("_gap") * 100)
    step = c("_step")
    pair, between = (c("_raw_a"), "' and '", c("_raw_b")), lambda k: (c(f"{k}_a"), "' and '", c(f"{k}_b"))
    texts = {
        0: say(what, " is given in units without a common scale, ", c("unit_a"), " and ", c("unit_b"), "; there are no exchange rates or deflators to compare them by."),
        1: say("No number could be read, but both state '", *pair, "' for ", F.coalesce("predicate_label_a", F.lit("The metric")), "."),
        2: say("At least one of '", *pair, "' is no number, so they cannot be checked against each other."),
        4: say(what, " is '", *pair, "', that is ", describe_value(c("value_numeric_a"), c("unit_a")), F.when(c("temporal_match"), say(" for ", c("_period_a"))).otherwise(""), ", within the tolerance of 1.5 per cent."),
        5: say(what, " is '", *pair, "', apart by ", gap, " per cent; the periods are '", *between("_period"), "', so both may be right."),
        6: say("'", *pair, "' are apart by ", gap, " per cent; the scopes are '", *between("_scope"), "', so both may be right."),
        8: say("'", *pair, "' are apart by ", gap, " per cent, but the periods '", *between("_period"), "' are not both stated beside the figures, so no conflict can be claimed."),
        10: say(what, " for ", c("_period_a"), " is '", *pair, "' on the bases '", *between("_qualifier"), "', which points to a revision between releases."),
        11: say(what, " for ", c("_period_a"), " is '", *pair, "', apart by ", gap, " per cent", F.when(c("qualifier_one_sided"), say("; only one names its basis ('", *between("_qualifier"), "'), so a revision is likely.")).otherwise("; nothing stated accounts for it.")),
    }
    out = F.lit(None).cast("string")
    for i, text in reversed(texts.items()):
        out = F.when(step == i, text).otherwise(out)
    return out


def relationship_id(a: Column, b: Column) -> Column:
    """The id of a pair, whichever order its facts are in."""
    return F.concat(F.lit("rel_"), F.left(F.sha1(F.concat_ws("|", F.least(a, b), F.greatest(a, b))), F.lit(20)))


def compare_all(facts: DataFrame) -> DataFrame:
    """Relationships of all facts, with their ids."""
    once = facts_once(facts)
    return classify(candidate_pairs(once)).withColumn("id", relationship_id(F.col("fact_a_id"), F.col("fact_b_id")))


def count_agreement(facts: DataFrame) -> DataFrame:
    """comparison_summary and pairs of the verdicts that rest on values or texts alone; pairs are counted by step and metric, titles come after."""
    x = decide(candidate_pairs(facts_once(facts))).where(F.col("_step").isin([i for i, (_, title) in enumerate(STEPS) if title in ("Corroborated", "Not numerically comparable")]))
    counts = x.groupBy("_step", "predicate_label_a").agg(F.count("*").alias("_n"))
    return counts.groupBy(summary(F.col("_step"), F.col("predicate_label_a")).alias("comparison_summary")).agg(F.sum("_n").alias("pairs"))


def fold_in(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Relationships that facts of new documents bring, as a rebuild would give them; stored facts are not paired with each other."""
    once = facts_once(stored.unionByName(new))
    return classify(candidate_pairs(once, new=new.where("id is not null"))).withColumn("id", relationship_id(F.col("fact_a_id"), F.col("fact_b_id")))
