"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.bins import fill_containers, unused_room
from factloom.llm.groups import assign_groups, connected_groups, known_pairs
from factloom.llm.mixing import mixture, reached_shares, source_rates
from factloom.llm.names import average_linkage, name_groups, similar_names, variant_pairs
from factloom.llm.repeated_lines import repeated_lines, without_lines
from factloom.llm import residue as rules
from factloom.llm.residue import residue, without_residue
from factloom.llm.scanned import Repair
from factloom.llm.sentences import sentence_ends, sentences
from factloom.llm.tokens import token_count
from factloom.plans.joins import lookup_join
from factloom.plans.staging import Stage
from factloom.queries_general import SALTS, document_categories
from factloom.sources.tables import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.upper(F.regexp_replace("relationship_type", r"(?U)^\s+|\s+$", ""))
    return table(spark, sf_dir, "fact_relationships").where(kind == "CORROBORATED").select("fact_a_id", "fact_b_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each group of two or more facts that corroborating links chain together."""
    pairs = known_pairs(_links(spark, sf_dir), "fact_a_id", "fact_b_id", table(spark, sf_dir, "facts"), "id")
    return connected_groups(pairs, "fact_a_id", "fact_b_id").withColumnRenamed("member", "fact_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every fact, those without links alone in theirs."""
    return assign_groups(table(spark, sf_dir, "facts"), "id", _links(spark, sf_dir), "fact_a_id", "fact_b_id").withColumnRenamed("id", "fact_id")


def _repair(spark: SparkSession, sf_dir: str) -> Repair:
    documents = table(spark, sf_dir, "source_documents").where("id is not null").groupBy(F.col("id").alias("document_id"))
    titles = documents.agg(F.max("title").alias("title"), F.max("dominant_subject").alias("publisher"))
    return Repair(table(spark, sf_dir, "document_pages"), titles)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken words, misread words and numbers, running heads and page numbers of every page."""
    return _repair(spark, sf_dir).faults()


def p2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once as continuous paragraphs."""
    return _repair(spark, sf_dir).repaired()


def _recurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "document_pages"), "document_id", "id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lines that recur within their report."""
    return _recurring(spark, sf_dir).select("id", "line_no")


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page once, without the lines that recur within its report."""
    return without_lines(table(spark, sf_dir, "document_pages"), _recurring(spark, sf_dir), "id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of normalised subjects that mean the same organisation or person."""
    return variant_pairs(average_linkage(similar_names(table(spark, sf_dir, "facts"), "subject_normalized")))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every normalised subject with the group of its spellings."""
    return name_groups(table(spark, sf_dir, "facts"), "subject_normalized")


def _quotes_and_editions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The records of problem 7: quotes of facts, and pages of the language editions, whose lines end sentences."""
    quotes = table(spark, sf_dir, "facts").select(F.col("id").alias("record_id"), F.col("evidence_quote").alias("text"))
    editions = document_categories(spark, sf_dir).where(F.col("source") == "language_editions").select("document_id")
    pages = lookup_join(table(spark, sf_dir, "document_pages").select(F.col("id").alias("record_id"), "document_id", "text"), editions, "document_id", "left_semi", salts=SALTS)
    return quotes, pages.select("record_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each sentence that another one follows in its record."""
    quotes, pages = _quotes_and_editions(spark, sf_dir)
    return sentence_ends(quotes, "record_id", "text", line_ends=False).unionByName(sentence_ends(pages, "record_id", "text", line_ends=True))


def p7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the records, with its place in code points."""
    quotes, pages = _quotes_and_editions(spark, sf_dir)
    return sentences(quotes, "record_id", "text", line_ends=False).unionByName(sentences(pages, "record_id", "text", line_ends=True))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", token_count("text").alias("tokens"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that alone exceed a container of a kind."""
    kinds = F.broadcast(table(spark, sf_dir, "container_kinds"))  # one row a kind
    return _sized(spark, sf_dir).where("doc_id is not null").join(kinds, F.col("tokens") > F.col("capacity_tokens")).select("container_kind", "doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each part of one that exceeds it."""
    sized = Stage(spark, "sized").cut(_sized(spark, sf_dir), "tokens")  # else each reader counts the tokens anew
    return fill_containers(sized, table(spark, sf_dir, "container_kinds"), "doc_id")


def p8_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each kind and their unused room."""
    return unused_room(p8_containers(spark, sf_dir), table(spark, sf_dir, "container_kinds"))


def _rates(spark: SparkSession, sf_dir: str, sized: DataFrame) -> DataFrame:
    return source_rates(sized, table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their share of the whole."""
    sized = _sized(spark, sf_dir).groupBy("source").agg(F.sum("tokens").alias("tokens"))  # the sums are read twice, the texts once
    return _rates(spark, sf_dir, Stage(spark, "sized").cut(sized, "sums")).where(~F.col("reachable")).select("source")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of each document in the mixture, with its tokens."""
    sized = Stage(spark, "sized").cut(_sized(spark, sf_dir), "tokens")
    return mixture(sized, _rates(spark, sf_dir, sized), "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source of the mixture."""
    sized = Stage(spark, "sized").cut(_sized(spark, sf_dir), "tokens")
    rates = _rates(spark, sf_dir, sized)
    return reached_shares(mixture(sized, rates, "doc_id"), rates)


def p10_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are no report text, each with the reason."""
    return residue(table(spark, sf_dir, "documents"), "doc_id", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an unfilled template field, and those that are only filler, an error or access message or a request for scripts."""
    return p10_residue(spark, sf_dir).select("doc_id")


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without those."""
    return without_residue(table(spark, sf_dir, "documents"), p10_residue(spark, sf_dir), "doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_groups": p1_groups, "p2_found": p2_found, "p2_pages": p2_pages, "p3_found": p3_found, "p3_pages": p3_pages, "p5_found": p5_found, "p5_groups": p5_groups, "p7_found": p7_found, "p7_sentences": p7_sentences, "p8_found": p8_found, "p8_containers": p8_containers,
    "p8_unused": p8_unused, "p9_found": p9_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_residue": p10_residue, "p10_kept": p10_kept,
}

_LINKS = """WITH RECURSIVE known AS (SELECT DISTINCT id FROM facts WHERE id IS NOT NULL),
    pairs AS (SELECT DISTINCT fact_a_id AS a, fact_b_id AS b FROM fact_relationships WHERE upper(regexp_replace(relationship_type, '^\\s+|\\s+$', '', 'g')) = 'CORROBORATED'
              AND fact_a_id <> fact_b_id AND fact_a_id IN (SELECT id FROM known) AND fact_b_id IN (SELECT id FROM known)),
    steps AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    reach(x, y) AS (SELECT a, b FROM steps UNION SELECT r.x, s.b FROM reach r JOIN steps s ON r.y = s.a),
    grouped AS (SELECT least(x, min(y)) AS group_id, x AS fact_id FROM reach GROUP BY x)"""
_LINES = """WITH once AS (SELECT DISTINCT id, document_id, text FROM document_pages WHERE id IS NOT NULL),
    lines AS (SELECT id, document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM once WHERE text IS NOT NULL AND document_id IS NOT NULL),
    spelled AS (SELECT *, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS letters FROM lines),
    sizes AS (SELECT document_id, count(*) AS pages FROM once GROUP BY 1),
    wide AS (SELECT s.document_id, letters FROM spelled s JOIN sizes z USING (document_id) WHERE len(letters) >= 15 GROUP BY s.document_id, letters, z.pages HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) >= z.pages * 0.05),
    found AS (SELECT id, line_no FROM spelled SEMI JOIN wide USING (document_id, letters))"""


def _matches(what: str, patterns: list[str]) -> str:
    """Whether a whole text matches one of some patterns that need no look-behind and no back-reference."""
    return "(" + " OR ".join(f"regexp_full_match({what}, '" + p.replace("'", "''") + "')" for p in patterns if "\\1" not in p) + ")"


_MASKS = [
    (r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+", "@"), (rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s(?:{rules._MONTHS})\s\d{{4}}\b|\b(?:{rules._MONTHS})\s\d{{1,2}},?\s\d{{4}}\b", "0"), (r"\d+(?:[.,:/-]\d+)*", "0"),
    (r"([.!?…؟।])[\")\]”’»]*\s+", r"\1\n"), (r"([。！？])", r"\1\n"),
]
_MASKED = "lower(text)"
for _seen, _put in _MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_seen}', " + (f"'{_put}'" if "n" not in _put else "'\\1' || chr(10)") + ", 'g')"
_LATIN = "len(list_filter(string_split(regexp_replace(m, '[^a-z ]', ' ', 'g'), ' '), lambda w: w IN (" + ", ".join(f"'{w}'" for w in rules.LOREM.split()) + ")))"
_RESIDUE = f"""WITH messages AS (SELECT DISTINCT doc_id, source, m FROM (SELECT doc_id, source, trim(regexp_replace(unnest(string_split({_MASKED}, chr(10))), '[\\s\\x{{00a0}}\\x{{202f}}]+', ' ', 'g')) AS m FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) WHERE regexp_matches(m, '\\p{{L}}')),
    kinds AS (SELECT m, count(*) AS records, count(DISTINCT coalesce(source, '')) AS sources, CASE WHEN {_matches("m", rules.SCRIPTS + rules.ERRORS + rules.FILLERS)} OR (len(list_distinct(string_split(m, ' '))) = 1 AND contains(m, ' ') AND regexp_full_match(m, '[a-z]{{1,5}} .*'))
              OR (len(string_split(m, ' ')) >= 3 AND regexp_full_match(m, '[a-z .,]+') AND {_LATIN} >= 0.7 * len(string_split(m, ' '))) THEN 'notice' WHEN {_matches("m", rules.HELPERS)} THEN 'helper'
              WHEN len(m) <= {rules.TITLE_LENGTH} AND len(string_split(m, ' ')) <= 9 AND NOT regexp_matches(m, '[.!?。！？।؟…]$') THEN 'title' END AS kind FROM messages GROUP BY m),
    judged AS (SELECT doc_id, count(*) FILTER (WHERE kind IS NULL) AS other, max(m) FILTER (WHERE kind IS NULL) AS odd FROM messages JOIN kinds USING (m) GROUP BY doc_id HAVING count(*) FILTER (WHERE kind = 'notice') > 0),
    adopted AS (SELECT odd FROM judged JOIN kinds ON odd = m WHERE other = 1 AND records >= {rules.MIN_RECORDS} AND sources >= {rules.MIN_SOURCES} GROUP BY odd, records HAVING count(*) = records)"""
_FIELDS = "(" + " OR ".join("regexp_matches(text, '" + p.replace("(?<![\\w_])", "(?:^|[^A-Za-z0-9_])").replace("(?![\\w_])", "(?:[^A-Za-z0-9_]|$)") + "')" for p in rules.PLACEHOLDERS) + ")"
ORACLE = {
    "p1_found": f"{_LINKS} SELECT group_id, fact_id FROM grouped",
    "p1_groups": f"{_LINKS} SELECT coalesce(group_id, id) AS group_id, id AS fact_id FROM known LEFT JOIN grouped ON fact_id = id",
    # the same by bytes as by any usual tokenizer, whose tokens have about four of them
    "p8_found": "SELECT container_kind, doc_id FROM documents, container_kinds WHERE doc_id IS NOT NULL AND strlen(text) > 4 * capacity_tokens",
    "p9_found": """SELECT t.source FROM mix_targets t LEFT JOIN (SELECT source, sum(strlen(text)) AS has FROM documents GROUP BY 1) s USING (source)
        WHERE coalesce(has, 0) * max_repeats < target_share * (SELECT sum(strlen(text)) FROM documents)""",
    "p10_found": f"{_RESIDUE} SELECT doc_id FROM judged WHERE other = 0 OR (other = 1 AND odd IN (SELECT odd FROM adopted)) UNION SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND {_FIELDS}",
    "p3_found": f"{_LINES} SELECT id, line_no::INT AS line_no FROM found",
}
