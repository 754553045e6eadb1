"""Repair of text from scanned pages: words broken over lines, misread characters, running heads and page numbers.

Correction candidates come from an inverted join of character q-grams between the rare word forms and the frequent ones,
over strings of strokes in which characters that scanners confuse look alike; boosted trees, trained on corrupted
copies of frequent words, rank them.  Pairs of lines are classified the same way: whether the word over a line end keeps
its hyphen, from the counts of both readings; whether a line at the top of a page is a running head, from how often its
letters recur there, in the report and elsewhere.  All counts are over all pages; only the training samples are bounded.

Null pages, texts and documents are left out; repeated rows of a page count once; blank texts have no lines to repair.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.boosting import Boosted
from factloom.plans.joins import lookup_join
from factloom.plans.staging import Stage

#: Bounds of the training samples, in rows that reach the driver.
SAMPLE_WORDS, SAMPLE_NAMES, SAMPLE_LINES = 4000, 2000, 4000
#: Share of the q-grams of a form that a candidate must hold.
OVERLAP = 0.6
Q = 3
#: A right form occurs at least so often, and so many times as often as the form it corrects.
MIN_COUNT, MIN_RATIO = 10, 8
ACCEPT = 0.5
SALTS = 8

# What a scanner reads for what is printed.
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("ii", "u"), ("w", "vv"), ("vv", "w"), ("li", "h"), ("h", "li"), ("n", "ri"), ("ri", "n"), ("in", "m"), ("ni", "m"), ("e", "c"), ("c", "e"), ("c", "("), ("o", "0"), ("l", "1"), ("i", "l"), ("l", "i"), ("i", "1"),
    ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("a", "à"), ("a", "á"), ("e", "é"), ("o", "ò"), ("u", "ü"), ("v", "y"), ("y", "v"), ("z", "2"), ("tt", "ft"), ("ll", "11"), ("a", "o"), ("o", "a"), ("q", "g"), ("l", "|"), ("i", "!"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"),
]
# Strokes of characters that are confused; what is left out stands for itself.
STROKES = {"m": "lll", "n": "ll", "d": "cl", "u": "ll", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "i": "l", "r": "l", "1": "l", "|": "l", "!": "l", "w": "vv", "y": "v", "e": "c", "(": "c", "f": "t", "0": "o", "5": "s", "9": "g", "q": "g", "2": "z", "a": "a", "ß": "s"}
DIGITS = str.maketrans("OoDQlIi|!ZzSsBbgq", "00001111122558699")
# A numeral with separators; the letters that stand for its digits when misread.
_NUMERAL = re.compile(r"\d{1,3}(?:[,. ' ]\d{2,3})*(?:[.,]\d+)?|\d+(?:[.,]\d+)?|\d+(?:[-/.]\d+)+|\d{1,2}:\d{2}(?::\d{2})?")
_MISREAD_NUMERAL = re.compile(r"(?=.*\d)(?=.*[OoDlI|!ZSsBbgq])[\dOoDlI|!ZSsBbgq]+(?:[.,\-/:][\dOoDlI|!ZSsBbgq]+)*")
_CURRENCY = re.compile(r"[+\-−]?(?:US\$|S\$|[€$£₹¥])")
_STRIP = " .,;:!?()[]\"“”„‘’'«»‚‹›"
_BREAKS = "-­‐‑¬"
_BROKEN = re.compile(rf"(\S*\w)[{_BREAKS}]\s*$")
_PAGE = re.compile(r"[\W_]*(?:page|pg|p|seite|página|pagina|s)?[\W_]*([\dOolISZB|]{1,6})(?:\s*(?:/|of|von|de|sur)\s*[\dOolISZB|]{1,6})?[\W_]*", re.I)
_SENTENCE_END = re.compile(r"[.!?:][\"”’»)\]]*$")
_TOKENS = re.compile(r"\S+")

TOKEN_SCHEMA = "id string, line_no int, place int, form string, written string, capital boolean, opens boolean, named boolean"
# Characters and sequences that are read for each other, folded into one.
_FOLDED = [("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("in", "m"), ("ni", "m")]


def strokes(form: str) -> str:
    """A form as strokes, without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", form) if not unicodedata.combining(c))
    return "".join(STROKES.get(c, c) for c in plain)


def grams(form: str) -> list[str]:
    s = f"^{strokes(form)}$"
    return sorted({s[i : i + Q] for i in range(max(len(s) - Q + 1, 1))})


def _distance(a: str, b: str, stop: int = 4) -> int:
    if abs(len(a) - len(b)) > stop:
        return stop + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def confused(form: str, word: str) -> int | None:
    """The number of confusions that turn the word into the form, or none."""
    best: dict[tuple[int, int], int] = {(0, 0): 0}
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        cost = best[i, j]
        steps = [(1, 1, 0)] if i < len(word) and j < len(form) and word[i] == form[j] else []
        if cost < 3:
            steps += [(len(a), len(b), 1) for a, b in CONFUSIONS if word.startswith(a, i) and form.startswith(b, j)]
        for di, dj, c in steps:
            at = (i + di, j + dj)
            if cost + c < best.get(at, 9):
                best[at] = cost + c
                todo.append(at)
    return best.get((len(word), len(form)))


def features(form: str, n: int, capitals: float, word: str, count: int, word_capitals: float, shared: float) -> list[float]:
    made = confused(form, word)
    odd = sum(not c.isalpha() and c != "-" for c in form)
    return [9 if made is None else made, _distance(form, word), float(strokes(form) == strokes(word)), shared, np.log10(count / max(n, 1)), np.log10(count), len(word), odd, capitals, word_capitals, float(form[:1] == word[:1])]


def _corrupt(word: str, k: int) -> list[str]:
    """Up to k corrupted copies, the same ones each time."""
    places = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
    if not places:
        return []
    step = max(1, len(places) // k)
    return [word[:i] + b + word[i + len(a) :] for i, a, b in places[:: step][:k]]


def train_ranker(words: list[tuple[str, int, float]], names: list[tuple[str, int, float]]) -> Boosted:
    """Boosted trees over (form, candidate) pairs: corrupted copies of words against names and other words."""
    index: dict[str, list[int]] = {}
    for at, (w, _, _) in enumerate(words):
        for g in grams(w):
            index.setdefault(g, []).append(at)
    x, y = [], []

    def pairs(form: str, n: int, capitals: float, right: str | None) -> None:
        own = grams(form)
        hits = Counter(at for g in own for at in index.get(g, ()))
        for at, k in hits.most_common(4):
            w, count, share = words[at]
            if w != form and k >= OVERLAP * len(own) and count >= MIN_RATIO * n:
                x.append(features(form, n, capitals, w, count, share, k / len(own)))
                y.append(float(w == right))

    for at, (w, count, share) in enumerate(words):
        for c in _corrupt(w, 3):
            # a corrupted form is seen seldom, so the share of its capitals is its word's, or all or none
            pairs(c, max(1, count // (20 + 997 * (at % 40))), (share, 0.0, 1.0 if share > 0.02 else share)[at % 3], w)
    for form, n, capitals in names:
        pairs(form, n, capitals, None)
    # what holds in any corpus, so that a small one trains too: one confusion of a far commoner word, and none
    for ratio in (1.5, 2.5, 3.5):
        for size in (4, 8):
            x += [[1, 1, 1, 1, ratio, 3, size, 0, 0, 0, 1], [1, 2, 0, 0.7, ratio, 3, size, 0, 0, 0, 1], [9, 2, 0, 0.6, ratio, 3, size, 0, 1, 1, 1], [9, 4, 0, 0.6, ratio, 3, size, 0, 0, 0, 0]] * 3
            y += [1.0, 1.0, 0.0, 0.0] * 3
    return Boosted().fit(np.array(x), np.array(y))


_INITIAL = re.compile(r"(?:[A-Z]|Dr|Mr|Mrs|St|Ltd|Inc|Pvt|Prof|Co|No|Fig|Sec)\.")


def _ends(token: str) -> bool:
    """Whether a token ends a sentence."""
    return token[-1] in ".!?:\"”’»)]" and bool(_SENTENCE_END.search(token)) and not _INITIAL.fullmatch(token)


def _capital(token: str) -> bool:
    return token.lstrip(_STRIP)[:1].isupper()


def _reads_as_title(tokens: list[str], line: str, line_no: int) -> bool:
    return all(len(t) <= 3 or _capital(t) for t in tokens) or (line_no <= 3 and "|" in line)


class _Line:
    """The tokens of a line, of which words broken over its ends are none, and how the line before it ended."""

    __slots__ = ("no", "text", "raw", "first", "last", "before")

    def __init__(self, no: int, text: str, raw: list[str], first: int, last: int, before: _Line | None) -> None:
        self.no, self.text, self.raw, self.first, self.last, self.before = no, text, raw, first, last, before

    def opens(self, i: int) -> bool:
        """Whether a token opens a sentence."""
        if i:
            return _ends(self.raw[i - 1])
        return self.before is None or _ends(self.before.raw[-1]) or _reads_as_title(self.before.raw, self.before.text, self.before.no)

    def named(self, i: int) -> bool:
        """Whether a token stands among names: a capital beside a capital."""
        raw = self.raw
        if self.text.isupper() or not _capital(raw[i]):
            return False
        if i + 1 < len(raw) and _capital(raw[i + 1]) and not _SENTENCE_END.search(raw[i]):
            return True
        return i > 0 and _capital(raw[i - 1]) and not self.opens(i) and not _SENTENCE_END.search(raw[i - 1])


def _lines(text: str) -> Iterator[_Line]:
    """The lines of a page that hold tokens; a blank line ends what stands before it."""
    before, carried = None, False
    for no, line in enumerate(text.split("\n"), 1):
        raw = line.split()
        if not raw:
            before = None
            continue
        broken = raw[-1][-1] in _BREAKS and bool(_BROKEN.search(line))
        before = _Line(no, line, raw, int(carried), len(raw) - broken, before)
        yield before
        before.before = None  # no chain of lines stays alive
        carried = broken


def _forms(token: str) -> list[str]:
    """The token without punctuation, and with a leading bracket that may be a misread c."""
    word = token.strip(_STRIP)
    return [word, "(" + word] if token[0] == "(" and ")" not in token and word[:1].islower() else [word]


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of forms in a batch: n, how many stand within a sentence, and how many of these are capital."""
    for pdf in batches:
        n, caps, opening = Counter(), Counter(), Counter()
        for text in pdf["text"]:
            for line in _lines(text):
                tokens = line.raw[line.first : line.last]
                words = [t.strip(_STRIP) for t in tokens]
                n.update([w.lower() for w in words])
                n.update(w.lower() for t in tokens if t[0] == "(" for w in _forms(t)[1:])
                for i, w in enumerate(words, line.first):
                    # only what can open a sentence or is capital is looked at
                    if (i == 0 or line.raw[i - 1][-1] in ".!?:\"”’»)]") and line.opens(i):
                        opening[w.lower()] += 1
                    elif w[:1].isupper():
                        caps[w.lower()] += 1
        kept = [k for k in n if k and len(k) <= 40 and any(c.isalpha() for c in k)]
        yield pd.DataFrame({"form": kept, "n": [n[k] for k in kept], "inner": [n[k] - opening[k] for k in kept], "capitals": [caps[k] for k in kept]})


def _broken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word that a line end divides: id, line_no, left, right and whether its mark is a plain hyphen."""
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["id"], pdf["text"]):
            lines = text.split("\n")
            for at, (a, b) in enumerate(zip(lines, lines[1:]), 1):
                m = _BROKEN.search(a) if a.rstrip()[-1:] in _BREAKS else None
                if m and (nxt := _TOKENS.match(b)) and (left := m[1].lstrip(_STRIP)):
                    right = nxt[0].rstrip(_STRIP)
                    if right[:1].isalpha() and left[-1:].isalpha():
                        rows.append((key, at, left, right, a.rstrip()[-1] == "-"))
        yield pd.DataFrame(rows, columns=["id", "line_no", "left", "right", "plain"])


def _key(line: Column) -> Column:
    """The letters and digits of a line, without a page number at its edge, misread ones folded into right ones."""
    key = F.lower(F.regexp_replace(line, r"^\s*\d+\s{2,}|\s{2,}\d+\s*$", ""))
    key = F.translate(key, "015(9àáéèíóòúü", "olscgaaeeioouu")
    for seen, meant in _FOLDED:
        key = F.replace(key, F.lit(seen), F.lit(meant))
    return F.translate(F.regexp_replace(key, r"[^\p{L}\d]+", ""), "ietyh68", "lcfvbbb")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _grammed(forms: pd.Series) -> pd.Series:
    return forms.map(grams)


def _count(lower: Column) -> Column:
    return F.coalesce(lower, F.lit(0))


class Repair:
    """The found faults of pages.

    pages: id, document_id, page_number, text; titles: document_id, title and publisher, any of them null, one row a
    document.  ``hyphens`` (id, line_no, word), ``misread`` (id, line_no, place, written, word) and ``furniture`` (id,
    line_no, kind) are lazy.
    """

    def __init__(self, pages: DataFrame, titles: DataFrame) -> None:
        spark = pages.sparkSession
        self.stage = Stage(spark, "scanned")
        kept = pages.where("id is not null and document_id is not null and text is not null").select("id", "document_id", "page_number", "text")
        self.pages = self.stage.cut(kept.dropDuplicates(["id"]), "pages")
        self.titles = titles
        counted = self.pages.select("text").mapInPandas(_word_counts, "form string, n long, inner long, capitals long")
        self.words = self.stage.cut(counted.groupBy("form").agg(F.sum("n").alias("n"), (F.sum("capitals") / F.greatest(F.sum("inner"), F.lit(1))).alias("capitals")), "words")
        self.furniture = self._furniture()
        self.corrections = self._corrections()
        self.hyphens = self._hyphens()
        self.misread = self._misread()

    def _corrections(self) -> DataFrame:
        """The best correction of each form that has one: form, word, and whether the word is far more common."""
        # what can be a misread word at all: Latin letters and what is read for them, and no number with a unit
        forms = self.words.where((F.length("form") >= 2) & F.col("form").rlike(r"^[\p{IsLatin}\d('’|!-]+$") & F.col("form").rlike(r"\p{L}") & ~F.col("form").rlike(r"^\d+(?:st|nd|rd|th)$|\d-?\d.*\d"))
        own = self.stage.cut(forms.select("form", "n", "capitals", _grammed("form").alias("grams")), "forms")
        right = own.where((F.col("n") >= MIN_COUNT) & F.col("form").rlike(r"^[a-z]+(?:[-'’][a-z]+)*$"))
        index = self.stage.cut(right.select(F.col("form").alias("word"), F.col("n").alias("count"), F.explode("grams").alias("gram")), "index")
        frequency = index.groupBy("gram").agg(F.count("*").alias("df"))
        # of the grams of a form, rarest first, so many that a candidate with the overlap must share one of them
        ranked = lookup_join(own.select("form", "n", F.explode("grams").alias("gram")), frequency, "gram", salts=SALTS)
        ordered = ranked.groupBy("form", "n").agg(F.array_sort(F.collect_list(F.struct(_count(F.col("df")).alias("df"), "gram"))).alias("g"))
        prefix = ordered.select("form", "n", F.explode(F.slice("g", 1, F.size("g") - F.ceil(F.size("g") * OVERLAP).cast("int") + 1)).alias("x")).where("x.df > 0").select("form", "n", F.col("x.gram").alias("gram"))
        near = prefix.join(index, "gram").where((F.col("form") != F.col("word")) & (F.col("count") >= F.col("n") * MIN_RATIO) & (F.abs(F.length("form") - F.length("word")) <= 3)).select("form", "word").distinct()
        sides = near.join(own, "form").join(right.select(F.col("form").alias("word"), F.col("n").alias("count"), F.col("capitals").alias("word_capitals"), F.col("grams").alias("_w")), "word")
        shared = F.size(F.array_intersect("grams", "_w")) / F.size("grams")
        pairs = sides.withColumn("shared", shared).where(F.col("shared") >= OVERLAP).select("form", "n", "capitals", "word", "count", "word_capitals", "shared")
        words = [(r["form"], r["n"], r["capitals"]) for r in right.orderBy(F.desc("n"), "form").limit(SAMPLE_WORDS).collect()]
        names = [(r["form"], r["n"], r["capitals"]) for r in forms.where((F.col("capitals") > 0.9) & (F.col("n") < MIN_COUNT) & ~F.col("form").rlike(r"[\d(]")).orderBy(F.xxhash64("form"), "form").limit(SAMPLE_NAMES).collect()]
        model = train_ranker(words, names)

        def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.array([features(*r) for r in zip(pdf["form"], pdf["n"], pdf["capitals"], pdf["word"], pdf["count"], pdf["word_capitals"], pdf["shared"])])
                    p = np.where(x[:, 0] < 9, model.probability(x), 0.0)
                    yield pd.DataFrame({"form": pdf["form"], "word": pdf["word"], "score": p, "count": pdf["count"], "common": (x[:, 4] >= 2.5) & (x[:, 0] == 1)})[p >= ACCEPT]

        scored = pairs.mapInPandas(rank, "form string, word string, score double, count long, common boolean")
        best = scored.groupBy("form").agg(F.max(F.struct("score", "count", "word", "common")).alias("b")).select("form", F.col("b.word").alias("word"), F.col("b.common").alias("common"))
        return self.stage.cut(best, "corrections")

    def _hyphens(self) -> DataFrame:
        broken = self.stage.cut(self.pages.select("id", "text").mapInPandas(_broken, "id string, line_no int, left string, right string, plain boolean"), "broken")
        pairs = broken.groupBy("left", "right").agg(F.max("plain").alias("plain"))
        forms = pairs.select("left", "right", "plain", F.explode(F.array(F.struct(F.lower(F.concat("left", "right")).alias("form"), F.lit(False).alias("kept")), F.struct(F.lower(F.concat_ws("-", "left", "right")).alias("form"), F.lit(True).alias("kept")))).alias("f")).select("left", "right", "plain", "f.*")
        fixed = lookup_join(lookup_join(forms, self.corrections.select("form", "word"), "form", salts=SALTS).withColumn("form", F.coalesce("word", "form")), self.words.select("form", "n"), "form", salts=SALTS)
        sides = fixed.groupBy("left", "right", "plain").agg(F.sum(F.when(F.col("kept"), F.col("n"))).alias("with"), F.sum(F.when(~F.col("kept"), F.col("n"))).alias("without"), F.max(F.when(F.col("kept"), F.col("word"))).alias("w1"), F.max(F.when(~F.col("kept"), F.col("word"))).alias("w0"))
        known = self.words.where("n >= 20 and form rlike '^[a-z]+-?[a-z]+$' and length(form) >= 5").orderBy(F.xxhash64("form"), "form").limit(SAMPLE_LINES)
        model = train_joins([(r["form"], r["n"]) for r in known.collect()])
        two = sides.select("left", "right", "plain", "w0", "w1", F.log1p(_count(F.col("with"))).alias("a"), F.log1p(_count(F.col("without"))).alias("b"))

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.array([[a, b, float(r[:1].isupper() and not l.isupper()), float(p), len(l), len(r)] for a, b, l, r, p in zip(pdf["a"], pdf["b"], pdf["left"], pdf["right"], pdf["plain"])])
                    keep = model.probability(x) >= 0.5
                    words = [_cased((l + "-" + r) if k else (l + r), (w1 if k else w0)) for l, r, k, w0, w1 in zip(pdf["left"], pdf["right"], keep, pdf["w0"], pdf["w1"])]
                    yield pd.DataFrame({"left": pdf["left"], "right": pdf["right"], "kept": keep, "word": words})

        decided = two.mapInPandas(decide, "left string, right string, kept boolean, word string")
        return self.stage.cut(broken.join(decided, ["left", "right"]).select("id", "line_no", "left", "right", "kept", "word"), "hyphens")

    def _misread(self) -> DataFrame:
        wanted = self.stage.cut(self.pages.select("id", "text").mapInPandas(_suspects(self._clean()), TOKEN_SCHEMA), "tokens")
        numbers = wanted.where("form rlike '[0-9]'").select("id", "line_no", "place", "written", _numerals(self._units())("written").alias("word")).where("word is not null")
        # names have no misread characters; a capital before a capital may still open a sentence, and no name holds a digit
        words = lookup_join(wanted, self.corrections, "form", "inner", salts=SALTS).where("not named or form rlike '[0-9(]' or (opens and common)")
        cased = F.when((F.col("written") == F.upper("written")) & (F.length(F.regexp_replace("written", r"\P{L}", "")) > 1) & ~F.col("opens"), F.upper("word"))
        first = F.substring("written", 1, 1)
        capital = F.when(first.rlike(r"\p{Lu}"), True).when(first.rlike(r"\p{Ll}") & ~((first == "l") & F.startswith("word", F.lit("i"))), False).otherwise(F.col("opens"))
        words = words.withColumn("word", F.coalesce(cased, F.when(capital, F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))).otherwise(F.col("word"))))
        both = words.select("id", "line_no", "place", "written", "word").unionByName(numbers)
        heads = self.furniture.select("id", "line_no")
        return both.join(heads, ["id", "line_no"], "left_anti")

    def _units(self) -> str:
        """Of the letters that misread digits look like, those that end numbers far oftener than they stand within them: units."""
        ends, within = F.regexp_extract("form", r"^[\d.,]*\d([lgbsq])$", 1), F.regexp_extract("form", r"^[\d.,]*([lgbsq])[\d.,]*\d$", 1)
        counts = self.words.where("form rlike '[0-9]'").select("n", ends.alias("e"), within.alias("w")).where("e <> '' or w <> ''")
        letter = F.when(F.col("e") != "", F.col("e")).otherwise(F.col("w"))
        rows = counts.groupBy(letter.alias("letter")).agg(F.sum(F.when(F.col("e") != "", F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(F.col("e") == "", F.col("n")).otherwise(0)).alias("within")).collect()
        return "".join(sorted(r["letter"] for r in rows if r["ends"] > 3 * r["within"]))

    def _clean(self) -> frozenset[str]:
        """Of the most frequent forms, those that need no correction: a bounded set that tokens needn't be joined for."""
        top = self.words.where("n >= 20").orderBy(F.desc("n"), "form").limit(20000).select("form")
        return frozenset(r["form"] for r in top.join(self.corrections.select("form"), "form", "left_anti").collect())

    def _furniture(self) -> DataFrame:
        """id, line_no and kind of running heads and page numbers."""
        lines = self.pages.select("id", "document_id", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("_pos", "line"))
        numbers = lines.where((F.length("line") <= 40) & F.col("line").rlike(r"[\dOlISZB|]")).withColumn("_n", _page_of("line")).where(F.col("_n") == F.col("page_number"))
        numbers = self.stage.cut(numbers.select("id", (F.col("_pos") + 1).cast("int").alias("line_no")), "numbers")
        # the first lines of a page that are neither blank nor its number
        filled = F.filter(F.transform(F.split("text", "\n", -1), lambda l, i: F.struct((i + 1).cast("int").alias("line_no"), l.alias("line"))), lambda x: x["line"].rlike(r"\S"))
        top = F.filter(F.slice(filled, 1, 3), lambda x: ~x["line"].rlike(r"^[\W_]*(?i:page|pg|p)?[\W_]*[\dOlISZB|]{1,6}(?:\s*(?:/|of)\s*[\dOlISZB|]{1,6})?[\W_]*$"))
        first = self.pages.select("id", "document_id", F.explode(F.slice(top, 1, 1)).alias("x"), F.size(filled).alias("_lines")).select("id", "document_id", "x.*").withColumn("key", _key(F.col("line"))).where(F.length("key") >= 6)
        first = self.stage.cut(first.withColumn("keys", _prefixes(F.col("line"))), "first")
        each = first.select("document_id", F.explode("keys").alias("part")).groupBy("document_id", "part").agg(F.count("*").alias("on"))
        sizes = self.pages.groupBy("document_id").agg(F.count("*").alias("of"))
        # sentences are no heads, so only lines without their marks are counted further down a page
        inside = lines.where((F.col("_pos") > 3) & (F.length("line") <= 120) & ~F.col("line").rlike(r"[.!?;,。！？।؟]\s*$|, |\. ")).select("document_id", F.explode(_prefixes(F.col("line"))).alias("part")).where(F.length("part") <= 80).groupBy("document_id", "part").agg(F.count("*").alias("inner"))
        wide = each.groupBy("part").agg(F.count("*").alias("documents"), F.sum("on").alias("pages"))
        elsewhere = inside.groupBy("part").agg(F.sum("inner").alias("inner_all"))
        parts = each.join(inside, ["document_id", "part"], "left").join(wide, "part").join(elsewhere, "part", "left")
        parts = self.stage.cut(lookup_join(parts, sizes, "document_id", salts=SALTS), "parts")
        known = lookup_join(first, self.titles.select("document_id", _key(F.col("title")).alias("title"), _key(F.col("publisher")).alias("publisher")), "document_id", salts=SALTS)
        whole = parts.select("document_id", F.col("part").alias("key"), "on", F.coalesce("inner", F.lit(0)).alias("inner"), "of", "documents", "pages", F.coalesce("inner_all", F.lit(0)).alias("inner_all"))
        lead = parts.select("document_id", F.col("part").alias("_lead"), F.col("on").alias("lead_on"), F.coalesce("inner", F.lit(0)).alias("lead_inner"))
        seen = known.withColumn("_lead", F.element_at("keys", 1)).join(whole, ["document_id", "key"], "left").join(lead, ["document_id", "_lead"], "left")
        titled = F.coalesce((F.length("title") >= 6) & F.contains("key", F.substring_index("title", "§", 1)), F.lit(False))
        published = F.coalesce((F.length("publisher") >= 6) & F.startswith("key", "publisher"), F.lit(False))
        prose = F.col("line").rlike(r"[.!?]\s*$|[.!?] \p{Lu}|, |[;:。！？।؟،]|[\u0e00-\u0e7f]") | F.col("line").rlike(r"\p{Ll}{2,}(?:ed|ing|was|were)\b.*\p{Ll}{2,} \p{Ll}{2,} \p{Ll}{2,}")
        num = lambda c: F.log1p(_count(F.col(c))).alias(c)
        x = seen.select("id", "line_no", "line", titled.alias("titled"), published.alias("published"), prose.alias("prose"), num("on"), num("inner"), (_count(F.col("on")) / F.coalesce("of", F.lit(1))).alias("share"), num("documents"), num("inner_all"), num("lead_on"), num("lead_inner"), F.length("line").alias("length"))
        names = ["titled", "published", "prose", "on", "inner", "share", "documents", "inner_all", "lead_on", "lead_inner", "length"]
        x = self.stage.cut(x.withColumns({c: F.col(c).cast("double") for c in names}), "heads")
        sample = x.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_LINES).select(*names).toPandas()
        model = train_heads(sample)

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.loc[model.probability(pdf[names].to_numpy()) >= 0.5, ["id", "line_no"]]

        heads = x.mapInPandas(judge, "id string, line_no int").withColumn("kind", F.lit("header"))
        return self.stage.cut(heads.unionByName(numbers.withColumn("kind", F.lit("page_number"))), "furniture")

    def faults(self) -> DataFrame:
        """id, line_no, kind and word of every fault."""
        hyphens = self.hyphens.join(self.furniture.select("id", "line_no"), ["id", "line_no"], "left_anti").select("id", "line_no", F.lit("hyphen").alias("kind"), "word")
        chars = self.misread.select("id", "line_no", F.lit("char").alias("kind"), "word")
        return hyphens.unionByName(chars).unionByName(self.furniture.select("id", "line_no", "kind", F.lit("").alias("word"))).distinct()

    def repaired(self) -> DataFrame:
        """id, document_id, page_number and text in paragraphs, without furniture, broken words and misread characters."""
        fixes = (
            self.furniture.select("id", F.struct("line_no", F.lit("drop").alias("kind"), F.lit("").alias("written"), F.lit("").alias("word")).alias("fix"))
            .unionByName(self.misread.select("id", F.struct("line_no", F.lit("char").alias("kind"), "written", "word").alias("fix")))
            .unionByName(self.hyphens.select("id", F.struct("line_no", F.lit("join").alias("kind"), F.concat_ws("\n", "left", "right").alias("written"), "word").alias("fix")))
            .groupBy("id")
            .agg(F.collect_list("fix").alias("fixes"))  # the faults of one page
        )

        def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf["text"] = [paragraphs(t, f if f is not None else []) for t, f in zip(pdf["text"], pdf.pop("fixes"))]
                yield pdf

        return self.pages.join(fixes, "id", "left").select("id", "document_id", "page_number", "text", "fixes").mapInPandas(mend, "id string, document_id string, page_number int, text string")


def _cased(written: str, word: str | None) -> str:
    if word is None:
        return written
    if written.isupper():
        return word.upper()
    return word[:1].upper() + word[1:] if written[:1].isupper() else word


def paragraphs(text: str, fixes) -> str:
    """The text with its faults mended; lines run on within a paragraph, blank lines part paragraphs."""
    lines = text.split("\n")
    dropped, joins = set(), {}
    for f in fixes:
        at = f["line_no"] - 1
        if f["kind"] == "drop":
            dropped.add(at)
        elif f["kind"] == "join":
            joins[at] = (*f["written"].split("\n"), f["word"])
        else:
            lines[at] = lines[at].replace(f["written"], f["word"], 1)
    for at in sorted(joins, reverse=True):
        left, right, word = joins[at]
        nxt = at + 1
        if nxt < len(lines) and lines[nxt].lstrip().startswith(right):
            head = lines[at].rstrip().rstrip(_BREAKS)
            lines[at] = head[: len(head) - len(left)] + word + lines[nxt].lstrip()[len(right) :].split(" ", 1)[0]
            rest = lines[nxt].lstrip()[len(right) :].split(" ", 1)
            lines[nxt] = rest[1] if len(rest) > 1 else "\0"
    out, held = [], []
    for at, line in enumerate(lines):
        if at in dropped or line == "\0":
            continue
        if line.strip():
            held.append(" ".join(line.split()))
        elif held:
            out.append(" ".join(held))
            held = []
    if held:
        out.append(" ".join(held))
    return "\n\n".join(out)


def train_joins(known: list[tuple[str, int]]) -> Boosted:
    """Whether a word over a line end keeps its hyphen, from words of both kinds divided at each place in turn."""
    x, y = [], []
    for at, (form, n) in enumerate(known):
        if "-" in form:
            left, right = form.split("-", 1)
            x.append([np.log1p(n), np.log1p(0 if at % 3 else n // 50), 0.0, 1.0, len(left), len(right)])
            y.append(1.0)
        elif len(form) >= 5:
            cut = 2 + at % (len(form) - 3)
            x.append([np.log1p(0 if at % 3 else n // 50), np.log1p(n), 0.0, float(at % 2), cut, len(form) - cut])
            y.append(0.0)
    # words of neither count: a capital after the hyphen begins the second part of a name
    x += [[0, 0, 1, 1, 5, 5], [2, 0, 1, 1, 5, 5], [2, 0, 0, 1, 5, 5], [0, 0, 0, 1, 5, 5], [0, 0, 0, 0, 5, 5], [0, 2, 0, 1, 5, 5]] * 20
    y += [1.0, 1.0, 1.0, 0.0, 0.0, 0.0] * 20
    return Boosted(rounds=30).fit(np.array(x), np.array(y))


def train_heads(sample: pd.DataFrame) -> Boosted:
    """Running heads from features of the first lines, labelled where title, publisher or prose leave no doubt."""
    sure = sample[((sample["titled"] == 1) & (sample["length"] < 120)) | (sample["prose"] == 1) | (sample["inner"] > np.log1p(1))]
    y = (sure["titled"] == 1).to_numpy(float)
    x = sure.to_numpy(float)
    # the same lines without a known title, so that recurrence decides where no title is given
    bare = x.copy()
    bare[:, 0] = bare[:, 1] = 0
    keep = (bare[:, 3] >= np.log1p(2)) | (bare[:, 8] >= np.log1p(2)) | (y == 0)
    x, y = np.vstack([x, bare[keep]]), np.concatenate([y, y[keep]])
    if len(set(y)) < 2:
        x, y = np.array([[1, 1, 0, 2, 0, 0.9, 1, 0, 2, 0, 40], [0, 0, 1, 0.7, 0, 0.1, 0.7, 0, 0.7, 0, 80]]), np.array([1.0, 0.0])
    return Boosted(rounds=30).fit(x, y)


def _prefixes(line: Column) -> Column:
    """The letters of a line, and those before its first bar or dash."""
    return F.array_distinct(F.array(_key(F.regexp_replace(line, r"\s+[|–—].*$", "")), _key(line)))


@F.pandas_udf(T.IntegerType())
def _page_of(lines: pd.Series) -> pd.Series:
    out = []
    for line in lines:
        m = _PAGE.fullmatch(line.strip())
        t = m[1].translate(DIGITS) if m and any(c.isdigit() for c in m[1]) else ""
        out.append(int(t) if t.isdigit() else None)
    return pd.Series(out, dtype="Int32")


_UNIT_WORD = re.compile(r"\d(?:sq|bbl|gb|lb|lbs|bl|gal)$")


def read_numeral(written: str, units: str = "") -> str | None:
    """The numeral that a misread one stands for, or none; a letter of ``units`` at the end is a unit."""
    if m := _CURRENCY.match(written):
        rest = read_numeral(written[m.end() :], units)
        return None if rest is None else m[0] + rest
    if not _MISREAD_NUMERAL.fullmatch(written) or _UNIT_WORD.search(written) or re.fullmatch(r"[QHT]\d", written):
        return None
    right = written.translate(DIGITS)
    if not _NUMERAL.fullmatch(right) or right == written:
        return None
    odd = [c for c in written if not c.isdigit() and c not in ".,-/"]
    return None if len(odd) == 1 and written[-1] in units else right


def _numerals(units: str):
    @F.pandas_udf(T.StringType())
    def run(written: pd.Series) -> pd.Series:
        return written.map(lambda w: read_numeral(w, units))

    return run


def _suspects(clean: frozenset[str]):
    """Every token whose form is not among the clean ones, with where it stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                for line in _lines(text):
                    for i in range(line.first, line.last):
                        token = line.raw[i]
                        word = token.strip(_STRIP)
                        if word.lower() in clean and token[0] != "(":
                            continue
                        for w in _forms(token):
                            form = w.lower()
                            if w and form not in clean and len(w) <= 40 and any(c.isalpha() for c in w):
                                rows.append((key, line.no, i, form, w, _capital(token), line.opens(i), line.named(i)))
            yield pd.DataFrame(rows, columns=["id", "line_no", "place", "form", "written", "capital", "opens", "named"])

    return run
