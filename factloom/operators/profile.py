"""What a document is about, learned from its own first pages: its subject, its period and the acronyms it defines.

Names are counted with where they stand (masthead, title, sentences with figures, after an article, on how many pages);
spellings of one name are merged, short forms credited to the long one, self-references dropped, and the name with the
highest weight is the subject.  One task reads the first ``PROFILE_PAGES`` pages of a document, so groups are bounded.

Null texts count as empty pages; a document without names takes its title, one without title is ``Unknown``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import cues as Q
from factloom.functions.vocabulary import CURRENCIES, LEGAL_FORMS
from factloom.operators.pages import PROFILE_PAGES

SCHEMA = "document_id string, default_subject string, default_period string, subject_threshold int, acronyms map<string,string>, subject_counts map<string,int>, ranking array<struct<score:double,name:string>>"
MASTHEAD_LINES = 6
_NAME, _POSSESSIVE, _ACRONYM, _TITLE_OF = re.compile(Q.NAME), re.compile(Q.POSSESSIVE), re.compile(Q.ACRONYM), re.compile(Q.TITLE_OF)
_TIME, _QUANTITY = re.compile(Q.TIME, re.I), re.compile(Q.QUANTITY + Q.FOLLOWING_WORDS + Q.CLOSING, re.I)
_MIXED = re.compile(r"^[A-Z][a-z]{1,2}[A-Z][a-z]?$")
_SIGNS = frozenset(c for c, _ in CURRENCIES)


def clean_name(raw: str) -> str | None:
    """A mention without what stands around a name, or none where it names nothing."""
    text = " ".join(raw.split()).strip(" .,;:-")
    words = text.split()
    low = [w.lower() for w in words]
    bare = [w.strip(".") for w in low]
    if not 3 <= len(text) <= 60 or not words:
        return None
    nothing = (
        all(w in Q.NO_NAMES for w in low)
        or all(b in Q.MEASURES or w in _SIGNS for w, b in zip(low, bare))
        or bare[0] in Q.PARTS
        or all(b in Q.MONTH_NAMES for b in bare)
        or sum(w.isupper() and len(w) > 1 for w in words) >= 3
        or any(_MIXED.match(w) for w in words)
    )
    if nothing:
        return None
    first = next((i for i, w in enumerate(low) if w not in Q.LEADING), len(words))
    words = words[first:]
    while len(words) > 1 and words[-1].lower().strip(".") in Q.NO_NAMES:
        words = words[:-1]
    head = [w.lower() for w in words[:4]]
    if "of" in head:
        at = head.index("of")
        if len(words) > at + 1 and any(w in Q.NO_NAMES for w in head[:at]):
            words = words[at + 1 :]
    return " ".join(words) or None


def name_key(name: str) -> str:
    """The key of a name, as ``entity_key`` gives it."""
    shown = re.sub(r"[‘’']s\b", "", " ".join(name.split()).strip(",;:.")).strip()
    words = [w for w in re.findall(r"[a-z0-9&]+", shown.lower()) if w not in ("the", "a", "an")]
    while words and words[-1] in LEGAL_FORMS:
        words.pop()
    return "_".join(words or re.findall(r"[a-z0-9]+", shown.lower()) or ["unknown"])


@dataclass
class Mentions:
    """Counts of one name."""

    total: int = 0
    prose: int = 0
    article: int = 0
    titled: int = 0
    masthead: int = 0
    rank: int | None = None
    pages: set = field(default_factory=set)
    page_count: int = 0

    def take(self, other: Mentions) -> None:
        """Adds the mentions of another spelling; the pages of the two are taken to be the same ones."""
        self.total += other.total
        self.prose += other.prose
        self.titled += other.titled
        self.page_count = max(self.page_count, other.page_count)
        if other.masthead:
            self.masthead += other.masthead
            self.rank = other.rank if self.rank is None else min(self.rank, other.rank)


class Profile:
    """Collects the mentions of the pages of one document."""

    def __init__(self) -> None:
        self.names: dict[str, Mentions] = {}
        self.acronyms: dict[str, str] = {}
        self.periods: Counter = Counter()
        self.pages = 0

    def _at(self, name: str) -> Mentions:
        return self.names.setdefault(name, Mentions())

    def read(self, text: str, first: bool) -> None:
        if not text:
            return
        self.pages += 1
        lines = text.split("\n")
        if first:
            for rank, line in enumerate(lines[:MASTHEAD_LINES]):
                for m in _TITLE_OF.finditer(line):
                    if m[1].lower() in Q.NO_NAMES and (name := clean_name(m[2])):
                        self._at(name).titled += 1
                for m in _NAME.finditer(line):
                    if name := clean_name(m[0]):
                        seen = self._at(name)
                        seen.masthead += 1
                        seen.rank = rank if seen.rank is None else seen.rank
        for m in _ACRONYM.finditer(text):
            if 1 <= len(m[1].split()) <= 6:
                self.acronyms.setdefault(m[2], m[1].strip())
        for m in _POSSESSIVE.finditer(text):
            if name := clean_name(m[1]):
                self._count(name, 3)
        start = 0
        for line in lines:
            figures = any(q["cur"] or q["mag"] or q["pct"] for q in _QUANTITY.finditer(line))
            self._read_names(text, start, start + len(line), figures)
            start += len(line) + 1
        for m in _TIME.finditer(text):
            if is_period(m[0]):
                self.periods[m[0].strip().lower()] += 1

    def _count(self, name: str, n: int) -> Mentions:
        seen = self._at(name)
        seen.total += n
        seen.pages.add(self.pages)
        return seen

    def _read_names(self, text: str, start: int, end: int, figures: bool) -> None:
        for m in _NAME.finditer(text, start, end):
            before = text[: m.start()].rstrip() if " " not in m[0] and not m[0].isupper() else None
            if before is not None and (not before or before[-1] in ".!?"):
                continue  # one capital word that opens a sentence
            if not (name := clean_name(m[0])):
                continue
            seen = self._count(name, 1)
            seen.prose += figures
            head = name.split(" ")[0]
            if head != name and len(head) > 2 and head.lower() not in Q.NO_NAMES:
                self._count(head, 1)
            left = text[max(0, m.start() - 6) : m.start()].lower().split()
            if m[0].split(" ", 1)[0].lower() in Q.DETERMINERS or (left and left[-1] in Q.DETERMINERS):
                seen.article += 1

    def _merge(self) -> None:
        """Spellings of one key become one name, short forms go to their long form, self-references are dropped."""
        for seen in self.names.values():
            seen.page_count = len(seen.pages)
        counted = [n for n, s in self.names.items() if s.total]
        groups: dict[str, list[str]] = {}
        for n in counted:
            groups.setdefault(name_key(n), []).append(n)
        for variants in groups.values():
            shown = min(variants, key=lambda n: (n.isupper(), len(n)))
            for n in variants:
                if n != shown:
                    self.names[shown].take(self.names[n])
                    self.names[shown].article += self.names[n].article
                    self.names[n].total = 0
        live = lambda: [n for n in counted if self.names[n].total]
        for short in sorted(live(), key=lambda n: len(n.split())):
            words = short.lower().split()
            if len(words) > 2 or not self.names[short].total:
                continue
            hosts = [n for n in live() if n != short and " " in n and set(words) < set(n.lower().split())]
            if len(hosts) > 1 and all(n.lower().split()[: len(words)] == words for n in hosts):
                for n in hosts:
                    self.names[short].take(self.names[n])
                    self.names[n].total = 0
            elif len(hosts) == 1:
                self.names[hosts[0]].take(self.names[short])
                self.names[short].total = 0
        for n in live():
            seen = self.names[n]
            if " " not in n and seen.rank != 0 and seen.article >= max(2, 0.6 * seen.total):
                seen.total = 0

    def _weight(self, name: str, seen: Mentions, title_words: set[str]) -> float:
        # The factors of a name's weight.
        words = name.split()
        again = seen.total > seen.masthead
        score = seen.total * (1.0 + 0.35 * min(len(words) - 1, 4)) * (2.5 if again else 1.0)
        if self.pages > 1:
            score *= 1.0 + 2.0 * ((seen.page_count or 1) / self.pages)
        score *= 3.0 if seen.titled else 1.0
        if seen.rank is not None:
            score *= (3.0 if seen.rank == 0 else 1.8) if again else 1.5
        score *= 1.0 + 2.0 * (seen.prose / seen.total)
        score *= 0.4 if len(words) == 1 and words[0].isupper() and words[0] not in self.acronyms else 1.0
        score *= 1.8 if words[-1].lower().strip(".") in LEGAL_FORMS else 1.0
        return score * (4.0 if title_words and any(w.lower() in title_words for w in words) else 1.0)

    def result(self, title: str) -> dict:
        self._merge()
        title_words = {w for w in re.findall(r"[a-z]+", title.lower()) if len(w) > 3}
        live = {n: s for n, s in self.names.items() if s.total}
        ranked = sorted(((self._weight(n, s, title_words), n) for n, s in live.items()), reverse=True)
        subject, threshold = "Unknown", 3
        if ranked:
            subject, threshold = ranked[0][1], max(3, max(s.total for s in live.values()) // 10)
        elif title:
            subject = " ".join(w for w in title.split() if w.lower() not in Q.NO_NAMES) or title
        return {
            "default_subject": subject, "default_period": self.periods.most_common(1)[0][0] if self.periods else None, "subject_threshold": threshold, "acronyms": self.acronyms,
            "subject_counts": {n: s.total for n, s in live.items()}, "ranking": [{"score": round(w, 2), "name": n} for w, n in ranked[:5]],
        }


def is_period(text: str) -> bool:
    """Whether an expression of time has a key."""
    return not re.fullmatch(r"(?:as\s+(?:at|on|of)\s+)?FY\s?\d{3}", text.strip(), re.I)


def profile_documents(pages: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One profile a document.  pages: document_id, page_number, text; titles: document_id (unique), title."""
    first = pages.where(F.col("document_id").isNotNull()).select("document_id", "page_number", "text")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))).where(F.col("_n") <= PROFILE_PAGES)
    named = first.join(titles.select("document_id", "title"), "document_id", "left") if titles is not None else first.withColumn("title", F.lit(None).cast("string"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        profile = Profile()
        for i, text in enumerate(pdf.sort_values("_n")["text"]):
            profile.read(text or "", i == 0)
        title = next((t for t in pdf["title"] if t), "")
        return pd.DataFrame([{"document_id": pdf["document_id"].iloc[0], **profile.result(title)}])

    return named.groupBy("document_id").applyInPandas(run, SCHEMA)
