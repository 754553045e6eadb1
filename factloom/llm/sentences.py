"""Sentence boundaries across languages and scripts, by a pushdown automaton.

The automaton reads a text from left to right and stops at terminators, quotation marks, brackets and line breaks only.
Its stack holds the quotations and brackets that are open; the start of a line decides whether a numeral or letter with
a full stop is a list marker.  A full stop ends a sentence unless the word before it runs through the trie of
abbreviations, is an initial or an ordinal before a month, or what follows carries the sentence on.  Terminators of
scripts without blanks end a sentence where they stand; in Thai a blank ends one.  Closing marks belong to the sentence
they close.

Null, empty and blank texts have no sentence and no boundary.  Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, lower-cased, without their last full stop.  These always carry on,
CARRY = """
adj agric al approx aprox auth coop dept engy intl manuf mfg natl renew serv stat svcs univ art arts bd bldg bzgl ca cap capt cf chap cm col comdr d.h dept dipl dr dra drs ed eds éd e.g eq eqs env esp est etc.a ex
fig figs fr gen gov hon i.a i.e incl ing inkl insb jr lic lt m.e maj messrs mgr mlle mm mme mmes mr mrs ms mt mut nn nos nr núm núms ntra o.ä op p.a p.e
p.ej p.ex pág págs par pp prof profa pvt rep resp rev rs s.a s.o sec secs sen sgt sog sr sra sras srs sres srta st ste str tab tabl tel u.a u.ä u.u v.a vgl vol vols vs vtl z.b z.h z.t zzgl cía ud uds डॉ श्री प्रो सं
""".split()
# these carry on before a numeral only,
CARRY_NUMERAL = "no nos n art abs bl ch cl col eq fig ill item l ln map no. p par pt q r s sec ser t tab tome v vol § क्र".split()
# and these may also end a sentence, which they do before what can begin one.
MAY_END = """
ltd inc co corp cos plc llc llp bros pte pty ag kg s.a.r.l s.p.a cie a.m p.m am pm u.s u.k u.n u.s.a e.u d.c etc etc usw ft sq.ft in lb lbs oz yd mi hr hrs min sec jr sr
n.d n.a a.d b.c p.s jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun ph.d m.d b.a mio mrd tsd v.chr n.chr
""".split()
#: Words that a single letter with a full stop after them does not carry on.
LABELS = frozenset("annex annexe appendix anhang anexo part section table schedule group class option phase series type plan unit block zone grade level type".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember jan feb mär mrz apr jun jul aug sep sept okt nov dez january february march may june july october december quartal halbjahr jahrhundert tag platz".split())
UNITS = frozenset("kg km cm mm ha kw mw gw tw kwh mwh gwh twh gj mj tj kj kl ml hl cr mn bn tn lakh lb lbs hz khz mhz ghz mt kt".split())
OPENERS = frozenset("""
a according advisers after although an and approx as at because before both but by compared customers did do does during each figures following for from he heat her his how if in is it its local loading management
many neither no nor not of on one other our over peak plant she since so some sources such that the their then there these they this those to under until version was we what when where which while who why with work you
am bei das dem den der des die diese ein eine etwa für im in laut reicht sie und vom von wie wir zum zur als auch aus
au aux avec ce ces cette dans de des du elle en environ et il ils la le les l leur mais nous on par pour quelle selon si son sur un une voir
al con de del el ella en esta este la las los para por se según si su sus un una unos unas más
""".split())

SCALES = frozenset("k thousand lakh million billion trillion crore".split())
_ORGANISATIONS = frozenset("ltd inc co corp cos bros pte pty llc llp plc".split())
_SUFFIXES = _ORGANISATIONS | frozenset("limited corporation group gmbh ag holdings company trust s.a".split())
#: After these a capital begins a sentence only with a word that can.
_NAMES_ON = frozenset("u.s u.k u.n u.s.a e.u d.c ph.d m.d jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun jr sr".split())

_OPEN = {"“": "”", "„": "“”", "‘": "’", "‚": "‘’", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕"}
_CLOSE = frozenset("”’‘»›」』》〉)]}）］】〕") - {"‘"}
_BRACKETS = frozenset(")]}）］】〕")
_HARD = frozenset("。！？｡।॥؟۔፧།༎။៕⁇⁈⁉‼")
_STOP = re.compile(r"""[.!?…。！？｡।॥؟۔፧།༎။៕⁇⁈⁉‼]+|["“”„‘’‚«»‹›「」『』《》〈〉()\[\]{}（）［］【】〔〕]|\n""")
_BLANK, _WORD_BEFORE = re.compile(r"\s+"), re.compile(r"(?:[^\W\d_]|[\u0300-\u036f\u0900-\u097f])+(?:\.(?:[^\W\d_]|[\u0900-\u097f])+)*$")
_THAI, _CJK_NEXT = re.compile(r"[\u0e00-\u0e7f]"), re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_WORD_AFTER = re.compile(r"[\"“„‘‚«‹¿¡(\[]*\s?([^\W\d_]+(?:['’.-][^\W\d_]+)*)")
_CARRIED = re.compile(r"[,;:，、；：)\]}]|[-–—]\s|['’]\d\d\b")
_QUOTED_ON = re.compile(r"と|って|という|、|，")
_ORDINAL = re.compile(r"(?<![\w.,])\d{1,2}$")
_MARKER = re.compile(r"\s*(?:[(\[]?(?:\d{1,3}|[A-Za-z]|[ivxlc]{1,5})(?:\.\d{1,3})*)")


def _trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in reversed(w):
            node = node.setdefault(ch, {})
        node[""] = True
    return root


_TRIES = tuple(_trie(w) for w in (CARRY, CARRY_NUMERAL, MAY_END))


def _in_trie(trie: dict, low: str) -> bool:
    """Whether the word, read backwards, is in the trie as a whole."""
    for ch in reversed(low):
        trie = trie.get(ch)
        if trie is None:
            return False
    return "" in trie


def _previous(text: str, at: int) -> str:
    """The word that ends at a place after blanks, with a full stop of its own dropped."""
    end = at
    while end > 0 and text[end - 1] in "  .":
        end -= 1
    m = _WORD_BEFORE.search(text, max(0, end - 40), end)
    return m[0] if m else ""


def _full_stop_ends(text: str, at: int, after: int, line: int) -> bool:
    """Whether the full stop at a place ends a sentence; ``after`` is the next place that is no blank."""
    if _CARRIED.match(text, after) or _MARKER.fullmatch(text, line, at):  # a list marker stands at the start of a line
        return False
    nxt, numeral = text[after], text[after].isdigit()
    follows = _WORD_AFTER.match(text, after)
    head = follows[1] if follows else ""
    lower = head[:1].islower()
    m = _WORD_BEFORE.search(text, max(line, at - 40), at)
    if m is None:
        return not lower and not (head.lower() in MONTHS and _ORDINAL.search(text, max(line, at - 12), at))
    word, low, before = m[0], m[0].lower(), _previous(text, m.start())
    if _in_trie(_TRIES[0], low) or (numeral and _in_trie(_TRIES[1], low)):
        return False
    if len(word) == 1:  # a unit, a label, or an initial
        if text[: m.start()].rstrip()[-1:].isdigit() or before.lower() in UNITS or before.lower() in SCALES:
            return not lower
        if word.isupper():
            return before.lower() in LABELS and not lower
        return not (lower or numeral or nxt in "€$£¥₹(" or len(before) == 1 or (len(head) == 1 and text[follows.end() : follows.end() + 1] == "."))
    if _in_trie(_TRIES[2], low):
        if lower or nxt in "([{" or (numeral and low not in _ORGANISATIONS):
            return False
        if word.isascii() and nxt.isalpha() and not nxt.isascii() and not nxt.isupper():
            return False  # a foreign name within a sentence of a script without capitals
        if low in ("a.m", "p.m", "am", "pm"):
            return not (2 <= len(head) <= 5 and head.isupper())
        if low in _ORGANISATIONS:
            return head.lower() not in _SUFFIXES
        if low in _NAMES_ON:
            return head.lower() in OPENERS or nxt in "\"“„‘«¿¡"
        return True
    if word[0].isupper() and len(word) <= 3 and word[1:].islower() and before[:1].isupper() and not {low, before.lower()} & (UNITS | SCALES):
        return not lower and head.lower() in OPENERS  # else a shortened part of a name
    return not lower


class _Stack:
    """Open quotations and brackets, each with the characters that may close it and its place."""

    def __init__(self, text: str) -> None:
        self.items: list[tuple[str, int]] = []
        self.last = {c: text.rfind(c) for c in _CLOSE | {"\"", "“"}}

    def open(self, closers: str, at: int) -> None:
        if any(self.last[c] > at for c in closers):  # what nothing closes is not open
            self.items.append((closers, at))

    def close(self, ch: str) -> bool:
        for k in range(len(self.items) - 1, -1, -1):
            if ch in self.items[k][0]:
                del self.items[k:]
                return True
        return False

    def bracket(self) -> int | None:
        """The place of the outermost open bracket."""
        return next((at for closers, at in self.items if closers in _BRACKETS), None)


def _lower_follows(text: str, after: int) -> bool:
    head = _WORD_AFTER.match(text, after)
    return bool(head) and head[1][:1].islower()


def _ends(text: str, at: int, stop: str, after: int, line: int, closed: bool) -> bool:
    """Whether a terminator ends a sentence, given the next place that is no blank."""
    if stop[-1] in _HARD:
        return not _CARRIED.match(text, after) and not (closed and _QUOTED_ON.match(text, after))
    if stop == "." and not closed:
        return _full_stop_ends(text, at, after, line)
    return not _lower_follows(text, after) and not _CARRIED.match(text, after)


def boundaries(text: str | None, line_ends: bool = True) -> list[int]:
    """Places after the last character of each sentence that another one follows."""
    if not text:
        return []
    out: list[int] = []
    total, stack, line, pos = len(text.rstrip()), _Stack(text), 0, 0
    while (m := _STOP.search(text, pos)) and m.end() < total:
        at, pos, ch = m.start(), m.end(), text[m.start()]
        if ch == "\n":
            if line_ends:
                end = at
                while end and text[end - 1].isspace():
                    end -= 1
                out.append(end)
                stack.items.clear()
                line = pos
            continue
        if ch == '"':
            if not stack.close(ch):
                stack.open(ch, at)
            continue
        if ch in _CLOSE or (ch == "“" and any(ch in c for c, _ in stack.items)):
            stack.close(ch)
            continue
        if ch in _OPEN:
            if not (ch == "‘" and at and text[at - 1].isalnum()):
                stack.open(_OPEN[ch], at)
            continue
        end, closed = pos, False
        while end < total:  # closing marks belong to the sentence, guillemets with the blank before them
            c = text[end]
            if (c in _CLOSE or c in "\"“") and stack.close(c):
                end, closed = end + 1, True
            elif c in "\u00a0\u202f " and text[end + 1 : end + 2] in ("»", "›") and any(text[end + 1] in x for x, _ in stack.items):
                end += 1
            else:
                break
        pos = after = end
        while after < total and text[after].isspace():
            after += 1
        if after >= total or (line_ends and "\n" in text[end:after]):
            continue
        if m[0][-1] not in _HARD and after == end and not (m[0][-1] in "!?…" and _CJK_NEXT.match(text, after)):
            continue  # within a number, a name or an address
        held = stack.bracket()
        if held is not None and held > max(out[-1] if out else 0, line) + 1:
            continue  # within brackets that a sentence holds
        if _ends(text, at, m[0], after, line, closed):
            out.append(end)
    if _THAI.search(text):
        for row in re.finditer(r"[^\n]+", text):
            if _THAI.search(row[0]):
                out += [row.start() + b.start() for b in _BLANK.finditer(row[0]) if b.start()]
    first = total - len(text[:total].lstrip())
    return sorted({o for o in out if first < o < total})


def nonspace_ends(text: str | None, line_ends: bool = True) -> list[int]:
    """The same places, as counts of the characters before them that are no white space."""
    ends = boundaries(text, line_ends)
    if not ends:
        return []
    gaps = [(m.start(), m.end() - m.start()) for m in _BLANK.finditer(text)]
    out, k, spaces = [], 0, 0
    for e in ends:
        while k < len(gaps) and gaps[k][0] < e:
            spaces += gaps[k][1]
            k += 1
        out.append(e - spaces)
    return out


def spans(text: str | None, line_ends: bool = True) -> list[tuple[int, int]]:
    """Start and end of each sentence, without the blanks around it."""
    if not text or not text.strip():
        return []
    ends = [*boundaries(text, line_ends), len(text.rstrip())]
    starts = [0, *ends[:-1]]
    return [(s + len(text[s:e]) - len(text[s:e].lstrip()), e) for s, e in zip(starts, ends) if text[s:e].strip()]


def sentence_ends(records: DataFrame, key: str, text: str, line_ends: bool) -> DataFrame:
    """key and end_nonspace of each sentence that another one follows, for every distinct row of a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [nonspace_ends(t, line_ends) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key].repeat([len(e) for e in ends]), "end_nonspace": pd.Series([x for e in ends for x in e], dtype="int32").to_numpy()})

    kind = records.schema[key].dataType.simpleString()
    return records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, end_nonspace int").distinct()


def sentences(records: DataFrame, key: str, text: str, line_ends: bool) -> DataFrame:
    """key, sentence_no (from 1), start, end and sentence: every sentence of every distinct row of a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, s, e, t[s:e]) for k, t in zip(pdf[key], pdf[text]) for i, (s, e) in enumerate(spans(t, line_ends), 1)]
            yield pd.DataFrame(rows, columns=[key, "sentence_no", "start", "end", "sentence"])

    kind = records.schema[key].dataType.simpleString()
    return records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, sentence_no int, start int, end int, sentence string").distinct()
