"""Variant spellings of names, linked by character n-gram cosine and average linkage.

A name is read into parts: titles fall away, words that many names share (kinds of bodies, given names) are recognised
with their abbreviations, short forms and typing errors, what is left identifies the bearer.  Names become vectors of
character n-grams weighted by rarity; a distributed sparse join finds all pairs above a cosine, each name meeting only
names that share one of its rarest n-grams, which loses no pair above it.  An exact check of the parts drops pairs that
merely share part of a name, and average linkage groups the rest: in every round each group finds the group nearest on
average, and pairs that are nearest to each other merge.

Null and blank names are left out; equal names are one; a name without letters stays alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.staging import Stage

#: Cosine from which names are compared, and average from which groups merge.
COSINE, LINKAGE = 0.3, 0.2
#: A word is common if it stands in so many names at least, and in such a share of all; so at most 1 / share a word of a name.
COMMON_NAMES, COMMON_SHARE = 12, 0.003
SIZES = (3,)
#: Added to the names that hold an n-gram, so that those of a typing error do not outweigh the rest.
SMOOTH = 5

# Titles and particles, given names with their short forms.
TITLES = frozenset("the dr prof hon mr mrs ms miss sir dame lady lord rev capt".split())
PARTICLES = frozenset("of and for".split())
NICKNAMES = {
    "bill": "william", "will": "william", "willy": "william", "billy": "william", "liam": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "dick": "richard", "rick": "richard", "rich": "richard", "ricky": "richard", "mike": "michael", "mick": "michael", "mickey": "michael",
    "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "peg": "margaret", "trish": "patricia", "pat": "patricia", "patty": "patricia", "tricia": "patricia",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "katherine", "sue": "susan", "susie": "susan", "josie": "josephine", "jo": "josephine", "becky": "rebecca", "bella": "isabella", "isa": "isabella", "izzy": "isabella",
    "ted": "edward", "ed": "edward", "eddie": "edward", "ned": "edward", "theo": "theodore", "teddy": "theodore", "fritz": "frederick", "fred": "frederick", "freddie": "frederick", "sasha": "alexander", "alex": "alexander", "sandy": "alexander",
    "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "joe": "joseph", "sam": "samuel", "ben": "benjamin", "dan": "daniel", "dave": "david", "steve": "steven", "chris": "christopher", "nick": "nicholas", "andy": "andrew", "matt": "matthew",
    "charlie": "charles", "chuck": "charles", "harry": "henry", "hank": "henry", "larry": "lawrence", "jerry": "gerald", "greg": "gregory", "jeff": "jeffrey", "ken": "kenneth", "ron": "ronald", "don": "donald", "tim": "timothy", "vicky": "victoria", "debbie": "deborah", "barb": "barbara", "cathy": "catherine", "nancy": "anne", "molly": "mary", "polly": "mary", "sally": "sarah", "jenny": "jennifer", "abby": "abigail",
}
GIVEN = frozenset(NICKNAMES.values())


class Parts(NamedTuple):
    """What a name says: the words that identify the bearer, initials, given names, kinds of body, and whether it has a title."""

    core: tuple[str, ...]
    initials: tuple[str, ...]
    given: tuple[str, ...]
    kinds: tuple[str, ...]
    titled: bool


def plain(text: str) -> str:
    """Lower case without accents and with like-sounding spellings made one."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return t.replace("ph", "f").replace("oo", "u").replace("ck", "k").replace("y", "i")


def distance(a: str, b: str, stop: int) -> int:
    """Edits between two strings, neighbouring letters swapped counting once; ``stop`` + 1 for more than ``stop``."""
    if abs(len(a) - len(b)) > stop:
        return stop + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > stop:
            return stop + 1
        two, one = one, row
    return one[-1]


def _within(short: str, word: str) -> bool:
    """Whether an abbreviation begins like the word and its letters run through it."""
    it = iter(word)
    return len(short) < len(word) and short[:1] == word[:1] and all(c in it for c in short)


class Reader:
    """Reads names by the words that many names share: kinds of bodies, commonest first."""

    def __init__(self, kinds: list[str]) -> None:
        self.kinds = [k for at, k in enumerate(kinds) if len(k) >= 4 and not any(_within(k, w) for w in kinds[:at])]
        self.known = frozenset(self.kinds)

    def kind(self, word: str) -> str | None:
        """The kind of body that a word names, abbreviates or misspells."""
        if word in self.known:
            return word
        if 2 <= len(word) <= 6:
            for k in self.kinds:
                if k.startswith(word) and len(word) >= 3:
                    return k
        near = [k for k in self.kinds if len(word) >= 4 and distance(word, k, 2 if len(k) >= 8 else 1) <= (2 if len(k) >= 8 else 1)]
        if near:
            return near[0]
        if 2 <= len(word) <= 6:
            for k in sorted(self.kinds, key=len):
                if _within(word, k) and not re.search(r"[aeiou][^aeiou][aeiou]", word):
                    return k
        return None

    def first_name(self, word: str) -> str | None:
        if word in NICKNAMES:
            return NICKNAMES[word]
        if word in GIVEN:
            return word
        if len(word) >= 5:
            for g in sorted(GIVEN):
                limit = 1 if len(g) < 8 else 2
                if len(g) >= 5 and distance(word, g, limit) <= limit:
                    return g
        return None

    def parts(self, name: str) -> Parts:
        words = [w for w in re.split(r"[^\w]+|_", name.lower()) if w]
        titled = bool(words) and words[0] in TITLES - {"the"}
        words = [w for w in words if w not in TITLES]
        if len(words) > 2 and 2 <= len(words[-1]) <= 6 and words[-1] == "".join(w[0] for w in words[:-1] if w not in PARTICLES):
            words = words[:-1]  # an acronym of the rest
        of = next((i for i, w in enumerate(words) if w in PARTICLES and 0 < i < len(words) - 1), None)
        core, initials, given, kinds = [], [], [], []
        body = any(self.kind(w) for w in words[2:]) or any(w in self.known for w in words)
        lead = 0
        while lead < len(words) and words[lead] in self.known:
            lead += 1
        for i, w in enumerate(words):
            if w in PARTICLES:
                continue
            if len(w) == 1:
                initials.append(w)
            elif w in self.known or (of is not None and i < of and self.kind(w)):
                kinds.append(self.kind(w))
            elif (lead == 0 and of is None and (len(core) + len(initials) >= 2 or (core and len(core[0]) >= 8)) and not given) and (k := self.kind(w)):
                kinds.append(k)
            elif not body and len(words) <= 5 and (i == 0 or i == len(words) - 1 or (i == len(words) - 2 and len(words[-1]) == 1)) and (g := self.first_name(w)):
                given.append(g)
            else:
                core.append(w)
        return Parts(tuple(core), tuple(initials), tuple(given), tuple(dict.fromkeys(kinds)), titled)


def _cores_match(a: Parts, b: Parts) -> bool:
    """Whether the identifying words agree but for typing errors, order, joining and initials."""
    if not a.core or not b.core:
        return False
    if not (a.kinds or b.kinds) or a.initials == b.initials:  # bodies have initials for words only
        for form in (str, plain):
            y = "".join(map(form, b.core))
            if any(distance(o, y, 1) <= (len(y) > 4) for o in {"".join(map(form, a.core)), "".join(map(form, reversed(a.core)))}):
                return True
    for p, q in ((a, b), (b, a)):  # an initial for a word
        if len(p.core) + len(p.initials) == len(q.core) and p.initials and q.core:
            left = list(q.core)
            for w in p.core:
                near = min(left, key=lambda v: distance(plain(w), plain(v), 3), default=None)
                if near is None or distance(plain(w), plain(near), 1) > 1:
                    break
                left.remove(near)
            else:
                if sorted(v[0] for v in left) == sorted(p.initials):
                    return True
    return False


def same_bearer(a: Parts, b: Parts) -> bool:
    """Whether two names can mean one body or person."""
    if (a.given and b.kinds) or (b.given and a.kinds) or (a.titled and b.kinds) or (b.titled and a.kinds):
        return False
    if a.kinds and b.kinds and not (set(a.kinds) <= set(b.kinds) or set(b.kinds) <= set(a.kinds)):
        return False
    if not _cores_match(a, b):
        return False
    if a.kinds or b.kinds:
        if not (a.kinds and b.kinds):  # a name without its kind has all of its words
            bare = b if a.kinds else a
            return len(bare.core) >= 2 and not bare.initials
        return True
    person = a.given or b.given or a.titled or b.titled or a.initials or b.initials
    if not person:
        return True
    if a.given and b.given:
        if a.given[0] != b.given[0]:
            return False
        return not (a.initials and b.initials) or a.initials == b.initials
    full, short = (a, b) if a.given else (b, a)
    if short.initials and full.given:
        letters = [full.given[0][0], *full.initials]
        return letters[0] in short.initials and (len(short.initials) == 1 or not full.initials or sorted(short.initials) == sorted(letters))
    if a.initials and b.initials:
        return a.initials[0] == b.initials[0] and (len(a.initials) == 1 or len(b.initials) == 1 or a.initials == b.initials)
    return True


def name_grams(p: Parts) -> list[str]:
    """Character n-grams of the identifying words."""
    core = "".join(map(plain, p.core)) or "".join(p.initials)
    return sorted({core[i : i + n] for n in SIZES for i in range(max(len(core) - n + 1, 1))}) if core else []


def name_tags(p: Parts) -> list[str]:
    """What two names of one bearer share if both have any: a kind of body, or the letter of a given name."""
    return list(p.kinds) or sorted({g[0] for g in p.given} | set(p.initials))


def common_words(names: DataFrame, name: str) -> list[str]:
    """Kinds of bodies among the common words, commonest first; common words are few by definition."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*TITLES))
    each = names.select(F.posexplode(F.array_distinct(words)).alias("at", "word"))
    least = max(COMMON_NAMES, COMMON_SHARE * names.count())
    counted = each.groupBy("word").agg(F.count("*").alias("n"), F.sum((F.col("at") == 0).cast("int")).alias("first")).where(F.col("n") >= least)
    rows = [r for r in counted.orderBy(F.desc("n"), "word").collect() if r["word"] not in PARTICLES and r["word"] not in NICKNAMES]
    return [r["word"] for r in rows if r["first"] < 0.5 * r["n"] and r["word"] not in GIVEN]


def similar_names(names: DataFrame, name: str, cosine: float = COSINE) -> DataFrame:
    """key_a, key_b and similarity of all pairs of distinct names above a cosine whose parts can mean one bearer."""
    stage = Stage(names.sparkSession, "names")
    keys = stage.cut(names.where(F.col(name).isNotNull() & F.col(name).rlike(r"\p{L}")).select(F.col(name).alias("key")).distinct(), "keys")
    kinds = common_words(keys, "key")

    def gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(kinds)
        for pdf in batches:
            parts = [reader.parts(k) for k in pdf["key"]]
            yield pd.DataFrame({"key": pdf["key"], "grams": [name_grams(p) for p in parts], "tags": [name_tags(p) for p in parts]})

    grams = stage.cut(keys.mapInPandas(gram_rows, "key string, grams array<string>, tags array<string>"), "grams")
    each = grams.select("key", F.explode("grams").alias("gram"))
    rarity = each.groupBy("gram").agg(F.count("*").alias("df"))
    total = float(keys.count())
    weighed = each.join(rarity, "gram").withColumn("w", F.log1p(F.lit(total) / (F.col("df") + SMOOTH)))
    vectors = weighed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("r"), "gram"))).alias("v"))  # the n-grams of one name
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["r"] * x["r"]))
    vectors = stage.cut(vectors.withColumn("norm", norm), "vectors")
    # rarest first, as many as leave a rest shorter than the cosine: two names above it share one of these
    rest = F.transform("v", lambda x, i: F.aggregate(F.slice("v", i + 1, F.size("v")), F.lit(0.0), lambda a, y: a + y["r"] * y["r"]))
    lead = F.filter(F.transform("v", lambda x, i: F.struct(x["gram"].alias("gram"), rest[i].alias("rest"))), lambda x: x["rest"] >= F.pow(F.col("norm") * cosine, F.lit(2)))
    index = stage.cut(vectors.join(grams.select("key", "tags"), "key").select("key", "tags", F.explode(lead["gram"]).alias("gram")), "index")
    # names that both have a tag share one; the few without meet all
    tagged = index.where(F.size("tags") > 0).select("key", "gram", F.explode("tags").alias("tag"))
    alike = tagged.select(F.col("key").alias("key_a"), "gram", "tag").join(tagged.select(F.col("key").alias("key_b"), "gram", "tag"), ["gram", "tag"])
    bare = index.where(F.size("tags") == 0).select(F.col("key").alias("key_a"), "gram").join(index.select(F.col("key").alias("key_b"), "gram", "tags"), "gram").where("size(tags) > 0 or key_a < key_b")
    ordered = bare.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    near = alike.where("key_a < key_b").select("key_a", "key_b").unionByName(ordered).distinct()
    of = lambda side: vectors.select(F.col("key").alias(f"key_{side}"), F.col("v").alias(f"v_{side}"), F.col("norm").alias(f"norm_{side}"))
    both = near.join(of("a"), "key_a").join(of("b"), "key_b")
    dot = F.aggregate(F.array_intersect("v_a", "v_b"), F.lit(0.0), lambda a, x: a + x["r"] * x["r"]) / (F.col("norm_a") * F.col("norm_b"))
    above = both.select("key_a", "key_b", dot.alias("similarity")).where(F.col("similarity") >= cosine)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, read = Reader(kinds), {}
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["key_a"], pdf["key_b"]):
                for k in (a, b):
                    if k not in read:
                        read[k] = reader.parts(k)
                keep.append(same_bearer(read[a], read[b]))
            read.clear()
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    return stage.cut(above.mapInPandas(check, "key_a string, key_b string, similarity double"), "pairs")


def average_linkage(pairs: DataFrame, linkage: float = LINKAGE) -> DataFrame:
    """member and group of every name that a pair holds; pairs that are not listed count as no similarity.

    Groups that are nearest to each other on average merge, all such at once, which gives the same groups as merging one
    by one, since a merge never brings two groups nearer than they were to the nearer part.
    """
    stage = Stage(pairs.sparkSession, "linkage")
    members = pairs.select(F.explode(F.array("key_a", "key_b")).alias("member")).distinct()
    groups = stage.cut(members.select("member", F.col("member").alias("group")), "groups0")
    edges = stage.cut(pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.col("similarity").alias("s"), F.lit(1).cast("long").alias("n_a"), F.lit(1).cast("long").alias("n_b")), "edges0")
    k = 0
    while True:
        mean = edges.withColumn("mean", F.col("s") / (F.col("n_a") * F.col("n_b"))).where(F.col("mean") >= linkage)
        choice = F.struct((-F.col("mean")).alias("m"), F.col("a"), F.col("b"))
        best = mean.select(F.explode(F.array("a", "b")).alias("c"), choice.alias("x")).groupBy("c").agg(F.min("x").alias("x"))
        merged = stage.cut(best.groupBy("x.a", "x.b").agg(F.count("*").alias("n")).where("n = 2").select(F.col("b").alias("old"), F.col("a").alias("new")), f"merged{k}")
        if merged.isEmpty():
            return groups
        named = merged.select(F.col("old").alias("group"), "new")
        groups = stage.cut(groups.join(named, "group", "left").select("member", F.coalesce("new", "group").alias("group")), f"groups{k + 1}")
        size = groups.groupBy("group").agg(F.count("*").alias("n"))
        moved = edges.select("a", "b", "s").join(merged.select(F.col("old").alias("a"), F.col("new").alias("x")), "a", "left").join(merged.select(F.col("old").alias("b"), F.col("new").alias("y")), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "s").where("x <> y")
        summed = moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "s").groupBy("a", "b").agg(F.sum("s").alias("s"))
        sized = summed.join(size.select(F.col("group").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("group").alias("b"), F.col("n").alias("n_b")), "b")
        edges = stage.cut(sized.select("a", "b", "s", "n_a", "n_b"), f"edges{k + 1}")
        stage.drop(f"edges{k}", f"merged{k}", f"groups{k}")
        k += 1


def name_groups(names: DataFrame, name: str) -> DataFrame:
    """name and group of every distinct name; a name without variants is its own group."""
    found = average_linkage(similar_names(names, name))
    keys = names.where(F.col(name).isNotNull() & (F.trim(name) != "")).select(F.col(name).alias("member")).distinct()
    return keys.join(found, "member", "left").select(F.col("member").alias("name"), F.coalesce("group", "member").alias("group"))


def variant_pairs(groups: DataFrame) -> DataFrame:
    """key_a and key_b of all pairs of names of one group."""
    a, b = groups.select("group", F.col("member").alias("key_a")), groups.select("group", F.col("member").alias("key_b"))
    return a.join(b, "group").where("key_a < key_b").select("key_a", "key_b")
