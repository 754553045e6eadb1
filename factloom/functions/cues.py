"""Patterns and word lists that decide how a sentence is read."""

from __future__ import annotations

from factloom.functions.vocabulary import LEGAL_FORMS, MAGNITUDES, MONTHS, SYMBOLS, UNIT_WORDS


def either(words) -> str:
    """An alternation, longest first."""
    return "|".join(sorted(words, key=len, reverse=True))


# A quantity is a sign or bracket, a currency, a numeral, a magnitude and a share, in this order.
CURRENCY_SIGNS = r"US\$|U\.S\.\$|Rs\.?|INR|USD|EUR|GBP|CNY|JPY|AED|SGD|[₹$€£¥]"
NUMERAL = r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?"
SHARES = r"per\s*cent|percent|%|bps|basis\s+points"
QUANTITY = (
    rf"(?P<lead>[-−(])?\s*(?<![A-Za-z])(?P<cur>{CURRENCY_SIGNS})?\s*(?<![A-Za-z0-9.])(?P<num>{NUMERAL})\s*"
    rf"(?P<mag>{either(m for m in MAGNITUDES if len(m) > 1)})?\b\s*(?P<pct>{SHARES})?"
)
FOLLOWING_WORDS = r"[ \t]*(?P<unit>[A-Za-z][A-Za-z0-9²³/.-]{0,19}(?:[ \t]+[A-Za-z][A-Za-z0-9²³/.-]{0,19})?)?"
CLOSING = r"(?P<close>\s*\))?"

# Verbs between a metric and its value.
LINK_VERBS = """
stood stands standing was were is are be been being remained remains reached reaching touched touching totaled totalled amounted aggregated aggregating rose
rising grew grown grow grows growing increased increasing declined declining decreased decreasing fell falling dropped dropping moderated moderating eased
easing softened softening improved improving expanded expanding contracted contracting averaged averaging recorded recording reported reporting registered
registering estimated projected forecast forecasted expected placed contained clocked posted posting accelerated decelerated surged jumped slipped widened
narrowed crossed crossing hit achieved delivered generated stayed held printed settled closed ended accounted accounting represented representing comprised
comprising confirms confirmed verifies verified states stated notes noted finds found shows showed indicates indicated assesses assessed puts cites
constituted constituting contributed contributing numbered numbering
""".split()
# Verbs of saying, after which the metric stands.
SAYING_VERBS = """
report reports reported reporting record records recorded register registers registered confirm confirms confirmed verifies verified state states stated note
notes noted find finds found show shows showed indicate indicates indicated assesses assessed cite cites cited estimate estimates estimated project projects
projected forecast forecasts announce announces announced disclose discloses disclosed publishes published puts placed
""".split()
# Prepositions that link a metric to its value where no verb does.
LINK_WORDS = "at of to by from worth around about approximately nearly over above below under versus vs".split()
# Verb forms that end no metric's name, beside the verbs above.
TAIL_VERBS = "driven led aided supported helped boosted weighed dragged compared including excluding being having".split()
# Words that open a clause.
OPENERS = "although though while whereas however moreover meanwhile despite notwithstanding because if when unless thus hence therefore furthermore nonetheless nevertheless".split()
# Words after a comma that begin a claim about another quantity.
TURNS = r"which|while|and|or|of\s+which|below|above|compared|against|versus|vs|up|down|including|excluding|with|from|led|driven|but|higher|lower|greater|smaller|better|worse|broadly|roughly"
# Words between the claims of one sentence.
CLAUSES = r"\b(?:from|against|versus|vs\.?|compared\s+(?:with|to)|as\s+against|up\s+from|down\s+from|while|whereas|whilst|below\s+the|above\s+the)\b"

# Expressions of time.
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
TIME = (
    rf"(?:as\s+(?:at|on|of)\s+)?(?:Q[1-4]\s*[:\-]?\s*(?:FY)?\s*\d{{2,4}}(?:\s*[-/]\s*\d{{2,4}})?|(?:end[\s-]*(?:of\s+)?)?(?:{_MONTH})[\s,-]+\d{{4}}|\d{{1,2}}\s+(?:{_MONTH})[\s,]+\d{{4}}"
    rf"|(?:{_MONTH})\s+\d{{1,2}},\s*\d{{4}}|FY\s?\d{{4}}\s*[-/]\s*\d{{2,4}}|FY\s?\d{{2,4}}|(?:19|20)\d{{2}}\s*[-–/]\s*\d{{2,4}}|(?:19|20)\d{{2}})"
)

# Reporting bases in the order in which they are looked for.
QUALIFIERS = [
    (r"second\s+advance\s+estimate|2nd\s+advance\s+estimate|\bSAE\b", "Second Advance Estimate"), (r"first\s+advance\s+estimate|1st\s+advance\s+estimate|\bFAE\b", "First Advance Estimate"), (r"advance\s+estimate", "Advance Estimate"),
    (r"revised\s+estimate|\(RE\)|\[RE\]", "Revised Estimate"), (r"budget\s+estimate|\(BE\)|\[BE\]", "Budget Estimate"), (r"provisional", "Provisional"), (r"preliminary", "Preliminary"), (r"restated", "Restated"), (r"pro[\s-]?forma", "Pro Forma"),
    (r"seasonally\s+adjust\w*", "Seasonally Adjusted"), (r"annualis\w+|annualiz\w+", "Annualised"), (r"constant\s+currency", "Constant Currency"), (r"like[\s-]for[\s-]like", "Like for Like"), (r"trailing\s+twelve\s+months|\bTTM\b", "Trailing Twelve Months"),
    (r"\bunaudited\b", "Unaudited"), (r"\baudited\b", "Audited"), (r"\bprojected\b|\bforecast\w*\b", "Projection"), (r"\bestimated\b|\bestimates?\b", "Estimate"),
]
# Scopes in the order in which they are looked for.
SCOPES = [
    (r"\bexcluding\b|\bexclusive\s+of\b|\bnet\s+of\b|\bex[- ](?=[A-Z])", "Excluding items"), (r"\bincluding\b|\binclusive\s+of\b", "Including items"), (r"\bconsolidated\b", "Consolidated"), (r"\bstandalone\b", "Standalone"), (r"\bsegment(?:al)?\b", "Segment"),
    (r"\badjusted\b", "Adjusted"), (r"\bgeneral\s+government\b", "General Government"), (r"\bcentral\s+government\b|\bunion\s+government\b", "Central Government"), (r"\bstate\s+government", "State Governments"), (r"\bper\s+capita\b", "Per Capita"),
    (r"\brural\b", "Rural"), (r"\burban\b", "Urban"), (r"\bdomestic\b", "Domestic"), (r"\bglobal\b|\bworldwide\b", "Global"),
]

# Names, possessives, definitions of acronyms, section numbers.
NAME = rf"\b[A-Z][A-Za-z&.\-']*(?:[ \t]+(?:of|for|and|the|und|de|van|von)[ \t]+[A-Z][A-Za-z&.\-']*|[ \t]+[A-Z][A-Za-z&.\-']*){{0,5}}(?:[ \t]+(?:{either(LEGAL_FORMS)})\b\.?)?"
POSSESSIVE = r"\b((?:[A-Z][A-Za-z&.\-]+\s*){1,4})[‘’']s\b"
ACRONYM = r"\b((?:[A-Z][A-Za-z&.\-]+\s+){1,5})\(([A-Z]{2,6})\)"
SECTION = r"(?i)^\s*(?:[IVXLCDM]+|\d{1,2})(?:\.\d{1,3})+\.?\s+"
CONTENTS = r"(?:table\s+of\s+contents|contents|index(?:\s+of\s+[\w\s]+)?|list\s+of\s+(?:tables|figures|boxes|charts|illustrations|exhibits|appendices|abbreviations)|appendix\s+tables|brief\s+contents)\s*"
TITLE_OF = rf"\b([A-Za-z]+)\s+(?:of|on|into|about|for)\s+({NAME})"
# Words that measure and name no metric; parts of a document; words that name a document or nothing; determiners; notes.
MEASURES = frozenset(MAGNITUDES) | frozenset(SYMBOLS) | frozenset(UNIT_WORDS) | frozenset("rs inr usd eur gbp cent percent percentage bps basis point points rupee rupees dollar dollars".split())
PARTS = frozenset("table figure fig chart graph exhibit box annex annexure appendix chapter section part note notes page source sources panel schedule statement para paragraph item column row".split())
NO_NAMES = frozenset("""
the this that these those it in on at for and or but however although while during as table figure chart annex annexure appendix chapter section note notes page
source sources total january february march april may june july august september october november december report annual quarterly statement statements results
prospectus presentation survey review consultation article excerpt earnings filing deck update overview summary memorandum circular bulletin brief briefing
paper study analysis outlook edition audit assessment evaluation inspection opinion independent draft final interim volume disclosure disclosures highlights
""".split())
DETERMINERS = frozenset("the a an our its their this that his her your these those".split())
LEADING = frozenset("the a an in of and for by to at from with through via under about".split())
NOTES = frozenset("note notes disclaimer source sources footnote annexure appendix".split())
COMPARED = frozenset("yoy qoq mom y-o-y q-o-q m-o-m".split())
# Abbreviations that end no sentence.
SHORT_FORMS = frozenset("rs no nos fig vs etc inc ltd plc co corp jan feb mar apr jun jul aug sep sept oct nov dec approx est dept govt mr mrs ms dr".split())
MONTH_NAMES = frozenset(MONTHS)
