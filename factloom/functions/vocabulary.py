"""Word lists and tables that results depend on."""

from __future__ import annotations


def _pairs(text: str) -> dict[str, str]:
    """``value: key key ...`` lines as a mapping from key to value."""
    out = {}
    for line in text.strip().splitlines():
        value, keys = line.split(":", 1)
        out |= {k: value.strip() for k in keys.split()}
    return out


# Magnitude words and their factors.
MAGNITUDES = {
    w: f
    for f, ws in (
        (1e2, "hundred"), (1e3, "k thousand"), (1e5, "lakh lakhs lac lacs"), (1e6, "mn m million millions"), (1e7, "cr crore crores"),
        (1e9, "bn b billion billions"), (1e12, "tn trillion trillions"),
    )
    for w in ws.split()
}

# Currency signs and codes in the order in which they are looked for.
CURRENCIES = [
    ("$", "USD"), ("us$", "USD"), ("usd", "USD"), ("u.s.$", "USD"), ("₹", "INR"), ("rs", "INR"), ("rs.", "INR"), ("inr", "INR"), ("€", "EUR"), ("eur", "EUR"),
    ("£", "GBP"), ("gbp", "GBP"), ("¥", "JPY"), ("jpy", "JPY"), ("aed", "AED"), ("sgd", "SGD"), ("cny", "CNY"), ("rmb", "CNY"),
]

# Families of units that are written as such.
FAMILIES = _pairs("""
currency: USD INR EUR GBP JPY AED SGD CNY
ratio: % bps x
duration: days months years
""") | {"% of GDP": "ratio_of_gdp"}

# Unit symbols, in lower case, by family.
SYMBOLS = _pairs("""
energy: wh kwh mwh gwh twh btu kcal
power: kw mw gw tw kva mva
distance: km cm mm nm mi ft
area: sqft sqm ha acre km2
volume: ml cl bbl gal cbm
mass: kg mg kt mt lb lbs oz
data: kb mb gb tb pb
frequency: hz khz mhz ghz
pressure: psi bar mmhg
sound: db
concentration: ppm
""")

# Units written out, by family.
UNIT_WORDS = _pairs("""
mass: tonne tonnes ton tons gram grams kilogram kilograms
volume: litre litres liter liters
distance: metre metres meter meters kilometre kilometres kilometer kilometers mile miles
area: acre acres hectare hectares
duration: day days week weeks month months year years hour hours minute minutes second seconds
""")

# Words that may follow a number and are not what it counts.
NO_UNITS = """
and or but than then versus vs compared against respectively each more less fewer higher lower above below over under around about approximately
nearly almost times point points further additional new other such same different including excluding namely was were is are be been being has have
had will would may might can could should must reported recorded registered estimated projected expected stood stands reached totalled totaled
amounted rose grew fell declined increased decreased remained
""".split()

# Endings of names of bodies.
LEGAL_FORMS = "ltd limited plc inc incorporated corp corporation co company llp llc pvt private gmbh sa nv ag holdings group".split()

# Months by their names and short names.
MONTHS = {n: i for i, ns in enumerate("january jan|february feb|march mar|april apr|may|june jun|july jul|august aug|september sep sept|october oct|november nov|december dec".split("|"), 1) for n in ns.split()}

# Words that name no metric.
STOPWORDS = """
a an the of in on at to for by with from and or as is was were are be been it its this that these those which while during over under than then also
about into per such same other our their his her your we they he she there here however although though but not no more most less least some any all
both each further moreover meanwhile despite amid amidst against between within including included well very up down out off again only own so too s
""".split()
