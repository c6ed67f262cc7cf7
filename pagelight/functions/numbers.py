"""Numbers, units and entities in answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found, metric_text, strip, text_of, words

# Word lists, aliases and patterns of the reference results.
ENTITY_STOP = "a an and answer are as at be by company for from has have in inc is it of on or question reported the to was were which with".split()
ENTITY_SUFFIXES = "ag bank co company corp corporation group holdings inc incorporated limited llc ltd plc pty sa".split()
# Units by the names they go by.
UNIT_ALIASES = {
    "%": "%",
    "percent": "%",
    "percentage": "%",
    "pp": "percentage_point",
    "percentage point": "percentage_point",
    "percentage points": "percentage_point",
    "point": "point",
    "points": "point",
    "million": "million",
    "millions": "million",
    "m": "million",
    "billion": "billion",
    "billions": "billion",
    "bn": "billion",
    "thousand": "thousand",
    "thousands": "thousand",
    "crore": "crore",
    "crores": "crore",
    "usd": "usd",
    "dollar": "usd",
    "dollars": "usd",
    "$": "usd",
    "eur": "eur",
    "euro": "eur",
    "euros": "eur",
    "dkk": "dkk",
    "chf": "chf",
    "rmb": "rmb",
    "cny": "rmb",
    "rupee": "inr",
    "rupees": "inr",
    "inr": "inr",
    "kg": "kg",
    "kilogram": "kg",
    "kilograms": "kg",
    "lb": "lbs",
    "lbs": "lbs",
    "pound": "lbs",
    "pounds": "lbs",
    "mtco2e": "mtco2e",
    "mtco2-e": "mtco2e",
    "mtco2": "mtco2",
    "co2e": "co2e",
    "tonne": "tonne",
    "tonnes": "tonne",
    "ton": "ton",
    "tons": "ton",
    "barrel": "barrel",
    "barrels": "barrel",
    "share": "share",
    "shares": "share",
    "store": "store",
    "stores": "store",
    "employee": "employee",
    "employees": "employee",
    "dialogue": "dialogue",
    "dialogues": "dialogue",
    "sentence": "sentence",
    "sentences": "sentence",
    "token": "token",
    "tokens": "token",
    "acre": "acre",
    "acres": "acre",
    "mw": "mw",
    "f1": "f1",
    "bleu": "bleu",
    "auprc": "auprc",
    "wer": "wer",
}
UNIT_PHRASES = {"percentage point": "percentage_point", "million dollars": "usd", "billion dollars": "usd", "thousand shares": "share"}
SYMBOLS = {"$": "usd", "€": "eur", "₹": "inr"}
NUMBER_A = r"[$€£₹]?\d[\d,]*(?:\.\d+)?%?"
NUMBER_SIGNED = r"[$₹€£]?\s*-?\d[\d,]*(?:\.\d+)?\s*%?"
PLAIN_SUFFIXES = "the ltd limited inc incorporated corp corporation co company group plc llc".split()
MENTION_UNITS = r"%|percent|percentage|million|billion|thousand|tokens?|points?|pp|kg|lbs?|mtco2e|co2e|dkk|usd|eur|chf|rmb|crores?|shares?|employees?|documents?|dialogues?|stores?|restaurants?|sentences?|pages?"
MENTION_ALIASES = {"percent": "%", "percentage": "%", "token": "tokens", "point": "points", "lb": "lbs", "crore": "crores", "share": "shares", "employee": "employees", "document": "documents", "dialogue": "dialogues", "store": "stores", "restaurant": "restaurants", "sentence": "sentences", "page": "pages", "$": "usd", "€": "eur", "£": "gbp", "₹": "inr"}


def _number(token: Column, places: int) -> Column:
    """A number token in one form: no commas, currency, trailing point or one trailing %; integers plain."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(token), "[,$€£₹]", ""), r"\.+$", ""), "%$", "")
    t = strip(t)
    value = t.try_cast("double")
    plain = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", value), "0+$", ""), r"\.$", "")
    return F.when(value.isNull(), t).when(value == F.floor(value), F.floor(value).cast("string")).otherwise(plain)


def number_token(token: Column) -> Column:
    """NUM1: six places."""
    return _number(F.lower(token), 6)


def numbers_a(c: Column) -> Column:
    """NUM2: numbers of a text in order, repeats stay."""
    return F.transform(found(c, NUMBER_A), number_token)


def number_token_b(token: Column) -> Column:
    """NUM3: eight places."""
    return _number(token, 8)


def numeric_values(c: Column) -> Column:
    """NUM4: signed values: array<struct<raw, value, normalized, is_integer, is_percentage>>."""

    def one(m: Column) -> Column:
        raw = strip(m)
        normal = number_token_b(raw)
        value = normal.try_cast("double")
        whole = (value == F.floor(value)) & ~F.contains(raw, F.lit("."))
        return F.struct(raw.alias("raw"), value.alias("value"), normal.alias("normalized"), whole.alias("is_integer"), F.contains(raw, F.lit("%")).alias("is_percentage"))

    return F.filter(F.transform(found(c, NUMBER_SIGNED), one), lambda v: v["value"].isNotNull())


def oracle_numbers(c: Column) -> Column:
    """NUM5, of text in its oracle form."""
    return found(c, r"\d+(?:\.\d+)?%?")


def fusion_numbers(c: Column) -> Column:
    """NUM6: set of numbers without commas."""
    return F.array_distinct(F.transform(found(c, r"\d[\d,]*(?:\.\d+)?"), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def mentions(c: Column) -> Column:
    """NUM7: numbers with their unit: array<struct<value, unit, is_integer, is_percentage>>."""
    pattern = rf"(?i)([$€£₹])?\s*(-?\d[\d,]*(?:\.\d+)?)\s*({MENTION_UNITS})?"
    part = lambda k: F.regexp_extract_all(text_of(c), F.lit(pattern), F.lit(k))
    alias = F.create_map(*[F.lit(x) for pair in MENTION_ALIASES.items() for x in pair])

    def one(z: Column) -> Column:
        number = F.replace(z["n"], F.lit(","), F.lit(""))
        unit = F.lower(F.coalesce(F.nullif(z["u"], F.lit("")), F.nullif(z["p"], F.lit("")), F.lit("")))
        unit = F.coalesce(F.try_element_at(alias, unit), unit)
        return F.struct(number.try_cast("double").alias("value"), unit.alias("unit"), (~F.contains(number, F.lit("."))).alias("is_integer"), (unit == "%").alias("is_percentage"))

    zipped = F.arrays_zip(part(1).alias("p"), part(2).alias("n"), part(3).alias("u"))
    return F.filter(F.transform(zipped, one), lambda v: v["value"].isNotNull())


def multiset_exact(generated: Column, expected: Column) -> Column:
    """NUM8: equality of two lists of numbers up to order; null when nothing is expected."""
    return F.when(F.size(expected) > 0, (F.array_sort(generated) == F.array_sort(expected)).cast("double"))


def relaxed_equal(g: Column, e: Column) -> Column:
    """NUM9, of two numeric values."""
    near = F.abs(g["value"] - e["value"])
    return F.when(e["is_percentage"] | g["is_percentage"], near <= 0.1).when(e["is_integer"], g["normalized"] == e["normalized"]).otherwise(near / F.greatest(F.abs(e["value"]), F.lit(1e-12)) <= 0.01)


def relaxed_match(generated: Column, expected: Column) -> Column:
    """NUM10: greedy one-to-one match in the order expected, each taking the first that fits. A fold
    over the expected values that carries the values not yet used, and null once one finds none."""

    def step(left: Column, e: Column) -> Column:
        fits = F.transform(left, lambda g: relaxed_equal(g, e))
        at = F.array_position(fits, True).cast("int")
        return F.when(left.isNull() | (at == 0), None).otherwise(F.concat(F.slice(left, 1, F.greatest(at - 1, F.lit(0))), F.slice(left, at + 1, F.size(left))))

    rest = F.reduce(expected, generated, step)
    return F.when(F.size(expected) > 0, F.when(rest.isNull(), 0.0).otherwise(1.0))


def all_mentioned(generated: Column, expected: Column, relaxed: bool) -> Column:
    """NUM11: every expected mention has some generated one that fits; null when none is expected."""

    def fits(e: Column, g: Column) -> Column:
        near = F.abs(e["value"] - g["value"])
        exact = near <= 1e-9
        if not relaxed:
            return exact
        return F.when(e["is_percentage"] | g["is_percentage"], near <= 0.1).when(e["is_integer"] & g["is_integer"], exact).otherwise(near / F.greatest(F.abs(e["value"]), F.lit(1e-9)) <= 0.01)

    return F.when(F.size(expected) > 0, F.forall(expected, lambda e: F.exists(generated, lambda g: fits(e, g))))


def unit_token(token: Column) -> Column:
    """A unit's canonical name, or null. Most words are none, which a hash set says without a look at the map."""
    t = F.btrim(token, F.lit(" .,:;()[]{}"))
    names = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.when(t.isin(*UNIT_ALIASES), F.try_element_at(names, t))


def units(c: Column, t: Column | None = None) -> Column:
    """UNIT1: set of canonical units of a text, sorted. t: its metric_text, if a column holds it."""
    t = metric_text(c) if t is None else t
    own = F.transform(found(t, r"[a-z%$€₹][a-z0-9%$€₹\-]*"), unit_token)
    marks = [F.when(F.contains(t, F.lit("%")), "%"), *[F.when(F.contains(text_of(c), F.lit(s)), u) for s, u in SYMBOLS.items()], *[F.when(F.contains(t, F.lit(p)), u) for p, u in UNIT_PHRASES.items()]]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(own, F.array(*marks)))))


def subset(part: Column, whole: Column) -> Column:
    """UNIT2: 1 if all expected are there, null when none is expected."""
    return F.when(F.size(part) > 0, (F.size(F.array_except(part, whole)) == 0).cast("double"))


def entity_tokens(c: Column, t: Column | None = None) -> Column:
    """ENT1: set of name tokens, without numbers, stop words, company suffixes and units; sorted. t: as in units."""
    t = F.regexp_replace(metric_text(c) if t is None else t, NUMBER_SIGNED, " ")
    w = F.transform(found(t, r"[a-z][a-z0-9&+\-]*"), lambda x: F.regexp_replace(x, "^-+|-+$", ""))
    w = F.array_except(F.array_distinct(w), words("", *ENTITY_STOP, *ENTITY_SUFFIXES))
    return F.array_sort(F.filter(w, lambda x: unit_token(x).isNull()))


def entity_match(generated: Column, expected: Column) -> Column:
    """ENT2, of two token sets."""
    both, either = F.size(F.array_intersect(expected, generated)), F.size(F.array_union(expected, generated))
    close = (both == F.size(expected)) | (both / F.greatest(either, F.lit(1)) >= 0.8) | (both / F.greatest(F.size(expected), F.lit(1)) >= 0.9)
    return F.when(F.size(expected) > 0, F.when(F.size(generated) == 0, 0.0).otherwise(close.cast("double")))


def entity_plain(c: Column) -> Column:
    """Tokens of the pipeline's entity form, in order."""
    t = F.regexp_replace(F.lower(text_of(c)), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(t, r"\s+"), lambda x: (F.length(x) > 1) & ~x.rlike("^[0-9]+$") & ~F.array_contains(words(*PLAIN_SUFFIXES), x))


def entity_match_plain(generated: Column, expected: Column) -> Column:
    """ENT3: containment either way (an empty generated text is contained), else recall >= 0.8."""
    g, e = entity_plain(generated), entity_plain(expected)
    gs, es = F.array_join(g, " "), F.array_join(e, " ")
    recall = F.size(F.array_intersect(F.array_distinct(e), g)) / F.greatest(F.size(F.array_distinct(e)), F.lit(1))
    return F.when((es != "") & ~es.rlike(r"^[\d\s.%\-]+$"), F.contains(gs, es) | F.contains(es, gs) | (recall >= 0.8))
