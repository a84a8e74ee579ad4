"""Normalisers of free text, identifiers and units as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that a spreadsheet writes on errors.
ERROR_TOKENS = ["#NAME?", "#REF!", "#VALUE!", "#DIV/0!", "#N/A"]
#: Whole words and what they are written as, the longest first.
REPLACEMENTS = [
    ("ss304", "stainless steel 304"), ("ss316", "stainless steel 316"), ("galv", "galvanised"), ("s s", "stainless steel"),
    ("pcs", "piece"), ("nos", "piece"), ("pkt", "packet"), ("ctn", "carton"), ("ss", "stainless steel"), ("zp", "zinc plated"), ("pc", "piece"), ("kg", "kilogram"),
]
#: Words of an order that name nothing.
ORDER_WORDS = ["please", "pls", "send", "need", "urgent", "item", "order", "kindly"]
#: Phrases of lines without a product.
NON_ITEM_PHRASES = [
    "same as last month", "subtotal", "total only", "thanks bro", "deliver by", "po attached", "quote best price", "confirm stock",
    "opening balance", "delivery fee", "misc charge",
]
#: Short lines without a product.
NON_ITEM_LINES = ["subtotal", "total", "thanks"]
#: Unit spellings (normalised) and the unit they mean.
UNIT_NAMES = {
    "ea": "piece", "each": "piece", "pc": "piece", "pcs": "piece", "piece": "piece", "pieces": "piece", "unit": "piece", "units": "piece",
    "nos": "piece", "no": "piece", "pkt": "packet", "packet": "packet", "pack": "packet", "box": "box", "ctn": "carton", "carton": "carton",
    "kg": "kilogram", "kgs": "kilogram", "kilogram": "kilogram", "roll": "roll", "length": "length",
}
#: Units that make a token of their own with the number before them.
SIZE_UNITS = ["mm", "cm", "m", "kilogram", "g", "ml", "l"]
#: Openings of an order that the audit removes, in this order.
AUDIT_PREFIXES = ["please send ", "pls send ", "urgent ", "need ", "item ", "1 "]


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters whose compatibility decomposition has one ASCII character, and common ones with several; made by rule."""
    single, several = {}, []
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        to = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(to) == 1:
            single[chr(code)] = to
        elif len(to) > 1 and (code < 0x100 or code in (0x2026, 0x2116, 0x2122) or code >= 0xFB00):
            several.append((chr(code), to))
    return "".join(single), "".join(single.values()), several


def ascii_fold(col: Column) -> Column:
    """Compatibility decomposition without what is not ASCII; null as ''."""
    source, target, several = _folding()
    out = F.coalesce(col, F.lit(""))
    for ch, to in several:
        out = F.replace(out, F.lit(ch), F.lit(to))
    return F.regexp_replace(F.translate(out, source, target), r"[^\x00-\x7F]", "")


def tokens_of(col: Column) -> Column:
    """Runs of letters and numbers (with decimals) of a text, in order."""
    lowered = F.regexp_replace(F.lower(ascii_fold(col)), r"(?<=[a-z0-9])x(?=[0-9])", " x ")
    return F.regexp_extract_all(lowered, F.lit(r"[a-z]+|\d+(?:\.\d+)?"), 0)


def normalise_text(col: Column) -> Column:
    """Stable lower-case form: ASCII, dimensions apart, trade abbreviations written out."""
    joined = F.array_join(tokens_of(col), " ")
    for word, to in REPLACEMENTS:
        joined = F.regexp_replace(joined, rf"\b{word}\b", to)
    return joined


def normalise_order_text(col: Column) -> Column:
    words = F.split(normalise_text(col), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(ORDER_WORDS) & (w != "")), " ")


def normalise_identifier(col: Column) -> Column:
    """Lower-case letters and digits of an identifier; null as ''."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]", "")


def normalise_unit(col: Column) -> Column:
    text = normalise_text(col)
    names = F.create_map(*(F.lit(x) for pair in UNIT_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, text), text)


def token_set(normalised: Column) -> Column:
    """Distinct words of a normalised text, sorted; empty for an empty text."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalised, " "), lambda w: w != "")))


def numeric_tokens(normalised: Column) -> Column:
    """Words with a digit, and such words joined to a size unit that follows; distinct and sorted."""
    words = F.split(normalised, " ")
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("next")))
    numbers = F.filter(at, lambda x: x["w"].rlike("[0-9]"))
    made = F.transform(numbers, lambda x: F.when(x["next"].isin(SIZE_UNITS), F.array(x["w"], F.concat(x["w"], x["next"]))).otherwise(F.array(x["w"])))
    return F.array_sort(F.array_distinct(F.flatten(made)))


def overlap(left: Column, right: Column) -> Column:
    """Share of the left set that is in the right; 0 if either is empty."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / F.size(left)).otherwise(0.0)


def is_non_item(normalised: Column) -> Column:
    """Empty, or a request, summary or courtesy without a product."""
    return (normalised == "") | normalised.rlike("|".join(NON_ITEM_PHRASES)) | normalised.isin(NON_ITEM_LINES)


def has_error_token(col: Column) -> Column:
    tests = [F.contains(F.upper(F.coalesce(col, F.lit(""))), F.lit(t)) for t in ERROR_TOKENS]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def audit_text(col: Column) -> Column:
    """The audit's own form: words and digits only, one leading opening removed."""
    text = F.array_join(F.regexp_extract_all(F.lower(ascii_fold(col)), F.lit("[a-z0-9]+"), 0), " ")
    return F.regexp_replace(text, f"^(?:{'|'.join(AUDIT_PREFIXES)})", "")


def segment(raw: Column, normalised: Column, has_identifier: Column, unit_text: Column, ambiguous: Column) -> Column:
    """One segment per line, by what can be seen when it is matched; the first that holds."""
    words = F.filter(F.split(normalised, " "), lambda w: w != "")
    packs = F.array(*(F.lit(w) for w in ("box", "carton", "packet", "pack", "outer", "dozen")))
    return (
        F.when(has_identifier, "identifier_present")
        .when(is_non_item(normalised), "non_item_like")
        .when((F.trim(F.coalesce(unit_text, F.lit(""))) != "") | F.arrays_overlap(words, packs), "pack_or_uom")
        .when(F.size(words) <= 3, "sparse_text")
        .when(ambiguous, "ambiguous_candidates")
        .when(F.coalesce(raw, F.lit("")).rlike(r"[/#_]|  "), "noisy_text")
        .otherwise("plain_text")
    )
