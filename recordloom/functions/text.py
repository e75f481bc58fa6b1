"""Text functions as Column expressions (no Python in the row path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv

# The members of `fixed_values.WHITESPACE` as the JVM tests them fastest; needs `(?U)`.
WS = "\\s\\x1c-\\x1f"
_ESCAPED_BAR = "\\|"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def strip(c: Column, extra: str = "") -> Column:
    """Trim every Unicode blank (plus the characters of `extra`, in regex class syntax)."""
    return F.regexp_replace(c, f"(?U)^[{WS}{extra}]+|[{WS}{extra}]+$", "")


def squeeze(c: Column) -> Column:
    """Collapse runs of blanks to one space and trim."""
    return F.trim(F.regexp_replace(c, f"(?U)[{WS}]+", " "))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and blank-only cells."""
    return F.coalesce(~c.rlike(f"(?U)[^{WS}]"), F.lit(True))


def normalize(c: Column, normalizer=None) -> Column:
    """NULL becomes empty, Arabic letter forms become Persian, blanks are collapsed.

    `normalizer` is the optional language normaliser (a vectorised UDF, off by default).
    """
    out = squeeze(F.translate(F.coalesce(c.cast("string"), F.lit("")),
                              fv.ARABIC_LETTERS, fv.PERSIAN_LETTERS))
    return out if normalizer is None else F.trim(normalizer(out))


def strip_markdown(c: Column) -> Column:
    """unwrap bold, emphasis and code marks, drop heading marks wherever they stand."""
    for mark in (r"\*\*(.*?)\*\*", r"\*(.*?)\*", r"`(.*?)`"):
        c = F.regexp_replace(c, f"(?d){mark}", "$1")
    return strip(F.regexp_replace(c, f"(?U)#{{1,6}}[{WS}]?", ""))


def parse_object(c: Column) -> Column:
    """the JSON object spanning the first `{` to the last `}` as a string map, else NULL.

    The span is parsed as the only element of an array, so that a second value behind
    the first makes it invalid.  Nested values stay JSON text.
    """
    options = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
    as_list = lambda span: F.from_json(F.concat(F.lit("["), span, F.lit("]")), "array<map<string,string>>", options)
    only = lambda parsed: F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))
    return let(as_list(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))), only)


def object_value(obj: Column, key: Column | str) -> Column:
    """The value under `key`; of repeated keys the last one counts."""
    entries = F.filter(F.map_entries(obj), lambda e: e["key"] == key)
    return F.try_element_at(entries, F.lit(-1))["value"]


def match_key(c: Column) -> Column:
    """the key on which titles are compared across datasets."""
    folded = F.translate(c.cast("string"), fv.ARABIC_LETTERS + "|",
                         fv.PERSIAN_LETTERS + fv.PROSE_COMMA)
    return squeeze(F.replace(folded, F.lit(fv.PROSE_COMMA), F.lit(f" {fv.PROSE_COMMA} ")))


def bars_to_commas(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)[{WS}]*{_ESCAPED_BAR}[{WS}]*", f"{fv.PROSE_COMMA} ")


def repair_prose(c: Column) -> Column:
    """list bars in prose become commas; cells without a bar are left alone."""
    return F.when(c.contains("|"), strip(bars_to_commas(c))).otherwise(c)


def unify_separators(c: Column) -> Column:
    """commas of a list cell become bars, repeated bars collapse, ends are trimmed."""
    spaced = F.regexp_replace(c, f"(?U)[{WS}]*[،,|][{WS}]*", fv.LIST_SEPARATOR)
    single = F.regexp_replace(spaced, f"(?U)({_ESCAPED_BAR}[{WS}]*)+", "| ")
    return F.regexp_replace(single, r"^[ |]+|[ |]+$", "")


def clean_item(c: Column) -> Column:
    """F16: one list item, with bars turned into slashes and blanks collapsed."""
    return squeeze(F.translate(c, "|", "/"))


def list_items(c: Column) -> Column:
    """The items of a list cell: split on bars, trimmed, placeholders dropped."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), _ESCAPED_BAR), lambda p: strip(p))
    return F.filter(pieces, lambda p: ~p.isin(*fv.BLANK_CELLS))


def cell_items(field: str, c: Column, prose_whole: bool = True) -> Column:
    """items of one cell.  Prose is one item when matched, none when displayed."""
    if field not in fv.PROSE_COLUMNS:
        return list_items(c)
    empty = F.array().cast("array<string>")
    if not prose_whole:
        return empty
    whole = strip(F.coalesce(c, F.lit("")))
    return F.when(whole.isin(*fv.BLANK_CELLS), empty).otherwise(F.array(whole))


def title_tokens(c: Column, stop_words=fv.QUESTION_WORDS, min_chars: int = fv.TOKEN_MIN) -> Column:
    """content words of a question or title, case kept, question words removed."""
    words = F.split(c, f"(?U)[{WS}{fv.TITLE_SEPARATORS}]+")
    return F.array_distinct(F.filter(
        words, lambda w: (F.char_length(w) >= min_chars) & ~w.isin(*stop_words)))


def item_tokens(c: Column, min_chars: int = fv.TOKEN_MIN) -> Column:
    """lower-cased content words of one item, each once."""
    words = F.split(F.lower(c), f"(?U)[{WS}{fv.ITEM_SEPARATORS}]+")
    return F.array_distinct(F.filter(words, lambda w: F.char_length(w) >= min_chars))


def lexical_tokens(c: Column) -> Column:
    """Lower-cased blank-separated tokens, repeats kept (the BM25 view of a text)."""
    return F.array_remove(F.split(F.lower(c), f"(?U)[{WS}]+"), "")


def fold_digits_latin(c: Column) -> Column:
    """Persian and Arabic-Indic digits become ASCII digits."""
    return F.translate(c, fv.PERSIAN_DIGITS + fv.ARABIC_DIGITS, fv.LATIN_DIGITS * 2)


def fold_digits_persian(c: Column) -> Column:
    """ASCII digits become Persian digits."""
    return F.translate(c.cast("string"), fv.LATIN_DIGITS, fv.PERSIAN_DIGITS)


def drawable(c: Column, keep: str) -> Column:
    """drop characters outside the regex class body `keep`, then trim each line.

    Line feeds, tabs, blanks and the joining controls always stay.
    """
    kept = F.regexp_replace(c, f"[^{fv.ALWAYS_PRINTABLE}{keep}]", "")
    return F.array_join(F.transform(F.split(kept, "\n"), lambda line: strip(line)), "\n")
