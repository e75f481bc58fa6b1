"""What a question asks for, decided before retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import WS


def contains_any(c: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in phrases), F.lit(False))


def detect_intent(q: Column, keywords=None, default: str = fv.DEFAULT_INTENT) -> Column:
    """The first intent, in declaration order, one of whose phrases occurs in `q`."""
    keywords = fv.INTENT_KEYWORDS if keywords is None else keywords
    branches = [F.when(contains_any(q, phrases), F.lit(intent)) for intent, phrases in keywords.items()]
    return F.coalesce(*branches, F.lit(default))


def is_request(q: Column, phrases=None, patterns=None) -> Column:
    """The text describes a wanted job instead of asking about a known one."""
    phrases = fv.REQUEST_PHRASES if phrases is None else phrases
    patterns = fv.REQUEST_PATTERNS if patterns is None else patterns
    return reduce(lambda a, b: a | b, (q.rlike(p) for p in patterns), contains_any(q, phrases))


def question_intent(q: Column, keywords=None, question_words=fv.QUESTION_WORDS,
                    marks=fv.QUESTION_MARKS, max_words: int = fv.BARE_NAME_MAX_WORDS) -> Column:
    """`detect_intent`, with a short bare name read as a request for a description."""
    found = detect_intent(q, keywords)
    words = F.array_distinct(F.array_remove(F.split(q, f"(?U)[{WS}]+"), ""))
    asks = contains_any(q, marks) | F.arrays_overlap(
        words, F.array(*[F.lit(w) for w in question_words]))
    bare = (found == fv.DEFAULT_INTENT) & (F.size(words) <= max_words) & ~F.coalesce(asks, F.lit(False))
    return F.when(bare, F.lit(fv.BARE_NAME_INTENT)).otherwise(found)


def intent_fields(intent: Column, fields=None) -> Column:
    """The columns that answer an intent; unknown intents get the general set."""
    fields = fv.INTENT_FIELDS if fields is None else fields
    as_array = {k: F.array(*[F.lit(f) for f in v]) for k, v in fields.items()}
    lookup = F.create_map(*[x for k, v in as_array.items() for x in (F.lit(k), v)])
    return F.coalesce(F.try_element_at(lookup, intent), as_array[fv.DEFAULT_INTENT])


def is_combination(q: Column, phrases=fv.COMBINATION_PHRASES) -> Column:
    """The question names a combination of two roles outright."""
    return contains_any(q, phrases)
