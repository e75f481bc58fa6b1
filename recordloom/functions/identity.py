"""Keys, digests, contact fields and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from .text import fold_digits_latin, WS, let, strip

UNIT_MARK, GROUP_MARK = "\x1f", "\x1e"


def text_key(text: Column, model: str = fv.DEFAULT_MODEL) -> Column:
    """content key of one text under one encoder."""
    return F.sha2(F.concat(F.lit(model + UNIT_MARK), text), 256)


def corpus_digest(df: DataFrame, group: str, text: str, model: str = fv.DEFAULT_MODEL) -> DataFrame:
    """F5 at scale: an order-free digest of all texts, one row.

    Per group the count and the sum of 60-bit text hashes are kept (map-side combined),
    so no text travels and no row order is needed.  It answers the same question as the
    ordered digest, "is this the same corpus", with a different value.
    """
    sixty_bits = F.conv(F.substring(F.sha2(F.col(text), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    per_group = df.groupBy(F.col(group).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(sixty_bits).alias("h"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("grp", "n", "h"))),
                        lambda s: F.concat_ws(":", s["grp"], s["n"], s["h"]))
    return per_group.agg(
        F.sum("n").alias("n_texts"),
        F.substring(F.sha2(F.concat_ws(UNIT_MARK, F.lit(model), F.array_join(parts, GROUP_MARK)),
                           256), 1, 12).alias("digest"))


def ordered_digest(df: DataFrame, group: str, seq: str, text: str, model: str = fv.DEFAULT_MODEL) -> str:
    """12 hex digits that stand for the texts and their positions, for tables of any size.

    Every row is hashed with its group and position; counts and sums of the hashes per group
    are all that meets.  It tells the same corpora apart as a hash over the texts in order
    does, but has another value: an archive's name has to be made by this function when the
    archive is converted to a table.
    """
    placed = df.select(F.col(group), F.to_json(F.struct(
        F.col(group).alias("g"), F.col(seq).alias("s"), F.sha2(F.col(text), 256).alias("t"))).alias("placed"))
    return corpus_digest(placed, group, "placed", model).first()["digest"]


def blank_to_null(c: Column) -> Column:
    """F8: trimmed text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def phone(c: Column) -> Column:
    """struct(value, is_valid); NULL is valid and means "none"."""
    digits = lambda v: F.char_length(F.regexp_replace(v, "[^0-9]", ""))
    return _checked(fold_digits_latin(blank_to_null(c)),
                    lambda v: v.rlike(fv.PHONE_PATTERN) & (digits(v) >= fv.PHONE_MIN_DIGITS))


def email(c: Column) -> Column:
    """struct(value, is_valid); the value is lower-cased."""
    return _checked(F.lower(blank_to_null(c)), lambda v: v.rlike("(?U)" + fv.EMAIL_PATTERN.format(ws=WS)))


def _checked(value: Column, test) -> Column:
    def body(v):
        valid = v.isNull() | test(v)
        return F.struct(F.when(valid, v).alias("value"), valid.alias("is_valid"))
    return let(value, body)


def full_name(first: Column, last: Column) -> Column:
    """the non-empty halves joined by a space, NULL when there is neither."""
    empty = F.lit("")
    return F.nullif(F.concat_ws(" ", F.nullif(first, empty), F.nullif(last, empty)), empty)


def display_name(first: Column, last: Column, username: Column) -> Column:
    """the full name, else the user name."""
    return F.coalesce(full_name(first, last), username)


def client_source(forwarded: Column, host: Column, trust_forwarded: bool) -> Column:
    """F32: the last hop of a trusted forwarding list, else the peer, else `unknown`."""
    peer = F.coalesce(host, F.lit("unknown"))
    if not trust_forwarded:
        return peer
    last_hop = strip(F.element_at(F.split(forwarded, ","), -1))
    return F.when(F.coalesce(forwarded, F.lit("")) != "", last_hop).otherwise(peer)


def login_key(source: Column, username: Column) -> Column:
    """the key a login budget is kept under."""
    return F.concat_ws("|", source, F.lower(strip(username)))
