"""Item-by-item coverage of capability profiles by records.

Profiles come as rows `(profile_id, field, pos, item)`; records as a table with one list
cell per field.  A profile item is covered by a record's field when

* every word of the item meets some word of the field, or
* some item of the field has words, and every one of them meets a word of the item,

where two words meet when either is a prefix of the other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as fv
from ..functions.text import cell_items, item_tokens, normalize
from ..session import stored
from .shuffle import BROADCAST_BYTES, broadcast_if_small

WHOLE, PREFIX = 0, 1
#: Cells of the tables that one batch is covered with, and bytes of what is kept of the words met.
_CELLS, _KNOWN_BYTES = 1 << 22, 1 << 26
_SEPARATORS = f"[{fv.WHITESPACE}{fv.ITEM_SEPARATORS}]+"


def clean_profiles(profiles: DataFrame, fields=fv.PROFILE_FIELDS) -> DataFrame:
    """known fields only, items normalised, blanks dropped, repeats keep their first form."""
    known = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    item = normalize(F.col("item"))
    rows = (profiles.filter(F.col("field").isin(*fields))
            .select("profile_id", "field", known.cast("int").alias("field_no"), "pos", item.alias("item"))
            .filter(~F.col("item").isin(*fv.BLANK_CELLS)))
    return (rows.groupBy("profile_id", "field", "field_no", F.lower("item").alias("_form"))
            .agg(F.min_by("item", "pos").alias("item"), F.min("pos").alias("pos")).drop("_form"))


def profile_fields(profiles: DataFrame) -> DataFrame:
    """Cleaned profiles back as `(profile_id, fields)`: array of struct(key, items) in field order."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda r: r["item"])
    per_field = profiles.groupBy("profile_id", "field_no", "field").agg(items.alias("items"))
    ordered = F.sort_array(F.collect_list(F.struct("field_no", F.col("field").alias("key"), "items")))
    return per_field.groupBy("profile_id").agg(
        F.transform(ordered, lambda r: F.struct(r["key"].alias("key"), r["items"].alias("items"))
                    ).alias("fields"))


def _item_words(field: str, cell: Column) -> Column:
    words = F.transform(cell_items(field, cell), lambda i: item_tokens(i))
    return F.filter(words, lambda w: F.size(w) > 0)


def record_cells(records: DataFrame, doc_id: str, fields=fv.PROFILE_FIELDS) -> DataFrame:
    """`(doc_id, field, item_words)`: the token sets of the items of each non-empty field."""
    def cell(field):
        return F.struct(F.lit(field).alias("field"), _item_words(field, F.col(field)).alias("item_words"))
    present = [f for f in fields if f in records.columns]
    rows = records.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(*[cell(f) for f in present])).alias("c"))
    return rows.select("doc_id", "c.field", "c.item_words").filter(F.size("item_words") > 0)


def _leading(word: Column, longest: Column, shortest: int = fv.TOKEN_MIN) -> Column:
    """Every prefix of `word` from `shortest` up to `longest` characters."""
    end = F.least(F.char_length(word), longest)
    return F.when(end >= shortest, F.transform(F.sequence(F.lit(shortest), end),
                                               lambda n: F.substring(word, F.lit(1), n)))


class ProfileIndex:
    """The distinct items of a profile table, prepared for probing by record words.

    `forms` holds one row per distinct `(field, words)`; profiles sharing an item share
    the row.  `probes` lists what a record word may equal: a profile word itself (met by
    any record word it is a prefix of) or one of its proper prefixes (met by the record
    word that is exactly it).  `kind` tells them apart and is part of the key, which turns
    the two-way prefix test into one equi-join whose every candidate is a match.
    """

    def __init__(self, profiles: DataFrame, words: Column | None = None):
        default = words is None
        words = item_tokens(F.col("item")) if default else words
        self.items = (profiles.withColumn("words", F.sort_array(words))
                      .withColumn("form", F.array_join("words", " ")))
        # One look at the items bounds every table made of them: a word of n characters
        # has at most n prefixes.
        length = lambda w: F.char_length(w)
        squares = F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + 4 * length(w) * length(w) + 64)
        seen = self.items.agg(
            F.max(F.array_max(F.transform("words", length))).alias("longest"),
            F.collect_set(F.when(F.size("words") > 0, F.col("field"))).alias("fields"),
            F.sum(squares).alias("probes"),
            F.sum((F.octet_length("item") * 2 + 96) * (F.size("words") + 1)).alias("forms")).first()
        self.longest, self.fields = seen["longest"] or 0, seen["fields"]
        fit = lambda df, size: F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df
        self.fit = lambda df: fit(df, seen["forms"])
        self.small = default and max(seen["forms"] or 0, seen["probes"] or 0) <= BROADCAST_BYTES

        forms = self.items.filter(F.size("words") > 0).select("field", "form", "words").distinct()
        word_rows = forms.select("field", F.explode("words").alias("word")).distinct()
        prefixes = F.transform(_leading(F.col("word"), F.lit(self.longest)), lambda p: F.struct(
            p.alias("probe"), F.when(p == F.col("word"), PREFIX).otherwise(WHOLE).alias("kind")))
        self.probes = fit(word_rows.select("field", "word", F.explode(prefixes).alias("p"))
                          .select("field", "word", "p.probe", "p.kind"), seen["probes"])
        # The words of one item are the residual test; the longest stands for the item.
        anchor = F.array_max(F.transform("words", lambda w: F.struct(length(w).alias("n"), w.alias("w"))))
        self.by_anchor = self.fit(forms.select("field", "form", "words", anchor.getField("w").alias("word")))
        self.by_word = self.fit(forms.select("field", "form", "words", F.explode("words").alias("word")))

    def met_words(self, rows: DataFrame, word: str) -> DataFrame:
        """`rows` joined to each profile word that its column `word` meets (`met`)."""
        reach = F.col(word)
        prefixes = F.transform(_leading(reach, F.lit(self.longest)), lambda p: F.struct(
            p.alias("probe"), F.lit(PREFIX).alias("kind")))
        whole = F.array(F.struct(reach.alias("probe"), F.lit(WHOLE).alias("kind")))
        # A record word longer than every profile word can only be met as an extension.
        probes = F.concat(prefixes, F.when(F.char_length(reach) < self.longest, whole)
                          .otherwise(F.slice(whole, 1, 0)))
        spread = rows.withColumn("_p", F.explode(probes)).select(*rows.columns, "_p.probe", "_p.kind")
        return spread.join(self.probes.withColumnRenamed("word", "met"), ["field", "probe", "kind"]).drop("probe", "kind")


def _meets(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a)


def _covered(small: Column, large: Column) -> Column:
    return F.forall(small, lambda s: F.exists(large, lambda t: _meets(s, t)))


def covered_forms(records: DataFrame, doc_id: str, index: ProfileIndex, fields=fv.PROFILE_FIELDS,
                  cells: DataFrame | None = None) -> DataFrame:
    """Distinct `(doc_id, field, form)`, partitioned by document.

    `cells` may hold the `record_cells` of the records, where they are stored already.

    Both tests start from one word that has to be met (the longest of the side to be
    covered) and verify the rest inside the row, so no pair is built from a common word
    alone being present in many records and many profiles.
    """
    cells = record_cells(records, doc_id, fields) if cells is None else cells

    # Every word of the profile item meets some word of the field.
    words = cells.select("doc_id", "field", F.explode(
        F.array_distinct(F.flatten("item_words"))).alias("own"))
    met = (index.met_words(words, "own").select("doc_id", "field", "met").repartition("doc_id")
           .groupBy("doc_id", "field").agg(F.collect_set("met").alias("met")))
    by_field = (met.withColumn("word", F.explode("met")).join(index.by_anchor, ["field", "word"])
                .filter(F.size(F.array_except("words", "met")) == 0)
                .select("doc_id", "field", "form"))

    # Every word of a record item meets a word of the profile item.
    longest = F.array_max(F.transform("own_words", lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))
    items = (cells.select("doc_id", "field", F.explode("item_words").alias("own_words"))
             .withColumn("own", longest.getField("w")))
    by_item = (index.met_words(items, "own").withColumnRenamed("met", "word")
               .join(index.by_word, ["field", "word"])
               .filter(_covered(F.col("own_words"), F.col("words")))
               .select("doc_id", "field", "form"))
    return by_field.unionByName(by_item).repartition("doc_id").dropDuplicates(["doc_id", "field", "form"])


def _shares(profiles: DataFrame, index: ProfileIndex) -> DataFrame:
    """How many items of the profile share one form (and are therefore covered together)."""
    totals = profiles.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n_items"))
    return (index.items.groupBy("profile_id", "field", "form").agg(F.count(F.lit(1)).alias("n"), F.any_value("words").alias("words"))
            .join(totals, "profile_id"))


class _FieldForms:
    """The forms of one field as arrays.

    Of each record word that came up is kept, as bits, which profile words it meets, which
    forms hold one of these, and which forms have one of these as their longest word.
    """

    def __init__(self, field: str, forms: list[tuple[str, ...]], shares: list[list[tuple[int, int]]], n_profiles: int):
        self.prose = field in fv.PROSE_COLUMNS
        self.vocabulary = sorted({w for words in forms for w in words})
        self.number = {w: i for i, w in enumerate(self.vocabulary)}
        self.longest = max(map(len, self.vocabulary))
        self.n_forms, self.n_profiles = len(forms), n_profiles
        self.words, self.ends = _lists([[self.number[w] for w in words] for words in forms])
        holding, anchored = [[] for _ in self.vocabulary], [[] for _ in self.vocabulary]
        for form, words in enumerate(forms):
            for w in words:
                holding[self.number[w]].append(form)
            anchored[self.number[max(words, key=lambda w: (len(w), w))]].append(form)
        self.holding, self.anchored = ([np.array(x, dtype=np.int64) for x in lists] for lists in (holding, anchored))
        self.profile, self.share_ends = _lists([[p for p, _ in share] for share in shares])
        self.share, _ = _lists([[n for _, n in share] for share in shares])
        self.table = None
        if self.n_forms * n_profiles <= _CELLS:
            self.table = np.zeros((self.n_forms, n_profiles), dtype=np.float32)
            self.table[np.repeat(np.arange(self.n_forms), np.diff(self.share_ends)), self.profile] = self.share
        self.most = max(1024, _KNOWN_BYTES // (_bytes(len(self.vocabulary)) + 2 * _bytes(self.n_forms)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.met = np.zeros((0, _bytes(len(self.vocabulary))), dtype=np.uint8)
        self.reach, self.lead = (np.zeros((0, _bytes(self.n_forms)), dtype=np.uint8) for _ in range(2))

    def _meeting(self, word: str) -> list[int]:
        """The profile words that are a prefix of `word` or begin with it."""
        shorter = [self.number.get(word[:n], -1) for n in range(1, min(len(word) - 1, self.longest) + 1)]
        first = bisect_left(self.vocabulary, word)
        after = first
        while after < len(self.vocabulary) and self.vocabulary[after].startswith(word):
            after += 1
        return [u for u in shorter if u >= 0] + list(range(first, after))

    def _learn(self, words: list[str]) -> np.ndarray:
        """The rows of these distinct words."""
        if len(self.known) + len(words) > self.most:
            self._forget()
        fresh = [w for w in words if w not in self.known]
        tables = [np.zeros((len(fresh), t.shape[1]), dtype=np.uint8) for t in (self.met, self.reach, self.lead)]
        for row, word in enumerate(fresh):
            self.known[word] = len(self.known)
            own = self._meeting(word)
            if own:
                for table, bits in zip(tables, (own, *(np.concatenate([x[u] for u in own]) for x in (self.holding, self.anchored))), strict=True):
                    flags = np.zeros(table.shape[1] * 8, dtype=bool)
                    flags[bits] = True
                    table[row] = np.packbits(flags, bitorder="little")
        if fresh:
            self.met, self.reach, self.lead = (np.vstack(pair) for pair in zip((self.met, self.reach, self.lead), tables, strict=True))
        return np.array([self.known[w] for w in words], dtype=np.int64)

    def hits(self, cells: pa.ListArray) -> np.ndarray:
        """Which form (column) the cells of a record (row) cover."""
        n = len(cells)
        found = np.zeros((n, self.n_forms), dtype=bool)
        row = np.repeat(np.arange(n), cells.value_lengths().to_numpy(zero_copy_only=False))
        items = cells.flatten()
        if not self.prose:
            pieces = pc.split_pattern(items, "|")
            row, items = np.repeat(row, pieces.value_lengths().to_numpy(zero_copy_only=False)), pieces.flatten()
        items = items.dictionary_encode()
        # Each distinct item once: its words, as `item_tokens` has them, and what they meet.
        tokens = pc.split_pattern_regex(items.dictionary, _SEPARATORS)
        item = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
        long = pc.greater_equal(pc.utf8_length(tokens.flatten()), fv.TOKEN_MIN)
        words, item = tokens.flatten().filter(long).dictionary_encode(), item[long.to_numpy(zero_copy_only=False)]
        if not len(words):
            return found
        own = self._learn(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        n_words = np.bincount(item, minlength=len(tokens))
        starts = _starts(n_words[n_words > 0])
        reach = np.bitwise_and.reduceat(_wide(self.reach)[own], starts)
        met, lead = (np.bitwise_or.reduceat(_wide(table)[own], starts) for table in (self.met, self.lead))
        # Then the records, by the items they have.
        chosen = items.indices.to_numpy(zero_copy_only=False)
        worded = n_words[chosen] > 0
        chosen, per_row = (np.cumsum(n_words > 0) - 1)[chosen[worded]], np.bincount(row[worded], minlength=n)
        rows = np.flatnonzero(per_row)
        starts = _starts(per_row[rows])
        by_item, met, lead = (np.bitwise_or.reduceat(table[chosen], starts) for table in (reach, met, lead))
        # Every word of one item meets a word of the form.
        found[rows] = np.unpackbits(by_item.view(np.uint8), axis=1, count=self.n_forms, bitorder="little")
        # Every word of the form meets a word of the field: the longest first, then all.
        met = met.view(np.uint8)
        at, form = np.nonzero(np.unpackbits((lead & ~by_item).view(np.uint8), axis=1, count=self.n_forms, bitorder="little"))
        if len(at):
            each, place = _expand(self.ends, form)
            word = self.words[place]
            is_met = (met[at[each], word >> 3] >> (word & 7)) & 1
            whole = np.logical_and.reduceat(is_met.astype(bool), _starts(np.diff(self.ends)[form]))
            found[rows[at[whole]], form[whole]] = True
        return found

    def matched(self, found: np.ndarray) -> np.ndarray:
        """How many items of each profile (column) the forms found for a record (row) stand for."""
        n = len(found)
        row, form = np.nonzero(found)
        pairs = int(np.diff(self.share_ends)[form].sum())
        if self.table is not None and found.size * self.n_profiles < 100 * pairs:
            return (found.astype(np.float32) @ self.table).astype(np.int64)
        each, place = _expand(self.share_ends, form)
        keys = row[each] * self.n_profiles + self.profile[place]
        return np.bincount(keys, weights=self.share[place], minlength=n * self.n_profiles).reshape(n, -1).astype(np.int64)


def _lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists laid end to end, and where each begins and ends."""
    return (np.array([x for one in lists for x in one], dtype=np.int64),
            np.concatenate([[0], np.cumsum([len(one) for one in lists], dtype=np.int64)]))


def _expand(ends: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each element of the chosen lists: the number of its choice, and where it lies."""
    sizes = ends[chosen + 1] - ends[chosen]
    each = np.repeat(np.arange(len(chosen)), sizes)
    return each, np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends[chosen], sizes)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64) - sizes


def _bytes(bits: int) -> int:
    """Bytes that so many bits take, in whole words of eight."""
    return -(-bits // 64) * 8


def _wide(table: np.ndarray) -> np.ndarray:
    return table.view(np.uint64)


class HeldForms:
    """The forms of a small profile table, with which a task covers records where they lie.

    A record's rows are judged by bits, its pairs with profiles counted by one product, so no
    row stands for a record, a form and a profile.
    """

    def __init__(self, shares: pa.Table, fields: list[str]):
        rows = shares.select(["field", "words", "n"]).to_pylist()
        ids = shares.column("profile_id").combine_chunks().dictionary_encode()
        self.ids, profile = ids.dictionary, ids.indices.to_numpy(zero_copy_only=False)
        self.n_items = np.zeros(len(self.ids), dtype=np.int64)
        self.n_items[profile] = shares.column("n_items").to_numpy()
        forms: dict[str, dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for row, p in zip(rows, profile.tolist(), strict=True):
            if row["words"] and row["field"] in fields:
                forms.setdefault(row["field"], {}).setdefault(tuple(row["words"]), []).append((p, row["n"]))
        self.fields = list(forms)
        self.tables = [_FieldForms(field, list(found), list(found.values()), len(self.ids)) for field, found in forms.items()]
        self.rows = max(1, _CELLS // max(1, len(self.ids), *(t.n_forms for t in self.tables)))

    def covered(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Slices of the batch with the number of items matched per record (row) and profile (column)."""
        for start in range(0, batch.num_rows, self.rows):
            part = batch.slice(start, self.rows)
            matched = np.zeros((part.num_rows, len(self.ids)), dtype=np.int64)
            for field, table in zip(self.fields, self.tables, strict=True):
                matched += table.matched(table.hits(part.column(f"_{field}")))
            yield part, matched


def field_texts(records: DataFrame, doc_id: str, fields: list[str], kept: list[str]) -> DataFrame:
    """`(doc_id, kept..., _field...)`: the lower-cased cells of each field, a row per record.

    Rows that share an id are one record: each has the cells of all.
    """
    named = records.withColumn("doc_id", F.col(doc_id))
    texts = lambda df: df.select("doc_id", *kept, *[F.array(F.lower(F.coalesce(F.col(f).cast("string"), F.lit("")))).alias(f"_{f}") for f in fields])
    shared = stored(named.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_id"), "shared")
    if shared.isEmpty():
        return texts(named)
    shared = broadcast_if_small(shared)
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    several = texts(named.join(shared, same, "left_semi"))
    # Equal cells are folded, so an id in many rows is gathered from what differs.
    whole = several.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)), *[
        F.flatten(F.collect_set(f"_{f}")).alias(f"_{f}") for f in fields])
    several = several.select("doc_id", *kept) if kept else several.select("doc_id").distinct()
    merged = several.join(whole, same).select("doc_id", *kept, *[f"_{f}" for f in fields])
    return texts(named.join(shared, same, "left_anti")).unionByName(merged)


def _text_cells(texts: DataFrame, fields: list[str]) -> DataFrame:
    """`field_texts` as the rows of `record_cells`."""
    def cell(field):
        words = F.flatten(F.transform(f"_{field}", lambda c: _item_words(field, c)))
        return F.struct(F.lit(field).alias("field"), words.alias("item_words"))
    rows = texts.select("doc_id", F.explode(F.array(*[cell(f) for f in fields])).alias("c"))
    return rows.select("doc_id", "c.field", "c.item_words").filter(F.size("item_words") > 0)


def coverage_lists(texts: DataFrame, profiles: DataFrame, index: ProfileIndex, fields: list[str], kept: list[str]) -> DataFrame:
    """G8 for whole records: `(doc_id, kept..., bonus)`, the list of (profile, share covered) above zero of each record.

    `texts` are the `field_texts` of the `fields`.  A small profile table travels to the
    records, whose rows stay where they lie; a larger one is met by joins.
    """
    if not index.small:
        pairs = _joined_ratios(covered_forms(texts, "doc_id", index, fields, _text_cells(texts, fields)), profiles, index)
        lists = pairs.groupBy("doc_id").agg(F.collect_list(F.struct(
            F.col("profile_id").cast("long").alias("query_id"), F.col("coverage").alias("value"))).alias("bonus"))
        return texts.select("doc_id", *kept).join(lists, "doc_id", "left")
    held = HeldForms(_shares(profiles, index).toArrow(), fields)
    schema = T.StructType([texts.schema[c] for c in ("doc_id", *kept)] + T.DataType.fromDDL("bonus array<struct<query_id:bigint,value:double>>").fields)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held.ids.cast(pa.int64())
        for batch in batches:
            for part, matched in held.covered(batch):
                row, profile = np.nonzero(matched)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))])
                pair = pa.StructArray.from_arrays([ids.take(pa.array(profile)), pa.array(matched[row, profile] / held.n_items[profile])], ["query_id", "value"])
                bonus = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pair)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", *kept)), bonus], names=["doc_id", *kept, "bonus"])
    return texts.select("doc_id", *kept, *[f"_{f}" for f in held.fields]).mapInArrow(lists, schema)


def _joined_ratios(hits: DataFrame, profiles: DataFrame, index: ProfileIndex) -> DataFrame:
    return (hits.join(index.fit(_shares(profiles, index).drop("words")), ["field", "form"]).groupBy("doc_id", "profile_id")
            .agg(F.sum("n").alias("n_matched"), F.max("n_items").alias("n_items"))
            .select("doc_id", "profile_id", "n_matched",
                    (F.col("n_matched") / F.col("n_items")).alias("coverage")))


def coverage_ratios(records: DataFrame, doc_id: str, profiles: DataFrame, index: ProfileIndex,
                    fields=fv.PROFILE_FIELDS) -> DataFrame:
    """G8, the headline number: `(doc_id, profile_id, n_matched, coverage)` where above zero.

    Item-weighted over all fields of the profile.
    """
    if not index.small:
        return _joined_ratios(covered_forms(records, doc_id, index, fields), profiles, index)
    fields = [f for f in fields if f in records.columns]
    texts = field_texts(records, doc_id, [f for f in fields if f in index.fields], [])
    held = HeldForms(_shares(profiles, index).toArrow(), fields)
    schema = T.StructType([texts.schema["doc_id"], profiles.schema["profile_id"],
                           *T.DataType.fromDDL("n_matched bigint, coverage double").fields])

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, matched in held.covered(batch):
                row, profile = np.nonzero(matched)
                n = matched[row, profile]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), held.ids.take(pa.array(profile)), pa.array(n), pa.array(n / held.n_items[profile])],
                    names=["doc_id", "profile_id", "n_matched", "coverage"])
    return texts.select("doc_id", *[f"_{f}" for f in held.fields]).mapInArrow(ratios, schema)


def coverage_fields(matches: DataFrame, records: DataFrame, doc_id: str, profiles: DataFrame,
                    index: ProfileIndex, labels=fv.LABELS, fields=fv.PROFILE_FIELDS) -> DataFrame:
    """G8, the breakdown for chosen `(profile_id, doc_id)` pairs.

    Adds `fields`: array of struct(key, label, matched, missing, ratio) in field order,
    items in the profile's own words and order.
    """
    chosen = matches.select(F.col("doc_id").alias(doc_id)).distinct()
    # Written out, so that the records are read once for the few that are shown.
    cells = stored(record_cells(records.join(chosen, doc_id, "left_semi"), doc_id, fields), "chosen")
    hits = covered_forms(records, doc_id, index, fields, cells)
    pairs = matches.select("profile_id", "doc_id").join(index.items, "profile_id")
    flagged = pairs.join(hits.withColumn("hit", F.lit(True)), ["doc_id", "field", "form"], "left")
    entry = F.struct("pos", "item", F.coalesce("hit", F.lit(False)).alias("hit"))
    per_field = (flagged.groupBy("profile_id", "doc_id", "field_no", "field")
                 .agg(F.sort_array(F.collect_list(entry)).alias("e")))
    pick = lambda flag: F.transform(F.filter("e", lambda r: r["hit"] == flag), lambda r: r["item"])
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    shaped = per_field.select("profile_id", "doc_id", F.struct(
        "field_no", F.col("field").alias("key"),
        F.coalesce(F.try_element_at(names, F.col("field")), F.col("field")).alias("label"),
        pick(True).alias("matched"), pick(False).alias("missing"),
        (F.size(pick(True)) / F.size("e")).alias("ratio")).alias("f"))
    grouped = shaped.groupBy("profile_id", "doc_id").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    slim = F.transform("fs", lambda f: F.struct(
        f["key"].alias("key"), f["label"].alias("label"), f["matched"].alias("matched"),
        f["missing"].alias("missing"), f["ratio"].alias("ratio")))
    return matches.join(grouped.select("profile_id", "doc_id", slim.alias("fields")),
                        ["profile_id", "doc_id"], "left")
