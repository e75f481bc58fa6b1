"""Records written out as text or as display structures.

A record is passed as its cells, a map from column name to text, so that the same
functions serve tables, joined records and drafts, and every per-field rule is one lambda.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .text import bars_to_commas, let, list_items, normalize, object_value, parse_object, strip

_COMMA = f"{fv.PROSE_COMMA} "


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> Column:
    """A literal array of strings."""
    return F.expr(f"array({', '.join(map(_quoted, values))})")


def _literal_map(values: Mapping[str, str]) -> Column:
    return F.expr(f"map({', '.join(_quoted(x) for kv in values.items() for x in kv)})")


def record_cells(struct: str | None = None) -> Column:
    """The cells of the record in the columns of the table, or in one struct column."""
    head = f"{struct}." if struct else ""
    return F.expr("map(" + ", ".join(f"'{c}', coalesce({head}{c}, '')" for c in fv.RECORD_COLUMNS) + ")")


def _cell(cells: Column, field) -> Column:
    key = F.lit(field) if isinstance(field, str) else field
    return F.coalesce(F.try_element_at(cells, key), F.lit(""))


def _label(names: Column, field: Column) -> Column:
    return F.coalesce(F.try_element_at(names, field), field)


def _labelled(label: Column | str, value: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(label, F.lit(": "), value)


def combined_text(cells: Column | None = None, labels=fv.LABELS) -> Column:
    """the whole record as one text, most telling fields first."""
    names = _literal_map(labels)

    def part(record, field):
        value = _cell(record, field)
        shown = F.when(field == "aliases", F.translate(value, "|", fv.PROSE_COMMA)).otherwise(value)
        return F.when(strip(value) != "", _labelled(_label(names, field), shown))
    return let(record_cells() if cells is None else cells, lambda record: F.array_join(
        F.transform(strings(fv.ENCODING_ORDER), lambda field: part(record, field)), " . "))


def title_alias_text(cells: Column | None = None) -> Column:
    """title and aliases as one text."""
    cells = record_cells() if cells is None else cells
    text = F.concat(_cell(cells, "job_title"), F.lit(f" {fv.PROSE_COMMA} "),
                    F.translate(_cell(cells, "aliases"), "|", fv.PROSE_COMMA))
    return F.btrim(text, F.lit(f" {fv.PROSE_COMMA}"))


def profile_text(fields: Column, labels=fv.LABELS) -> Column:
    """a profile in the shape of a record text.

    `fields` is an array of struct(key, items) in profile field order.
    """
    names = _literal_map(labels)
    parts = F.transform(F.filter(fields, lambda f: F.size(f["items"]) > 0),
                        lambda f: _labelled(_label(names, f["key"]), F.array_join(f["items"], _COMMA)))
    return F.array_join(parts, " . ")


def context_lines(fields: Column, cells: Column | None = None, labels=fv.LABELS) -> Column:
    """The labelled non-empty fields, one per line, in the order of the array `fields`."""
    names = _literal_map(labels)
    lines = lambda record: F.transform(F.filter(fields, lambda f: _cell(record, f) != ""),
                                       lambda f: _labelled(_label(names, f), _cell(record, f)))
    return let(record_cells() if cells is None else cells, lambda record: F.array_join(lines(record), "\n"))


def record_context(fields: Column, cells: Column | None = None, labels=fv.LABELS) -> Column:
    """title, aliases if there are any, then the labelled fields."""
    cells = record_cells() if cells is None else cells
    aliases = _cell(cells, "aliases")
    return F.concat_ws(
        "\n", _labelled(labels["job_title"], _cell(cells, "job_title")),
        F.when(aliases != "", _labelled(labels["aliases"], aliases)),
        F.nullif(context_lines(fields, cells, labels), F.lit("")))


def answer_one(fields: Column, cells: Column | None = None) -> Column:
    """the answer text for one record."""
    cells = record_cells() if cells is None else cells
    return F.concat(F.lit(f"{fv.PIN_MARK} "), _cell(cells, "job_title"), F.lit("\n\n"), context_lines(fields, cells))


def answer_two(fields: Column, first: Column, second: Column) -> Column:
    """the answer text for a combined role."""
    titles = [_cell(c, "job_title") for c in (first, second)]
    head = F.concat(F.lit(f"{fv.LINK_MARK} {fv.COMBINED_ROLE}: "), titles[0], F.lit(" + "), titles[1])
    sections = [F.concat(F.lit("— "), t, F.lit(":\n"), context_lines(fields, c))
                for t, c in zip(titles, (first, second))]
    return F.concat_ws("\n\n", head, *sections)


def _lines(parts: Column) -> Column:
    return F.array_join(F.flatten(parts), "\n")


def _joined(items: Column) -> Column:
    return F.array_join(items, _COMMA)


def profile_answer(matches: Column) -> Column:
    """ranked matches with what each covers and misses.

    `matches` is an array of struct(job_title, fields: array of struct(label, matched,
    missing)).
    """
    def field_lines(f):
        line = lambda heading, items: F.when(F.size(items) > 0, _labelled(
            F.concat(f["label"], F.lit(f" — {heading}")), _joined(items)))
        return F.array_compact(F.array(line(fv.PROFILE_COVERED, f["matched"]),
                                       line(fv.PROFILE_UNCOVERED, f["missing"])))
    per_match = F.transform(matches, lambda m: F.concat(
        F.array(F.lit(""), F.concat(F.lit(f"{fv.PIN_MARK} "), m["job_title"])),
        F.flatten(F.transform(m["fields"], field_lines))))
    return _lines(F.concat(F.array(F.array(F.lit(fv.PROFILE_HEADER))), per_match))


def profile_context(profile: Column, matches: Column, labels=fv.LABELS) -> Column:
    """the profile and the finished comparison, as handed to a text generator."""
    names = _literal_map(labels)
    own = F.transform(profile, lambda f: _labelled(_label(names, f["key"]), _joined(f["items"])))
    dash = lambda items: F.coalesce(F.nullif(_joined(items), F.lit("")), F.lit("—"))

    def field_line(f):
        return F.concat(f["label"], F.lit(f" — {fv.PROFILE_COVERED}: "), dash(f["matched"]),
                        F.lit(f" / {fv.PROFILE_UNCOVERED}: "), dash(f["missing"]))
    per_match = F.transform(matches, lambda m, i: F.concat(
        F.array(F.lit(""), F.concat(F.lit(f"{fv.PROFILE_CONTEXT_JOB} "), (i + 1).cast("string"),
                                    F.lit(": "), m["job_title"])),
        F.transform(m["fields"], field_line)))
    return _lines(F.concat(F.array(F.concat(F.array(F.lit(fv.PROFILE_CONTEXT_HEADER)), own)), per_match))


def draft_offer(draft: Column, related: Column) -> Column:
    """the offer of a designed record, `related` naming its neighbours."""
    description = _cell(draft, "description")
    return F.concat_ws(
        "\n", F.lit(fv.DRAFT_HEADER), F.lit(""),
        _labelled(f"{fv.PIN_MARK} {fv.LABELS['job_title']}", _cell(draft, "job_title")),
        F.when(description != "", _labelled(fv.LABELS["description"], description)),
        F.when(F.size(related) > 0, F.concat(F.lit(f"\n{fv.RELATED_LABEL}: "), _joined(related))),
        F.lit(""), F.lit(fv.DRAFT_QUESTION))


def related_list(header: Column | str, related: Column) -> Column:
    """A refusal sentence followed by the nearest titles."""
    header = F.lit(header) if isinstance(header, str) else header
    return F.concat(header, F.lit("\n"), F.array_join(
        F.transform(related, lambda t: F.concat(F.lit("- "), t)), "\n"))


def detail(primary: Column, cells: Column | None = None, labels=fv.LABELS) -> Column:
    """struct(job_title, fields) with the primary fields first, order kept otherwise."""
    names, prose = _literal_map(labels), strings(fv.PROSE_COLUMNS)
    none = F.expr("cast(array() as array<string>)")

    def filled(key, value, items):
        is_prose = F.array_contains(prose, key)
        usable = ~value.isin(*fv.BLANK_CELLS) & (is_prose | (F.size(items) > 0))
        return F.when(usable, F.struct(
            key.alias("key"), _label(names, key).alias("label"),
            F.when(is_prose, value).otherwise(_joined(items)).alias("value"),
            F.when(is_prose, none).otherwise(items).alias("items"),
            F.array_contains(primary, key).alias("primary")))

    def box(record, key):
        return let(strip(_cell(record, key)), lambda v: let(list_items(v), lambda items: filled(key, v, items)))

    def shaped(record):
        boxes = F.array_compact(F.transform(strings(fv.DETAIL_FIELDS), lambda key: box(record, key)))
        ordered = lambda bs: F.concat(F.filter(bs, lambda b: b["primary"]), F.filter(bs, lambda b: ~b["primary"]))
        return F.struct(strip(_cell(record, "job_title")).alias("job_title"), let(boxes, ordered).alias("fields"))
    return let(record_cells() if cells is None else cells, shaped)


def clean_draft(reply: Column) -> Column:
    """struct(status, draft) of one generated reply, the draft being its cells.

    Status is `generated`, `not_a_job` or `unavailable` (no reply, no object, no title).
    """
    columns, prose = strings(fv.RECORD_COLUMNS), strings(fv.PROSE_COLUMNS)

    def cell(obj, name):
        plain = lambda v: F.when(F.array_contains(prose, name), F.btrim(
            bars_to_commas(v), F.lit(_COMMA))).otherwise(v)
        return let(normalize(object_value(obj, name)), plain)

    def judged(obj, draft):
        flagged = F.lower(strip(F.coalesce(object_value(obj, F.lit("not_a_job")), F.lit("")))) == "true"
        return (F.when(obj.isNull(), "unavailable").when(flagged, "not_a_job")
                .when(_cell(draft, "job_title") == "", "unavailable").otherwise("generated"))

    def shaped(status, draft):
        return F.struct(status.alias("status"), F.when(status == "generated", draft).alias("draft"))

    return let(parse_object(reply), lambda obj: let(
        F.map_from_arrays(columns, F.transform(columns, lambda name: cell(obj, name))), lambda draft: let(
            judged(obj, draft), lambda status: shaped(status, draft))))
