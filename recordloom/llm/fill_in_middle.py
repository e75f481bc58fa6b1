"""Documents rewritten for fill-in-the-middle training, by one pyarrow.compute pipeline a batch.

A text is cut into line units.  All units of a batch lie flat in one array beside the index of
their parent text; a unit's ordinal within its text tells its role (prefix, middle, suffix),
units are filtered by role, lists are rebuilt from the counts that are left, and `binary_join`
makes one string of each list.  Where to cut and which form to write comes from four numbers
of a digest of the seed and the document's id, so a document is rewritten alike on every run,
whatever partition it lies in.  The form `psm` puts `<P>`, `<S>` and `<M>` before prefix, suffix
and middle; `spm` puts the suffix first.

No row meets another: the operator is one scan without a shuffle.  A batch is cut to about
`BATCH_BYTES` of text, one text at least, so memory is bounded by the longest text.

Defined cases: a null text is an empty one; an empty text, and one that holds a marker, is
`plain` and comes out as it is, its counts null; a null id hashes as the seed and a colon alone;
repeated rows come out repeated and alike; a text is taken whole at any length that a string
column holds; an empty table gives an empty result; extra columns pass through `transformed`
in `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import by_batch, column, dealt, read

SEED = "7"
#: Per cent of texts to rewrite, and per cent of those to write suffix first.
RATE, SUFFIX_FIRST = 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
BATCH_BYTES = 8 << 20


def drawn(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all units in a row, each one's parent, units of each text); texts without nulls."""
    parts = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
    sizes = pc.list_value_length(parts).to_numpy()
    closing = np.zeros(len(flat), bool)
    closing[np.cumsum(sizes) - 1] = True
    # Every part but a text's last had a line feed after it; a last one that is empty is no unit.
    ended = pc.binary_join_element_wise(flat, pc.if_else(pa.array(closing), "", "\n"), "")
    real = pc.not_equal(ended, "")
    parent = parent[real.to_numpy(zero_copy_only=False)]
    return ended.filter(real), parent, np.bincount(parent, minlength=len(texts))


def joined_by_role(flat: pa.Array, parent: np.ndarray, mask: np.ndarray, count: int) -> pa.Array:
    """One string for each text: its units in `mask`, in order."""
    sizes = np.bincount(parent[mask], minlength=count)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, flat.filter(pa.array(mask))), "")


def rewritten(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, form: pa.Array) -> list[pa.Array]:
    """[n, form, prefix_chars, middle_chars, output] of texts without nulls; `form` is what is wished."""
    flat, parent, n = units(texts)
    first, second = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    ordinal = np.arange(len(parent)) - (np.cumsum(n) - n)[parent]
    in_prefix, in_suffix = ordinal < first[parent], ordinal >= second[parent]
    prefix, middle, suffix = (joined_by_role(flat, parent, mask, len(texts))
                              for mask in (in_prefix, ~in_prefix & ~in_suffix, in_suffix))
    marked = pc.equal(texts, "")
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(texts, marker))
    form = pc.if_else(marked, PLAIN, form)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    plain = pc.equal(form, PLAIN)
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, PSM), psm, spm))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, output]


def transformed(docs: DataFrame, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """`row` (the document's columns but its text) with `n`, `form`, `prefix_chars`, `middle_chars` and `output`."""
    h1, h2, h3, h4 = drawn(column(docs, "doc_id", "long"), seed)
    form = F.when(h3 % 100 >= rate, PLAIN).when(h4 % 100 < suffix_first, SPM).otherwise(PSM)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    rows = docs.select(row.alias("row"), h1.alias("h1"), h2.alias("h2"), form.alias("form"),
                       F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    schema = T.StructType([rows.schema["row"], *T.DataType.fromDDL(
        "n long, form string, prefix_chars long, middle_chars long, output string").fields])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = rewritten(batch.column("text"), batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), batch.column("form"))
        yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", *names])
    return by_batch(dealt(rows), work, schema, "text", BATCH_BYTES)


def restored(made: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """`made` with the text rebuilt from `output` and `form` alone.

    Rewritten texts hold each marker once, so cutting at the markers gives back the pieces.
    """
    schema = T.StructType([*made.schema.fields, T.StructField(name, T.StringType())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, kind = batch.column(output), batch.column(form)
        plain = pc.equal(kind, PLAIN)
        # Plain texts may hold any number of markers: three alone stand for them.
        pieces = pc.split_pattern_regex(pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, out), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
        a, b, middle = (pc.list_element(pieces, i) for i in (1, 2, 3))
        psm = pc.equal(kind, PSM)
        text = pc.binary_join_element_wise(pc.if_else(psm, a, b), middle, pc.if_else(psm, b, a), "")
        yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(plain, out, text)], names=[*batch.schema.names, name])
    return by_batch(made, work, schema, output, BATCH_BYTES)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rewritten, with checksums of what it became and of the text rebuilt from that."""
    made = transformed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    slim = made.select(F.col("row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output")
    return restored(slim).select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                                 F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                                 F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
pieces AS (SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(u[1:least(a, b)], ''), '') AS prefix,
    coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
    coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM pieces"""
