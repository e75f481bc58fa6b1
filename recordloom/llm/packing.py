"""Token sequences packed into fixed windows by non-negative least squares over the length histogram.

Documents longer than the window give whole windows first.  The lengths of what is left are
counted in `BINS` bins; all combinations of up to `DEPTH` bins that fill a window are
enumerated, and non-negative least squares finds how often to use each so that the histogram
is met.  Counts are rounded down, then up again one by one where pieces are left.  Each
combination's sequences take pieces of their bins by rank; the few tokens by which the last,
longest piece overshoots are cut off.  What remains (bins met too little, offcuts) is packed
greedily: laid end to end in table order and cut at every window.  The last, partly filled
window is split into sequences of powers of two, which need no padding.

The driver holds the histogram and the combinations, both bounded by `BINS`; ranks and running
sums are distributed over the stored parts.

Defined cases: a null text is an empty one and has the closing id only; repeated rows are
packed each; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import by_batch, column, dealt, numbered, read, running, saved
from .tokens import encoder

SEQUENCE = 2048
BINS = 128
DEPTH = 3
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def tokenised(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """(row, part, doc_id, n, ids) stored; ids are little-endian unsigned 32-bit."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sizes = encoder(path)(batch.column("text").to_pylist(), end_id)
        offsets = np.concatenate([[0], np.cumsum(sizes)]) * 4
        data = ids.astype("<u4")
        packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)),
                                                                 pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), packed],
                                         names=["doc_id", "n", "ids"])
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    out = by_batch(dealt(rows), work, "doc_id long, n long, ids binary", "text", 2 << 20)
    return saved(out.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"),
                            "doc_id", "n", "ids"), "tokens")


def combinations(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending tuples of up to `depth` bins whose sum is `bins`."""
    found: list[tuple[int, ...]] = []

    def extend(taken: tuple[int, ...], left: int) -> None:
        least = taken[-1] if taken else 1
        if least <= left < bins:
            found.append((*taken, left))
        if len(taken) + 2 <= depth:
            for b in range(least, left // 2 + 1):
                extend((*taken, b), left - b)
    extend((), bins)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active set method."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(1.0, np.abs(gradient).max(initial=0.0))
    for _ in range(rounds):
        gradient[free] = -np.inf
        if free.all() or gradient.max() <= tolerance:
            break
        free[np.argmax(gradient)] = True
        while True:
            trial = np.zeros_like(x)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 1e-12)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0.0
        gradient = a.T @ (b - a @ x)
    return x


def repeat_counts(histogram: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """How often to use each combination: whole numbers that never ask for more pieces than there are."""
    uses = np.zeros((len(histogram), len(combos)))
    for j, combo in enumerate(combos):
        for b in combo:
            uses[b, j] += 1
    exact = nnls(uses[1:], histogram[1:].astype(float))
    counts = np.floor(exact)
    for j in np.argsort(counts - exact, kind="stable"):  # largest fraction first
        counts[j] += exact[j] > counts[j]
    left = histogram - uses @ counts
    for j in np.argsort(exact, kind="stable"):  # take back what the histogram does not hold
        while counts[j] > 0 and (left[list(combos[j])] < 0).any():
            counts[j] -= 1
            left += uses[:, j]
    return counts.astype(np.int64)


def slots(counts: np.ndarray, combos: list[tuple[int, ...]], bins: int) -> dict[str, np.ndarray]:
    """Runs of ranks per bin: rank `start`.. of bin `bin` goes to sequences `first`.. at place `place`."""
    rows = []
    used, first = np.zeros(bins, np.int64), 0
    for j in np.flatnonzero(counts):
        for place, b in enumerate(combos[j]):
            rows.append((b, used[b], counts[j], first, place))
            used[b] += counts[j]
        first += int(counts[j])
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("bin", "start", "count", "first", "place"), table.T)) | {"sequences": first}


def packed(tokens: DataFrame, window: int = SEQUENCE, bins: int = BINS, depth: int = DEPTH) -> DataFrame:
    """(row, start, length, sequence_id, offset) of every piece."""
    if window % bins:
        raise ValueError("the window must be a multiple of the bins")
    grain = window // bins
    lengths = tokens.select("row", "part", "n", F.floor(F.col("n") / window).cast("long").alias("wholes"),
                            F.pmod("n", F.lit(window)).alias("rest"))
    tails = lengths.filter("rest > 0").select(
        "row", "part", F.col("rest").alias("length"), (F.col("n") - F.col("rest")).alias("start"),
        F.floor(F.col("rest") / grain).cast("int").alias("bin"))
    histogram = np.zeros(bins, np.int64)
    for b, n in tails.groupBy("bin").count().collect():
        histogram[b] = n
    combos = combinations(bins, depth)
    table = slots(repeat_counts(histogram, combos), combos, bins)
    ranked = numbered(tails, ["bin"], "row", "rank")

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        b, rank = batch.column("bin").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
        sequence, place = np.full(len(b), -1, np.int64), np.zeros(len(b), np.int64)
        if len(table["bin"]):
            base = 1 << 40
            run = np.searchsorted(table["bin"] * base + table["start"], b * base + rank, side="right") - 1
            run = np.maximum(run, 0)
            inside = rank - table["start"][run]
            hit = (table["bin"][run] == b) & (inside >= 0) & (inside < table["count"][run])
            sequence[hit], place[hit] = (table["first"][run] + inside)[hit], table["place"][run][hit]
        cols = [batch.column(c) for c in ("row", "part", "start", "length")] + [pa.array(sequence), pa.array(place)]
        yield pa.RecordBatch.from_arrays(cols, names=["row", "part", "start", "length", "sequence_id", "place"])
    placed = ranked.mapInArrow(lambda it: (x for batch in it for x in assign(batch)),
                               "row long, part int, start long, length long, sequence_id long, place long")
    placed = saved(placed, "placed")
    # At most `depth` pieces share a sequence here.
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    combined = (placed.filter("sequence_id >= 0")
                .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
                .withColumn("kept", F.least("length", F.lit(window) - F.col("offset"))))
    from_combos = combined.select("row", "start", F.col("kept").alias("length"), "sequence_id", "offset")
    offcuts = combined.filter("kept < length").select(
        "row", "part", (F.col("start") + F.col("kept")).alias("start"), (F.col("length") - F.col("kept")).alias("length"))
    next_id = table["sequences"]

    whole = running(lengths.filter("wholes > 0"), "wholes", "row", "before")
    from_wholes = whole.select("row", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wholes") - 1)).alias("k")).select(
        "row", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"),
        (F.col("before") + F.col("k") + next_id).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    next_id += lengths.agg(F.sum("wholes")).first()[0] or 0

    rest = placed.filter("sequence_id < 0").select("row", "part", "start", "length").unionByName(offcuts)
    laid = running(rest, "length", "row", "at")
    total = rest.agg(F.sum("length")).first()[0] or 0
    full = total // window
    marks, at = [], full * window
    for bit in reversed(range(window.bit_length())):
        if (total - full * window) >> bit & 1:
            marks.append((at, at + (1 << bit), next_id + full + len(marks)))
            at += 1 << bit
    span = lambda a, b, s: F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"),
                                    F.lit(s).cast("long").alias("s"))
    last = F.array(*[span(*m) for m in marks]) if marks else F.array(span(total, total, next_id + full))
    windows = F.transform(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window)),
                          lambda k: F.when(k < full, F.array(F.struct((k * window).alias("a"), ((k + 1) * window).alias("b"),
                                                                      (k + next_id).alias("s")))).otherwise(last))
    cut = laid.select("row", "start", "length", "at", F.explode(F.flatten(windows)).alias("w")).select(
        "row", "start", "at", F.greatest("at", F.col("w.a")).alias("lo"),
        F.least(F.col("at") + F.col("length"), F.col("w.b")).alias("hi"), "w").filter("lo < hi")
    from_rest = cut.select("row", (F.col("start") + F.col("lo") - F.col("at")).alias("start"),
                           (F.col("hi") - F.col("lo")).alias("length"), F.col("w.s").alias("sequence_id"),
                           (F.col("lo") - F.col("w.a")).alias("offset"))
    return from_combos.unionByName(from_wholes).unionByName(from_rest)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(tokens: DataFrame, with_ids: bool = False, **shape) -> DataFrame:
    """The packed pieces with their checksums, and their ids if wanted.

    A document's pieces are gathered (as many as its length allows) and meet its ids once.
    """
    own = packed(tokens, **shape).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts"))
    joined = tokens.select("row", "doc_id", "n", "ids").join(own, "row")
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        taken: list[np.ndarray] = []
        for doc, n, ids, cuts in zip(*(batch.column(c) for c in ("doc_id", "n", "ids", "cuts"))):
            data = memoryview(ids.as_buffer())
            for c in cuts.as_py():
                a, m = c["start"], c["length"]
                rows.append((doc.as_py(), a, m, zlib.crc32(data[4 * a:4 * (a + m)]), n.as_py(), c["sequence_id"], c["offset"]))
                if with_ids:
                    taken.append(np.frombuffer(data[4 * a:4 * (a + m)], "<u4").astype(np.int32))
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 7)]
        names = [f.split()[0] for f in PIECE.split(", ")]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in taken])]).astype(np.int32)
            values = np.concatenate(taken) if taken else np.zeros(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)
    return by_batch(joined, work, schema, "ids")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 2048 tokens."""
    return pieces(tokenised(read(spark, sf_dir, "documents"), tokenizer_path()))
