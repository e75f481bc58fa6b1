"""Byte strings that occur more than once removed from all documents, by column-wise construction.

Every byte covered by a string of `LENGTH` bytes that also starts anywhere else is removed.

1. A window (a string of `LENGTH` bytes) belongs to the bucket of the least hash of its `GRAM`-byte
   grams, and is anchored at the leftmost gram that has it.  Equal windows share bucket and
   position relative to the anchor.  Successive windows with one anchor form a fragment.
2. Buckets are counted over all documents.  A bucket with one fragment repeats nothing; one
   whose fragments are all identical repeats all its windows.  Only buckets with different
   fragments are built: their fragments, each distinct one once, with the number of its
   occurrences, move to their bucket's task.
3. There the fragments are the documents of a collection aligned at their anchors.  Columns are
   taken from the right; each round inserts one symbol per fragment, re-sorting the collection
   by it (a stable pass over the order before, which is the column's Burrows-Wheeler transform)
   and updating the common prefixes of neighbours as one more than the least in between, or
   zero.  A window whose common prefix with a neighbour reaches `LENGTH` is repeated.

Aligning by anchor replaces the comparison of all suffixes of all columns: with it, one symbol
costs a constant number of steps, where inserting into one transform of the whole collection
rewrites that transform as often as the longest document has bytes.  Task partitions, sorted by
bucket and read in order, stand for the sequential files.  Buckets of more than `LARGE` distinct
fragments are decided window by window, by a digest grouped over all tasks.

Defined cases: a null text is an empty one for the query and stays null in `deduplicated`; a
repeated row repeats every window it has; matches never cross documents; characters cut in two
lose their remaining bytes; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import by_batch, column, cut, dealt, packed, read, saved, scratch, unpacked
from .shingles import mix

LENGTH = 200
GRAM = 32
LARGE = 8192
BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every run of `gram` bytes; `gram` is a power of two."""
    out, size = _BYTES[data], 1
    while size < gram:
        out = out[:len(out) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + out[size:] if len(out) > size else out[:0]
        size *= 2
    return mix(out)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    if len(values) < width:
        return values[:0]
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - size:])


def fragments(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, start in its text, windows, bucket) of the fragments of texts laid end to end in `data`."""
    grams = gram_hashes(data, gram)
    least = sliding_least(grams, length - gram + 1)
    if not len(least):
        none = np.zeros(0, np.int64)
        return none, none, none, least
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(least)]
    valid = np.arange(len(least)) + length <= ends[text]
    # A fragment ends where the bucket changes, its anchor is left behind, or the text has no more windows.
    last = np.ones(len(least), bool)
    last[:-1] = (least[1:] != least[:-1]) | (grams[:len(least) - 1] == least[:-1]) | ~valid[1:] | (text[1:] != text[:-1])
    stop = np.flatnonzero(last & valid)
    first = np.ones(len(least), bool)
    first[1:] = last[:-1] | ~valid[:-1]
    start = np.flatnonzero(first & valid)
    return text[start], start - (ends - sizes)[text[start]], stop - start + 1, least[start]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and each value's size; nulls are empty."""
    parts = [b"" if v is None else v.encode() if isinstance(v, str) else v for v in column.to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint (start, end) rows covering `spans`; touching ones are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def repeated_windows(groups: np.ndarray, anchors: np.ndarray, texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each fragment the offsets of windows that another fragment of its group has too.

    `anchors` are the fragments' anchor positions; fragments must be sorted by group.
    """
    sizes = np.array([len(t) for t in texts])
    left, right = int(anchors.max()), int((sizes - anchors).max())
    table = np.zeros((left + right, len(texts)), np.uint8)  # column by column
    begin, end = left - anchors, left - anchors + sizes
    flat = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    table[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[owner], owner] = flat
    found: list[tuple[np.ndarray, np.ndarray]] = []
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int16)
    starting = np.argsort(-end, kind="stable")
    entered = 0
    for c in range(left + right - 1, -1, -1):
        # Fragments whose last byte is in this column enter with an empty suffix, before all others of their group.
        upto = entered
        while upto < len(starting) and end[starting[upto]] > c:
            upto += 1
        keep = begin[order] <= c
        if not keep.all():
            # What leaves takes its prefix along: its successor keeps the lesser of both.
            order, common = _without(order, common, keep)
        if upto > entered:
            fresh = np.sort(starting[entered:upto])
            fresh = fresh[begin[fresh] <= c]
            both = np.concatenate([fresh, order])
            shared = np.concatenate([np.zeros(len(fresh), np.int16), common])
            place = np.argsort(groups[both], kind="stable")
            order, common = both[place], shared[place]
            # The first old one of a group follows a fresh one now; its prefix was zero and stays so.
            entered = upto
        if not len(order):
            continue
        key = groups[order].astype(np.int64) * 256 + table[c, order]
        move = np.argsort(key, kind="stable")
        same = np.concatenate([[False], key[move][1:] == key[move][:-1]])
        fell = np.zeros(len(order), np.int16)
        at = np.flatnonzero(same)
        if len(at):
            a, b = move[at - 1], move[at]  # old places, a < b: the least of common[a + 1 .. b]
            near = b == a + 1
            fell[at[near]] = common[b[near]]
            far = np.flatnonzero(~near)
            if len(far):
                far = far[np.argsort(a[far], kind="stable")]
                edges = np.stack([a[far] + 1, b[far] + 1], axis=1).reshape(-1)
                fell[at[far]] = np.minimum.reduceat(np.append(common, np.int16(0)), edges)[::2]
            fell[at] += 1
        order, common = order[move], np.minimum(fell, np.int16(length))
        full = common >= length
        hit = full | np.concatenate([full[1:], [False]])
        if hit.any():
            who = order[hit]
            found.append((who, c - begin[who]))
    if not found:
        return [np.zeros(0, np.int64)] * len(texts)
    who, offset = (np.concatenate(x) for x in zip(*found))
    place = np.lexsort((offset, who))
    return np.split(offset[place], np.searchsorted(who[place], np.arange(1, len(texts))))


def _without(order: np.ndarray, common: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(keep)
    if not len(starts):
        return order[:0], common[:0]
    # The prefix with the neighbour before is the least over those that left in between.
    before = np.concatenate([[0], starts[:-1] + 1])
    edges = np.stack([before, starts + 1], axis=1).reshape(-1)
    least = np.minimum.reduceat(np.append(common, np.int16(0)), edges)[::2]
    least[0] = 0
    return order[starts], least


RANGES = "array<struct<a:int,b:int>>"
_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def ranges(offsets: np.ndarray) -> list[dict]:
    """Runs of successive offsets."""
    if not len(offsets):
        return []
    breaks = np.flatnonzero(np.diff(offsets) > 1) + 1
    return [{"a": int(r[0]), "b": int(r[-1]) + 1} for r in np.split(offsets, breaks)]


def _keys(docs: DataFrame) -> DataFrame:
    """(row, text, k, c): the document's other columns packed, its text, and a hash and a second hash of id and text."""
    parts = (column(docs, "doc_id", "long"), column(docs, "text", "string"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("string").alias("none")]
    return docs.select(F.struct(*others).alias("row"), parts[1].alias("text"),
                       F.xxhash64(*parts).alias("k"), F.hash(*parts).bitwiseAND(F.lit((1 << 21) - 1)).cast("long").alias("c"))


def _listed(rows: DataFrame) -> DataFrame:
    """(bucket, digest, k, at): every fragment of every text; `at` packs start, windows and the second hash."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, sizes = joined(batch.column("text"))
        text, start, windows, bucket = fragments(data, sizes)
        base = (np.cumsum(sizes) - sizes)[text] + start
        view = memoryview(data)
        digest = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(base.tolist(), (base + windows + LENGTH - 1).tolist())],
                          np.uint64)
        k, c = batch.column("k").to_numpy(), batch.column("c").to_numpy()
        at = start | (windows << 32) | (c[text] << 42)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket.view(np.int64), digest.view(np.int64), k[text], at)],
                                         names=["bucket", "digest", "k", "at"])
    return by_batch(rows.select("text", "k", "c"), work, "bucket long, digest long, k long, at long", "text", 1 << 20)


def _resolved(text: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text, and how many bytes went."""
    if not len(spans):
        return text, 0
    edges = np.concatenate([[0], spans.reshape(-1), [len(text)]])
    kept = b"".join(text[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))
    return kept, len(text) - len(kept)


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _result(texts: list[bytes | None], spans: list[np.ndarray], keep_text: bool) -> list[pa.Array]:
    rows = []
    for text, own in zip(texts, spans):
        kept, gone = _resolved(text or b"", own)
        rows.append((len(text or b""), gone, len(own), hashlib.sha256(kept).hexdigest(),
                     None if text is None or not keep_text else kept.decode("utf-8", "ignore") if gone else text.decode()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return [pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 5, kinds)]


def with_removals(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """`row` (the document's other columns) with n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the `kept` text.

    Texts travel twice, compressed: to give the fragments that need a build, and to meet their spans.
    """
    rows = dealt(_keys(docs))
    spans = _spans(rows)
    names = [f.split()[0] for f in RESULT.split(", ")]
    schema = T.StructType([rows.schema["row"], *T.DataType.fromDDL(RESULT).fields])

    def last(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        gone = []
        for found, c in zip(batch.column("spans"), batch.column("c").to_pylist()):
            values = found.values if found.is_valid else None
            if values is None or not len(values):
                gone.append(np.zeros((0, 2), np.int64))
                continue
            own = values.field("c").to_numpy() == c
            gone.append(merged(np.stack([values.field(f).to_numpy()[own] for f in ("a", "b")], axis=1)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), *_result(unpacked(batch.column("text")), gone, keep_text)], names=["row", *names])
    joined = packed(rows).join(spans, "k", "left").select("row", "text", "c", "spans")
    return by_batch(joined, last, schema, "text", 1 << 18)


def _spans(rows: DataFrame) -> DataFrame:
    """(k, spans) stored: the byte spans (c, a, b) of repeated windows in each text that has any."""
    with scratch():
        listed = _listed(rows)
        buckets = (listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
                   .filter("n > 1").select("bucket", (F.col("low") == F.col("high")).alias("alike")))
        hits = saved(listed.join(buckets, "bucket").select("bucket", "digest", "k", "at", "alike"), "hits")
        unsure = hits.filter("NOT alike")
        found = _decided(unsure, rows)
        place = {"c": F.shiftright("at", 42), "start": F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)),
                 "windows": F.shiftright("at", 32).bitwiseAND(F.lit(0x3FF))}
        span = lambda a, b: F.struct("c", (F.col("start") + a).alias("a"), (F.col("start") + b + (LENGTH - 1)).alias("b"))
        sure = hits.filter("alike").withColumns(place).select("k", F.array(span(F.lit(0), F.col("windows"))).alias("some"))
        more = unsure.join(found, ["bucket", "digest"]).withColumns(place).select(
            "k", F.transform("ranges", lambda r: span(r["a"], r["b"])).alias("some"))
        # A text's own spans: bounded by its length.
        own = sure.unionByName(more).groupBy("k").agg(F.flatten(F.collect_list("some")).alias("spans"))
        return saved(own, "spans", keep=True)


FRAGMENT = "bucket long, digest long, n long, anchor int, body binary"


def _bodies(wanted: DataFrame) -> DataFrame:
    """The bytes and anchors of the fragments (bucket, digest, n, at) that each text is to give."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, c, listed in zip(unpacked(batch.column("text")), batch.column("c").to_pylist(), batch.column("wanted").to_pylist()):
            mine = [w for w in listed if w["at"] >> 42 == c]
            if not mine or text is None:
                continue
            grams = gram_hashes(np.frombuffer(text, np.uint8)).view(np.int64)
            for w in mine:
                a, windows = w["at"] & 0xFFFFFFFF, w["at"] >> 32 & 0x3FF
                b = a + windows + LENGTH - 1
                # The anchor lies in every window of the fragment: sought from the last one's start.
                anchor = windows - 1 + int(np.argmax(grams[a + windows - 1:b - GRAM + 1] == w["bucket"]))
                out.append((w["bucket"], w["digest"], w["n"], anchor, text[a:b]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 5, kinds)],
                                         names=[f.split()[0] for f in FRAGMENT.split(", ")])
    return by_batch(wanted, work, FRAGMENT, "text", 1 << 18)


def _decided(unsure: DataFrame, rows: DataFrame) -> DataFrame:
    """(bucket, digest, ranges) stored: the repeated windows of each distinct fragment of buckets whose fragments differ."""
    # One text gives the bytes of each distinct fragment, however many hold it.
    groups = saved(unsure.groupBy("bucket", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "at")).alias("first")), "groups")
    wanted = groups.groupBy(F.col("first.k").alias("k")).agg(
        F.collect_list(F.struct("bucket", "digest", "n", F.col("first.at").alias("at"))).alias("wanted"))
    fragments = saved(_bodies(packed(rows.select("text", "k", "c")).join(wanted, "k").select("text", "c", "wanted")), "fragments")
    large = saved(groups.groupBy("bucket").count().filter(F.col("count") > LARGE).select("bucket"), "large")
    by_bucket = fragments.join(large, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket")
    found = by_bucket.mapInArrow(_build, f"bucket long, digest long, ranges {RANGES}").unionByName(
        _by_window(fragments.join(large, "bucket", "left_semi")))
    return saved(found, "found")


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole buckets, in the order they come, built one after the other.

    A fragment that occurs more than once enters the collection twice: its twin's common prefix shows its windows repeated.
    """
    held: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        entries = [r for r in rows for _ in range(1 + (r[2] > 1))]
        bucket, _, _, anchor, body = zip(*entries)
        groups = np.cumsum(np.concatenate([[0], np.diff(np.array(bucket, np.int64)) != 0]))
        hits = iter(repeated_windows(groups, np.array(anchor, np.int64), list(body)))
        out = []
        for r in rows:
            own = next(hits)
            if r[2] > 1:
                next(hits)
            if len(own):
                out.append((r[0], r[1], ranges(own)))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int64(), _RANGES))],
                                         names=["bucket", "digest", "ranges"])
    for batch in batches:
        for part in cut(batch, "body", BLOCK_BYTES // 4):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("bucket", "digest", "n", "anchor", "body"))))
            held += rows
            size += sum(len(r[4]) for r in rows)
            if size > BLOCK_BYTES and held[0][0] != held[-1][0]:
                # The last bucket may go on in the next batch.
                split = next(i for i in range(len(held), 0, -1) if held[i - 1][0] != held[-1][0])
                yield from flush(held[:split])
                held = held[split:]
                size = sum(len(r[4]) for r in held)
    yield from flush(held)


def _by_window(large: DataFrame) -> DataFrame:
    """Repeated windows of buckets too large to build in one task, from digests of all their windows."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(b, d, n, i, xxhash.xxh3_128_digest(t[i:i + LENGTH]))
                for b, d, n, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "n", "body")))
                for i in range(len(t) - LENGTH + 1)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*rows)) or [()] * 5, kinds)],
                                         names=["bucket", "digest", "n", "offset", "window"])
    windows = by_batch(large.select("bucket", "digest", "n", "body"), work,
                       "bucket long, digest long, n long, offset int, window binary", "body", 1 << 18)
    again = windows.groupBy("window").agg(F.sum("n").alias("all")).filter("all > 1").select("window")
    return windows.join(again, "window").groupBy("bucket", "digest").agg(
        F.collect_list(F.struct(F.col("offset").alias("a"), (F.col("offset") + 1).alias("b"))).alias("ranges"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, their own columns, without the repeated bytes of their texts."""
    out = with_removals(docs)
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, and the checksum of what is left."""
    out = with_removals(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
