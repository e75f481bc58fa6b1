"""Near-duplicate texts by BagMinHash signatures of their word shingles.

A text is a multiset of five-word shingles.  Each shingle runs one Poisson process per weight
level: (0, 1], (1, 2], (2, 4], (4, 8] and so on.  A point of a process has a time, a register
and a cell of its level; it counts for a text if the cell lies below the shingle's number of
occurrences there.  A register keeps its least time, so two texts agree in a register with
probability equal to their weighted Jaccard similarity.  Points of a process come in time
order, and a process ends for a text once its time passes the text's largest register, so long
texts cost about one or two points a shingle.

Texts that agree in a band of registers are candidates.  A bucket's texts are first compared
with its least text only; the links found are contracted to components, and only texts of a
bucket that are still in different components are compared with each other, and in a large
bucket only those whose bitmaps leave room for the similarity asked for.  So a large group of
near copies costs about one comparison a text, and no link is lost.  Comparisons are cut by the
length ratio, then by the registers in common (`LEAST_AGREED`, far below what similar texts
have), and the rest is decided by the exact multiset overlap.

Defined cases: equal texts form one class and are compared once; a text of fewer than five
words is one shingle of all its words; texts without words, null ones included, are similar to
nothing (empty texts equal each other, null texts do not); an empty table gives an empty result; repeated rows share a class, of which `one_each` keeps
one row; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import by_batch, column, dealt, read, saved, scratch, total
from .components import components
from .shingles import mix, multisets, overlap

SIMILAR = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Of 160 registers, similar texts share fewer than this with a probability of 1e-8.
LEAST_AGREED = 100
#: In buckets of more texts than this, bitmaps of `BITS` bits bound the similarity of a pair.
LARGE = 64
BITS = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Least times, one row of `registers` per text, of the multisets (text, shingle, count)."""
    least = np.full((texts, registers), np.inf)
    flat = least.reshape(-1)
    # Level 0 is (0, 1]; level j is (2^(j-1), 2^j] with as many cells as weights.
    owner, seed, cells, below = [text], [mix(shingle)], [np.ones(len(text), np.int64)], [np.ones(len(text), np.int64)]
    level = 1
    while (more := count > 1 << (level - 1)).any():
        owner.append(text[more])
        seed.append(mix(shingle[more] + np.array([level], np.uint64) * _STEP))
        cells.append(np.full(more.sum(), 1 << (level - 1), np.int64))
        below.append(count[more] - (1 << (level - 1)))
        level += 1
    owner, seed = np.concatenate(owner), np.concatenate(seed)
    cells, below = np.concatenate(cells), np.concatenate(below)
    order = np.argsort(owner, kind="stable")
    owner, seed, cells, below = owner[order], seed[order], cells[order], below[order]
    time = np.zeros(len(owner))
    while len(owner):
        seed = seed + _STEP
        draw = mix(seed)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / (registers * cells)
        other = mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
        register = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        cell = (other >> np.uint64(32)).astype(np.int64) % cells
        counted = cell < below
        np.minimum.at(flat, owner[counted] * registers + register[counted], time[counted])
        own = owner[np.concatenate([[True], owner[1:] != owner[:-1]])]
        top = np.zeros(texts)
        top[own] = least[own].max(axis=1)
        alive = time < top[owner]
        owner, seed, cells, below, time = owner[alive], seed[alive], cells[alive], below[alive], time[alive]
    return least


def band_hashes(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash of each band of each signature."""
    bits = mix(least.view(np.uint64))
    out = np.zeros((len(least), least.shape[1] // rows), np.uint64)
    out += np.arange(out.shape[1], dtype=np.uint64)
    for k in range(rows):
        out = mix(out * _STEP + bits[:, k::rows])
    return out


def distinct_texts(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One stored row per distinct text with words: (node, tid, first_doc, n, bands, brief).

    `brief` has 16 bits of each register; `first_doc` is the least doc_id that holds the text.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column("text").to_pylist()
        text, shingle, count = multisets(texts)
        least = signatures(text, shingle, count, len(texts), bands * rows)
        keys = band_hashes(least, rows).view(np.int64)
        brief = (mix(least.view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
        size = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
        offsets = np.arange(len(texts) + 1, dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets * bands), pa.array(keys.reshape(-1)))
        shorts = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets * np.int32(2 * bands * rows)),
                                                                 pa.py_buffer(np.ascontiguousarray(brief))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(size), lists, shorts],
                                         names=["doc_id", "tid", "n", "bands", "brief"])
    texts = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    texts = dealt(texts.filter("text IS NOT NULL")).withColumn("tid", F.unhex(F.md5("text")))
    signed = by_batch(texts, work, "doc_id long, tid binary, n long, bands array<long>, brief binary", "text", 2 << 20)
    found = signed.groupBy("tid").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"),
                                      F.first("bands").alias("bands"), F.first("brief").alias("brief"))
    return saved(found.select(F.monotonically_increasing_id().alias("node"), "*"), "texts")


def agreeing(pairs: DataFrame, texts: DataFrame, least: int = LEAST_AGREED) -> DataFrame:
    """The pairs (u, v) whose signatures share at least `least` registers."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                for c in ("a", "b")) if batch.num_rows else (np.zeros((0, 1)), np.zeros((0, 1)))
        yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= least))
    brief = lambda n, c: texts.select(F.col("node").alias(n), F.col("brief").alias(c))
    joined = pairs.join(brief("v", "b"), "v").join(brief("u", "a"), "u").select("u", "v", "a", "b")
    return joined.mapInArrow(lambda it: (x for batch in it for x in work(batch)), "u long, v long")


def bodies(nodes: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of `nodes`, stored: the texts that have any candidate travel once.

    One row per text is read, that of its least doc_id, so copies are told apart before they meet.
    """
    wanted = texts.join(nodes, "node").select("node", "tid", "first_doc")
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    rows = rows.withColumn("tid", F.unhex(F.md5("text")))
    found = rows.join(wanted, (rows.tid == wanted.tid) & rows.doc_id.eqNullSafe(wanted.first_doc))
    return saved(found.select("node", "text").dropDuplicates(["node"]), "bodies")


def verified(pairs: DataFrame, body: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (u, v) whose texts are similar, decided by the multisets of their shingles."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        text_of: dict[int, str] = dict(zip(us, batch.column("a").to_pylist())) | dict(zip(vs, batch.column("b").to_pylist()))
        keys = list(text_of)
        text, shingle, count = multisets([text_of[k] for k in keys])
        edges = np.searchsorted(text, np.arange(len(keys) + 1))
        sets = {k: (shingle[a:b], count[a:b]) for k, a, b in zip(keys, edges, edges[1:])}
        good = [overlap(sets[u], sets[v]) >= similar for u, v in zip(us, vs)]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
    side = lambda n, c: body.select(F.col("node").alias(n), F.col("text").alias(c))
    joined = pairs.join(side("v", "b"), "v").join(side("u", "a"), "u").select("u", "v", "a", "b")
    return saved(by_batch(joined, work, "u long, v long", "b", 1 << 20), "similar")


def bitmaps(nodes: DataFrame, body: DataFrame) -> DataFrame:
    """(node, bits): the `BITS` hashed bits of each text's multiset.

    Each bit in which two bitmaps differ stems from an element that only one text has, so the
    differing bits are never more than the texts' true difference.
    """
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text, shingle, count = multisets(batch.column("text").to_pylist())
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        bit = mix(np.repeat(shingle, count) + which.astype(np.uint64) * _STEP) % np.uint64(BITS)
        table = np.zeros((batch.num_rows, BITS), np.uint8)
        table[np.repeat(text, count), bit.astype(np.int64)] = 1
        longs = np.packbits(table, axis=1).view(np.int64)
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (BITS // 64)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(longs.reshape(-1)))], names=["node", "bits"])
    return by_batch(body.join(nodes, "node").select("node", "text"), work, "node long, bits array<long>", "text", 1 << 20)


def linked(texts: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Similar pairs (u, v) that connect all texts which any chain of similar pairs connects."""
    near = lambda a, b: (F.col(a) >= similar * F.col(b) - 1e-9) & (F.col(b) >= similar * F.col(a) - 1e-9)
    bands = texts.filter("n > 0").select("node", "n", F.explode("bands").alias("band"))
    buckets = (bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("least"))
               .filter("size > 1").select("band", "least"))
    members = saved(bands.join(buckets, "band").select("band", "node", "n", "least"), "members")
    body = bodies(members.select("node").distinct(), texts, docs)
    stars = members.filter(F.col("node") != F.col("least.node")).filter(near("n", "least.n")).select(
        F.col("least.node").alias("u"), F.col("node").alias("v")).distinct()
    first = verified(agreeing(stars, texts), body, similar)
    group = components(first)
    placed = (members.select("band", "node", "n").join(group, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    split = (placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                        (F.count(F.lit(1)) > LARGE).alias("large")).filter("low < high"))
    open_ = saved(placed.join(split.select("band", "large"), "band").select("band", "node", "n", "root", "large"), "open")
    # In large buckets bitmaps rule out, by a proven bound, most pairs before they are formed.
    bits = saved(bitmaps(open_.filter("large").select("node").distinct(), body), "bits")
    able = open_.join(bits.join(texts.select("node", "bands"), "node"), "node", "left")
    side = lambda c: able.select("band", *[F.col(x).alias(f"{y}{c}") for x, y in (
        ("node", ""), ("n", "n_"), ("root", "root_"), ("bits", "b_"), ("bands", "h_"))])
    # A pair of large buckets is looked at in the first band that it shares.
    same = [F.coalesce(F.get("h_u", F.lit(i)) == F.get("h_v", F.lit(i)), F.lit(False)) for i in range(BANDS)]
    here = F.lit(True)
    for i in reversed(range(BANDS)):
        here = F.when(same[i], F.get("h_u", F.lit(i)) == F.col("band")).otherwise(here)
    apart = total(F.bit_count(F.get("b_u", F.lit(i)).bitwiseXOR(F.get("b_v", F.lit(i)))) for i in range(BITS // 64))
    allowed = (F.col("n_u") + F.col("n_v")) * ((1 - similar) / (1 + similar)) + 1e-9
    crossed = (side("u").join(side("v"), "band")
               .filter((F.col("root_u") < F.col("root_v")) & near("n_u", "n_v") & here & (F.coalesce(apart, F.lit(0)) <= allowed))
               .select("u", "v").distinct())
    tried = stars.select(F.col("u").alias("v"), F.col("v").alias("u")).unionByName(stars)
    crossed = saved(crossed, "crossed")
    second = verified(agreeing(crossed.join(tried, ["u", "v"], "left_anti"), texts), body, similar)
    return first.unionByName(second)


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(tid, class_id, keeper): each distinct text's class, named by its least doc_id, and the text that stays."""
    with scratch():
        texts = distinct_texts(docs)
        group = components(linked(texts, docs, similar))
        placed = texts.join(group, "node", "left").select(
            "tid", F.coalesce("root", "node").alias("root"),
            F.struct(F.col("first_doc").isNull().alias("unknown"), F.col("first_doc"), F.col("tid")).alias("rank"))
        least = placed.groupBy("root").agg(F.min("rank").alias("first"))
        return saved(placed.join(least, "root").select("tid", F.col("first.first_doc").alias("class_id"),
                                                       (F.col("tid") == F.col("first.tid")).alias("keeper")), "classes", keep=True)


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least doc_id of its class of near-duplicates."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs)
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("tid"))
    out = rows.join(found.select("tid", "class_id"), "tid", "left")
    return out.select("doc_id", F.when(F.col("tid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The documents with one of each class of near-duplicates: a row of its least doc_id."""
    found = classes(docs, similar)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       column(docs, "doc_id", "long").alias("id"), F.unhex(F.md5(column(docs, "text", "string"))).alias("tid"))
    # One row per text is chosen in each task before rows move.
    turn = F.row_number().over(Window.partitionBy("tid").orderBy(F.col("id").asc_nulls_last()))
    single = rows.filter("tid IS NOT NULL").withColumn("turn", turn).filter("turn = 1")
    kept = single.join(found.filter("keeper").select("tid"), "tid", "left_semi").select("row.*")
    return kept.unionByName(rows.filter("tid IS NULL").select("row.*"))
