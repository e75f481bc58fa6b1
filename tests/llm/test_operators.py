"""Each operator on odd rows and empty tables, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ODD_ROWS, PROSE, table
from recordloom.llm import (bag_minhash, hnsw, kd_sharding, license_scan, line_dedup, packing, quality_rules,
                            sentencepiece_unigram as sp, shingles, suffix_dedup, tokens, warc)
from recordloom.llm.components import components
from recordloom.session import fresh_path

SEVEN = len(ODD_ROWS)


# ---------------------------------------------------------------- 1 quality rules
def _stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics(spark, odd):
    got = [tuple(r) for r in quality_rules.with_stats(odd).select("row.text", *quality_rules.STATS, "base_failed").collect()]
    assert len(got) == SEVEN
    for text, *stats, failed in got:
        assert tuple(stats) == _stats(text)
        assert failed == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])


@pytest.mark.parametrize("n, k", [(500, 0), (500, 3), (4000, 60), (90000, 1700), (10, 9), (0, 0)])
def test_binomial_tail(one, n, k):
    got = one(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), 0.02))
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(.02) + (n - i) * math.log(.98)
            for i in range(k + 1)] if k < n * 0.02 and n else [0.0]
    assert got == pytest.approx(sum(map(math.exp, logs)), rel=1e-8)


def test_cutoffs_hold_the_risk(spark):
    rows = [(i, "en", 0.9 if bad else 0.05 + 0.3 * (i % 50 == 0), not bad) for i in range(6000) for bad in (i % 5 == 0,)]
    rows += [(10_000 + i, None, 0.9, False) for i in range(20)]
    scored = spark.createDataFrame(rows, "text_key long, stratum string, score double, good boolean")
    found = {r["stratum"]: r["cutoff"] for r in quality_rules.cutoffs(scored).collect()}
    assert set(found) == {"en"} and 0.35 < found["en"] <= 0.9  # the stratum without good labels proves nothing


def test_quality_verdict(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int")
    kept = quality_rules.accepted(odd, labels)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 9} - {6} | ({6} & {r["doc_id"] for r in kept.collect()})
    assert quality_rules.accepted(none, labels).count() == 0
    assert quality_rules.accepted(odd, labels.limit(0)).count() == kept.count()


# ---------------------------------------------------------------- 2 line dedup
def test_line_dedup(spark, none):
    a, b = "the first line of all words", "Another LINE with some  more words"
    rows = [(2, f"{a}\nx\n{b}", "en"), (1, f"{b.lower()}\n{a}\n{a}", "en"), (3, a, "en"), (4, None, "en"), (5, "", "en"), (3, a, "en")]
    out = {r["doc_id"]: r for r in line_dedup.with_removals(table(spark, rows)).select(F.col("row.doc_id"), "kept_text", "spans").collect()}
    assert out[1]["kept_text"] == f"{b.lower()}\n{a}" and out[2]["kept_text"] == "x" and out[3]["kept_text"] == ""
    assert out[4]["kept_text"] is None and out[5]["kept_text"] == ""
    assert [(s["start"], s["length"], s["kept_in"]) for s in out[2]["spans"]] == [(0, len(a), 1), (len(a) + 3, len(b), 1)]
    assert line_dedup.deduplicated(none).columns == none.columns and line_dedup.deduplicated(none).count() == 0


def _lines_removed(rows):
    """(doc_id -> kept text, removed line numbers with the document that keeps each), every non-blank line a unit."""
    keeper, out = {}, {}
    for doc_id, text in sorted(rows):
        if text is None:
            out[doc_id] = (None, [])
            continue
        kept, gone = [], []
        for i, line in enumerate(text.split("\n")):
            plain = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
            first = keeper.setdefault(plain, (doc_id, i)) if plain else (doc_id, i)
            if first == (doc_id, i):
                kept.append(line)
            else:
                gone.append((i, first[0]))
        out[doc_id] = ("\n".join(kept), gone)
    return out


def test_line_dedup_of_short_and_unspaced_lines(spark):
    han = "版权所有未经许可不得转载本网站的任何内容"
    rows = [(1, f"All rights reserved.\n\n{han}\nx"), (2, f"all  RIGHTS reserved.\n\t\n{han}\nown"),
            (3, f"{han}\n \nx\n\n\nall rights reserved.\n---"), (4, "---\n\nx"), (5, None)]
    docs = table(spark, [(i, t, "en") for i, t in rows])
    out = {r["doc_id"]: r for r in line_dedup.with_removals(docs).select(F.col("row.doc_id"), "kept_text", "spans").collect()}
    expected = _lines_removed(rows)
    assert {i: (r["kept_text"], [s["kept_in"] for s in r["spans"]]) for i, r in out.items()} == \
        {i: (text, [k for _, k in gone]) for i, (text, gone) in expected.items()}
    assert out[2]["kept_text"] == "\t\nown" and out[3]["kept_text"] == " \n\n\n---" and out[4]["kept_text"] == ""
    assert line_dedup.with_removals(docs, 5).filter("size(spans) > 0").count() == 0


# ---------------------------------------------------------------- 3 packing
def test_tokens_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer
    path = packing.tokenizer_path()
    whole, words = Tokenizer.from_file(path), tokens.WordEncoder(path)
    texts = [t for _, t, _ in ODD_ROWS] + ["It's, don't. x%., A.B. ÉTÉ, ſ µ. <|endoftext|> <|ENDOFTEXT|>", "a\x1cb\x85c İΣσ"]
    ids, sizes = words(texts, 1)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == whole.encode(text or "", add_special_tokens=False).ids + [1]


def test_nnls_and_counts():
    rng = np.random.default_rng(1)
    a, x = rng.random((8, 20)), np.zeros(20)
    x[[2, 5, 9]] = 1, 2, 3
    assert np.abs(a @ packing.nnls(a, a @ x) - a @ x).max() < 1e-6
    combos = packing.combinations(16, 3)
    assert all(sum(c) == 16 and list(c) == sorted(c) for c in combos) and len(set(combos)) == len(combos)
    histogram = rng.integers(0, 50, 16)
    counts = packing.repeat_counts(histogram, combos)
    used = Counter(b for c, n in zip(combos, counts) for b in c for _ in range(n))
    assert (counts >= 0).all() and all(used[b] <= histogram[b] for b in used) and counts.sum() > 0


def test_packing(spark, odd, none):
    many = odd.unionByName(table(spark, [(100 + i, " ".join(["token"] * (i * 37 % 3000)), "en") for i in range(150)]))
    stored = packing.tokenised(many, packing.tokenizer_path())
    rows = packing.pieces(stored, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    sums = [sum(n for _, n in own) for own in sequences.values()]
    assert sum(n for n in sums if n & (n - 1)) == 0  # full, or a power of two
    assert sum(sums) == stored.agg(F.sum("n")).first()[0]
    whole = Counter()
    for r in rows:
        whole[r["doc_id"]] += r["length"]
    assert whole[2] == 2 * whole[1]  # a repeated row is packed twice
    assert packing.pieces(packing.tokenised(none, packing.tokenizer_path())).count() == 0


# ---------------------------------------------------------------- 4 k-d shards
@pytest.mark.parametrize("shards", [1, 3, 24])
def test_kd_shards(spark, odd, none, shards):
    many = odd.unionByName(table(spark, [(100 + i, "w" * (i * 37 % 900) + "\n" * (i % 7), "en") for i in range(600)]
                                 + [(1000 + i, "copy " * 40, "en") for i in range(300)]))
    rows = kd_sharding.sharded(kd_sharding.points(many), shards).collect()
    assert len(rows) == SEVEN + 900
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(shards))
    assert max(size.values()) <= 1.1 * sum(size.values()) / shards
    assert kd_sharding.sharded(kd_sharding.points(none), shards).count() == 0


def _kd_shards(rows, shards, whole, first=0):
    """(number of the row -> shard): each node cut along its widest dimension at the row nearest to its quantile."""
    if shards == 1 or not rows:
        return {r["i"]: first for r in rows}
    spans = [(max(r["d"][k] for r in rows) - min(r["d"][k] for r in rows)) / whole[k] for k in range(3)]
    axis = spans.index(max(spans))
    key = lambda r: (r["d"][axis], r["k_text"], r["k_row"])
    rows, reached, n = sorted(rows, key=key), 0, 0
    target = sum(r["size"] for r in rows) * (shards // 2) / shards
    while reached + rows[n]["size"] < target and n < len(rows) - 1:
        reached, n = reached + rows[n]["size"], n + 1
    n += not target - reached < reached + rows[n]["size"] - target
    left = shards // 2
    return _kd_shards(rows[:n], left, whole, first) | _kd_shards(rows[n:], shards - left, whole, first + left)


@pytest.mark.parametrize("shards", [2, 7, 24, 300])
def test_kd_cuts_equal_brute_force(spark, shards):
    rng = np.random.default_rng(shards)
    docs = table(spark, [(i, "wé"[i % 2] * int(rng.integers(1, 400)) + "\n" * int(rng.integers(0, 6)), "en") for i in range(500)]
                 + [(600 + i, "copy " * 30, "en") for i in range(60)])
    points = kd_sharding.points(docs)
    tree = kd_sharding.kd_tree(points, shards, tolerance=0.0)
    leaves, todo = {}, [tree]
    while todo:
        node = todo.pop()
        todo += node.children
        leaves |= {} if node.children else {id(node): node.first}
    batch = points.toArrow().combine_chunks().to_batches()[0]
    got = kd_sharding.Walk(tree, leaves)(batch, kd_sharding.DIMENSIONS)[0].tolist()
    rows = [{"i": i, "d": [r[d] for d in kd_sharding.DIMENSIONS], **r} for i, r in enumerate(batch.to_pylist())]
    whole = [max(1, max(r["d"][k] for r in rows) - min(r["d"][k] for r in rows)) for k in range(3)]
    want = _kd_shards(rows, shards, whole)
    assert got == [want[i] for i in range(len(rows))] and (shards > 24 or set(got) == set(range(shards)))


# ---------------------------------------------------------------- 5 suffix dedup
def _removed(texts, length=200):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("large", [8192, 1])
def test_suffix_dedup(spark, odd, none, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdé "), 900))
    rows = [(20 + i, base[i * 40:i * 40 + 420] + "".join(rng.choice(list("xyz"), 60)) + base[500:500 + 30 * i], "en") for i in range(9)]
    docs = odd.unionByName(table(spark, rows + [(40, "ab" * 300, "en"), (41, "q" + "ab" * 150, "en")]))
    got = Counter(tuple(r) for r in suffix_dedup.with_removals(docs, False)
                  .select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == Counter(_removed([(r["text"] or "").encode() for r in docs.select("text").collect()]))
    if large > 1:
        out = suffix_dedup.deduplicated(docs)
        assert out.columns == docs.columns and out.filter("text IS NULL").count() == 2 and out.count() == docs.count()
        assert suffix_dedup.deduplicated(none).count() == 0


# ---------------------------------------------------------------- 6 license scan
def test_license_scan(spark, odd, none):
    mit = license_scan.TEMPLATES["MIT"]
    words = mit.split()
    edited = " ".join(words[:20] + ["really"] + words[20:40] + words[42:])
    rows = [(50, f"intro ü\n{mit}\nend", "en"), (51, f"before {edited} after", "en"), (52, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "en"),
            (53, " ".join(words[:30]), "en")]
    docs = odd.unionByName(table(spark, rows))
    found = license_scan.scan(docs).collect()
    by = {(r["doc_id"], r["template"], r["span_start"]): r for r in found}
    assert {k[0] for k in by} == {50, 51, 52} and len([k for k in by if k[0] == 52]) == 2
    full = next(r for r in found if r["doc_id"] == 50)
    assert full["coverage"] == 1.0 and f"intro ü\n{mit}\nend"[full["span_start"]:full["span_end"]] == mit.rstrip(".")
    part = next(r for r in found if r["doc_id"] == 51 and r["template"] == "MIT")
    assert part["matched_words"] == part["template_words"] - 2
    assert license_scan.scan(none).count() == 0 and license_scan.scan(docs, {}).count() == 0


def _found(name, words, index):
    text = " ".join(["some words before", *words, "and some after"])
    return max((m[1] for m in license_scan.matches(text, index) if m[0] == name), default=0)


def _short():
    return {n: license_scan.words_of(t) for n, t in license_scan.TEMPLATES.items() if len(license_scan.words_of(t)) <= 12}


@pytest.mark.parametrize("name", sorted(_short()))
def test_every_one_word_edit_of_a_short_notice_is_found(name):
    index, words = license_scan.Index(license_scan.TEMPLATES), _short()[name]
    n = len(words)
    for i in range(n):
        assert _found(name, words[:i] + words[i + 1:], index) == n - 1, ("deleted", i)
        assert _found(name, words[:i] + ["zzz"] + words[i + 1:], index) == n - 1, ("substituted", i)
        assert _found(name, words[:i] + ["zzz"] + words[i:], index) == n, ("inserted", i)
        for j in range(n - 1):  # and a word put in besides
            left = words[:i] + words[i + 1:]
            assert _found(name, left[:j] + ["zzz"] + left[j:], index) == n - 1, ("deleted and inserted", i, j)


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_the_worst_edits_that_coverage_allows_are_found(name):
    index, words = license_scan.Index(license_scan.TEMPLATES), license_scan.words_of(license_scan.TEMPLATES[name])
    t, n = index.names.index(name), len(words)
    edited = list(words)
    for _ in range(n - math.ceil(0.8 * n)):  # the word whose loss leaves the fewest hits
        def hits(i):
            ids = np.array([index.number.get(w, 0) for w in edited[:i] + ["zzz"] + edited[i + 1:]])
            return sum(u == t and at == p for u, at, p in index.hits(ids))
        edited[min((i for i in range(n) if edited[i] != "zzz"), key=hits)] = "zzz"
    assert _found(name, edited, index) == sum(w != "zzz" for w in edited)


def test_winnow_guarantees_a_shared_fingerprint():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1000, 6)
    a, b = (np.concatenate([rng.integers(0, 1000, 30), shared, rng.integers(0, 1000, 30)]) for _ in range(2))
    prints = [{int(h[p]) for p in license_scan.winnow(h, 4)} for h in (license_scan.grams(a, 3), license_scan.grams(b, 3))]
    assert prints[0] & prints[1]


# ---------------------------------------------------------------- 7 near-duplicates
def test_signatures_estimate_weighted_jaccard():
    texts = ["a b c d e f g h " * 3 + " ".join(f"w{i}" for i in range(k, k + 60)) for k in (0, 10, 40)]
    sets = shingles.multisets(texts)
    least = bag_minhash.signatures(*sets, 3, 4096)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        exact = shingles.overlap(*((sets[1][sets[0] == t], sets[2][sets[0] == t]) for t in (i, j)))
        assert abs((least[i] == least[j]).mean() - exact) < 0.04


def _classes(rows, similar=0.8):
    bags, root = {}, {}
    for t in {t for _, t in rows if t is not None}:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bags[t] = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])
    root = {t: t for t in bags}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t
    for a in bags:
        for b in bags:
            common = sum((bags[a] & bags[b]).values())
            if a < b and common and common >= similar * sum((bags[a] | bags[b]).values()):
                root[find(b)] = find(a)
    first = {}
    for i, t in rows:
        if t is not None:
            c = find(t)
            first[c] = i if first.get(c) is None else first[c] if i is None else min(first[c], i)
    return [(i, i if t is None else first[find(t)]) for i, t in rows]


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(90):
        own = words[:120] if i < 60 else list(rng.choice(words, 120))
        for j in rng.choice(120, i % 6, replace=False):
            own = [*own[:j], f"e{i}", *own[j + 1:]]
        rows.append((100 + i, " ".join(own), "en"))
    docs = odd.unionByName(table(spark, rows))
    path = fresh_path(spark, "odd")
    docs.write.parquet(f"{path}/documents.parquet")
    got = sorted(((r["doc_id"], r["class_id"]) for r in bag_minhash.op7_bag_minhash(spark, path).collect()), key=str)
    want = _classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == sorted(want, key=str)
    kept = bag_minhash.one_each(docs)
    texts = len({c for (i, c), r in zip(want, docs.collect()) if r["text"] is not None and c is not None})
    unnamed = len({r["text"] for r in docs.filter("doc_id IS NULL AND text IS NOT NULL").collect()})
    assert kept.columns == docs.columns and kept.filter("text IS NOT NULL").count() == texts + unnamed
    assert kept.filter("text IS NULL").count() == 2 and bag_minhash.one_each(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 130)}


# ---------------------------------------------------------------- 8 unigram pieces
@pytest.fixture(scope="module")
def model():
    return sp.unigram(sp.model_path())


def _viterbi(model, text):
    keys = {p: i for i, (p, k) in enumerate(zip(model.model.pieces, model.model.kinds)) if k == sp.NORMAL}
    text = sp.MARK + text.replace(" ", sp.MARK) if text else ""
    best = [(0.0, 0, [])] + [None] * len(text)
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + 48) + 1):
            alone = b == a + 1 and text[a:b] not in keys
            if text[a:b] in keys or alone:
                value = best[a][0] + (model.unknown if alone else model.scores[keys[text[a:b]]])
                if best[b] is None or value > best[b][0]:
                    best[b] = value, a, [int(model.bytes[x]) for x in text[a:b].encode()] if alone else [keys[text[a:b]]]
    out, at = [], len(text)
    while at:
        out, at = best[at][2] + out, best[at][1]
    return out


def test_unigram(model, spark, odd, none):
    texts = [t for _, t, _ in ODD_ROWS] + ["  two  spaces ", "\n\nx\n", "日本語 text", "▁mark"]
    for text, ids in zip(texts, model.encode(texts)):
        if text is None:
            assert ids is None
        else:
            assert ids.tolist() == _viterbi(model, text) and model.decode(ids) == text.replace(sp.MARK, " ")
    out = sp.encoded(odd, sp.model_path()).collect()
    assert len(out) == SEVEN and all(r["decoded"] == t for r, (_, t, _) in zip(sorted(out, key=str), sorted(ODD_ROWS, key=str)) if r["doc_id"] == 1)
    assert sp.encoded(none, sp.model_path()).count() == 0


# ---------------------------------------------------------------- 9 WARC
def test_warc(spark):
    long = "<p>" + "é" * 600 + "</p>\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (5, "http://b", long), (5, "http://b", long), (3, "u", "short"), (4, "u", "short"),
            (6, "u", None), (None, "u", long), (7, "u", "")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.decided(warc.pages_of(pages)), path)
    out = warc.resolved(warc.read_archives(spark, path)).collect()
    body = long.encode()
    for r in out:
        text = next((h for i, _, h in rows if i == r["page_id"])) or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out) == Counter({
        (1, "revisit", 5): 1, (2, "revisit", 5): 1, (None, "revisit", 5): 1, (5, "response", None): 2, (3, "response", None): 1,
        (4, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1})
    assert len(body) > 1000
    empty = fresh_path(spark, "warc")
    warc.write_archives(warc.decided(warc.pages_of(pages.limit(0))), empty)
    assert warc.resolved(warc.read_archives(spark, empty)).count() == 0


# ---------------------------------------------------------------- 10 nearest neighbours
def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 8)) * rng.random((1500, 1))
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7), (None, [1.0] * 8), (2020, [1.0, 2.0]), (0, rows[0][1])]
    table_ = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, query string")
    out = hnsw.nearest(table_, table_.filter("vec_id % 20 = 0"), shard_rows=400).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 20):
        scores = vectors @ vectors[q]
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:20]
        assert len(found[q]) == 20 and found[q] == sorted(found[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(s - scores[i]) < 1e-9 for i, s in found[q])
        hits += len({i for i, _ in found[q]} & {i for _, i in best})
    assert hits / (75 * 20) >= 0.9 and set(found) == set(range(0, 1500, 20))
    assert hnsw.nearest(table_.limit(0), table_.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1e-190, 1e150])
def test_nearest_of_any_magnitude(spark, scale):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 8)) * scale
    table_ = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    out = hnsw.nearest(table_, table_.filter("vec_id % 20 = 0")).collect()
    hits = 0
    for q in range(0, 300, 20):
        own = (vectors / scale) @ (vectors[q] / scale)
        best = set(sorted((i for i in range(300) if i != q), key=lambda i: -own[i])[:20])
        found = [r for r in out if r["query_id"] == q]
        assert sorted(r["rank"] for r in found) == list(range(1, 21)) and not any(math.isnan(r["score"]) for r in found)
        hits += len(best & {r["vec_id"] for r in found}) if scale > 1 else 20  # products of tiny ones are all zero
    assert hits >= 0.9 * 300


def test_vectors_that_share_an_id_are_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *[(i, [math.cos(i), math.sin(i)]) for i in range(1, 12)]]
    out = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"),
                       spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>"), 5).collect()
    got = Counter((r["rank"], r["vec_id"]) for r in out)
    want = Counter()
    for _, v in rows[:2]:
        scores = sorted((-(v[0] * math.cos(i) + v[1] * math.sin(i)), i) for i in range(1, 12))[:5]
        want.update((n + 1, i) for n, (_, i) in enumerate(scores))
    assert got == want
