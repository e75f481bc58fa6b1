"""The Merkle manifest against trees built the plain way."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import ODD_ROWS, table
from recordloom.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return _h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def _levels(leaves, fan):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def _path(levels, i, fan):
    """(place in its run, the run) of each level below the root."""
    for level in levels[:-1]:
        run = i - i % fan
        yield i - run, level[run:run + fan]
        i //= fan


def _manifest(rows, fan=16):
    """The rows of the query, from (doc_id, source, lang, n_chars, text)."""
    low = lambda v: (v is not None, 0 if v is None else v)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((low(r[0]), _leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda x: x[:2]), _levels([x[1] for x in sorted(by[s], key=lambda x: x[:2])], fan)) for s in sources}
    top = _levels([trees[s][1][-1][0] for s in sources], fan)
    out = []
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for i, (_, leaf, r) in enumerate(own):
            path = [*_path(levels, i, fan), *_path(top, k, fan)]
            proof = _h(*[x for at, run in path for j, x in enumerate(run) if j != at])
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if changed else r[4]
            again = _leaf(*r[:4], text)
            for at, run in path:
                again = _h(*run[:at], again, *run[at + 1:])
            out.append((r[0], leaf, levels[-1][0], top[-1][0], proof, again, again == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan, height", [(16, 1), (16, 2), (16, 3), (2, 5), (3, 4)])
def test_every_node_has_a_place_of_its_own(fan, height):
    places = np.concatenate([merkle.address(height, d, np.arange(fan ** d), fan) for d in range(height + 1)])
    assert sorted(places.tolist()) == list(range(merkle.subtree_size(height, fan)))
    # Each lower part of the split lies in one piece.
    upper = (height + 1) // 2
    for i in range(fan ** upper):
        part = np.concatenate([merkle.address(height, d, np.arange(i * fan ** (d - upper), (i + 1) * fan ** (d - upper)), fan)
                               for d in range(upper, height + 1)])
        assert part.max() - part.min() + 1 == len(part) == merkle.subtree_size(height - upper, fan)


@pytest.mark.parametrize("fan, height, n", [(16, 3, 1), (16, 3, 17), (16, 2, 256), (2, 5, 21), (3, 2, 7)])
def test_blocks_and_paths(fan, height, n):
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).hexdigest().encode() for i in range(n)]
    block = merkle.Block.built(height, leaves, fan)
    level = [x.decode() for x in leaves]
    for _ in range(height):
        level = [_h(*level[i:i + fan]) for i in range(0, len(level), fan)]
    assert block.root.decode() == level[0] and block.level(height) == leaves
    paths = list(block.paths())
    assert len(paths) == n and all(merkle.folded(leaf, p) == block.root for leaf, p in zip(leaves, paths))
    assert merkle.folded(leaves[0].upper(), paths[0]) != block.root or height == 0


def _docs(spark, rows):
    return spark.createDataFrame([(i, s, lang, n, t, "x", 1) for i, s, lang, n, t in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int")


def _rows(count):
    rows = [(i, f"src{i % 40 if i % 3 else 0}", "en", i % 7, f"Text NUMBER {i} é\n" * (i % 5)) for i in range(count)]
    return rows + [(i, None, None, None, t) for i, t, _ in ODD_ROWS] + [(5, "src0", "en", None, "Équal"), (5, "src0", "en", None, "Équal"),
                                                                        (None, "ü", "en", 1, "A"), (9, "ü", "en", 1, None), (10, "Z", "", 0, "")]


@pytest.mark.parametrize("fan, height, count", [(16, 3, 900), (16, 1, 900), (2, 2, 150)])
def test_manifest(spark, fan, height, count):
    rows = _rows(count)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.Manifest(_docs(spark, rows), tampered, fan, height)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = made.proofs(with_proof=True).collect()
    want = _manifest(rows, fan)
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == want
    assert made.root == want[0][3] and 0 < sum(r["verified"] for r in got) < len(rows)
    assert all(hashlib.sha256("".join(r["proof"]).encode()).hexdigest() == r["proof_sha256"] for r in got)


def test_edges(spark, none):
    assert merkle.Manifest(none).proofs().count() == 0 and merkle.Manifest(none).root is None
    one = merkle.Manifest(table(spark, [(1, "A", "en")])).proofs().collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] == one[0]["folded_root"]
    assert one[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest() and one[0]["verified"]
    bare = merkle.Manifest(spark.createDataFrame([(1,), (2,)], "doc_id long")).proofs().collect()
    assert len(bare) == 2 and all(r["verified"] for r in bare)
