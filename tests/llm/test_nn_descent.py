"""Linked vectors against all pairs compared."""

import math

import numpy as np

from recordloom.llm import nn_descent as nd

SCHEMA = "vec_id long, embedding array<double>, label int, node long, unit string, ball int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], SCHEMA)


def _brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of every row, by the row's place."""
    def fits(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    near = [set() for _ in rows]
    by = {}
    for at, (_, v, label) in enumerate(rows):
        if fits(v, label):
            by.setdefault((label, len(v)), []).append(at)
    for own in by.values():
        m = np.array([rows[i][1] for i in own], np.longdouble)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.sqrt((m ** 2).sum(axis=1, keepdims=True))
        for a, b in zip(*np.nonzero(m.astype(float) @ m.T.astype(float) >= threshold)):
            if a != b:
                near[own[a]].add(own[b])
    root = [None] * len(rows)
    for at in range(len(rows)):
        if root[at] is None:
            seen, todo = {at}, [at]
            while todo:
                for y in near[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            least = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
            for i in seen:
                root[i] = (least,)
    return sorted(((r[0], len(near[at]), root[at][0], r[0] is not None and r[0] == root[at][0]) for at, r in enumerate(rows)), key=str)


def _got(spark, rows, **how):
    links = nd.Links(_table(spark, rows), **how)
    out = links.per_vector()
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return links, sorted((tuple(r) for r in out.collect()), key=str)


def _around(rng, centre, angle, count):
    """Vectors at up to `angle` from a centre."""
    noise = rng.normal(size=(count, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    a = angle * rng.uniform(0.2, 1, count)[:, None]
    return np.cos(a) * centre + np.sin(a) * noise


def _unit(rng, dim=24):
    v = rng.normal(size=dim)
    return v / np.linalg.norm(v)


def _vectors(seed):
    rng = np.random.default_rng(seed)
    rows, theta = [], math.acos(0.93)
    for _ in range(500):
        rows.append((_unit(rng), int(rng.integers(0, 3))))
    for _ in range(40):  # pairs, some a little too far apart
        c, label = _unit(rng), int(rng.integers(0, 3))
        rows += [(c, label), (_around(rng, c, theta * 1.1, 1)[0], label)]
    for count, angle in ((90, 0.15), (60, 0.3), (50, 0.6)):  # one ball, open balls, a loose cloud
        rows += [(v, 1) for v in _around(rng, _unit(rng), angle, count)]
    a, b = _unit(rng), _unit(rng)
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    rows += [(np.cos(t) * a + np.sin(t) * b, 2) for t in np.arange(0, 3, 0.2)]  # a chain
    rows += [(a, 0)] * 30
    ids = rng.permutation(len(rows)) * 3
    return [(int(i), (v * rng.uniform(0.1, 9)).tolist(), label) for i, (v, label) in zip(ids, rows)]


ODD = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 1e-9], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None),
       (6, None, 1), (7, [], 1), (8, [0.0, -0.0], 1), (9, [1.0, None], 1), (10, [float("nan"), 1.0], 1), (11, [float("inf"), 1.0], 1),
       (12, [1e-190, 1e-195], 1), (13, [1e200, 1e190], 1), (14, [1.0, 0.0, 0.0], 1), (15, [-1.0, -0.0], 1), (None, [1.0, 0.01], 1),
       (None, [0.0, 1.0], 3), (None, None, None), (16, [5e-324, 0.0], 1), (17, [0.93, math.sqrt(1 - 0.93 ** 2)], 4), (18, [1.0, 0.0], 4),
       (19, [0.92999, math.sqrt(1 - 0.92999 ** 2)], 5), (20, [1.0, 0.0], 5)]


def test_links_equal_all_pairs(spark):
    """Clusters of all kinds, with odd rows among them."""
    rows = _vectors(1) + [(i, v, label if label is None else label + 10) for i, v, label in ODD]
    links, got = _got(spark, rows)
    assert links.recall >= nd.RECALL
    want = _brute(rows)
    assert sum(r[1] for r in want) > 5000
    missed = sum(w[1] - g[1] for w, g in zip(want, got))
    assert all(g[1] <= w[1] for w, g in zip(want, got))  # nothing below the threshold
    assert missed <= 0.005 * sum(r[1] for r in want)
    assert sum(g[2:] != w[2:] for w, g in zip(want, got)) <= 4
    odd = {str(r) for r in _brute([r for r in rows if r[2] is None or r[2] >= 10])}
    assert odd <= {str(r) for r in got}  # these exactly


def test_tables_without_links(spark):
    assert _got(spark, [(1, None, 1), (2, [0.0], None)])[1] == [(1, 0, 1, True), (2, 0, 2, True)]
    bare = spark.createDataFrame([(1,)], "vec_id long").limit(0)
    assert nd.Links(bare).per_vector().count() == 0


def test_lists_are_widened_when_the_audit_fails(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(2 * i + j, v.tolist(), 0) for i in range(150) for j, v in enumerate(_around(rng, _unit(rng, 64), 0.2, 2))]
    widths, whole = [], nd.descend
    # The first descent stands still; what it missed shows in the audit.
    monkeypatch.setattr(nd, "descend", lambda g, rounds=nd.ROUNDS, settled=nd.SETTLED:
                        widths.append(g.first()["k"]) or whole(g, 0 if len(widths) == 1 else rounds, settled))
    links, _ = _got(spark, rows, neighbours=8)
    assert links.recall >= nd.RECALL and widths[0] == 8 and max(widths) == 16
