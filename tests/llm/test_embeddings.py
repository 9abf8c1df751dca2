import numpy as np
import pytest

from marginflow.llm import embeddings as e


def cosine(x, y):
    return float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))


def brute(rows, threshold=0.9):
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and all(a is not None and np.isfinite(a) for a in v) and any(v)}
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and cosine(ok[a], ok[b]) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out.append((i, len(links[k]), min(rows[m][0] for m in seen)))
    return sorted(out)


@pytest.mark.parametrize("block_rows", [4096, 9])
def test_against_brute_force(spark, block_rows):
    r = np.random.default_rng(0)
    centres = r.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + r.normal(size=16) * r.choice([0.05, 0.3])).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, rows[5][1]) for i in range(7)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0, float("nan")] + [0.0] * 14), (204, [float("inf")] * 16), (205, [1.0, None] + [0.0] * 14), (206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [1e-30] * 16), (209, [1e30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n_links", "2 AS id", "vec_id % 3 AS label")
    out = e.near_vectors(df, block_rows=block_rows).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in out) == brute([(i, [None if a is None else float(np.float32(a)) for a in v] if v is not None else None) for i, v in rows])
    assert all(x.kept == (x.vec_id == x.component_id) for x in out)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in e.near_vectors(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    assert e.near_vectors(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        e.near_vectors(df, threshold=0.0)


def test_bounds_hold_and_no_link_is_missed():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 24)) * np.exp(r.normal(size=(300, 24)))
    x[150:] = x[:150] + r.normal(size=(150, 24)) * 0.4 * np.linalg.norm(x[:150], axis=1)[:, None] / 5
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, err = e.quantise(u)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None]
    bound = (1 + err)[:, None] * err[None] + err[:, None]
    assert (np.abs(u @ u.T - approx) <= bound).all()
    for t in (0.5, 0.9, 0.99):
        parts = list(e.candidates((q, s, err), None, t))
        i, j, sure = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        want = {tuple(w) for w in np.argwhere(np.triu(u @ u.T >= t, 1))}
        have, certain = set(zip(i.tolist(), j.tolist())), set(zip(i[sure].tolist(), j[sure].tolist()))
        assert certain <= want <= have and len(have) < 45_000
        near = e.cosines(x[i], x[j]) >= t
        assert set(zip(i[near].tolist(), j[near].tolist())) == want


def test_spanning_links():
    i, j = np.triu_indices(6, 1)
    tree = e.Spanning(6)
    tree.add(i, j)
    assert len(tree.kept) == 5
    r = np.random.default_rng(2)
    for _ in range(30):
        i = np.sort(r.integers(0, 30, 20))
        j = r.integers(0, 30, 20)
        tree, root = e.Spanning(30), list(range(30))
        tree.add(i[:9], j[:9])
        tree.add(i[9:], j[9:])

        def labels(pairs):
            root = list(range(30))
            for a, b in pairs:
                root = [root[a] if x == root[b] else x for x in root]
            return [root.index(x) for x in root]

        assert labels(tree.kept) == labels(zip(i, j)) and len(tree.kept) == 30 - len(set(labels(zip(i, j))))


def test_a_dense_tile_is_done_in_parts():
    x = np.random.default_rng(3).normal(size=16) + np.random.default_rng(4).normal(size=(3000, 16)) * 0.01
    counts, tree = np.zeros(3000, int), e.Spanning(3000)
    side = e.quantise(x / np.linalg.norm(x, axis=1)[:, None])
    for i, j, sure in e.candidates(side, None, 0.9):
        assert len(i) <= 1 << 20 and sure.all()
        np.add.at(counts, i, 1)
        np.add.at(counts, j, 1)
        tree.add(i, j)
    assert (counts == 2999).all() and len(tree.kept) == 2999


def test_pairs_at_the_threshold(spark):
    """Pairs that the bounds can't decide go through full precision: cosines just above and below."""
    r = np.random.default_rng(6)
    rows = []
    for k in range(40):
        a = r.normal(size=32)
        a /= np.linalg.norm(a)
        b = r.normal(size=32)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = 0.9 + (1e-5 if k % 2 else -1e-5)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {x.vec_id: x.n_links for x in e.near_vectors(df, block_rows=16).collect()}
    assert all(out[2 * k] == out[2 * k + 1] == k % 2 for k in range(40))
