import numpy as np

from tests.llm.plain import roots
from vitrina.llm.vectors import near_vectors, passes_for, passes_needed


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int")


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 24))
    rows = []
    for c in range(6):
        for _ in range(40 if c else 300):
            rows.append((len(rows), (centre[c] + 0.28 * rng.standard_normal(24)).tolist()))
    rows += [(len(rows) + k, rng.standard_normal(24).tolist()) for k in range(200)]
    same = rows[0][1]
    rows += [(5_000 + k, same) for k in range(50)]
    odd = [(6_000, None), (6_001, [0.0] * 24), (6_002, [float("nan")] + [1.0] * 23), (6_003, [None] + [1.0] * 23),
           (6_004, [float("inf")] * 24), (6_005, []), (6_006, same[:5]), (None, same), (6_007, [v * 1e200 for v in same])]
    got = {r["vec_id"]: r for r in near_vectors(table(spark, rows + odd + [rows[0]])).collect()}
    good = rows + [odd[-1]]
    ids = [i for i, _ in good]
    x = np.array([v for _, v in good])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    want = roots(ids, [(ids[p], ids[q]) for p, q in zip(a, b) if p < q])
    assert len(got) == len(rows) + len(odd)
    assert {i: got[i]["component_id"] for i in ids} == want
    assert {i: got[i]["n_links"] for i in ids} == dict(zip(ids, hit.sum(axis=1).tolist()))
    for i, _ in odd[:-1]:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]


def test_chain_of_vectors(spark):
    """A component much wider than the threshold: counts outside the centre's ball."""
    angle = np.arange(0, 180, 5) * np.pi / 180
    rows = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(angle)]
    got = {r["vec_id"]: r for r in near_vectors(table(spark, rows)).collect()}
    for i, t in enumerate(angle):
        assert got[i]["component_id"] == 0
        assert got[i]["n_links"] == int((np.cos(angle - t) >= 0.9).sum()) - 1


def test_empty_and_unusable(spark):
    assert near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors(table(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_passes_grow_with_the_table():
    assert passes_needed(10, 0.9, 128, 0.999) <= passes_needed(10**6, 0.9, 128, 0.999) < passes_needed(10**9, 0.9, 128, 0.999)


def test_recall_on_a_cone(spark):
    """Vectors about one direction, as embeddings of texts are: pairs must still meet."""
    rng = np.random.default_rng(7)
    n, dim, n_pairs = 4_000, 48, 300
    axis = np.eye(dim)[0]

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    def across(v, k):
        w = rng.standard_normal((k, dim))
        return unit(w - (w * v).sum(axis=1, keepdims=True) * v)

    x = np.sqrt(0.7) * axis + np.sqrt(0.3) * across(axis, n)
    # Partners at cosine 0.902 that stay as near the axis as the others.
    side = across(axis, n_pairs)
    own = unit(x[:n_pairs] - np.sqrt(0.7) * axis)
    side = unit(side - (side * own).sum(axis=1, keepdims=True) * own)
    near = (0.902 - 0.7) / 0.3
    x[n_pairs : 2 * n_pairs] = np.sqrt(0.7) * axis + np.sqrt(0.3) * (near * own + np.sqrt(1 - near**2) * side)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    want = roots(range(n), [(p, q) for p, q in zip(a.tolist(), b.tolist()) if p < q])
    got = {r["vec_id"]: r["component_id"] for r in near_vectors(table(spark, rows), window=8).collect()}
    linked = [i for i in range(n) if want[i] != i]
    assert len(linked) >= n_pairs
    assert sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)


def test_passes_from_chances():
    assert passes_for([(0.5, 10)], 0.999) == 10 and passes_for([(1.0, 5)], 0.999) == 1
    assert passes_for([(0.5, 9_000), (0.01, 1_000)], 0.999) > 400
    assert passes_for([(0.0, 1)], 0.999) is None
