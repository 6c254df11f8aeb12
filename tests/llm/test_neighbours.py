"""Nearest neighbours against a comparison with all rows, and on copies, ties, odd vectors, several shards and empty tables."""

import numpy as np
import pytest

from sheaf.llm import hnsw, neighbours
from sheaf.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, ids string, _v int"


def exact(rows, every=20, k=20):
    """query: [(score, id)], by all products in double precision."""
    fine = sorted({(-(1 << 63) if i is None else i, tuple(v)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, v in fine:
        if q % every == 0 and q != -(1 << 63):
            near = [(-float(np.dot(v, w)), i) for i, w in fine if i != q and len(w) == len(v)]
            out[q] = sorted(near)[:k]
    return out


def of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append((r["rank"], -(1 << 63) if r["vec_id"] is None else r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def recall_of(found, true):
    return sum(len({i for _, i, _ in found.get(q, [])} & {i for _, i in x}) for q, x in true.items()) / sum(map(len, true.values()))


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    vectors, true = {i: np.asarray(v, float) for i, v in rows}, exact(rows)
    answer = QUERIES["op11_neighbours"](spark, sf)
    found = of(answer.collect())
    assert set(found) == set(true) and recall_of(found, true) >= 0.95
    for q, mine in found.items():
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in {i for _, i, _ in mine} and len({i for _, i, _ in mine}) == 20
        assert all(s == pytest.approx(float(vectors[q] @ vectors[i]), abs=1e-12) for _, i, s in mine)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:]))
    measured = neighbours.recall(table, answer).first()
    assert measured["n_queries"] == len(true) and measured["recall"] == pytest.approx(recall_of(found, true), abs=1e-6)


def clustered(rng, n, d=16):
    """Vectors of different length: groups of near ones, and single ones."""
    centres = rng.normal(size=(8, d))
    return np.vstack([centres[rng.integers(0, 8, n // 2)] + 0.01 * rng.normal(size=(n // 2, d)), rng.normal(size=(n - n // 2, d))]) * rng.uniform(0.5, 3, (n, 1))


def test_several_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(rng, 1200))]
    df = spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA).repartition(4)
    all_rows = neighbours.valid(df)
    points = neighbours.points(all_rows, 21)
    index = neighbours.build_index(points, shard_rows=200)
    assert index.count() == 6 and sum(len(r["ids"]) // 8 for r in index.collect()) == 1200  # every row is indexed
    asked = points.where("ids[0] % 20 = 0").select("_h", "_g", "_v")
    many = {(r["_h"], r["_g"]): [(x["_id"], x["score"]) for x in r["found"]] for r in neighbours.nearest(index, asked, 21, block_rows=10).collect()}
    assert len(many) == 60 and all(len(x) == 21 for x in many.values())
    true = exact(rows)
    ids = {(r["_h"], r["_g"]): r["ids"][0] for r in points.collect()}
    hit = sum(len({i for i, _ in x} & {i for _, i in true[ids[k]]}) for k, x in many.items())
    assert hit >= 0.95 * 20 * 60


def test_copies_are_one_point(spark):
    """A third of all rows is one vector: its neighbours are its copies with the smallest ids, its own row left out."""
    rng = np.random.default_rng(2)
    others = [(1000 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))]
    one = (3 * np.ones(8)).tolist()
    rows = [(i, one) for i in range(100)] + others
    df = spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA)
    assert neighbours.points(neighbours.valid(df), 21).count() == 201
    found, true = of(neighbours.neighbour_report(df).collect()), exact(rows)
    assert [i for _, i, _ in found[0]] == list(range(1, 21)) and [i for _, i, _ in found[80]] == list(range(20)) and set(found) == set(true)
    assert recall_of(found, true) >= 0.99


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(45, 4)))]
    odd = [(60, None), (80, [0.0] * 4), (100, [1.0, None, 2.0, 3.0]), (120, [float("nan"), 1.0, 1.0, 1.0]), (140, [float("inf"), 1.0, 1.0, 1.0]), (160, []), (None, [9.0, 9.0, 9.0, 9.0]), (180, [1.0, 2.0]), (200, [3.0, 1.0]), (201, [-0.0, 1.0]), (202, [0.0, 1.0])]
    rows = [*good, *odd, good[0], good[7], good[7]]
    found, true = of(neighbours.neighbour_report(spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA).repartition(3)).collect()), exact(rows)
    assert set(found) == set(true) == {0, 20, 40, 180, 200}
    assert {q: [i for _, i, _ in x] for q, x in found.items()} == {q: [i for _, i in x] for q, x in true.items()}  # so few that all are found
    assert len(found[180]) == 3 and neighbours.neighbour_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fewer_candidates_than_wanted(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 0), (1, [0.5, 0.5], 0, "", 0)], SCHEMA)
    assert [tuple(r) for r in neighbours.neighbour_report(df).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.neighbour_report(df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 700, 3000])
def test_graph(n):
    rng = np.random.default_rng(n)
    vectors = clustered(rng, n) if n > 1 else rng.normal(size=(1, 16))
    graph = hnsw.build(vectors)
    links = graph.levels[0]
    assert links.shape == (n, 2 * hnsw.M) and all(len(x) <= len(y) for x, y in zip(graph.levels[1:], graph.levels))
    for level in graph.levels:
        assert all((row[row >= 0] != i).all() and len(set(row[row >= 0])) == (row >= 0).sum() and (row < len(level)).all() for i, row in enumerate(level))
    queries = rng.normal(size=(50, 16))
    at, _ = graph.search(queries, neighbours.WIDTH)
    k = min(20, n)
    true = np.argsort(-(queries @ vectors.T), axis=1)[:, :k]
    assert np.mean([len(set(a[:k]) & set(t)) / k for a, t in zip(at, true)]) >= 0.95
