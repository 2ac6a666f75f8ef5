"""Graph search: recall and exact scores against brute force."""

import numpy as np

from fixtura.llm import neighbours as N
from fixtura.llm.queries import QUERIES


def brute(ids, vectors, query, q, k):
    d = np.sqrt(((vectors - q) ** 2).sum(axis=1))
    order = np.lexsort((ids, d))
    return [(int(ids[i]), float(d[i])) for i in order if ids[i] != query][:k]


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    got = QUERIES["op7_nearest_neighbours"](spark, sf).toPandas()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        own = got[got.query_id == q].sort_values("rank")
        want = brute(ids, x, q, x[ids == q][0], 10)
        assert own["rank"].tolist() == list(range(1, 11)) and q not in own.vec_id.tolist()
        exact = np.sqrt(((x[np.searchsorted(np.sort(ids), own.vec_id)][:, :] - x[ids == q][0]) ** 2).sum(axis=1)) if (np.diff(ids) > 0).all() else own.score
        assert np.allclose(own.score, exact) and own.score.is_monotonic_increasing
        hits += len({i for i, _ in want} & set(own.vec_id))
        total += 10
    assert hits / total >= 0.9


def test_shards_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD_VECTORS", 40)
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=5).tolist() for _ in range(150)]
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[7]) for i in range(60)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 5), (2003, [1.0, None, 1.0, 1.0, 1.0]), (2004, [float("nan")] + [1.0] * 4), (2005, [float("inf")] + [1.0] * 4), (None, vectors[3])]
    other = [(3000, [1.0, 2.0]), (3001, [1.0, 2.5]), (3000, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows + bad + other], "player_id long, attributes array<double>, node string, rank int")
    asked = df.where("player_id % 10 = 0 OR player_id >= 2000 OR player_id IS NULL")
    got = {}
    for r in N.nearest_players(df, asked, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.player_id, r.score))
    ids, x = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    queries = [k for k, _ in rows if k % 10 == 0]
    assert set(got) == set(queries) | {3000, 3001}
    assert [i for i, _ in got[3000]] == [3001] and [i for i, _ in got[3001]] == [3000]
    hits = 0
    for q in queries:
        want = brute(ids, x, q, x[ids == q][0], 10)
        assert len(got[q]) == 10
        hits += len(set(i for i, _ in want) & set(i for i, _ in got[q]))
        if q >= 1000:
            assert [i for i, _ in got[q]] == [i for i, _ in want]
    assert hits / (10 * len(queries)) >= 0.9
    assert N.nearest_players(df.limit(0), asked, 10).count() == 0 and N.nearest_players(df, asked.limit(0), 10).count() == 0


def test_graph_of_one_and_flat_arrays():
    one = N.build_graph(np.ones((1, 3)), 0)
    assert N.search_graph(one, np.zeros(3), 5, np.full(1, -1, np.int64), 0)[0] == [0]
    g = N.build_graph(np.random.default_rng(0).normal(size=(300, 8)), 0)
    assert g.ground.shape[0] == 300 and all((links < 300).all() for _, links in g.upper) and (g.ground[:, 0] >= 0).all()
