import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrain.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<float>, label int"
EVERY = "pmod(vec_id, 50) = 0"


def exact(rows, k, picks):
    """Best k of each picked id by brute force: (query, rank, id, score)."""
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v):
            usable.setdefault(i, np.asarray(v, np.float32).astype(float))
    out = []
    for q in sorted(i for i in usable if picks(i)):
        a = usable[q]
        scores = [(-float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in usable.items() if i != q]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((round(s, 12), i) for s, i in scores)[:k])]
    return out


def result(df, **kw):
    got = nn.nearest(df, kw.pop("picks", EVERY), **kw).orderBy("query_id", "rank").collect()
    return [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in got]


def rows_of(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    return df, [(r["vec_id"], r["embedding"]) for r in df.collect()]


def test_recall_on_the_given_vectors(spark):
    df, rows = rows_of(spark, "sf0.1")
    want = exact(rows, 5, lambda i: i % 50 == 0)
    got = result(df)
    near = {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want)
    assert len(near & {(q, i) for q, _, i, _ in got}) >= 0.93 * len(near)
    score = {i: np.asarray(v, float) for i, v in rows}
    for q, _, i, s in got:
        a, b = score[q], score[i]
        assert abs(s - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-11


def test_recall_with_many_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + rng.normal(size=24)).tolist(), 0) for i in range(12_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    picks = "pmod(vec_id, 200) = 0"
    want = exact([r[:2] for r in rows], 5, lambda i: i % 200 == 0)
    near = {(q, i) for q, _, i, _ in want}
    got = {(q, i) for q, _, i, _ in result(df, picks=picks)}
    assert len(near & got) >= 0.9 * len(near)


def test_copies_and_scaled_vectors_tie_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(700)] + [(1000 + i, [2.0, 4.0, 6.0], 0) for i in range(300)]
    rows += [(2000, [1.0, 2.0, 3.5], 0), (2000, [1.0, 2.0, 3.5], 0)]
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert [g[2] for g in got if g[0] == 0] == [1, 2, 3, 4, 5]
    assert [g[2] for g in got if g[0] == 50] == [0, 1, 2, 3, 4]
    assert [g[2] for g in got if g[0] == 2000] == [0, 1, 2, 3, 4]
    assert all(abs(g[3] - 1) < 1e-12 for g in got if g[0] < 2000)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0])]
    rows += [(50, [0.0, 0.0]), (100, [-1.0, 0.0]), (7, [0.5, 0.5]), (150, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).withColumn("rank", F.lit("x")).withColumn("key", F.lit(1))
    # fewer candidates than k: all of them, however far
    assert [g[:3] for g in result(df)] == [(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)]
    assert result(df.limit(0)) == [] and result(df.filter("vec_id = 0")) == []
    assert result(df.filter("vec_id in (2, 1)")) == []


def test_far_queries_fall_back_to_all_vectors(spark):
    rng = random.Random(1)
    rows = [(i * 50 + 1, [rng.gauss(0, 1) + 9.0, rng.gauss(0, 1)], 0) for i in range(400)] + [(50, [-1.0, 0.01], 0), (100, [-1.0, -0.2], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [w[:3] for w in exact([r[:2] for r in rows], 5, lambda i: i % 50 == 0)]
    assert [g[:3] for g in result(df, tables=1, probes=1, width=0.05)] == want


def test_probes_come_by_expected_distance():
    sets = nn.probe_sets(6, 40)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == 40
    assert all(11 - r not in s for s in sets for r in s)
    hashes = nn.Tables(8, 6)
    units = nn.units_of(np.random.default_rng(0).normal(size=(50, 8)))
    own, probed = hashes.own(units), hashes.probed(units, sets)
    assert all((probed[t * 40] == own[t]).all() for t in range(len(hashes)))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blocks_of_heavy_buckets_lose_nothing(spark, monkeypatch, kind):
    monkeypatch.setattr(nn, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(i, (np.array([5.0, 0, 0]) + 0.1 * rng.normal(size=3)).tolist(), 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", kind))
    want = [w[:3] for w in exact([r[:2] for r in rows], 5, lambda i: i % 50 == 0)] if kind == "float" else None
    got = [g[:3] for g in result(df, tables=8, probes=8)]
    assert len(got) == 50 and (want is None or sum(a in want for a in got) >= 48)


def planted(rows, queries, cosine, rng):
    """``queries`` unit vectors, each with five neighbours of that cosine, amid ``rows`` random ones."""
    q = nn.units_of(rng.normal(size=(queries, 48)))
    side = rng.normal(size=(queries, 5, 48))
    side -= (side * q[:, None]).sum(axis=2, keepdims=True) * q[:, None]
    near = cosine * q[:, None] + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=2, keepdims=True)
    return q, near.reshape(-1, 48), rng.normal(size=(rows, 48))


@pytest.mark.parametrize("rows", [51_282, 250_000, 3_000_000])
def test_directions_hold_recall_at_any_number_of_rows(rows):
    q, near, _ = planted(0, 400, 0.45, np.random.default_rng(11))
    pairs = np.repeat(q, 5, axis=0), near
    functions = nn.directions(rows, pairs[0][:1000], pairs[1][:1000], nn.TABLES, nn.PROBES, nn.WIDTH, nn.SEED)
    hashes = nn.Tables(48, functions)
    assert nn.recalled(pairs[0][1000:], pairs[1][1000:], hashes, nn.probe_sets(functions, nn.PROBES)) >= 0.9


@pytest.mark.parametrize("most", [6, 10])
def test_recall_does_not_fall_with_the_directions(spark, monkeypatch, most):
    monkeypatch.setattr(nn, "functions_for", lambda rows: most)  # as for 10 thousand and 5 million rows
    q, near, other = planted(4000, 40, 0.5, np.random.default_rng(12))
    vectors = np.concatenate([near, other])
    ids = [i for i in range(1, 10_000) if i % 50][: len(vectors)]
    rows = [(50 * i, v.tolist(), 0) for i, v in enumerate(q)] + [(i, v.tolist(), 0) for i, v in zip(ids, vectors)]
    want = {w[::2][:2] for w in exact([r[:2] for r in rows], 5, lambda i: i % 50 == 0)}
    got = {g[::2][:2] for g in result(spark.createDataFrame(rows, SCHEMA))}
    assert len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize("rows", [2_000, 51_282, 3_000_000])
@pytest.mark.parametrize("cosine", [0.45, 0.6, 0.9])
def test_the_chosen_setting_is_cheaper_than_all_pairs(rows, cosine):
    rng = np.random.default_rng(13)
    q, near, other = planted(4000, 300, cosine, rng)
    q, other = np.repeat(q, 5, axis=0), nn.units_of(other)
    chosen = nn.cheapest(rows, q[:1000], near[:1000], other[:2048], nn.SEED)
    if chosen is None:
        assert cosine < 0.5
        return
    hashes, sets = nn.Tables(48, chosen.functions, chosen.tables, chosen.width), nn.probe_sets(chosen.functions, chosen.probes)
    share = nn.visited(q[1000:], other, hashes, sets)
    assert share < 1 and (cosine < 0.9 or share < 0.3)
    assert nn.recalled(q[1000:], near[1000:], hashes, sets) >= 0.9


def test_one_table_compares_no_pair_twice():
    rng = np.random.default_rng(14)
    units = nn.units_of(rng.normal(size=(500, 16)))
    hashes, sets = nn.Tables(16, 4, 1), nn.probe_sets(4, 64)
    own, probed = hashes.own(units), hashes.probed(units[:50], sets)
    times = (own[0][:, None, None] == probed[None]).sum(axis=1)
    assert times.max() == 1
    assert abs(nn.visited(units[:50], units, hashes, sets) - times.mean()) < 1e-12


def test_neighbours_like_any_other_vector_mean_all_pairs():
    rng = np.random.default_rng(15)
    units = nn.units_of(rng.normal(size=(3000, 64)))
    assert nn.cheapest(50_000, units[:500], units[500:1000], units[1000:], nn.SEED) is None
    assert nn.cheapest(0, units[:0], units[:0], units[:0], nn.SEED) is None
