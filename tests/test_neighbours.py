"""The neighbour graph against all pairs."""

import numpy as np
import pytest

from corpuslens.operators import neighbours as B

SCHEMA = "repo string, chunk_id long, file_path string, embedding array<float>"


def table(spark, vectors):
    rows = [(f"r{i % 3}" if i % 7 else None, i, f"f{i}.py", v if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def recall(vectors, rows, k):
    """Share of the k best other texts of every row that were found, by score, since equal scores are as good."""
    m = np.asarray(vectors, np.float32).astype(np.float64)
    distinct, first, own = np.unique(m, axis=0, return_index=True, return_inverse=True)
    unit = distinct / np.linalg.norm(distinct, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    found = {}
    for r in rows:
        assert r.similar_id == first[own[r.similar_id]] and own[r.similar_id] != own[r.chunk_id]
        assert r.n_equal == (own == own[r.chunk_id]).sum()
        assert abs(r.score - score[own[r.chunk_id], own[r.similar_id]]) < 2e-6
        found.setdefault(r.chunk_id, []).append(r.score)
    hit = total = 0
    for i in range(len(m)):
        best = np.sort(score[own[i]])[::-1][: min(k, len(distinct) - 1)]
        assert len(found[i]) == len(best)
        total += len(best)
        hit += sum(s >= best[-1] - 2e-6 for s in found[i])
    return hit / total


@pytest.mark.parametrize("kind", ["clusters and copies", "no clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 16))
    if kind != "no clusters":
        centre = rng.normal(size=(12, 16))
        vectors = centre[rng.integers(12, size=900)] + 0.1 * rng.normal(size=(900, 16))
        vectors = np.vstack([vectors, np.repeat(vectors[:1], 450, axis=0)])[rng.permutation(1350)]
    df = table(spark, vectors)
    got = B.similar_code(df, 5).collect()
    assert recall(vectors, got, 5) >= 0.95


def test_work_grows_with_the_rows(spark):
    """Pairs that a round looks at are bounded by rows times a list times its offers, and no plan pairs all rows."""
    df = table(spark, np.random.default_rng(5).normal(size=(600, 8)))
    nodes, _ = B.nodes_of(df, 8)
    nodes = B.cut_lineage(nodes)
    lists = B.top_per_group(B.start_lists(nodes, 8, 1), ["node"], B.by_score(), 6).withColumn("fresh", B.F.lit(True))
    found = B.grow(lists, nodes, 6, 0)
    assert found.count() <= 600 * 12 * B.OFFERS
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_odd_vectors_few_rows_and_empty_tables(spark):
    vectors = [[1, 0], [1, 0], [0, 1], None, [], [0, 0], [1], [None, 1], [float("nan"), 1]]
    df = table(spark, vectors)
    got = sorted((r.chunk_id, r.n_equal, r["rank"], r.score, r.similar_id) for r in B.similar_code(df).collect())
    assert got == [(0, 2, 1, 0.0, 2), (1, 2, 1, 0.0, 2), (2, 1, 1, 0.0, 0)]
    assert B.similar_code(df.limit(0)).collect() == []
    assert B.similar_code(table(spark, [[1, 2]])).collect() == []


def plain_round(spark, lists, units, length, turn):
    """One round over dictionaries: the lists {node: {other: (score, fresh)}} that follow."""
    back = {}
    for node, own in lists.items():
        for other, (_, fresh) in own.items():
            back.setdefault(other, []).append((node, fresh))
    pairs = [(node, other) for node, named in back.items() for other, _ in named]
    hashed = spark.createDataFrame(pairs, "node long, other long").select("node", "other", B.F.xxhash64("node", "other", B.F.lit(turn)))
    drawn = {(r[0], r[1]): r[2] for r in hashed.collect()}
    score = {}
    for node in units:
        met = {}
        for other, (_, fresh) in lists.get(node, {}).items():
            met[other] = met.get(other, False) or fresh
        for other, fresh in sorted(back.get(node, []), key=lambda x: (not x[1], drawn[node, x[0]], x[0]))[:length]:
            met[other] = met.get(other, False) or fresh
        for a in met:
            own = lists.get(a, {})
            last = min(s for s, _ in own.values()) if len(own) >= length else -2
            offered = []
            for b in met:
                if a != b and (met[a] or met[b]):
                    s = round(float(units[a] @ units[b]), B.DIGITS)
                    if s > last:
                        offered.append((-s, b))
            for s, b in sorted(offered)[: B.OFFERS]:
                score.setdefault(a, {})[b] = -s
    after = {}
    for node in units:
        every = {b: (s, True) for b, s in score.get(node, {}).items()}
        every.update({b: (s, False) for b, (s, _) in lists.get(node, {}).items()})
        after[node] = dict(sorted(every.items(), key=lambda x: (-x[1][0], x[0]))[:length])
    return after


def lists_of(state):
    found = {}
    for r in state.toArrow().to_batches():
        for i in range(r.num_rows):
            node, size, other, score, fresh = B.values(r.slice(i, 1), "node", "size", "other", "score", "fresh")
            at = np.repeat(node, size)
            for n in node:
                mine = at == n
                found[int(n)] = dict(zip(other[mine].tolist(), zip((score[mine] / B.UNIT).tolist(), fresh[mine].tolist())))
    return found


@pytest.mark.parametrize("parts", [1, 5])
def test_rounds_are_those_of_plain_python(spark, parts):
    """Clusters have hubs, so draws, the bound of offers and the cut of what is sent to one node all matter."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(4, 6))
    vectors = np.vstack([centre, centre[rng.integers(4, size=156)] + 0.2 * rng.normal(size=(156, 6))])
    nodes, _ = B.nodes_of(table(spark, vectors), 6)
    nodes = B.cut_lineage(nodes)
    units = {r.node: np.asarray(r.unit, np.float64) for r in nodes.collect()}
    starts = B.cut_lineage(B.start_lists(nodes, 6, 1).withColumn("fresh", B.F.lit(True)))
    steps = B.Parts(parts, 6, 10)
    state = B.cut_lineage(steps.held(nodes, starts))
    every = {n: {} for n in units}
    for r in starts.collect():
        every[r.node][r.other] = (r.score, True)
    want = {n: dict(sorted(own.items(), key=lambda x: (-x[1][0], x[0]))[:10]) for n, own in every.items()}
    assert lists_of(state) == want
    for turn in range(3):
        state = B.cut_lineage(steps.merged(state, steps.offers(state, turn)))
        want = plain_round(spark, want, units, 10, turn)
        assert lists_of(state) == want


def test_steps_cost_rows_and_calls_in_the_parts(spark):
    """Parts send each other packed arrays; no step calls Python for each node or moves a row for each pair."""
    df = table(spark, np.random.default_rng(7).normal(size=(900, 8)))
    nodes, _ = B.nodes_of(df, 8)
    nodes = B.cut_lineage(nodes)
    lists = B.start_lists(nodes, 8, 1).withColumn("fresh", B.F.lit(True))
    plan = B.grow(lists, nodes, 6, 0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "hashpartitioning(node" not in plan and "hashpartitioning(other" not in plan
    steps = B.Parts(4, 8, 6)
    state = B.cut_lineage(steps.held(nodes, lists))
    assert state.count() == 4
    assert steps.offers(state, 0).count() <= 4 * 4


def test_scores_of_a_pair_that_differ_in_the_last_digit(spark):
    node, other = np.array([3, 3, 3, 3]), np.array([9, 9, 8, 9])
    got = B.best_of(node, other, np.array([70, 71, 70, 71]), np.array([False, True, True, True]), 2)
    assert [c.tolist() for c in got] == [[3, 3], [9, 8], [71, 70], [False, True]]


def test_small_parts_wide_lists_and_few_rows_in_a_range(spark):
    rng = np.random.default_rng(8)
    for rows in (2, 3, 5, 9):
        vectors = rng.normal(size=(rows, 4))
        assert recall(vectors, B.similar_code(table(spark, vectors), 30).collect(), 30) == 1
