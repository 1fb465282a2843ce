"""Embedding links beside a hot group, against brute force; the audit's demands."""

import numpy as np
import pytest

from strandline.llm import hnsw


def beside_a_hot_group(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    k, h = n * 4 // 10, n // 10
    x[:k] = x[k : 2 * k] + r.normal(size=(k, 64)) * 0.42  # pairs of about 0.91
    x[-h:] = x[-1] + r.normal(size=(h, 64)) * 0.25
    return x[r.permutation(n)]


@pytest.mark.parametrize("config", [hnsw.NearConfig(shards=3), hnsw.NearConfig(shards=2, part_points=900, block=100)])
def test_links_of_both_ends_beside_a_hot_group(spark, config):
    x = beside_a_hot_group(2200, 1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    got = hnsw.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), config).toPandas().sort_values("vec_id")
    want = linked.sum(axis=1) - 1
    # Each pair found counts at both ends; a pair that is missed is missed at both.
    assert (got.n_links.to_numpy() <= want).all() and got.n_links.sum() % 2 == 0
    assert got.n_links.sum() >= 0.999 * want.sum() and ((want > 0) & (got.n_links.to_numpy() == 0)).sum() <= 2
    assert got.audit_recall.iloc[0] >= 0.99 and got.audit_worst.iloc[0] >= 0.8
    lone = got[got.n_links == 0]
    assert (lone.component_id == lone.vec_id).all()


def test_a_poor_audit_widens_the_beam_and_searches_again():
    x = beside_a_hot_group(1500, 2)
    config = hnsw.NearConfig(beam=1, audit=64, first_audit=5)
    shard = hnsw._Shard([(i, 1, v) for i, v in enumerate(x)], config)
    beams = []
    for at in range(0, 1500, 250):
        shard.search([(10_000 + i, 1, v) for i, v in enumerate(x[at : at + 250], at)])
        beams.append(shard.beam)
    assert beams[-1] > beams[0] >= 1 and len(shard.blocks) == len(shard.counts) == 6
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1)
    found = {int(i): int(c) for ids, counts in shard.counts for i, c in zip(ids, counts)}
    share = np.array([found.get(10_000 + i, 0) / want[i] for i in range(1500)])
    assert share.mean() >= 0.99


def test_what_hangs_on_leaders_is_all_there():
    x = hnsw._unit(beside_a_hot_group(1200, 3))
    graph = hnsw.Graph(x, hnsw.NearConfig())
    assert sorted(np.concatenate([graph.lead, graph.hung]).tolist()) == list(range(1200)) and graph.size < 1200
    for node in range(graph.size):
        hung = graph.hung[graph.start[node] : graph.start[node + 1]]
        assert (x[hung] @ x[graph.lead[node]] >= 0.9 - 1e-4).all()
    row, to = graph.over(x.astype(np.float32), 10_000)
    assert len(row) == (x.astype(np.float32) @ x.astype(np.float32).T >= np.float32(0.8999)).sum()
