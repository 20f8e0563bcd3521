"""Heights and components of large graphs: whole breadths at a time, with the answers of plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from codehealth.operators import graph
from codehealth.plans import table_queries
from codehealth.session import cut

FOLDER = "/root/testdata/sf0.01"


def random_dag(seed, n, m):
    """Edges, some of them twice, along a random order of the nodes; the order."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, n, (2, m))
    order = rng.permutation(n)
    keep = order[a] < order[b]
    return np.append(a[keep], a[keep][:5]).astype(np.int32), np.append(b[keep], b[keep][:5]).astype(np.int32), order


@pytest.mark.parametrize("n, m", [(1, 0), (5, 6), (40, 60), (60, 900), (3000, 20_000), (300, 40_000)])
@pytest.mark.parametrize("floor", [False, True])
def test_heights_by_layers_are_those_of_a_loop(n, m, floor):
    src, dst, order = random_dag(n, n, m)
    known = np.random.default_rng(m).integers(0, 9, n) if floor else np.zeros(n, int)
    want = known.copy()
    for k in sorted(range(len(src)), key=lambda k: -order[src[k]]):
        want[src[k]] = max(want[src[k]], want[dst[k]] + 1)
    ids, height = graph.path_heights(pa.array(range(n)), src, dst, known if floor else None)
    assert ids.to_pylist() == list(range(n)) and height.to_pylist() == want.tolist()


def test_a_cycle_has_no_heights():
    src = np.arange(100, dtype=np.int32)
    with pytest.raises(RuntimeError, match="cycle"):
        graph.path_heights(pa.array(range(101)), np.append(src, 100), np.append(src + 1, 50))


def test_edges_are_numbered_in_chunks(monkeypatch):
    monkeypatch.setattr(graph, "CHUNK_EDGES", 30)
    sizes, plain = [], graph.coded
    monkeypatch.setattr(graph, "coded", lambda edges: sizes.append(len(edges)) or plain(edges))
    names = [f"n{k:03}" for k in range(101)]
    rows = [pa.RecordBatch.from_pydict({"src": names[k : k + 10], "dst": names[k + 1 : k + 11]}) for k in range(90, -1, -10)]
    found = pa.Table.from_batches(list(graph.one_block(graph.path_heights, ["id", "height"])(iter(rows)))).to_pydict()
    assert found == {"id": names, "height": list(range(100, -1, -1))} and sizes == [30, 30, 30, 10]


def test_gate_diff_deals_no_blocks(spark, monkeypatch):
    want = table_queries.gate_diff(spark, FOLDER).collect()
    monkeypatch.setattr(graph, "TASK_EDGES", 1000)
    monkeypatch.setattr(graph, "in_blocks", lambda *a: pytest.fail("blocks"))
    assert table_queries.gate_diff(spark, FOLDER).collect() == want


def test_blocks_beyond_one_task(spark, monkeypatch):
    want = table_queries.max_depth(spark, FOLDER).first()
    rounds = []
    monkeypatch.setattr(graph, "TASK_EDGES", 1000)
    monkeypatch.setattr(graph, "HEIGHT_EDGES", 1000)
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    assert table_queries.max_depth(spark, FOLDER).first() == want and 3 < len(rounds) < 40


def searched(n, src, dst, monkeypatch):
    """The components, and how many edges are left for the depth-first search."""
    left, plain = [], graph.rows_of
    with monkeypatch.context() as m:
        m.setattr(graph, "rows_of", lambda n, src, dst: left.append(len(src)) or plain(n, src, dst))
        return graph.last_nodes(n, src, dst).tolist(), left[-1]


def test_large_components_need_no_depth_first_search(monkeypatch):
    rng = np.random.default_rng(2)
    part = rng.integers(0, 6, 60_000)
    src, dst = part * 500 + rng.integers(0, 500, (2, 60_000))
    scc, left = searched(3000, src, dst, monkeypatch)
    assert scc == [v // 500 * 500 + 499 for v in range(3000)] and left == 0


@pytest.mark.parametrize("seed", range(40))
def test_components_are_those_of_the_depth_first_search(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 200))
    src, dst = rng.integers(0, n, (2, int(rng.integers(0, 4 * n)))).astype(np.int32)
    src, dst = src[src != dst], dst[src != dst]
    got = graph.last_nodes(n, src, dst)
    monkeypatch.setattr(graph, "PIVOTS", 0)
    assert got.tolist() == graph.last_nodes(n, src, dst).tolist()


def test_scores_are_one_task(spark):
    assert table_queries.health(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 1
