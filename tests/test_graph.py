import random

import pyarrow as pa
import pytest

from codehealth.operators import graph as G
from codehealth.operators import graph, links, resolve, stats
from codehealth.operators.ordering import placed
from codehealth.plans import table_queries
from codehealth.session import cut


def frame(spark, edges):
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(edges)], "src long, dst long, seq long")


def nodes(spark, n, modules=None):
    return spark.createDataFrame([(k, k, (modules or {}).get(k, "m"), False) for k in range(n)], "id long, ord long, module string, named boolean")


@pytest.mark.parametrize("edges, cycles", [([(0, 1), (1, 2), (2, 0)], 1), ([(0, 0)], 0), ([(0, 1), (1, 0), (2, 3), (3, 2)], 2), ([(0, 1), (0, 1), (1, 0), (1, 0)], 1), ([(0, 1), (1, 2)], 0), ([], 0)])
def test_cycles(spark, edges, cycles):
    assert G.components(frame(spark, edges)).select("scc").distinct().count() == cycles


def tarjan(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, [])
    reach = {}
    for a in near:
        seen, todo = set(), [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    groups = {a: frozenset(b for b in near if b in reach[a] and a in reach[b]) for a in near}
    return {a: max(g) for a, g in groups.items() if len(g) > 1}


def test_components_against_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)]
    assert {r["id"]: r["scc"] for r in G.components(frame(spark, edges)).collect()} == tarjan(edges)


def starts(spark, ids):
    return spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, ord long")


@pytest.mark.parametrize(
    "edges, begin, want",
    [([(0, 1), (1, 2), (2, 3), (0, 3)], [0], (3, [0, 1, 2, 3])), ([(0, 1), (0, 2), (1, 3), (2, 3)], [0], (2, [0, 1, 3])), ([], [5], (0, [5])), ([(9, 1)], list(range(10)), (1, [9, 1]))],
)
def test_longest_paths(spark, edges, begin, want):
    assert G.longest_path(starts(spark, begin), frame(spark, edges), True) == want
    assert G.longest_path(starts(spark, begin), frame(spark, edges), False) == want


def recursive(begin, near):
    depth, inside, follow = {}, set(), {}

    def visit(n):
        if n in depth:
            return depth[n]
        inside.add(n)
        best = 0
        for m in near.get(n, ()):
            if m not in inside and visit(m) + 1 > best:
                best, follow[n] = depth[m] + 1, m
        inside.discard(n)
        depth[n] = best
        return best

    best, first = 0, begin[0]
    for b in begin:
        if visit(b) > best:
            best, first = depth[b], b
    path = [first]
    while path[-1] in follow:
        path.append(follow[path[-1]])
    return best, path


def test_search_on_cyclic_graphs():
    rng = random.Random(2)
    for _ in range(200):
        near = {}
        for _ in range(rng.randrange(1, 25)):
            near.setdefault(rng.randrange(8), []).append(rng.randrange(8))
        begin = rng.sample(range(8), 3)
        assert G.search(begin, near) == recursive(begin, near)
    chain = {k: [k + 1] for k in range(50_000)}
    assert G.search([0], chain)[0] == 50_000


def test_cyclic_depth_in_a_plan(spark):
    assert G.longest_path(starts(spark, [0]), frame(spark, [(0, 1), (1, 2), (2, 0)]), False) == (2, [0, 1, 2])


def test_modularity(spark):
    one = G.modularity(nodes(spark, 2, {0: "a", 1: "b"}), frame(spark, [(0, 1)])).first()
    assert (one["m"], one["q"]) == (1, 0.0)
    assert G.modularity(nodes(spark, 2), frame(spark, [])).first()["q"] == 1.0
    plain = G.modularity(nodes(spark, 4, {0: "a", 1: "a", 2: "b", 3: "b"}), frame(spark, [(0, 1), (2, 3), (1, 2)])).first()["q"]
    heavy = G.modularity(nodes(spark, 4, {0: "a", 1: "a", 2: "b", 3: "b"}), frame(spark, [(0, 1), (0, 1), (2, 3), (1, 2)])).first()["q"]
    assert heavy > plain > 0


def test_integrity_and_entries(spark):
    with pytest.raises(G.GraphError, match="InvalidGraphEdge"):
        G.checked(nodes(spark, 2), frame(spark, [(0, 5)]))
    with pytest.raises(G.GraphError, match="DuplicateNode"):
        G.checked(nodes(spark, 2).unionAll(nodes(spark, 1)), frame(spark, []))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    from pyspark.sql import functions as F

    assert ids(G.entries(nodes(spark, 3), frame(spark, [(0, 1)]))) == [0, 2]
    assert ids(G.entries(nodes(spark, 2), frame(spark, [(0, 1), (1, 0)]))) == [0]
    assert ids(G.entries(nodes(spark, 3), frame(spark, []))) == [0]
    assert ids(G.entries(nodes(spark, 3).withColumn("named", F.col("id") == 2), frame(spark, [(0, 1)]))) == [2]


@pytest.mark.parametrize("values, want", [([10] * 4, 0.0), ([1, 1, 1, 100], 0.7208737864), ([42], 0.0), ([0, 0], 0.0)])
def test_gini(spark, values, want):
    assert stats.gini(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()["gini"] == pytest.approx(want)


def test_no_value_no_gini(spark):
    assert stats.gini(spark.createDataFrame([], "v int"), "v").first() is None


FILES = ["src/main.zig", "src/core/types.zig", "src/core/mod.zig", "pkg/a/types.zig", "py/app/__init__.py", "py/app/util.py", "py/app/sub/mod1.py", "web/ui/index.ts", "internal/util.go", "rs/lib.rs", "rs/geo/mod.rs", "rs/geo/point.rs", "std.zig"]


@pytest.mark.parametrize(
    "raw, path, want",
    [
        ("core/types", "src/main.zig", "src/core/types.zig"), ("types", "src/main.zig", None), ("a/types", "src/main.zig", "pkg/a/types.zig"), ("./core/types", "src/main.zig", "src/core/types.zig"), ("../main", "src/core/mod.zig", "src/main.zig"),
        (".util", "py/app/__init__.py", "py/app/util.py"), ("..util", "py/app/sub/mod1.py", "py/app/util.py"), ("app.sub.mod1", "py/x.py", "py/app/sub/mod1.py"), (".", "py/app/util.py", "py/app/__init__.py"), ("os", "py/app/util.py", None),
        ("std", "src/main.zig", None), ("std.zig", "src/main.zig", "std.zig"), ("example.com/proj/internal/util", "cmd/main.go", "internal/util.go"), ("self::point", "rs/geo/mod.rs", "rs/geo/point.rs"), ("super::lib", "rs/geo/mod.rs", "rs/lib.rs"),
        ("crate::geo", "rs/lib.rs", "rs/geo/mod.rs"), ("crate", "rs/lib.rs", None), ("./ui", "web/main.ts", "web/ui/index.ts"), ("react", "web/main.ts", None), ("mypkg/point", "rs/lib.rs", "rs/geo/point.rs"),
    ],
)
def test_resolution(raw, path, want):
    # The indexes as plain dictionaries; the queries do the same with joins.
    index = {(resolve.PATH, f): f for f in FILES}
    keys = {}
    for f in FILES:
        from codehealth.functions import paths as P

        stems = [P.strip_extension(f)] + ([P.strip_extension(P.parent(f))] if P.is_index(f) and P.parent(f) else [])
        for s in (x for stem in stems for x in resolve.suffixes(stem)):
            keys.setdefault(s, set()).add(f)
    index |= {(resolve.SUFFIX, s): next(iter(fs)) for s, fs in keys.items() if len(fs) == 1}
    found = next((index[p] for p in resolve.probes(raw, path, {"mypkg": "rs/geo/mod.rs"}) if p in index), None)
    assert found == want


def brute_components(edges):
    reach = {}
    for a, _ in edges:
        todo, seen = [a], set()
        while todo:
            for x, y in edges:
                if x == todo[-1] and y not in seen:
                    seen.add(y)
                    todo.insert(0, y)
            todo.pop()
        reach[a] = seen
    out = {a: {b for b in seen if b != a and a in reach.get(b, ())} | {a} for a, seen in reach.items()}
    return {a: max(c) for a, c in out.items() if len(c) > 1}


@pytest.mark.parametrize("task_edges", [0, 12, 1000])
def test_components_and_heights_in_and_out_of_one_task(spark, task_edges):
    rng = random.Random(task_edges)
    for n in (6, 30):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n + n // 3)]
        table = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long")
        assert {r["id"]: r["scc"] for r in graph.components(table, task_edges).collect()} == brute_components(edges)
        down = [(a, b) for a, b in edges if a < b]
        height = {}
        for v in reversed(range(n)):
            height[v] = max((height[b] + 1 for a, b in down if a == v), default=0)
        ends = {x for e in down for x in e}
        got = graph.heights(spark.createDataFrame(down, "src long, dst long"), task_edges).collect()
        assert {r["id"]: r["height"] for r in got} == {v: height[v] for v in ends} and len(got) == len(ends)


def layered(spark):
    """60 copies of a dense graph of 30 nodes, no task taking more than 1000 edges."""
    rng = random.Random(8)
    one = [(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.8]
    return one, spark.createDataFrame([(a + 30 * k, b + 30 * k) for k in range(60) for a, b in one], "src long, dst long")


def test_heights_of_many_layers_take_few_rounds(spark, monkeypatch):
    one, table = layered(spark)
    height = {}
    for v in reversed(range(30)):
        height[v] = max((height[b] + 1 for a, b in one if a == v), default=0)
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    got = {r["id"]: r["height"] for r in graph.heights(table, 1000).collect()}
    assert got == {v + 30 * k: height[v] for k in range(60) for v in range(30)} and max(height.values()) > 15
    assert len(rounds) < 20


def test_longest_path_of_many_layers_takes_few_rounds(spark, monkeypatch):
    one, table = layered(spark)
    begin, edges = starts(spark, range(1800)), table.withColumn("seq", table["dst"])
    want = graph.longest_path(begin, edges, True)
    rounds = []
    monkeypatch.setattr(graph, "TASK_EDGES", 1000)
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    assert graph.longest_path(begin, edges, True) == want and want[0] > 15
    assert len(rounds) < 30


def test_depth_of_many_layers_takes_few_rounds(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    want = table_queries.max_depth(spark, folder).first()
    rounds = []
    monkeypatch.setattr(graph, "TASK_EDGES", 1000)
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    assert table_queries.max_depth(spark, folder).first() == want and want["max_depth"] > 40
    assert len(rounds) < 40


def test_components_of_dense_graphs_are_contracted(spark, monkeypatch):
    _, table = layered(spark)
    ring = table.unionAll(table.selectExpr("dst", "src"))
    monkeypatch.setattr(graph, "coloured", lambda edges: pytest.fail("a round of colours"))
    got = {r["id"]: r["scc"] for r in graph.components(ring, 3000).collect()}
    assert got == {v + 30 * k: 30 * k + 29 for k in range(60) for v in range(30)}


@pytest.mark.parametrize("n, m, limit", [(40, 60, 15), (60, 200, 25), (12, 40, 7)])
def test_blocks_of_random_graphs(spark, n, m, limit):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    names = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "src string, dst string")
    assert {r["id"]: r["scc"] for r in graph.components(names, limit).collect()} == {f"n{a:03}": f"n{b:03}" for a, b in brute_components(edges).items()}
    order = rng.sample(range(n), n)
    down = {(a, b) for a, b in edges if order[a] < order[b]}
    height = {}
    for v in sorted(range(n), key=lambda v: -order[v]):
        height[v] = max((height[b] + 1 for a, b in down if a == v), default=0)
    got = {r["id"]: r["height"] for r in graph.heights(spark.createDataFrame(list(down), "src long, dst long"), limit).collect()}
    assert got == {v: height[v] for e in down for v in e}


def test_cycles_across_blocks_have_no_heights(spark):
    with pytest.raises(Exception, match="cycle"):
        graph.heights(spark.range(20).selectExpr("id AS src", "(id + 1) % 20 AS dst"), 5).collect()


def test_long_chains(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst", "id AS seq")
    starts = spark.createDataFrame([(0, 0)], "id long, ord long")
    assert graph.components(chain).count() == 0
    depth, path = graph.longest_path(starts, chain, True)
    assert depth == n and path == list(range(n + 1))
    ring = chain.selectExpr("src", f"dst % {n} AS dst")
    assert [tuple(r) for r in graph.components(ring).groupBy("scc").count().collect()] == [(n - 1, n)]


def test_intervals_around_points_against_brute_force(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), k, (low := rng.randrange(-40, 60)), low + rng.randrange(-2, 40)) for k in range(60)] + [("a", 99, 5, 5), ("b", 98, -1000, 1_000_000)]
    points = [(rng.choice("abc"), rng.randrange(-60, 120)) for _ in range(200)] + [("a", None), (None, 3)]
    left = spark.createDataFrame(points, "key string, point long")
    right = spark.createDataFrame([*spans, ("a", 97, None, 3)], "key string, place long, low long, high long")
    for smallest in (True, False):
        want = []
        for key, p in points:
            around = [((high - low) if smallest else 0, place) for k, place, low, high in spans if k == key and p is not None and low <= p <= high]
            want.append((key, p, min(around)[1] if around else None))
        got = [tuple(r) for r in links.enclosing(left, right, ["key"], smallest).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_points_and_blocks_are_not_broadcast(spark):
    spans = spark.range(50).selectExpr("'a' AS key", "id AS place", "id AS low", "id + 3 AS high")
    points = spark.range(5000).selectExpr("'a' AS key", "id % 60 AS point")
    found = links.enclosing(points, spans, ["key"], True)
    assert found.count() == 5000
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_places_in_a_global_order(spark):
    rng = random.Random(6)
    values = [rng.randrange(10_000) for _ in range(500)]
    got = placed(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), ["v"]).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["place"])] == sorted(values) and sorted(r["place"] for r in got) == list(range(1, 501))
    assert placed(spark.createDataFrame([], "v long"), ["v"]).collect() == []


def test_repeated_edges_are_contracted_as_they_lie(spark, monkeypatch):
    monkeypatch.setattr(graph, "trimmed", lambda edges: pytest.fail("rounds of colours"))
    ring = spark.range(20_000).selectExpr("id % 500 AS src", "(id + 1) % 500 AS dst")
    assert [tuple(r) for r in graph.components(ring, 3000).groupBy("scc").count().collect()] == [(499, 500)]


def test_stored_edges_are_not_stored_again(spark, monkeypatch):
    ring = spark.range(50).selectExpr("id AS src", "(id + 1) % 50 AS dst")
    monkeypatch.setattr(graph, "kept", lambda *a: pytest.fail("stored"))
    assert graph.components(ring, stored=True).count() == 50
    assert graph.heights(ring.where("src < dst"), stored=True).agg({"height": "max"}).first()[0] == 49


def test_a_task_takes_few_edges_at_a_time():
    sizes = []

    def solve(ids, src, dst):
        sizes.append(len(src))
        return ids, ids

    rows = pa.RecordBatch.from_pydict({"src": list(range(10)), "dst": list(range(1, 11))})
    assert sum(b.num_rows for b in graph.one_block(solve, ["src", "dst"], 25)(iter([rows] * 7))) == 33 and sizes == [30, 30, 10]
