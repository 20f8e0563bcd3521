"""Graph measures over node and edge tables: modularity, cycles, longest paths, reachability.

A graph of at most TASK_EDGES edges is solved in one task, whose memory that number bounds.
A larger one is dealt to tasks of so many edges each, and what they find is put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codehealth.session import cut, kept

ROUNDS = 10_000
#: Hops of one job; each refers to the one before once, so the plan grows with their number only.
HOPS = 4
#: Edges of one partition, about.
PART_EDGES = 200_000
#: Edges that one task takes.
TASK_EDGES = 2_000_000
#: Edges whose heights one task finds, as arrays of four bytes an end and eight an edge.
HEIGHT_EDGES = 16_000_000
#: Edges that are numbered at a time, so that a task holds no more of them as they came.
CHUNK_EDGES = 1_000_000
#: Nodes, and eight times as many edges, below which a loop is faster than arrays.
FEW = 8
#: Large components that are looked for in whole breadths, and the breadths of one.
PIVOTS, FAR = 200, 200
#: Rounds after which blocks that still change each other are dealt anew.
DEAL_ROUNDS = 8
#: Part of the edges that contraction must take away to go on.
SHRINK = 0.2


class GraphError(ValueError):
    """Edges and nodes that don't fit together; ``code`` is InvalidGraphEdge or DuplicateNode."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def checked(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises GraphError if a node (id) is there twice or an edge (src, dst) has an end that is no node."""
    if not nodes.groupBy("id").count().where("count > 1").isEmpty():
        raise GraphError("DuplicateNode")
    if not dangling(nodes, edges).isEmpty():
        raise GraphError("InvalidGraphEdge")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the edges' ends that are no nodes."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes, "id", "left_anti")


def edge_bag(*tables: DataFrame) -> DataFrame:
    """All edges of the tables (two columns each, whatever their names) as src and dst; each counts as often as it occurs."""
    out = None
    for t in tables:
        some = t.toDF("src", "dst")
        out = some if out is None else out.unionAll(some)
    return out


def module_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, k_out, k_in, intra) of the modules that edges touch; repeated edges count as often as they occur."""
    home = nodes.select("id", "module")
    ends = edges.join(home.select(F.col("id").alias("src"), F.col("module").alias("src_module")), "src")
    ends = ends.join(home.select(F.col("id").alias("dst"), F.col("module").alias("dst_module")), "dst")
    pairs = ends.groupBy("src_module", "dst_module").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("src_module").alias("module"), F.col("n").alias("k_out"), F.lit(0).cast("long").alias("k_in")), F.struct(F.col("dst_module").alias("module"), F.lit(0).cast("long").alias("k_out"), F.col("n").alias("k_in")))
    both = pairs.select(F.explode(sides).alias("s"), F.when(F.col("src_module") == F.col("dst_module"), F.col("n")).otherwise(0).alias("n"))
    # An edge inside a module shows up on both of its sides.
    return both.groupBy("s.module").agg(F.sum("s.k_out").alias("k_out"), F.sum("s.k_in").alias("k_in"), (F.sum("n") / 2).cast("long").alias("intra"))


def modularity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (m, q): the edges' number and Newman's modularity of the nodes' modules, from -0.5 to 1; 1 without edges."""
    sums = module_degrees(nodes, edges).agg(
        F.coalesce(F.sum("k_out"), F.lit(0)).alias("m"),
        F.coalesce(F.sum("intra"), F.lit(0)).alias("intra"),
        F.coalesce(F.sum(F.col("k_out").cast("double") * F.col("k_in")), F.lit(0.0)).alias("products"),
    )
    q = (F.col("intra") - F.col("products") / F.col("m")) / F.col("m")
    return sums.select("m", F.when(F.col("m") == 0, 1.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(1.0), q))).alias("q"))


def entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (id, ord, named) that paths start from: the named ones, else those that no edge enters, else the first."""
    named = nodes.where("named")
    if not named.isEmpty():
        return named
    if not edges.isEmpty():
        free = nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select(nodes.columns)
        if not free.isEmpty():
            return free
    return nodes.orderBy("ord").limit(1)


def components(edges: DataFrame, task_edges: int | None = None, stored: bool = False) -> DataFrame:
    """(id, scc) of the nodes of strongly connected components of two nodes or more; the largest id names one.

    Edges may repeat. ``stored``: they can be read again without being computed again.

    Tasks contract the components of the edges that each of them has until one task takes
    what is left. Where that no longer helps, a round colours nodes with the largest id that
    reaches them; the nodes of a colour that reach its id are one component. They leave, as
    do edges between colours and nodes without edges in both directions.
    """
    limit = TASK_EDGES if task_edges is None else task_edges
    kind = edges.schema["src"].dataType.simpleString()
    left = edges.select("src", "dst").where("src <> dst")
    left = left if stored else kept(left, "edges")
    found = None
    for _ in range(ROUNDS):
        left = contracted(left, limit)
        if left.count() <= limit:
            rest = in_one_task(left, strong_components, f"id {kind}, scc {kind}")
            return cut(rest if found is None else found.unionAll(rest))
        left = trimmed(left)
        if left.isEmpty():
            break
        color = coloured(left)
        same = left.join(color.withColumnRenamed("id", "src").withColumnRenamed("color", "c"), "src").join(color.withColumnRenamed("id", "dst"), "dst").where("c = color")
        same = cut(same.select("src", "dst", "color"))
        roots = color.where("id = color").select("id", "color")
        own = reached(roots, same.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "color"), ["color"])
        multi = own.join(own.groupBy("color").count().where("count > 1").select("color"), "color").select("id", F.col("color").alias("scc"))
        found = multi if found is None else found.unionAll(multi)
        done = own.select("id")
        left = cut(same.select("src", "dst").join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    return cut(found) if found is not None else edges.sparkSession.createDataFrame([], f"id {kind}, scc {kind}")


def contracted(edges: DataFrame, limit: int) -> DataFrame:
    """Distinct edges of the same strongly connected components as ``edges``, ``limit`` at most unless too few can go.

    Each task has about ``limit`` of the edges. A component of these becomes one cycle
    through its nodes, and edges between components lead from one's last node to the other's.
    So whoever reaches whom stays the same. Edges are taken as they lie first, which moves none
    of them, then dealt by both ends, which leaves a sample of all to each task, or by ranges
    of their start, which keeps what is close together.
    """
    kind = edges.schema["src"].dataType.simpleString()
    n, vain = edges.count(), 0
    for k in range(ROUNDS):
        if n <= limit or vain == 2:
            break
        parts = 1 + n // max(limit, 1)
        if k == 0:
            # A quarter more, as they are not dealt evenly.
            dealt_ = edges.coalesce(parts + parts // 4)
        else:
            dealt_ = edges.repartition(parts, "src", "dst") if k % 2 else edges.repartitionByRange(parts, "src", "dst")
        small = kept(dealt_.mapInArrow(one_block(contract, ["src", "dst"], None if k else limit), f"src {kind}, dst {kind}").distinct(), "edges")
        before, n = n, small.count()
        vain = vain + 1 if k and n > before * (1 - SHRINK) else 0
        if n < before:
            edges = small
    return edges


def in_one_task(edges: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """What ``solve(ids, src, dst)`` says of ``edges`` (src, dst): the nodes in ascending order and the edges as places among them."""

    names = [c.split()[0] for c in schema.split(", ")]
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").coalesce(1).mapInArrow(one_block(solve, names), schema)


def one_block(solve: Callable, names: list[str], most: int | None = None) -> Callable:
    """For ``mapInArrow``: ``solve`` on the edges (src, dst) of a partition, all or about ``most`` at a time, its columns by ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, new, n, n_new = [], [], 0, 0
        for b in batches:
            if b.num_rows:
                new.append(b)
                n, n_new = n + b.num_rows, n_new + b.num_rows
            if n_new >= CHUNK_EDGES:
                parts.append(coded(pa.Table.from_batches(new)))
                new, n_new = [], 0
            if most is not None and n >= max(most, 1):
                yield from solved(parts, new)
                parts, new, n, n_new = [], [], 0, 0
        if n:
            yield from solved(parts, new)

    def solved(parts: list[tuple], new: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        if new:
            parts.append(coded(pa.Table.from_batches(new)))
        return pa.table(list(solve(*numbered(parts))), names=names).to_batches(max_chunksize=100_000)

    return run


def coded(edges: pa.Table) -> tuple[pa.Array, pa.Array]:
    """The ends (src, dst) of edges as places in a dictionary of either, four bytes each."""
    return tuple(edges[c].combine_chunks().dictionary_encode() for c in ("src", "dst"))


def numbered(parts: list[tuple[pa.Array, pa.Array]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes of ``coded`` edges in ascending order, and the edges as places among them. Empties ``parts``."""
    both = pa.chunked_array([x for side in zip(*parts) for x in side]).unify_dictionaries()
    parts.clear()
    nodes = both.chunk(0).dictionary
    order = pc.sort_indices(nodes).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    ends = np.concatenate([place[c.indices.to_numpy()] for c in both.chunks])
    return nodes.take(pa.array(order)), ends[: len(ends) // 2], ends[len(ends) // 2 :]


def rows_of(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, targets) of the different edges: node i leads to targets[begins[i]:begins[i + 1]]."""
    pairs = src.astype(np.int64) * n + dst
    pairs.sort()
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    begins = np.searchsorted(pairs, np.arange(n + 1) * n)
    pairs %= max(n, 1)
    return begins, pairs.astype(np.int32)


def targets_of(nodes: np.ndarray, begins: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What all ``nodes`` lead to, and how many each of them leads to."""
    first, near = begins[nodes], begins[nodes + 1] - begins[nodes]
    return targets[np.repeat(first - np.cumsum(near) + near, near) + np.arange(near.sum())], near


def strong_components(ids: pa.Array, src: np.ndarray, dst: np.ndarray) -> tuple:
    """Each node of a component of two nodes or more, and the component's last node."""
    scc = last_nodes(len(ids), src, dst)
    inside = np.flatnonzero(scc >= 0)
    return ids.take(pa.array(inside)), ids.take(pa.array(scc[inside]))


def contract(ids: pa.Array, src: np.ndarray, dst: np.ndarray) -> tuple:
    """Edges by which the same nodes reach each other: a cycle through each component, and one edge between two of them."""
    scc = last_nodes(len(ids), src, dst)
    inside = np.flatnonzero(scc >= 0)
    inside = inside[np.argsort(scc[inside], kind="stable")]
    # The nodes of a component stand together; each leads to the next one, the last one to the first.
    starts = np.flatnonzero(np.diff(scc[inside], prepend=-1))
    follow = np.roll(inside, -1)
    follow[np.append(starts[1:], len(inside))[: len(starts)] - 1] = inside[starts]
    home = np.where(scc >= 0, scc, np.arange(len(ids)))
    a, b = home[src], home[dst]
    between = np.unique(a[a != b] * len(ids) + b[a != b])
    return ids.take(pa.array(np.append(inside, between // len(ids)))), ids.take(pa.array(np.append(follow, between % len(ids))))


def large_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each node of components that make up most of what a node of theirs reaches or is reached by, the last one; else -1.

    What is reached and reaches from one node is its component, whole breadths at a time.
    """
    scc, open_ = np.full(n, -1), np.ones(n, bool)
    on, back = rows_of(n, src, dst), rows_of(n, dst, src)
    ends = np.minimum(np.diff(on[0]), np.diff(back[0]))
    for _ in range(PIVOTS):
        start = int(np.argmax(ends)) if n else 0
        if not n or not ends[start]:
            break
        there = reached_from(start, *on, open_)
        here = None if there is None else reached_from(start, *back, open_)
        if here is None:
            break
        own = np.flatnonzero(there & here)
        if len(own) < FEW or 4 * len(own) < np.count_nonzero(there | here):
            break
        scc[own], open_[own], ends[own] = own[-1], False, 0
    return scc


def reached_from(start: int, begins: np.ndarray, targets: np.ndarray, open_: np.ndarray) -> np.ndarray | None:
    """Whether ``start`` reaches each node by ``open_`` nodes; None where that is far."""
    seen = np.zeros(len(open_), bool)
    seen[start], front = True, np.array([start])
    for _ in range(FAR):
        near = targets_of(front, begins, targets)[0]
        front = np.unique(near[open_[near] & ~seen[near]])
        if not len(front):
            return seen
        seen[front] = True
    return None


def last_nodes(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """For each node the last one of its component, -1 if it is alone: large ones first, for the rest one depth-first search without recursion."""
    scc = large_components(n, src, dst)
    rest = (scc[src] < 0) & (scc[dst] < 0)
    begins, targets = (x.tolist() for x in rows_of(n, src[rest], dst[rest]))
    number, low, at = [0] * n, [0] * n, begins[:-1]
    done, stack = [False] * n, []
    counter = 0
    for root in range(n):
        if number[root]:
            continue
        counter += 1
        number[root] = low[root] = counter
        path = [root]
        stack.append(root)
        while path:
            v = path[-1]
            if at[v] < begins[v + 1]:
                w = targets[at[v]]
                at[v] += 1
                if not number[w]:
                    counter += 1
                    number[w] = low[w] = counter
                    path.append(w)
                    stack.append(w)
                elif not done[w] and number[w] < low[v]:
                    low[v] = number[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == number[v]:
                own = []
                while not own or own[-1] != v:
                    own.append(stack.pop())
                    done[own[-1]] = True
                if len(own) > 1:
                    scc[own] = max(own)
    return scc


def path_heights(ids: pa.Array, src: np.ndarray, dst: np.ndarray, known: np.ndarray | None = None) -> tuple:
    """Each node of an acyclic graph and the edges of the longest path from it, ``known`` (0) being the least; sinks leave first, layer by layer."""
    n = len(ids)
    begins, sources = rows_of(n, dst, src)
    open_ = np.bincount(sources, minlength=n)
    height = np.zeros(n, np.int64) if known is None else known.astype(np.int64)
    todo, seen = np.flatnonzero(open_ == 0), 0
    while len(todo):
        seen += len(todo)
        if len(todo) < FEW and sum(begins[v + 1] - begins[v] for v in todo) < 8 * FEW:
            freed = []
            for v in todo:
                above = height[v] + 1
                for u in sources[begins[v] : begins[v + 1]].tolist():
                    if height[u] < above:
                        height[u] = above
                    open_[u] -= 1
                    if not open_[u]:
                        freed.append(u)
            todo = freed
            continue
        todo = np.asarray(todo)
        above, near = targets_of(todo, begins, sources)
        np.maximum.at(height, above, np.repeat(height[todo] + 1, near))
        np.subtract.at(open_, above, 1)
        todo = np.unique(above[open_[above] == 0])
    if seen < n:
        raise RuntimeError("the graph has a cycle")
    return ids, pa.array(height, pa.int64())


def inner(edges: DataFrame) -> DataFrame:
    """``edges`` without those from nodes that none enters or to nodes that none leaves."""
    ends = edges.select(F.col("dst").alias("src")).distinct()
    starts = edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(ends, "src", "left_semi").join(starts, "dst", "left_semi").select("src", "dst")


def trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without the outermost nodes, which are in no cycle, for as long as that takes few rounds."""
    n = edges.count()
    for _ in range(4):
        edges = cut(inner(inner(edges.coalesce(1 + n // PART_EDGES))))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def dealt(edges: DataFrame) -> tuple[DataFrame, int]:
    """``edges``, computed, in as many partitions as their number asks for, and that number of partitions."""
    edges = cut(edges)
    parts = 1 + edges.count() // PART_EDGES
    return edges.coalesce(parts), parts


def spread(state: DataFrame, edges: DataFrame, value: str, along) -> DataFrame:
    """``state`` (id, value) after some hops along ``edges`` (src, dst): the largest of each node's own and what reaches it.

    ``along`` makes the value that arrives from the value that is sent.
    """
    for _ in range(HOPS):
        sent = state.join(edges, F.col("id") == F.col("src"), "left")
        pairs = F.array(F.struct("id", value), F.struct(F.col("dst").alias("id"), along(F.col(value)).alias(value)))
        state = sent.select(F.explode(pairs).alias("p")).select("p.*").where("id IS NOT NULL").groupBy("id").agg(F.max(value).alias(value))
    return state


def settled(state: DataFrame, edges: DataFrame, value: str, along) -> DataFrame:
    """``spread`` until nothing changes."""
    edges, parts = dealt(edges)
    state = cut(state).coalesce(parts)
    for _ in range(ROUNDS):
        before = state.select("id", F.col(value).alias("before"))
        new = cut(spread(state, edges, value, along).join(before, "id"))
        state = new.select("id", value).coalesce(parts)
        if new.where(F.col(value) != F.col("before")).isEmpty():
            return state
    raise RuntimeError("values did not settle")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def coloured(edges: DataFrame) -> DataFrame:
    """(id, color): the largest id that reaches each node, itself included."""
    return settled(vertices(edges).withColumn("color", F.col("id")), edges, "color", lambda c: c)


def reached(seeds: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``seeds`` (id and ``keys``) and all that ``edges`` (src, dst and ``keys``) lead to from them, breadth first."""
    keys = keys or []
    edges, parts = dealt(edges.select("src", "dst", *keys))
    visited = frontier = cut(seeds.select("id", *keys).distinct()).coalesce(parts)
    for k in range(ROUNDS):
        near = frontier
        for _ in range(HOPS):
            step = near.withColumnRenamed("id", "src").join(edges, ["src", *keys], "left")
            near = step.select(F.explode(F.array("src", "dst")).alias("id"), *keys).where("id IS NOT NULL").distinct()
        frontier = cut(near.join(visited, ["id", *keys], "left_anti")).coalesce(parts)
        if frontier.isEmpty():
            return visited
        visited = visited.unionAll(frontier).coalesce(parts)
        if k % 8 == 7:
            visited = cut(visited)
    raise RuntimeError("reachability did not settle")


def heights(edges: DataFrame, task_edges: int | None = None, stored: bool = False) -> DataFrame:
    """(id, height): the edges of the longest path from each node of an acyclic graph.

    ``stored``: no edge has a null, and they can be read again without being computed again. Then
    they are made distinct only where they are too many for one task.

    More edges than HEIGHT_EDGES are dealt to blocks of TASK_EDGES by ranges of their start. A task
    finds the heights in its block, given the least heights that are known of its nodes.
    Blocks for whose nodes others have found more start again, until there are none.
    """
    limit, size = (HEIGHT_EDGES, TASK_EDGES) if task_edges is None else (task_edges, task_edges)
    kind = edges.schema["src"].dataType.simpleString()
    left = edges.select("src", "dst") if stored else kept(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    n = left.count()
    if stored and n > limit:
        left = kept(left.distinct(), "edges")
        n = left.count()
    if n <= limit:
        return cut(in_one_task(left, path_heights, f"id {kind}, height long").select("id", F.col("height").cast("int").alias("height")))
    best, schema = None, f"block int, id {kind}, height long"
    for _ in range(ROUNDS):
        blocks = in_blocks(left, best, 1 + n // max(size, 1))
        todo, ask, own = blocks, edges.sparkSession.createDataFrame([], schema), None
        if best is not None:
            seats = blocks.select("block", F.col("src").alias("id")).union(blocks.select("block", "dst")).distinct()
            ask = seats.join(best, "id").select("block", "id", "height")
        for _ in range(DEAL_ROUNDS):
            new = todo.groupBy("block").cogroup(ask.groupBy("block")).applyInArrow(block_heights, schema)
            own = cut(new if own is None else new.unionAll(own.join(F.broadcast(stale), "block", "left_anti").select("block", "id", "height")))
            best = cut(own.groupBy("id").agg(F.max("height").alias("height")))
            most, nodes = best.agg(F.max("height"), F.count(F.lit(1))).first()
            if most >= nodes:
                raise RuntimeError("the graph has a cycle")
            both = own.join(best.withColumnRenamed("height", "best"), "id")
            stale = cut(both.where("best > height").select("block").distinct())
            if stale.isEmpty():
                return best.select("id", F.col("height").cast("int").alias("height"))
            ask = both.join(F.broadcast(stale), "block", "left_semi").select("block", "id", F.col("best").alias("height"))
            todo = blocks.join(F.broadcast(stale), "block", "left_semi")
    raise RuntimeError("heights did not settle")


def in_blocks(edges: DataFrame, height: DataFrame | None, parts: int) -> DataFrame:
    """``edges`` (src, dst) with their ``block``: ranges of the start, or of its ``height`` (id, height) so far, in which paths rarely leave a block."""
    if height is None:
        dealt_ = edges.repartitionByRange(parts, "src", "dst")
    else:
        dealt_ = edges.join(height.withColumnRenamed("id", "src"), "src").repartitionByRange(parts, "height", "src", "dst").select("src", "dst")
    return kept(dealt_.withColumn("block", F.spark_partition_id()), "blocks")


def block_heights(edges: pa.Table, known: pa.Table) -> pa.Table:
    """(block, id, height) of the nodes of one block's edges (src, dst, block), no less than the ``known`` (id, height)."""
    ids, src, dst = numbered([coded(edges)])
    least = np.zeros(len(ids), np.int64)
    if len(known):
        place = pc.index_in(known["id"], value_set=ids).to_numpy()
        least[place] = known["height"].to_numpy()
    ids, height = path_heights(ids, src, dst, least)
    return pa.table({"block": pa.array(np.full(len(ids), edges["block"][0].as_py(), np.int32)), "id": ids, "height": height})


def longest_path(starts: DataFrame, edges: DataFrame, acyclic: bool) -> tuple[int, list]:
    """(edges, nodes in order) of the longest path from ``starts`` (id, ord); ``edges``: src, dst, seq.

    Ties go to the start of least ord and at each node to the edge of least seq. On a
    graph with cycles the answer is that of a depth-first search that remembers each
    node's first result and skips nodes it is inside of; it depends on the order of edges
    and starts, so one task does it.
    """
    if acyclic:
        edges = kept(edges.select("src", "dst", "seq"), "edges")
        height = heights(edges.where("src <> dst"))
        best = starts.join(height, "id", "left").select("id", "ord", F.coalesce("height", F.lit(0)).alias("height")).orderBy(F.col("height").desc(), "ord").first()
        if best is None:
            return 0, []
        path, at = [best["id"]], best["height"]
        up = edges.join(height.withColumnRenamed("id", "dst"), "dst").groupBy("src", "height").agg(F.min_by("dst", "seq").alias("dst"))
        up = up.join(height.select(F.col("id").alias("src"), (F.col("height") - 1).alias("height")), ["src", "height"])
        return best["height"], followed(up.select("src", "dst"), path[0], at)
    rows = starts.select(F.lit(0).alias("kind"), F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.col("ord").cast("long").alias("k"))
    order = F.row_number().over(_by_seq())
    rows = rows.unionAll(edges.select("src", "dst", "seq").withColumn("k", order).select(F.lit(1), F.col("src").cast("string"), F.col("dst").cast("string"), F.col("k").cast("long")))
    found = rows.coalesce(1).mapInPandas(_search_all, "depth long, path array<string>").first()
    kind = type(starts.select("id").first()[0]) if found and found["path"] else str
    return (found["depth"], [kind(x) for x in found["path"]]) if found else (0, [])


def followed(step: DataFrame, start, n: int) -> list:
    """``start`` and the ``n`` nodes that follow it, each node having one next one in ``step`` (src, dst); hops double from round to round."""
    kind = step.schema["src"].dataType.simpleString()
    jump = cut(step)
    path = step.sparkSession.createDataFrame([(0, start)], f"place long, id {kind}")
    size = 1
    while size <= n:
        far = path.join(jump, F.col("id") == F.col("src")).select((F.col("place") + size).alias("place"), F.col("dst").alias("id"))
        path = cut(path.unionAll(far))
        size *= 2
        if size <= n:
            on = jump.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
            jump = cut(jump.join(on, F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst")))
    return [r["id"] for r in path.where(F.col("place") <= n).orderBy("place").collect()]


def _by_seq():
    from pyspark.sql.window import Window

    return Window.orderBy("seq")


def _search_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"kind": [], "a": [], "b": [], "k": []}), *batches]).sort_values(["kind", "k"])
    begin = rows[rows["kind"] == 0]["a"].tolist()
    near: dict[str, list[str]] = {}
    for a, b in rows[rows["kind"] == 1][["a", "b"]].itertuples(index=False):
        near.setdefault(a, []).append(b)
    depth, path = search(begin, near)
    yield pd.DataFrame({"depth": [depth], "path": [path]})


def search(begin: list, near: dict) -> tuple[int, list]:
    """Depth-first search for the longest path with remembered results, without recursion."""
    depth: dict = {}
    follow: dict = {}
    inside: set = set()

    def visit(start) -> int:
        if start in depth:
            return depth[start]
        stack = [(start, iter(near.get(start, ())), 0)]
        inside.add(start)
        while True:
            node, rest, best = stack.pop()
            for other in rest:
                if other in inside:
                    continue
                if other in depth:
                    if depth[other] + 1 > best:
                        best, follow[node] = depth[other] + 1, other
                    continue
                # Come back to this neighbour once its own depth is known.
                stack.append((node, _again(other, rest), best))
                stack.append((other, iter(near.get(other, ())), 0))
                inside.add(other)
                break
            else:
                inside.discard(node)
                depth[node] = best
                if not stack:
                    return best

    if not begin:
        return 0, []
    best, first = 0, begin[0]
    for start in begin:
        found = visit(start)
        if found > best:
            best, first = found, start
    path = [first]
    while path[-1] in follow:
        path.append(follow[path[-1]])
    return best, path


def _again(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest
