"""Control-flow graphs of single functions: searches, paths and post-dominance.

A function's graph is small and independent of others: its edges are gathered into one row by a native aggregate, and rows go
through Python in Arrow batches. One shuffle by function, no job for each iteration. Every choice is total: paths are ordered by (length, nodes).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from basalt.sources.shared import kept

Graph = dict[int, list[int]]


def graph_of(edges: Iterable[tuple[int, int]], nodes: Iterable[int] = ()) -> Graph:
    """Sorted adjacency; successors that are no keys become nodes."""
    out: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    return {n: sorted(out[n]) for n in sorted(out)}


def reverse(g: Graph) -> Graph:
    return graph_of(((b, a) for a, bs in g.items() for b in bs), g)


def entry_exits(g: Graph) -> tuple[int | None, list[int]]:
    """The smallest node without predecessor (else the smallest), and the nodes without successor."""
    if not g:
        return None, []
    pred = reverse(g)
    return min([n for n in g if not pred[n]] or g), [n for n in g if not g[n]]


def reachable(g: Graph, start: int, without: int | None = None) -> set[int]:
    if start == without:
        return set()
    seen, todo = {start}, [start]
    while todo:
        for b in g[todo.pop()]:
            if b not in seen and b != without:
                seen.add(b)
                todo.append(b)
    return seen


def shortest_path(g: Graph, start: int, goal: int, no_nodes: frozenset = frozenset(), no_edges: frozenset = frozenset()) -> list[int] | None:
    """The least of the shortest paths: distances to the goal backwards, then the smallest next node each time."""
    back: dict[int, list[int]] = {}
    for a, bs in g.items():
        for b in bs:
            if a not in no_nodes and b not in no_nodes and (a, b) not in no_edges:
                back.setdefault(b, []).append(a)
    distance, todo = {goal: 0}, deque([goal])
    while todo:
        b = todo.popleft()
        for a in back.get(b, ()):
            if a not in distance:
                distance[a] = distance[b] + 1
                todo.append(a)
    if start not in distance or start in no_nodes:
        return None
    path = [start]
    while path[-1] != goal:
        a = path[-1]
        path.append(next(b for b in g[a] if b not in no_nodes and (a, b) not in no_edges and distance.get(b, -1) == distance[a] - 1))
    return path


def simple_paths(g: Graph, start: int, goal: int, k: int = 10) -> list[list[int]]:
    """The k shortest loopless paths by (length, nodes): deviations from paths already found, best first."""
    first = shortest_path(g, start, goal)
    if first is None:
        return []
    found, open_ = [first], set()
    while len(found) < k:
        last = found[-1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            taken = frozenset((p[i], p[i + 1]) for p in found if p[: i + 1] == root and len(p) > i + 1)
            spur = shortest_path(g, root[-1], goal, frozenset(root[:-1]), taken)
            if spur:
                open_.add(tuple(root[:-1] + spur))
        open_ -= {tuple(p) for p in found}
        if not open_:
            break
        best = min(open_, key=lambda p: (len(p), p))
        found.append(list(best))
    return found


def is_path(g: Graph, path: list[int]) -> bool:
    return all(b in g.get(a, ()) for a, b in zip(path, path[1:], strict=False))


def post_dominators(g: Graph, classic: bool = False) -> dict[int, set[int]]:
    """d post-dominates n if every maximal path from n meets d; n itself always.

    Paths that go round for ever are maximal, too: d doesn't post-dominate n if n reaches an exit or a cycle without d.
    `classic` asks for paths to exits alone; a node that reaches none then has only itself.
    """
    bits = _post_dominator_bits(g, classic)
    names = list(g)
    return {n: {names[k] for k in _ones(bits[n])} for n in g}


def _ones(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _post_dominator_bits(g: Graph, classic: bool) -> dict[int, int]:
    """Sets as bits by a node's place in g: the node's own, and what all its successors' sets share. From empty sets up this ends at the paths that may be endless, from full ones down at the textbook's."""
    place = {n: 1 << k for k, n in enumerate(g)}
    pred = reverse(g)
    order, seen = [], set()
    for n in [*(n for n in g if not g[n]), *reversed(g)]:  # breadth first from the exits backwards, then what reaches none
        todo = deque([] if n in seen else [n])
        seen.add(n)
        while todo:
            order.append(x := todo.popleft())
            fresh = [p for p in pred[x] if p not in seen]
            seen.update(fresh)
            todo.extend(fresh)
    if classic:
        leads = set()
        todo = [n for n in g if not g[n]]
        while todo:
            if (x := todo.pop()) not in leads:
                leads.add(x)
                todo += pred[x]
        succ = {n: [b for b in g[n] if b in leads] if n in leads else [] for n in g}
        out = {n: (1 << len(g)) - 1 if succ[n] else place[n] for n in g}
    else:
        succ, out = g, dict.fromkeys(g, 0)
    changed = True
    while changed:
        changed = False
        for n in order:
            shared = -1
            for b in succ[n]:
                shared &= out[b]
            new = place[n] | shared if succ[n] else place[n]
            if new != out[n]:
                out[n], changed = new, True
    return out


def control_dependence(g: Graph, classic: bool = False) -> set[tuple[int, int]]:
    """(n, p): p precedes a node that n post-dominates, and n doesn't post-dominate p."""
    bits, names = _post_dominator_bits(g, classic), list(g)
    return {(names[k], p) for p, bs in g.items() for m in bs for k in _ones(bits[m] & ~bits[p])}


def back_edges(g: Graph) -> set[tuple[int, int]]:
    """Edges to a node that is still open in depth-first order."""
    state: dict[int, int] = {}
    out = set()
    for root in g:
        stack = [(root, iter(g[root]))] if root not in state else []
        state.setdefault(root, 1)
        while stack:
            n, rest = stack[-1]
            for b in rest:
                if b not in state:
                    state[b] = 1
                    stack.append((b, iter(g[b])))
                    break
                if state[b] == 1:
                    out.add((n, b))
            else:
                state[n] = 2
                stack.pop()
    return out


def map_functions(df: DataFrame, fn: str, run: Callable[..., Iterable[tuple]], schema: str, batch: int = 500) -> DataFrame:
    """Apply `run` to the columns behind the first of each row, which is a function's key: what it returns are rows behind the key. In Arrow batches."""
    kinds = StructType.fromDDL(schema)
    names = [f.name for f in kinds]
    arrow = [to_arrow_type(f.dataType) for f in kinds]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), batch):
                b = whole.slice(lo, batch)
                found = [(k, *r) for k, values in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)) for r in run(*values)]
                columns = list(zip(*found, strict=True)) or [()] * (len(names) + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], arrow, strict=True))], names=[fn, *names])

    return df.mapInArrow(rows, f"`{fn}` {df.schema[fn].dataType.simpleString()}, {schema}")


def edge_lists(edges: DataFrame, fn: str, source: str = "src", target: str = "dst") -> DataFrame:
    """(fn, links): each function's distinct (source, target) pairs, a target null where a row only names a node."""
    return edges.groupBy(fn).agg(F.collect_set(F.array(F.col(source).cast("long"), F.col(target).cast("long"))).alias("links"))


def _graph(links: list[list]) -> Graph:
    return graph_of(((a, b) for a, b in links if b is not None), (a for a, _ in links if a is not None))


def per_function(edges: DataFrame, fn: str, run: Callable[[Graph], Iterable[tuple]], schema: str, source: str = "src", target: str = "dst") -> DataFrame:
    """Apply `run` to each function's graph: its rows behind the function's key. Rows with a null target only name a node."""
    return map_functions(edge_lists(edges, fn, source, target), fn, lambda links: run(_graph(links)), schema)


def edges_of(functions: DataFrame, fn: str, cfg: str = "cfg") -> DataFrame:
    """(fn, src, dst) of block maps; a block without successor gives a null dst."""
    return functions.select(fn, F.explode(cfg).alias("src", "block")).select(fn, "src", F.explode_outer("block.successors").alias("dst"))


def entries_and_exits(edges: DataFrame, fn: str) -> DataFrame:
    """(fn, entry, exits) natively: degrees of nodes, then one aggregate."""
    ends = edges.filter("dst IS NOT NULL").select(fn, F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    alone = edges.filter("dst IS NULL").select(fn, F.col("src").alias("node"), F.lit(0).alias("o"), F.lit(0).alias("i"))
    degree = ends.unionByName(alone).groupBy(fn, "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return degree.groupBy(fn).agg(
        F.coalesce(F.min(F.when(F.col("i") == 0, F.col("node"))), F.min("node")).alias("entry"), F.sort_array(F.collect_list(F.when(F.col("o") == 0, F.col("node")))).alias("exits"), F.count(F.lit(1)).alias("n_nodes")
    )


def candidate_paths(edges: DataFrame, ends: DataFrame, fn: str, k: int = 10) -> DataFrame:
    """(fn, exit, rank, path): the k shortest simple paths from the entry to each exit, in order. ends: as of `entries_and_exits`."""
    links = edge_lists(edges.select(F.col(fn).alias("links_fn"), "src", "dst"), "links_fn")
    whole = ends.select(fn, "entry", "exits").join(links, F.col(fn) == F.col("links_fn")).select(fn, "entry", "exits", "links")

    def run(entry: int, exits: list[int], links: list[list]) -> Iterator[tuple]:
        g = _graph(links)
        yield from ((goal, n, p) for goal in exits for n, p in enumerate(simple_paths(g, entry, goal, k)))

    return map_functions(whole, fn, run, "exit bigint, rank bigint, path array<bigint>")


def paths(edges: DataFrame, fn: str, k: int = 10) -> DataFrame:
    """(fn, path, coverage): up to three paths of each function from its entry to exits, in order, and the share of nodes on them.

    Of the k shortest simple paths to each exit: the shortest of all; then twice the one with most new nodes (of equals that to the smallest exit, there the first). Repeats are
    left out. A function without a path to an exit has none, and covers 0.
    """
    edges = kept(edges.select(fn, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    ends = kept(entries_and_exits(edges, fn))
    found = candidate_paths(edges, ends, fn, k).groupBy(fn).agg(F.sort_array(F.collect_list(F.struct("exit", "rank", "path"))).alias("found"))
    nodes = F.array().cast("array<bigint>")

    def most_new(covered: Column) -> Column:
        scored = F.transform("candidates", lambda p, n: F.struct(F.size(F.array_except(p, covered)).alias("new"), (-n).alias("earlier"), p.alias("path")))
        return F.array_max(scored)["path"]

    some = found.select(fn, F.transform("found", lambda x: x["path"]).alias("candidates"))
    some = some.withColumn("first", F.array_min(F.transform("candidates", lambda p: F.struct(F.size(p).alias("n"), p.alias("path"))))["path"])
    some = some.withColumn("second", most_new(F.col("first"))).withColumn("covered", F.array_union("first", "second"))
    some = some.withColumn("third", most_new(F.col("covered"))).withColumn("covered", F.array_union("covered", "third"))
    chosen = F.when(F.col("first").isNull(), F.array().cast("array<array<bigint>>")).otherwise(F.array_sort(F.array_distinct(F.array("first", "second", "third"))))
    return ends.select(fn, "n_nodes").join(some, fn, "left").select(fn, chosen.alias("path"), (F.size(F.coalesce("covered", nodes)) / F.col("n_nodes")).alias("coverage"))


def onwards(g: dict[int, list[int]], start: int, closed: frozenset = frozenset()) -> dict[int, int]:
    """What one or more steps from a node lead to, with the least number of steps; closed nodes are reached but not left again."""
    found: dict[int, int] = {}
    edge, steps = [start], 0
    while edge:
        steps += 1
        edge = list({b for a in edge for b in g.get(a, ()) if b not in found})
        found.update(dict.fromkeys(edge, steps))
        edge = [b for b in edge if b not in closed]
    return found


def walks(edges: DataFrame, asked: DataFrame, fn: str) -> DataFrame:
    """(fn, label, start, node, steps): breadth-first searches along a function's edges (fn, src, dst), from each of the starts in asked: (fn, label, starts, closed).

    A function's edges and searches are one row, gathered natively; functions without edges have no rows.
    """
    links = edge_lists(edges.filter("dst IS NOT NULL").select(F.col(fn).alias("walk_fn"), "src", "dst"), "walk_fn")
    whole = asked.groupBy(fn).agg(F.collect_list(F.struct("label", "starts", "closed")).alias("asked")).join(links, F.col(fn) == F.col("walk_fn")).select(fn, "links", "asked")

    def run(links: list[list[int]], asked: list[dict]) -> Iterator[tuple]:
        g: dict[int, list[int]] = {}
        for a, b in links:
            g.setdefault(a, []).append(b)
        for one in asked:
            closed = frozenset(one["closed"])
            for start in one["starts"]:
                found = onwards(g, start, closed)
                yield one["label"], start, list(found), list(found.values())

    found = map_functions(whole, fn, run, "label string, start bigint, nodes array<bigint>, steps array<bigint>")
    return found.select(fn, "label", "start", F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("steps").alias("steps"))).alias("node", "steps"))


def shortest_exit_paths(edges: DataFrame, fn: str) -> DataFrame:
    """(fn, exit, length, path): from the entry to each exit that it reaches. Searches go back from the exits; the smallest of the nodes nearest to the exit comes next."""
    edges = kept(edges.select(fn, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    ends = kept(entries_and_exits(edges, fn))
    asked = ends.select(fn, F.lit("").alias("label"), F.col("exits").alias("starts"), F.array().cast("array<bigint>").alias("closed"))
    far = walks(edges.filter("dst IS NOT NULL").select(fn, F.col("dst").alias("src"), F.col("src").alias("dst")), asked, fn).select(fn, F.col("start").alias("exit"), F.col("node").alias("dst"), "steps")
    each = ends.select(fn, "entry", F.explode("exits").alias("exit"))
    near = far.unionByName(each.select(fn, "exit", F.col("exit").alias("dst"), F.lit(0).cast("long").alias("steps")))
    best = edges.filter("dst IS NOT NULL").join(near, [fn, "dst"]).groupBy(fn, "exit", "src").agg(F.min(F.struct("steps", "dst")).alias("next"))
    following = best.groupBy(fn, "exit").agg(F.map_from_entries(F.collect_list(F.struct("src", "next"))).alias("next"))
    found = each.join(following, [fn, "exit"], "left").withColumn("length", F.when(F.col("entry") == F.col("exit"), F.lit(0).cast("long")).otherwise(F.col("next")[F.col("entry")]["steps"] + 1)).filter("length IS NOT NULL")
    turns = F.when(F.col("length") > 0, F.sequence(F.lit(1).cast("long"), "length")).otherwise(F.array().cast("array<bigint>"))
    path = F.reduce(turns, F.array("entry"), lambda p, _: F.concat(p, F.array(F.col("next")[F.element_at(p, -1)]["dst"])))
    return found.select(fn, "exit", "length", path.alias("path"))


def post_dominance(edges: DataFrame, fn: str, classic: bool = False) -> DataFrame:
    return per_function(edges, fn, lambda g: [(n, d) for n, ds in post_dominators(g, classic).items() for d in sorted(ds)], "node bigint, post_dominator bigint")


def control_dependences(edges: DataFrame, fn: str, classic: bool = False) -> DataFrame:
    return per_function(edges, fn, lambda g: sorted(control_dependence(g, classic)), "node bigint, depends_on bigint")


def back_edge_rows(edges: DataFrame, fn: str) -> DataFrame:
    """(fn, src, dst): edges to a node that is still open in depth-first order."""
    return per_function(edges, fn, lambda g: sorted(back_edges(g)), "src bigint, dst bigint")


def broken_steps(paths_of: DataFrame, edges: DataFrame, fn: str, path: str = "path") -> DataFrame:
    """(fn, path, broken): how many steps of each path are no edge of its function. Native. paths_of: (fn, path: array of nodes)."""
    known = edges.filter("dst IS NOT NULL").groupBy(fn).agg(F.collect_set(F.struct(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))).alias("known"))
    steps = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return paths_of.join(known, fn, "left").select(fn, path, F.size(F.filter(steps, lambda e: ~F.array_contains(F.coalesce("known", empty), e))).cast("long").alias("broken"))


def consecutive_edges(rows: DataFrame, fn: str, state: Column, order: list[str]) -> DataFrame:
    """A walk's graph: distinct edges between states that follow each other in a function's rows."""
    w = Window.partitionBy(fn).orderBy(*order)
    steps = rows.select(fn, state.alias("src"), F.lead(state).over(w).alias("dst"))
    return steps.filter("dst IS NOT NULL").distinct()
