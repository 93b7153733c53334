"""HDBSCAN of a whole table (Campello et al. 2013, Euclidean, excess of mass).

1. Core distances: blocks of rows meet (`blocks.block_join`), each cell keeps the least distances of its rows.
   With samples 1 there is nothing to do: no pair is nearer than either's nearest row.
2. Spanning tree of mutual reachability. First each block's own tree, then for each two blocks the edges between them that are in
   the tree of their rows; an edge of the whole tree is in the tree of any rows that hold it, but for ties. A pair can
   only be in a tree if it is shorter than the longest edge between its ends in some other tree of the same rows. So a cell begins with its
   blocks' trees and a few pairs between them; their rows stand in a line in which any two are joined at the greatest gap between
   them (`lined`), and one comparison of a matrix product with these lengths leaves few pairs, which are measured exactly (`joined`).
   All cells' edges are a sparse graph that holds a shortest tree, which is found by Borůvka rounds: every component takes its
   shortest edge out, components that are joined get one name by pointer jumping, and of the edges between two components the
   shortest stays; no more than BAND edges are finished in one task. Edges are ordered by (length, ends), so no round makes a cycle.
3. Condensed tree. The edges come in order of their length, BAND at a time, and a band is one task: it merges the
   components that its edges join, from what is left of the bands before. A component keeps its size and the
   cluster that it is, with the sum of the rates at which its rows left it and the best that the clusters below are worth; so mass
   and choice are known when it merges with another cluster, and rows are written out as soon as they leave. What is held at
   once follows the band. Edges of one length merge what they join at once (but where a band ends among them).
4. Each row's cluster is the highest chosen one above the one it left, found by pointer doubling over the clusters, or in one
   task if they are no more than BAND.

Cells compare all pairs of rows once for each of 1 and 2, in products of matrices; the rest follows the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from gazetta.functions import vectors as V
from gazetta.operators import blocks as B
from gazetta.operators import relational as R
from gazetta.scratch import materialize

#: Rows of a block for core distances; edges that are merged in one task; pairs that are measured exactly at once.
BLOCK, BAND, PAIRS = 4096, 500_000, 1 << 15
#: Rows of a block for trees: at most, and at least where that leaves fewer than SPLIT blocks. Rows of a block's smallest parts.
WIDEST, NARROWEST, SPLIT, LEAF = 16_384, 2_048, 16, 1_024
#: Rows and columns of a product in a cell; of so many rows one is measured against all others first.
TILE, SAMPLED = (256, 4096), 32
#: Tasks for all cells at most.
CELLS = 4_096
#: The rate at which rows at distance 0 leave.
FASTEST = 1e12


def core_distances(points: DataFrame, size: int, samples: int, block: int = BLOCK) -> DataFrame:
    """Adds core: the distance to the samples-th nearest other row (the farthest, if there are fewer; none: 0). points: k, v."""
    n = B.count_of(points.count(), block)
    schema = StructType().add("k", points.schema["k"].dataType).add("near", ArrayType(DoubleType()))
    arrow = to_arrow_schema(schema)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        near: list[list[float]] = []
        if a.num_rows and b.num_rows:
            p, q = B.matrix(a, "v", size), B.matrix(b, "v", size)
            mine, theirs = a.column("k").to_pylist(), b.column("k").to_pylist()
            place = {k: j for j, k in enumerate(theirs)}
            squares = (q * q).sum(1)
            for at in range(0, len(p), B.ROWS):
                part = p[at : at + B.ROWS]
                rough = (part * part).sum(1)[:, None] + squares - 2 * part @ q.T
                for i, row in enumerate(rough, at):
                    if mine[i] in place:
                        row[place[mine[i]]] = np.inf
                    # the products only tell which rows may be among the nearest; those are measured exactly
                    edge = np.partition(row, samples - 1)[samples - 1] if len(row) > samples else np.inf
                    some = np.flatnonzero((row <= edge + 1e-9 * (1 + abs(edge))) & np.isfinite(row)) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
                    near.append(sorted(B.distances(q[some], p[i]).tolist())[:samples])
        else:
            mine = []
        return pa.Table.from_arrays([pa.array(mine, arrow.types[0]), pa.array(near, arrow.types[1])], schema=arrow)

    found = B.block_join(points, points, (n, n), cell, schema).groupBy("k").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, samples).alias("near"))
    core = F.when(F.size("near") > 0, F.element_at("near", -1)).otherwise(0.0)
    return points.join(found.select("k", core.alias("core")), "k")


def tree_of(keys: list, points: np.ndarray, core: np.ndarray) -> tuple[list, list, list]:
    """The spanning tree of mutual reachability of some rows: its ends, in order, and lengths."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, points, core = [keys[i] for i in order], points[order], core[order]
    n = len(keys)
    least, origin, outside = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, ends = 0, ([], [], [])
    for _ in range(n - 1):
        outside[at] = False
        w = np.maximum(np.maximum(B.distances(points, points[at]), core), core[at])
        closer = outside & (w < least)
        least[closer], origin[closer] = w[closer], at
        at = int(np.argmin(np.where(outside, least, np.inf)))
        a, b = sorted((int(origin[at]), at))
        for column, x in zip(ends, (keys[a], keys[b], float(least[at])), strict=True):
            column.append(x)
    return ends


def forest_of(keys: list, points: np.ndarray, core: np.ndarray, left: np.ndarray | None = None) -> tuple[list, list, list]:
    """The spanning tree of the pairs between rows in left and others (None: of all pairs), by Borůvka rounds over matrices of products.

    They are rough: they tell which pairs may be the shortest ones out of a component; those are measured exactly and
    ordered by (length, ends). Rows that are not finite have no edge.
    """
    good = np.flatnonzero(np.isfinite(points).all(1))
    order = sorted(good.tolist(), key=keys.__getitem__)
    keys, points, core, n = [keys[i] for i in order], points[order], core[order], len(order)
    sides = [np.arange(n)] * 2 if left is None else [np.flatnonzero(left[order]), np.flatnonzero(~left[order])]
    ends: tuple[list, list, list] = ([], [], [])
    if n < 2 or not len(sides[0]) or not len(sides[1]):
        return ends
    moved = points - points.mean(0)
    scale = np.sqrt((moved * moved).sum(1).max()) or 1.0
    rough, floor = (moved / scale).astype(np.float32), ((core / scale) ** 2).astype(np.float32)
    squares = (rough * rough).sum(1)
    slack = np.float32(8 * (points.shape[1] + 8) * 2.0**-24)

    def lengths(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        table = rough[mine] @ rough[theirs].T
        table *= -2
        table += squares[mine][:, None]
        table += squares[theirs]
        np.maximum(table, 0, out=table)
        if core.any():
            np.maximum(table, floor[mine][:, None], out=table)
            np.maximum(table, floor[theirs], out=table)
        return table

    views = [(mine, theirs, lengths(mine, theirs)) for mine, theirs in ([sides] if left is None else [sides, sides[::-1]])]
    names, near, least = np.arange(n), np.arange(n), np.full(n, np.inf, np.float32)

    def outside(mine: np.ndarray, theirs: np.ndarray, table: np.ndarray, some: np.ndarray) -> np.ndarray:
        return np.where(names[mine[some]][:, None] == names[theirs], np.float32(np.inf), table[some])

    def shortest(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = np.lexsort((np.maximum(u, v), np.minimum(u, v), w, names[u]))
        first = np.ones(len(by), bool)
        first[1:] = names[u[by[1:]]] != names[u[by[:-1]]]
        return u[by[first]], v[by[first]], w[by[first]]

    while True:
        for mine, theirs, some_table in views:
            # a row's nearest one counts until both are in one component
            stale = np.flatnonzero(names[near[mine]] == names[mine])
            for at in range(0, len(stale), B.ROWS):
                some = stale[at : at + B.ROWS]
                x = outside(mine, theirs, some_table, some)
                j = x.argmin(1)
                least[mine[some]], near[mine[some]] = x[np.arange(len(some)), j], theirs[j]
        edge = np.full(n, np.inf, np.float32)
        np.minimum.at(edge, names, least)
        if not np.isfinite(edge).any():
            return ends
        edge = np.where(np.isfinite(edge), edge + slack * (1 + edge), np.float32(-1))
        found = []
        for mine, theirs, some_table in views:
            rows = np.flatnonzero(least[mine] <= edge[names[mine]])
            for at in range(0, len(rows), B.ROWS):
                some = rows[at : at + B.ROWS]
                r, c = np.nonzero(outside(mine, theirs, some_table, some) <= edge[names[mine[some]]][:, None])
                for k in range(0, len(r), PAIRS):
                    u, v = mine[some[r[k : k + PAIRS]]], theirs[c[k : k + PAIRS]]
                    w = np.maximum(np.maximum(B.distances(points[u], points[v]), core[u]), core[v])
                    found.append(shortest(u, v, w))
        u, v, w = shortest(*map(np.concatenate, zip(*found, strict=True)))
        a, b = np.minimum(u, v), np.maximum(u, v)
        _, once = np.unique(a * n + b, return_index=True)
        for column, x in zip(ends, ([keys[i] for i in a[once]], [keys[i] for i in b[once]], w[once].tolist()), strict=True):
            column += x
        # of a mutual pair the least name is the root
        to = np.arange(n)
        to[names[u]] = names[v]
        back = to[to] == np.arange(n)
        to = np.where(back, np.minimum(to, np.arange(n)), to)
        while (to != to[to]).any():
            to = to[to]
        names = to[names]


def lined(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of some edges on rows 0 to n - 1 are in their shortest forest (of equal ones the first), the rows in a line, and the gap behind each.

    Two rows are joined at the greatest gap between them (inf: never), as whole lines are put behind one another.
    """
    up, size, tail, behind, gap = list(range(n)), [1] * n, list(range(n)), [-1] * n, [np.inf] * n
    kept = []
    order = np.argsort(w, kind="stable")
    for k, x, y, length in zip(order.tolist(), a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x == y:
            continue
        # a line begins with the row that names it; the longer one comes first
        if size[x] < size[y]:
            x, y = y, x
        up[y] = x
        size[x] += size[y]
        behind[tail[x]], gap[tail[x]] = y, length
        tail[x] = tail[y]
        kept.append(k)
    line = []
    for x in range(n):
        if up[x] == x:
            while x >= 0:
                line.append(x)
                x = behind[x]
    line = np.array(line, np.int64)
    return np.array(kept, np.int64), line, np.array(gap)[line]


def reach_of(line_gaps: np.ndarray, first: int, last: int) -> np.ndarray:
    """By place in a line: at which length, at most, it is joined with each of the places from first to last."""
    within = line_gaps[first:last].max(initial=0.0)
    out = np.full(len(line_gaps), within)
    out[last + 1 :] = np.maximum(within, np.maximum.accumulate(line_gaps[last:-1]))
    out[:first] = np.maximum(within, np.maximum.accumulate(line_gaps[:first][::-1])[::-1])
    return out


class Between:
    """The greatest gap between any two places of a line, from the greatest of each 1, 2, 4, ... gaps."""

    def __init__(self, gaps: np.ndarray):
        self.most = [gaps]
        while (half := 1 << (len(self.most) - 1)) * 2 <= len(gaps):
            wider = self.most[-1].copy()
            wider[:-half] = np.maximum(wider[:-half], self.most[-1][half:])
            self.most.append(wider)
        self.most = np.stack(self.most)

    def __call__(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of places p and q, which differ."""
        p, q = np.minimum(p, q), np.maximum(p, q)
        k = np.frexp(q - p)[1] - 1
        return np.maximum(self.most[k, p], self.most[k, q - (1 << k)])


def joined(points: np.ndarray, core: np.ndarray, m: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shortest tree of rows, all finite, given the edges a, b, w of the trees of the first m and of the others.

    Returns its edges and the line and gaps of `lined`; edges between the two sides have the first side's row first.
    """
    n = len(points)
    if not 0 < m < n:
        kept, line, gaps = lined(n, a, b, w)
        return a[kept], b[kept], w[kept], line, gaps
    moved = points - points.mean(0)
    scale = np.sqrt((moved * moved).sum(1).max()) or 1.0
    rough = (moved / scale).astype(np.float32)
    squares, ones = (rough * rough).sum(1)[:, None], np.ones((n, 1), np.float32)
    # the product of a row of either is a squared distance
    ours, theirs = np.hstack([-2 * rough[:m], squares[:m], ones[:m]]), np.hstack([rough, ones, squares])
    slack = np.float32(8 * (points.shape[1] + 8) * 2.0**-24)

    def lengths(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        parts = [np.maximum(np.maximum(B.distances(points[u[k : k + PAIRS]], points[v[k : k + PAIRS]]), core[u[k : k + PAIRS]]), core[v[k : k + PAIRS]]) for k in range(0, len(u), PAIRS)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def rough_limit(bound: np.ndarray) -> np.ndarray:
        """What the product of a pair within bound is at most."""
        limit = (bound / scale) ** 2
        return (limit + slack * (1 + limit)).astype(np.float32)

    # the nearest ones of some rows, so that most ways between the sides are short
    some = np.arange(0, m, SAMPLED)
    nearest = np.concatenate([m + (ours[some[k : k + 64]] @ theirs[m:].T).argmin(1) for k in range(0, len(some), 64)])
    a, b, w = np.concatenate([a, some]), np.concatenate([b, nearest]), np.concatenate([w, lengths(some, nearest)])
    waiting, found, many = np.ones(m, bool), [], 0

    def settle() -> tuple[np.ndarray, np.ndarray]:
        nonlocal a, b, w, many
        a, b, w = (np.concatenate([x, *(f[i] for f in found)]) for i, x in enumerate((a, b, w)))
        found.clear()
        kept, line, gaps = lined(n, a, b, w)
        a, b, w, many = a[kept], b[kept], w[kept], 0
        return line, gaps

    while True:
        line, gaps = settle()
        mine = np.flatnonzero((line < m) & waiting[np.minimum(line, m - 1)])
        if not len(mine):
            return a, b, w, line, gaps
        between = Between(gaps)
        places = np.flatnonzero(line >= m)
        columns = line[places]
        sorted_theirs = theirs[columns]
        for at in range(0, len(mine), TILE[0]):
            spots = mine[at : at + TILE[0]]
            rows = line[spots]
            waiting[rows] = False
            bound = reach_of(gaps, spots[0], spots[-1])[places]
            limit = rough_limit(bound)
            # nothing is shorter than 0, or than a core distance
            limit[(bound <= 0) | (core[columns] >= bound)] = -1
            for c in range(0, len(columns), TILE[1]):
                width = min(TILE[1], len(columns) - c)
                near = np.zeros((len(rows), -(-width // 8) * 8), bool)
                product = ours[rows] @ sorted_theirs[c : c + width].T
                np.less_equal(product, limit[c : c + width], out=near[:, :width])
                # eight at once: few are near
                eights = np.flatnonzero(near.view(np.uint64))
                e, k = np.nonzero(near.reshape(-1, 8)[eights])
                r, k = np.divmod(eights[e] * 8 + k, near.shape[1])
                if len(r):
                    u, v, most = rows[r], columns[c + k], between(spots[r], places[c + k])
                    few = (product[r, k] <= rough_limit(most)) & (np.maximum(core[u], core[v]) < most)
                    u, v, most = u[few], v[few], most[few]
                    exact = lengths(u, v)
                    short = exact < most
                    found.append((u[short], v[short], exact[short]))
                    many += int(short.sum())
            if many > 2 * n:
                break


def block_tree(points: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shortest tree of rows, all finite, as `joined` gives it: trees of LEAF rows are found by themselves, and joined by twos."""
    n = len(points)
    if n <= LEAF:
        a, b, w = forest_of(list(range(n)), points, core)
        a, b, w = np.array(a, np.int64), np.array(b, np.int64), np.array(w, np.float64)
        kept, line, gaps = lined(n, a, b, w)
        return a[kept], b[kept], w[kept], line, gaps
    m = n // 2
    one, two = block_tree(points[:m], core[:m]), block_tree(points[m:], core[m:])
    return joined(points, core, m, np.concatenate([one[0], two[0] + m]), np.concatenate([one[1], two[1] + m]), np.concatenate([one[2], two[2]]))


def block_rows(points: DataFrame, size: int) -> DataFrame:
    """Finite rows of points (k, v, core, __b) with their place and gap in their block's line, and one edge a, b, w (a < b) of its tree each, but for the last."""
    key = points.schema["k"].dataType
    schema = StructType([*points.schema.fields]).add("place", "integer").add("gap", "double").add("a", key).add("b", key).add("w", "double")
    arrow, names = to_arrow_schema(schema), points.columns

    def run(rows: pa.Table) -> pa.Table:
        keys, at = rows.column("k").to_pylist(), np.flatnonzero(np.isfinite(m := B.matrix(rows, "v", size)).all(1))
        at = np.array(sorted(at.tolist(), key=keys.__getitem__), np.int64)
        a, b, w, line, gaps = block_tree(m[at], rows.column("core").to_numpy()[at])
        keys = [keys[i] for i in at.tolist()]
        ends = [sorted((keys[x], keys[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        rest = [None] * (len(at) - len(ends))
        some = rows.take(pa.array(at[line]))
        new = [range(len(at)), gaps, [x for x, _ in ends] + rest, [y for _, y in ends] + rest, w.tolist() + rest]
        old = [some.column(c).cast(t) for c, t in zip(names, arrow.types, strict=False)]
        return pa.Table.from_arrays([*old, *[pa.array(x, t) for x, t in zip(new, arrow.types[len(names) :], strict=True)]], schema=arrow)

    return points.groupBy("__b").applyInArrow(run, schema)


def cell_trees(points: DataFrame, size: int, block: int | None = None) -> tuple[DataFrame, int]:
    """Edges a, b, w (a < b) of each block's tree, and those between each two blocks that are in the tree of their rows; and the number of blocks. points: k, v, core."""
    count = points.count()
    n = B.count_of(count, block or min(WIDEST, max(NARROWEST, -(-count // SPLIT))))
    schema = edge_schema(points.schema["k"].dataType)
    arrow = to_arrow_schema(schema)

    def cell(rows: pa.Table) -> pa.Table:
        side, place = (rows.column(c).to_numpy() for c in ("__b", "place"))
        order = np.lexsort((place, side))
        keys, gap, m = rows.column("k").to_pylist(), rows.column("gap").to_numpy()[order], int((side == side.min()).sum())
        # a line stands for its tree: neighbours joined at their gap
        at = np.flatnonzero(np.isfinite(gap))
        at = at[(at != m - 1) & (at != len(gap) - 1)]
        a, b, w = joined(B.matrix(rows, "v", size)[order], rows.column("core").to_numpy()[order], m, at, at + 1, gap[at])[:3]
        new = (a < m) & (b >= m)
        ends = [sorted((keys[x], keys[y])) for x, y in zip(order[a[new]].tolist(), order[b[new]].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(([x for x, _ in ends], [y for _, y in ends], w[new]), arrow.types, strict=True)], schema=arrow)

    lines = block_rows(B.in_blocks(points, n, "__b"), size)
    if n == 1:
        return lines.where("w is not null").select("a", "b", "w"), n
    lines = materialize(lines)
    spread = lines.select("k", "v", "core", "__b", "place", "gap", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__o")).where("__b <> __o")
    cells = spread.select("k", "v", "core", "__b", "place", "gap", F.least("__b", "__o").alias("__i"), F.greatest("__b", "__o").alias("__j"))
    # cells are few and dear, so each may be a task
    cells = cells.repartition(min(n * (n - 1) // 2, CELLS), "__i", "__j")
    return lines.where("w is not null").select("a", "b", "w").unionByName(cells.groupBy("__i", "__j").applyInArrow(cell, schema)), n


def edge_schema(key: DataType) -> StructType:
    return StructType().add("a", key).add("b", key).add("w", "double")


def named(hooks: DataFrame) -> DataFrame:
    """c and root: the least member of each mutual pair names its tree. hooks: c, to; each tree of them has one mutual pair."""
    back = hooks.select(F.col("c").alias("__c"), F.col("to").alias("__to"))
    mutual = hooks.join(back, F.col("to") == F.col("__c"), "left")
    root = (F.col("__to") == F.col("c")) & (F.col("c") < F.col("to"))
    state = materialize(mutual.select("c", F.when(root, F.col("c")).otherwise(F.col("to")).alias("root")))
    while True:
        up = state.select(F.col("c").alias("__c"), F.col("root").alias("__root"))
        state = materialize(state.join(up, F.col("root") == F.col("__c"), "left").select("c", F.coalesce("__root", "root").alias("new"), "root"))
        moved = state.where("new <> root").limit(1).count()
        state = state.select("c", F.col("new").alias("root"))
        if not moved:
            return state


def rest_of_tree(state: DataFrame, schema: StructType) -> DataFrame:
    """The shortest forest of edges x, y, w, a, b between components x and y, in one task: a, b, w."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([(c, "ascending") for c in ("w", "a", "b")])
        number: dict = {}
        x, y = (np.array([number.setdefault(c, len(number)) for c in table.column(s).to_pylist()], np.int64) for s in ("x", "y"))
        kept, _, _ = lined(len(number), x, y, table.column("w").to_numpy())
        some = table.take(pa.array(kept)).select(["a", "b", "w"]).cast(arrow)
        yield from some.to_batches()

    return state.select("x", "y", "w", "a", "b").coalesce(1).mapInArrow(run, schema)


def spanning_tree(edges: DataFrame, band: int = BAND) -> DataFrame:
    """The shortest spanning forest of a graph by Borůvka rounds, until band edges or less are left. edges: a, b, w with a < b; repeated edges count once."""
    key = edges.schema["a"].dataType
    found = None
    # x and y name the components of an edge's ends
    state = materialize(edges.groupBy("a", "b").agg(F.min("w").alias("w")).select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b"))
    while left := state.count():
        if left <= band:
            taken = rest_of_tree(state, edge_schema(key))
            found = taken if found is None else found.unionByName(taken)
            break
        order = F.struct("w", "a", "b")
        sides = state.select(F.col("x").alias("c"), F.col("y").alias("to"), order.alias("e")).unionByName(state.select(F.col("y").alias("c"), F.col("x").alias("to"), order.alias("e")))
        best = materialize(sides.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e"))
        taken = best.select("e.a", "e.b", "e.w").distinct()
        found = taken if found is None else found.unionByName(taken)
        roots = named(best.select("c", "to"))
        for side in ("x", "y"):
            to = roots.select(F.col("c").alias("__c"), F.col("root").alias("__root"))
            state = state.join(to, F.col(side) == F.col("__c"), "left").withColumn(side, F.coalesce("__root", side)).drop("__c", "__root")
        cross = state.where("x <> y").withColumns({"__l": F.least("x", "y"), "__g": F.greatest("x", "y")})
        state = materialize(cross.groupBy("__l", "__g").agg(F.min(order).alias("e")).select(F.col("__l").alias("x"), F.col("__g").alias("y"), "e.w", "e.a", "e.b"))
    return materialize(found) if found is not None else edges.sparkSession.createDataFrame([], edge_schema(key))


class Condenser:
    """Merges components by ascending edges and writes out what is settled.

    A component of under least rows is the list of its rows; a larger one is a cluster: number, size, sum of the rates at
    which rows left it, and what the best choice below it is worth (None: there are no clusters below).
    """

    def __init__(self, least: int, first: int):
        self.least, self.next = least, first
        self.parent: dict = {}
        self.small: dict[object, list] = {}
        self.large: dict[object, list] = {}
        #: Settled: rows with the cluster that they left, and clusters with the one above and whether they are chosen.
        self.rows: list[tuple] = []
        self.clusters: list[tuple] = []

    def top(self, x: object) -> object:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def put(self, x: object, size: int, number: int | None, left: float | None, below: float | None, rows: list | None) -> None:
        """A component from before."""
        if number is None:
            self.small[x] = rows or [x]
        else:
            self.large[x] = [number, size, left, below]

    def close(self, cluster: list, rate: float, above: int) -> float:
        """A cluster ends as it merges with another at a rate; returns what it or what is below it is worth."""
        number, size, left, below = cluster
        mass = left - size * rate
        chosen = below is None or mass >= below - 1e-12 * abs(left)
        self.clusters.append((number, above, chosen))
        return mass if below is None else max(mass, below)

    def level(self, edges: list[tuple], w: float) -> None:
        """Merges what edges (pairs of rows or components) of one length join, all at once, so their order does not count."""
        joined: dict[object, list] = {}
        for a, b in edges:
            x, y = self.top(a), self.top(b)
            if x != y:
                joined[x] = joined.pop(x, [x]) + joined.pop(y, [y])
                self.parent[y] = x
        rate = 1 / w if w > 0 else FASTEST
        for top, parts in joined.items():
            rest = [r for c in parts if c not in self.large for r in self.small.pop(c, [c])]
            large = [self.large.pop(c) for c in parts if c in self.large]
            if len(large) == 1:
                cluster = large[0]
                cluster[1] += len(rest)
                cluster[2] += len(rest) * rate
            elif large or len(rest) >= self.least:
                size = sum(c[1] for c in large) + len(rest)
                cluster = [self.next, size, size * rate, sum(self.close(c, rate, self.next) for c in large) if large else None]
                self.next += 1
            else:
                self.small[top] = rest
                continue
            self.large[top] = cluster
            self.rows += [(r, cluster[0]) for r in rest]


def band_task(least: int, first: int, last: bool, schema: StructType):  # noqa: ANN201
    """A function that merges the edges of a band (first: the first number for its clusters), given the components that they join."""
    arrow = to_arrow_schema(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        work = Condenser(least, first)
        for r in b.to_pylist():
            work.put(r["k"], r["size"], r["c"], r["left"], r["below"], r["rows"])
        names = b.column("k").to_pylist()
        edges = sorted(zip(a.column("w").to_pylist(), a.column("a").to_pylist(), a.column("b").to_pylist(), strict=True))
        for w, some in groupby(edges, key=lambda e: e[0]):
            work.level([e[1:] for e in some], w)
        out = [{"what": "row", "k": k, "c": c} for k, c in work.rows] + [{"what": "cluster", "c": c, "above": up, "chosen": ok} for c, up, ok in work.clusters]
        for x, (c, n, left, below) in work.large.items():
            out.append({"what": "held", "k": x, "size": n, "c": c, "left": left, "below": below})
            if last:
                out.append({"what": "cluster", "c": c, "above": None, "chosen": False})
        out += [{"what": "held", "k": x, "size": len(rest), "rows": rest} for x, rest in work.small.items()]
        out += [{"what": "name", "k": x, "to": top} for x in names if (top := work.top(x)) != x]
        return pa.Table.from_pylist(out, schema=arrow)

    return run


def condensed(tree: DataFrame, least: int, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """Rows with the cluster they left (k, c), and clusters (c, above, chosen); the root is never chosen. tree: a, b, w."""
    spark, key = tree.sparkSession, tree.schema["a"].dataType
    schema = (
        StructType().add("what", "string").add("k", key).add("c", "long").add("above", "long").add("chosen", "boolean")
        .add("to", key).add("size", "long").add("left", "double").add("below", "double").add("rows", ArrayType(key))
    )
    count = B.count_of(tree.count(), band)
    ordered = materialize(R.batches(tree, [F.col("w"), F.col("a"), F.col("b")], band)) if count > 1 else tree.withColumn("batch", F.lit(0).cast("long"))
    parts, held, last = [], None, count - 1
    for number in range(count):
        edges = ordered.where(F.col("batch") == number).select("a", "b", "w")
        names = edges.select(F.col("a").alias("k")).unionByName(edges.select(F.col("b").alias("k"))).distinct()
        before = names.withColumns({"size": F.lit(1).cast("long"), **{c: F.lit(None).cast(schema[c].dataType) for c in ("c", "left", "below", "rows")}})
        if held is not None:
            before = names.join(held, "k", "left").select("k", F.coalesce("size", F.lit(1)).cast("long").alias("size"), "c", "left", "below", "rows")

        # one group on either side
        sides = [x.withColumn("__g", F.lit(0)).groupBy("__g") for x in (edges, before)]
        one = sides[0].cogroup(sides[1]).applyInArrow(band_task(least, number * band, number == last, schema), schema)
        done = materialize(one)
        parts.append(done)
        if number < last:
            gone = done.where("what = 'name'").select("k", "to")
            fresh = done.where("what = 'held'").select("k", "size", "c", "left", "below", "rows")
            # components that this band did not touch stay as they are
            held = materialize(fresh if held is None else held.join(names, "k", "left_anti").select(*fresh.columns).unionByName(fresh))
            to = gone.select(F.col("k").alias("__k"), "to")
            later = ordered.where(F.col("batch") > number)
            for side in ("a", "b"):
                later = later.join(to, F.col(side) == F.col("__k"), "left").withColumn(side, F.coalesce("to", side)).drop("__k", "to")
            ordered = materialize(later)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.where("what = 'row'").select("k", "c"), every.where("what = 'cluster'").select("c", "above", "chosen")


def chosen_in_one(clusters: DataFrame) -> DataFrame:
    """chosen_above of few clusters, in one task. A cluster has a lower number than the one above."""
    schema = StructType().add("c", "long").add("best", "long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {None: None}
        for c, above, chosen in sorted((x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)), reverse=True):
            best[c] = c if best[above] is None and chosen else best[above]
        del best[None]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(best), list(best.values()))], schema=arrow)

    return clusters.select("c", "above", "chosen").coalesce(1).mapInArrow(run, schema)


def chosen_above(clusters: DataFrame, band: int = BAND) -> DataFrame:
    """c and best: the highest chosen cluster from c upwards (null: none), by pointer doubling; band clusters or less in one task."""
    if clusters.count() <= band:
        return materialize(chosen_in_one(clusters))
    state = materialize(clusters.select("c", F.when(F.col("chosen"), F.col("c")).alias("best"), "above"))
    while state.where("above is not null").limit(1).count():
        up = state.select(F.col("c").alias("__c"), F.col("best").alias("__best"), F.col("above").alias("__above"))
        joined = state.join(up, F.col("above") == F.col("__c"), "left")
        state = materialize(joined.select("c", F.coalesce("__best", "best").alias("best"), F.col("__above").alias("above")))
    return state.select("c", "best")


def hdbscan(df: DataFrame, key: str, vector: str, size: int, least: int = 2, samples: int = 1, block: int | None = None, band: int = BAND) -> DataFrame:
    """key and cluster of every row with a vector of size elements, over the whole table; -1 is noise.

    Clusters are numbered by their least key. key is unique and not null. Fewer rows than least: all are noise.
    """
    # floats are moved as floats, which is half the shuffle; cells reckon in doubles
    whole = F.col(vector) if df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull) else V.doubles(F.col(vector))
    points = materialize(B.usable(df, vector, size).select(F.col(key).alias("k"), whole.alias("v")))
    cored = points.withColumn("core", F.lit(0.0)) if samples == 1 else materialize(core_distances(points, size, samples, block or BLOCK))
    edges, blocks = cell_trees(cored, size, block)
    tree = materialize(edges)
    if blocks > 1:
        tree = spanning_tree(tree, band)
    rows, clusters = condensed(tree, max(2, least), band)
    found = materialize(rows.join(chosen_above(clusters, band), "c").where("best is not null").select("k", "best"))
    firsts = found.groupBy("best").agg(F.min("k").alias("first"))
    numbers = R.numbered(firsts, [F.col("first")], name="cluster").select(F.col("best").alias("__b"), "cluster")
    labels = found.join(numbers, F.col("best") == F.col("__b")).select("k", "cluster")
    out = points.select("k").join(labels, "k", "left")
    return out.select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def cluster_rows(labels: DataFrame, df: DataFrame, key: str, vector: str, title: str) -> DataFrame:
    """Clusters to store: cluster, id, label, description, centre, member count and the first member as representative; noise is none."""
    members = labels.where("cluster >= 0").join(df.select(key, vector, title), key)
    first = members.groupBy("cluster").agg(F.count("*").alias("member_count"), F.min(key).alias("representative_article_id"), F.min_by(title, key).alias("__title"))
    parts = members.select("cluster", F.posexplode(V.doubles(F.col(vector))).alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("x"))
    centers = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("center_embedding"))
    said = F.concat(F.lit("Cluster of "), F.col("member_count"), F.lit(" articles. Representative: "), F.substring(F.coalesce("__title", F.lit("")), 1, 100), F.lit("..."))
    ident = F.sha2(F.concat_ws("|", F.lit("hdbscan"), F.col("representative_article_id").cast("string"), F.col("member_count").cast("string")), 256)
    out = first.join(centers, "cluster")
    return out.select("cluster", ident.alias("id"), F.concat(F.lit("Cluster_"), F.col("cluster")).alias("label"), said.alias("description"), "center_embedding", "member_count", "representative_article_id")
