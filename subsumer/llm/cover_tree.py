"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and data are dealt to cells, the first level of the joint tree: balanced clusters of a bounded sample, with the
covering radius of all rows in each. Cells are dealt to blocks, and the tree of a block is built once. A first pass
searches each cell of queries in the few cells with the largest bounds; of the other pairs of cells only those whose
bound reaches the worst kth score of the query cell are searched, from each query's kth score on. Inside a pair of blocks
pairs of nodes are pruned in the same way, and what is left of two leaves is one matrix product.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import table

#: Sums of products up to here are exact in doubles.
EXACT = float(vectors.EXACT)
#: Cells of queries, and of data, in a tile.
CELL_TILE, LIST_TILE = 32, 4
#: Room for rounding in bounds and products, as a share of the largest that norms allow.
SLACK = 1e-12


@dataclass(frozen=True)
class Search:
    """k: answers. scale: components become floor(scale * x). cell_rows, cell_queries: distinct vectors, and queries, a
    cell, on average, until there are most_cells; larger cells have several blocks. first: cells that a cell of queries is
    searched in to begin with."""

    k: int = 5
    scale: float = 256.0
    cell_rows: int = 4096
    cell_queries: int = 512
    most_cells: int = 1024
    first: int = 3


@dataclass
class Node:
    """Points start to end - 1 of the tree's order, none farther from the center than radius, none longer than largest; leaves first to last - 1 are below it or it."""

    center: np.ndarray
    norm: float
    radius: float
    largest: float
    start: int
    end: int
    children: list[Node]
    first: int = 0
    last: int = 0


def nets(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(order, levels): the points in an order in which each is the farthest from those before it, and for each level (number of centres, the nearest centre of every point).

    The centres of a level are the first points of the order, so each level's are among the next one's (nesting); they are farther than its
    radius from each other (separation), and every point is within it of one (covering). Radii halve; levels that add no centre are left out.
    The last level has all distinct points.
    """
    n = len(x)
    squares = (x * x).sum(axis=1)
    away, nearest = np.full(n, np.inf), np.zeros(n, np.intp)
    order, levels, radius, at = [], [], np.inf, 0
    while True:
        if order and away[at] <= radius**2:
            levels.append((len(order), nearest.copy()))
            if not away[at] > 0:
                return np.array(order), levels
            radius = float(np.sqrt(away[at])) if radius == np.inf else radius
            while radius**2 >= away[at]:
                radius /= 2
        order.append(at)
        d = np.maximum(squares + squares[at] - 2 * (x @ x[at]), 0)
        d[d <= SLACK * (squares + squares[at])] = 0  # rounding only: the same place
        d[at] = 0
        near = d < away
        away[near], nearest[near] = d[near], at
        at = int(away.argmax())


def cover_tree(x: np.ndarray) -> tuple[Node, np.ndarray]:
    """The root and an order of the rows of x in which each node's points are those from start to end - 1.

    A node is a centre of a level with the points whose chain of nearest centres leads to it; its children are those of the next level.
    Children of a single point each are one leaf together: far points have nobody near, and a node for each would prune nothing.
    """
    norms = np.sqrt((x * x).sum(axis=1))
    _, levels = nets(x)
    # the centre of every point on each level, from the finest: a centre's own centre one level up
    chain = [levels[-1][1]]
    for _, nearest in reversed(levels[:-1]):
        chain.append(nearest[chain[-1]])
    chain.reverse()
    order: list[np.ndarray] = []
    placed = leaves = 0

    def node(rows: np.ndarray, center: np.ndarray, level: int) -> Node:
        nonlocal placed, leaves
        radius = float(np.sqrt(((x[rows] - center) ** 2).sum(axis=1)).max())
        out = Node(center, float(np.sqrt(center @ center)), radius, float(norms[rows].max()), placed, 0, [], leaves)
        while level < len(chain) and (chain[level][rows] == chain[level][rows[0]]).all():
            level += 1
        if radius and level < len(chain):
            own = chain[level][rows]
            by = np.argsort(own, kind="stable")
            groups = np.split(rows[by], np.flatnonzero(np.diff(own[by])) + 1)
            single = [g for g in groups if len(g) == 1]
            for g in groups:
                if len(g) > 1:
                    out.children.append(node(g, x[chain[level][g[0]]], level + 1))
            if out.children and single:
                rest = np.concatenate(single)
                out.children.append(node(rest, x[rest].mean(axis=0), len(chain)))
        if not out.children:
            order.append(rows)
            placed += len(rows)
            leaves += 1
        out.end, out.last = placed, leaves
        return out

    return node(np.arange(len(x)), x[0], 0), np.concatenate(order)


class Many:
    """Nodes as columns."""

    def __init__(self, nodes: list[Node]) -> None:
        self.nodes = nodes
        self.center = np.stack([b.center for b in nodes])
        self.norm, self.radius, self.largest = (np.array([getattr(b, c) for b in nodes], np.float64) for c in ("norm", "radius", "largest"))
        self.size = np.array([b.end - b.start for b in nodes])

    def bounds(self, center: np.ndarray, norm: np.ndarray, radius: np.ndarray, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower): for each of several balls of points (rows) and each node (columns), what no product is above and none below."""
        norm, radius, largest = (np.asarray(v, np.float64)[:, None] for v in (norm, radius, largest))
        dot = center @ self.center.T
        spread = radius * self.norm + self.radius * norm + radius * self.radius
        room = SLACK * 2 * (norm + radius + largest) * (self.norm + self.radius + self.largest) + SLACK * (largest**2 + self.largest**2)
        # rounding of the squared distance is a share of the norms
        apart = np.sqrt(np.maximum(norm**2 + self.norm**2 - 2 * dot - 8 * SLACK * (norm**2 + self.norm**2), 0)) - radius - self.radius
        by_distance = (largest**2 + self.largest**2 - np.maximum(apart, 0) ** 2) / 2
        return np.minimum(np.minimum(dot + spread, by_distance), largest * self.largest) + room, np.maximum(dot - spread, -largest * self.largest) - room


def room(a: Node, b: Node) -> float:
    """More than rounding changes a bound or a product of points of a and b."""
    return SLACK * (a.norm + a.radius + a.largest) * (b.norm + b.radius + b.largest) * 2 + SLACK * (a.largest**2 + b.largest**2)


@dataclass
class Tree:
    """A block's points in the order of their tree; first_id: the smallest id of each."""

    root: Node
    x: np.ndarray
    order: np.ndarray
    first_id: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, first_id: np.ndarray) -> Tree:
        root, order = cover_tree(x)
        return cls(root, x[order], order, first_id[order])


    def leaves(self) -> list[Node]:
        """The leaves in order."""
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            todo += reversed(n.children)
            out += [] if n.children else [n]
        return out


@dataclass
class Counts:
    """Products made, of all there are."""

    made: int = 0
    all: int = 0


def dual_tree(q: Tree, v: Tree, keep: int, least: np.ndarray | None = None, counts: Counts | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q's order, rows of v's order, scores) of the `keep` largest products of each query, ties to smaller first_id.

    least: for each query (in its tree's order) a score below which nothing is wanted. Scores are whole numbers: doubles, or
    Python's if doubles can't hold the products.
    """
    small = float(np.abs(q.x).max()) * float(np.abs(v.x).max()) * q.x.shape[1] < EXACT
    n = len(q.x)
    worst = np.full(n, -np.inf) if least is None else least.astype(np.float64)
    found: list[list[np.ndarray]] = [[np.zeros(0, np.intp)] * 2 + [np.zeros(0)]]
    top = np.full((n, keep), -np.inf)
    leaves, made, norms = Many(v.leaves()), 0, np.sqrt((q.x * q.x).sum(axis=1))

    def product(rows: np.ndarray, cols: np.ndarray, err: float) -> None:
        nonlocal made
        s = q.x[rows] @ v.x[cols].T
        made += s.size
        both = np.concatenate((top[rows], s if s.shape[1] <= keep else -np.partition(-s, keep - 1, axis=1)[:, :keep]), axis=1)
        top[rows] = -np.partition(-both, keep - 1, axis=1)[:, :keep]
        worst[rows] = np.maximum(worst[rows], top[rows].min(axis=1) - err)
        i, j = np.nonzero(s >= (worst[rows] - err)[:, None])
        found.append([rows[i], cols[j], s[i, j]])

    def search(a: Node, chosen: np.ndarray) -> None:
        """The queries of a leaf in the chosen leaves of v: of each query those whose bound reaches its worst score, the largest bounds first."""
        rows = np.arange(a.start, a.end)
        err = 0.0 if small else room(q.root, v.root) * q.x.shape[1]
        cols = lambda leaf: np.arange(leaves.nodes[leaf].start, leaves.nodes[leaf].end)
        if len(chosen) == 1:
            product(rows, cols(chosen[0]), err)
            return
        upper = leaves.bounds(q.x[rows], norms[rows], np.zeros(len(rows)), norms[rows])[0][:, chosen]
        sizes = leaves.size[chosen]
        for i, row in enumerate(rows.tolist()):
            order = np.argsort(-upper[i], kind="stable")
            # as many leaves as hold enough, then all that still reach the worst score, in one product
            enough = int(np.searchsorted(np.cumsum(sizes[order]), keep)) + 1
            one = np.array([row])
            begin = order[:enough]
            begin = begin[upper[i, begin] >= worst[row]]
            if not len(begin):
                continue
            product(one, np.concatenate([cols(c) for c in chosen[begin]]), err)
            rest = order[enough:]
            rest = rest[upper[i, rest] >= worst[row]]
            if len(rest):
                product(one, np.concatenate([cols(c) for c in chosen[rest]]), err)

    def visit(a: Node, nodes: list[Node]) -> None:
        """Pairs of a and the nodes: pruned against the worst score of the queries of a, the nodes opened while they are wider than a."""
        while True:
            many = Many(nodes)
            upper, lower = (z[0] for z in many.bounds(a.center[None], [a.norm], [a.radius], [a.largest]))
            # nodes that hold `keep` points have no product below the lowest of their bounds
            by = np.argsort(-lower, kind="stable")
            enough = int(np.searchsorted(np.cumsum(many.size[by]), keep))
            least_ = max(worst[a.start : a.end].min(), lower[by[enough]] if enough < len(by) else -np.inf)
            nodes = [b for b, up in zip(nodes, upper, strict=True) if up >= least_]
            wide = [b for b in nodes if b.children and (b.radius > a.radius or not a.children)]
            if not wide or not a.children:
                break
            nodes = [c for b in nodes for c in (b.children if b.children and b.radius > a.radius else [b])]
        if not nodes:
            return
        if a.children:
            for c in a.children:
                visit(c, nodes)
        else:
            search(a, np.concatenate([np.arange(b.first, b.last) for b in nodes]))

    visit(q.root, [v.root])
    if counts is not None:
        counts.made, counts.all = counts.made + made, counts.all + n * len(v.x)
    i, j, s = (np.concatenate(z) for z in zip(*found, strict=True))
    if small:
        kept = s >= worst[i]
    else:
        kept = s >= worst[i] - room(q.root, v.root) * q.x.shape[1]
    i, j, s = i[kept], j[kept], s[kept]
    if not small:
        exact = np.empty(len(i), object)
        for r, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            exact[r] = sum(int(c) * int(d) for c, d in zip(q.x[a].tolist(), v.x[b].tolist(), strict=True))
        s = exact
    # whole numbers in order without a double between them
    by = np.array(sorted(range(len(i)), key=lambda r: (i[r], -s[r], v.first_id[j[r]])), np.intp) if s.dtype == object else np.lexsort((v.first_id[j], -s, i))
    i, j, s = i[by], j[by], s[by]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < keep], j[place < keep], s[place < keep]


PACKED = "cell int, block int, tree binary, k1 array<long>, k2 array<long>, ids array<array<long>>"
FOUND = "k1 long, k2 long, ids array<long>, score double, whole binary"


def _trees(placed: DataFrame, rows: int) -> DataFrame:
    """PACKED: the trees of the blocks of cells of (cell, k1, k2, vec, ids), about `rows` points each, and what belongs to their points, in their order.

    Cells are at most as many as clusters were fitted, so their sizes fit a broadcast.
    """
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("n"))
    dealt = placed.join(F.broadcast(table(sizes, "cell-sizes")), "cell").withColumn("block", F.pmod(F.xxhash64("k1", "k2"), "n").cast("int"))

    def build(block: pd.DataFrame) -> pd.DataFrame:
        first = np.array([x[0] for x in block["ids"]], np.int64)
        tree = Tree.of(vectors.matrix(block["vec"]), first)
        own = block.iloc[tree.order]
        one = {"cell": [own["cell"].iloc[0]], "block": [own["block"].iloc[0]], "tree": [pickle.dumps(tree)]}
        return pd.DataFrame(one | {c: [own[c].tolist()] for c in ("k1", "k2", "ids")})

    return table(dealt.groupBy("cell", "block").applyInPandas(build, PACKED), "trees")


def largest_products(rows: DataFrame, queries: DataFrame, settings: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with the other rows, exactly.

    Rows are (vec_id, embedding); components become floor(scale * x), in doubles. queries: ids (query_id) of rows. Null ids, and vectors
    that are null or hold null or non-finite components, take no part; nor do vectors of another length than the
    most frequent one. Rows that repeat an id and vector count once. Ties go to smaller ids. Fewer candidates than
    k give fewer rows; empty tables give none. Scores beyond the range of a long are cut to it. Other columns are ignored.
    """
    spark, keep = rows.sparkSession, settings.k + 1
    held = table(vectors.as_bytes(rows, vectors.floor_of(settings.scale), F.lit(True)), "vectors")
    classes = table(vectors.classes_of(held, keep), "classes")
    asked = held.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), *vectors.keys(), "vec").distinct()
    asked = table(asked, "queries")
    one = table(asked.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.array(F.min("query_id")).alias("ids")), "query-classes")
    n, n_asked = classes.count(), one.count()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = vectors.sample_of(classes)

    def placed(points: DataFrame, count: int, per_cell: int) -> tuple[DataFrame, np.ndarray, list[Node]]:
        cells = vectors.balanced_clusters(sample, max(1, min(settings.most_cells, count // per_cell, len(sample) // 4)))
        centers = np.stack([sample[c].mean(axis=0) for c in cells])
        sent = spark.sparkContext.broadcast(centers)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = sent.value
            for batch in batches:
                x = vectors.matrix(batch["vec"])
                cell = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
                away = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
                yield batch.assign(cell=cell.astype(np.int32), away=away, norm=np.sqrt((x * x).sum(axis=1)))

        out = table(points.select("k1", "k2", "vec", "ids").mapInPandas(place, "k1 long, k2 long, vec binary, ids array<long>, cell int, away double, norm double"), "cells")
        # a row for each cell: at most as many as clusters were fitted
        radii = {r["cell"]: (r["a"], r["n"]) for r in out.groupBy("cell").agg(F.max("away").alias("a"), F.max("norm").alias("n")).collect()}
        numbers = np.array(sorted(radii), np.int32)
        return _trees(out, per_cell), numbers, [Node(centers[i], float(np.sqrt(centers[i] @ centers[i])), *radii[i], 0, 0, []) for i in numbers.tolist()]

    data, lists, list_nodes = placed(classes, n, settings.cell_rows)
    groups, cells, cell_nodes = placed(one, n_asked, settings.cell_queries)
    own = Many(cell_nodes)
    bounds = Many(list_nodes).bounds(own.center, own.norm, own.radius, own.largest)[0]
    begin = np.zeros(bounds.shape, bool)
    np.put_along_axis(begin, np.argsort(-bounds, axis=1, kind="stable")[:, : settings.first], True, axis=1)

    def searched(chosen: np.ndarray, name: str, least: DataFrame | None = None) -> DataFrame:
        """The best of each query in the chosen cells. Trees meet by tiles of neighbouring cells, so each is sent once for a tile, not once for each pair."""
        i, j = np.nonzero(chosen)
        pairs = pd.DataFrame({"cell": cells[i], "list": lists[j], "ct": (i // CELL_TILE).astype(np.int32), "lt": (j // LIST_TILE).astype(np.int32)})
        wanted = pairs.groupby(["cell", "ct", "lt"])["list"].agg(lambda x: [int(v) for v in x]).reset_index()
        wanted = F.broadcast(spark.createDataFrame(wanted, "cell int, ct int, lt int, lists array<int>"))
        met = F.broadcast(spark.createDataFrame(pairs[["list", "lt", "ct"]].drop_duplicates(), "list int, lt int, ct int"))
        q = groups.select("cell", F.col("block").alias("qb"), F.col("tree").alias("q"), "k1", "k2")
        q = q.withColumn("least", F.lit(None).cast("array<struct<k1:bigint,k2:bigint,score:double>>")) if least is None else q.join(F.broadcast(least), ["cell", "qb"], "left")
        v = data.select(F.col("cell").alias("list"), F.col("block").alias("vb"), F.col("tree").alias("v"), "ids")
        # blocks of a tile's cells by number: at most as many as the largest of its cells has
        q_blocks = groups.select("cell", F.col("block").alias("qb")).join(wanted, "cell").groupBy("ct").agg(F.collect_set("qb").alias("qb"))
        v_blocks = data.select(F.col("cell").alias("list"), F.col("block").alias("vb")).join(met, "list").groupBy("lt").agg(F.collect_set("vb").alias("vb"))
        left = q.join(wanted, "cell").join(F.broadcast(v_blocks), "lt").withColumn("vb", F.explode("vb"))
        right = v.join(met, "list").join(F.broadcast(q_blocks), "ct").withColumn("qb", F.explode("qb"))
        on = ["ct", "lt", "qb", "vb"]

        def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            trees = {}
            for number, tree, ids in zip(b["list"], b["v"], b["ids"], strict=True):
                own = np.empty(len(ids), object)
                own[:] = [list(x) for x in ids]
                trees[number] = pickle.loads(tree), own
            for tree, k1, k2, known, numbers in zip(a["q"], a["k1"], a["k2"], a["least"], a["lists"], strict=True):
                q = pickle.loads(tree)
                known = {(x["k1"], x["k2"]): x["score"] for x in known} if known is not None else {}
                worst = np.array([known.get(k, -np.inf) for k in zip(k1, k2, strict=True)])
                top = np.full((len(q.x), keep), -np.inf)
                for number in numbers:
                    if number not in trees:  # this block number has none of its rows
                        continue
                    v, ids = trees[number]
                    i, j, s = dual_tree(q, v, keep, worst)
                    out.append(vectors.best_of(np.asarray(k1), np.asarray(k2), ids, i, j, s))
                    # what the query has in this tile is a bound for the next tree
                    score = s.astype(np.float64)
                    score = score - np.abs(score) * SLACK if s.dtype == object else score
                    here = np.full((len(q.x), keep), -np.inf)
                    here[i, np.arange(len(i)) - np.searchsorted(i, i)] = score
                    top = -np.partition(-np.concatenate((top, here), axis=1), keep - 1, axis=1)[:, :keep]
                    worst = np.maximum(worst, top.min(axis=1))
            return pd.concat(out, ignore_index=True) if out else vectors.EMPTY.copy()

        # each group is a tile of bounded size; plans may put several in a task
        return table(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(score, FOUND), name)

    found = searched(begin, "first-cells")
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"))
    # a double may be above the whole number that it stands for
    lower = F.col("score") - F.abs("score") * SLACK
    kth = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == keep).select("k1", "k2", F.when(F.col("whole").isNull(), F.col("score")).otherwise(lower).alias("score"))
    each = groups.select("cell", F.col("block").alias("qb"), F.explode(F.arrays_zip("k1", "k2")).alias("k")).select("cell", "qb", "k.k1", "k.k2")
    each = table(each.join(kth, ["k1", "k2"], "left"), "kth-scores")
    worst = {r["cell"]: r["w"] for r in each.groupBy("cell").agg(F.min(F.coalesce("score", F.lit(float("-inf")))).alias("w")).collect()}
    rest = (bounds >= np.array([worst[i] for i in cells.tolist()])[:, None]) & ~begin
    if rest.any():
        least = each.where("score is not null").groupBy("cell", "qb").agg(F.collect_list(F.struct("k1", "k2", "score")).alias("least"))
        found = found.union(searched(rest, "other-cells", least))
    # if norms allow no product of 2**53, no block has whole numbers beyond doubles
    largest = [max(x.largest for x in y) for y in (cell_nodes, list_nodes)]
    whole = not largest[0] * largest[1] * sample.shape[1] * (1 + SLACK) < EXACT
    out = vectors.ranked(found, asked.select("query_id", "k1", "k2"), settings.k, whole=whole)
    return out.withColumn("score", F.col("score").cast("long"))
