"""Cluster trees over all clusters at once: average linkage (UPGMA) and neighbour joining.

A round takes the pairs of every cluster to one task per cluster and merges there. A cluster of at most ``WHOLE`` open
nodes is finished in that round. Of a larger one, average linkage merges all mutually nearest pairs by joins. Neighbour
joining sends the rows of the nodes with the least criterion only, as many as the same memory holds, and goes on merging
while a bound from row sums shows that no pair outside these rows comes first: the merges are those of one a round.
A node is named by its smallest leaf; ties go to the pair with the smaller names. State is written after each round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biotally.session import cut_lineage

WHOLE = 1024  # open nodes of a cluster whose distances a task holds as one matrix (8 MB)
_SURE = 1e-8  # what rounding of the criterion may hide from a bound
# Pairs of the last nodes tie in the criterion, and halved distances end in 5: the shift keeps equal ones on one side when rounded.
TIE_SHIFT = 1.37e-10


def nearest_pair(d: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The closest pair of each cluster, ties by (a, b): a partial aggregate, no sort of the pairs."""
    best = d.groupBy(cluster).agg(F.min(F.struct("d", "a", "b")).alias("m"))
    return best.select(cluster, F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.d").alias("d"))


def symmetric(d: DataFrame, cluster: str = "cluster") -> DataFrame:
    both = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
    return d.select(cluster, "d", F.inline(both))


def row_sums(d: DataFrame, cluster: str = "cluster") -> DataFrame:
    """r = sum of a node's distances / (n - 2), with n the number of open nodes of the cluster."""
    s = symmetric(d, cluster).groupBy(cluster, "node").agg(F.sum("d").alias("total"), F.count("*").alias("others"))
    return s.select(cluster, "node", (F.col("total") / F.nullif(F.col("others") - 1, F.lit(0))).alias("r"), (F.col("others") + 1).alias("n"))


def q_criterion(d: DataFrame, cluster: str = "cluster") -> DataFrame:
    """q = d - r_a - r_b per pair."""
    r = row_sums(d, cluster)
    ra = r.select(cluster, F.col("node").alias("a"), F.col("r").alias("ra"), "n")
    rb = r.select(cluster, F.col("node").alias("b"), F.col("r").alias("rb"))
    return d.join(ra, [cluster, "a"]).join(rb, [cluster, "b"]).withColumn("q", F.round(F.col("d") - F.col("ra") - F.col("rb"), 9))


def mutual_nearest(d: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Pairs that are each other's nearest node. Average linkage is reducible, so all of them can merge in one round."""
    sym = symmetric(d, cluster)
    order = F.struct("d", F.least("node", "other").alias("x"), F.greatest("node", "other").alias("y"))
    nn = sym.groupBy(cluster, "node").agg(F.min_by(F.struct("other", "d"), order).alias("m"))
    one = nn.select(cluster, F.col("node").alias("a"), F.col("m.other").alias("b"), F.col("m.d").alias("d"))
    other = one.select(cluster, F.col("a").alias("b"), F.col("b").alias("a"))
    return one.filter("a < b").join(other, [cluster, "a", "b"])


def _first(values: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[int, int]:
    """The pair (smaller, larger index) of the least value; among equal ones the first in order of its two indexes."""
    at = np.argwhere(values == values.min())
    i, j = rows[at[:, 0]], columns[at[:, 1]]
    lo, hi = np.minimum(i, j), np.maximum(i, j)
    k = np.lexsort((hi, lo))[0]
    return int(lo[k]), int(hi[k])


def _average_linkage(d: np.ndarray, size: np.ndarray, height: np.ndarray) -> list[tuple]:
    """(a, b, la, lb) until one node is left; d is rounded to 12 digits at each merge."""
    out, live = [], np.arange(len(d))
    np.fill_diagonal(d, np.inf)
    while len(live) > 1:
        a, b = _first(d[np.ix_(live, live)], live, live)
        h = d[a, b] / 2
        out.append((a, b, max(0.0, h - height[a]), max(0.0, h - height[b])))
        live = live[live != b]
        rest = live[live != a]
        d[a, rest] = d[rest, a] = np.round((size[a] * d[a, rest] + size[b] * d[b, rest]) / (size[a] + size[b]), 12)
        size[a] += size[b]
        height[a] = h
    return out


def _joined_neighbours(d: np.ndarray, total: np.ndarray, known: np.ndarray, least: np.ndarray) -> list[tuple]:
    """(a, b, la, lb) while the next merge is certain; ``d`` holds the rows of ``known`` nodes, and is brought up to date.

    ``total`` has every node's sum of distances, ``least`` the smallest distance of an unknown node to another unknown one.
    """
    out, live = [], np.ones(len(d), bool)
    np.fill_diagonal(d, np.inf)
    while live.sum() > 2:
        n = int(live.sum())
        r = total / (n - 2)
        rows, columns = np.flatnonzero(live & known), np.flatnonzero(live)
        hidden = np.flatnonzero(live & ~known)
        if len(hidden) and not out:
            columns = rows  # the first merge is among the known nodes
        q = np.round(d[np.ix_(rows, columns)] - r[rows, None] - r[columns] + TIE_SHIFT, 9)
        a, b = _first(q, rows, columns)
        if len(hidden) and out:
            bound = (least[hidden] - r[hidden]).min() - r[hidden].max()
            if not known[a] or not known[b] or q.min() >= bound - _SURE:
                break
        apart = d[a, b]
        limb = apart / 2 + (r[a] - r[b]) / 2
        out.append((a, b, max(0.0, limb), max(0.0, apart - limb)))
        live[b] = False
        rest = np.flatnonzero(live)
        rest = rest[rest != a]
        new = (d[a, rest] + d[b, rest] - apart) / 2
        total[rest] += new - d[a, rest] - d[b, rest]
        total[a] = new.sum()
        d[a, rest] = d[rest, a] = new
    if live.sum() == 2 and known[live].all():
        a, b = np.flatnonzero(live).tolist()
        half = max(0.0, d[a, b] / 2)
        out.append((a, b, half, half))
    return out


def _merging(method: str, cluster: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Merges of a cluster in one task, and the distances of its merged nodes to the open ones (step -1)."""

    def run(pairs: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node")
        names = nodes["node"].to_numpy()
        n = len(names)
        d = np.full((n, n), np.inf)
        if len(pairs):
            a, b = np.searchsorted(names, pairs["a"].to_numpy()), np.searchsorted(names, pairs["b"].to_numpy())
            d[a, b] = d[b, a] = pairs["d"].to_numpy()
        known = nodes["known"].to_numpy(zero_copy_only=False)
        if method == "upgma":
            merges = _average_linkage(d, nodes["size"].to_numpy().astype(float), nodes["height"].to_numpy().copy())
        else:
            merges = _joined_neighbours(d, nodes["total"].to_numpy().copy(), known, nodes["least"].to_numpy())
        rows = [(k, a, b, la, lb) for k, (a, b, la, lb) in enumerate(merges)]
        gone = {b for _, b, _, _ in merges}
        if len(gone) < n - 1:
            kept = sorted({a for a, _, _, _ in merges} - gone)
            open_ = [k for k in range(n) if k not in gone]
            rows += [(-1, min(a, k), max(a, k), d[a, k], 0.0) for a in kept for k in open_ if k > a or (k != a and k not in kept)]
        step, a, b, la, lb = zip(*rows, strict=True) if rows else ((),) * 5
        kind = nodes.schema.field("node").type
        label = nodes[cluster].slice(0, 1).combine_chunks()
        name = nodes["node"].combine_chunks()
        return pa.table(
            {
                cluster: label.take(pa.array(np.zeros(len(rows), np.int64))),
                "step": pa.array(step, pa.int32()),
                "a": name.take(pa.array(a, pa.int64())).cast(kind),
                "b": name.take(pa.array(b, pa.int64())).cast(kind),
                "la": pa.array(la, pa.float64()),
                "lb": pa.array(lb, pa.float64()),
            }
        )

    return run


def _drawing(cluster: str) -> Callable[[pa.Table], pa.Table]:
    """Newick text (leaf null) and the depth of each leaf of a cluster, from its merges in order."""

    def run(merges: pa.Table) -> pa.Table:
        merges = merges.sort_by([("round", "ascending"), ("step", "ascending")])
        a, b = merges["a"].to_pylist(), merges["b"].to_pylist()
        la, lb = merges["la"].to_pylist(), merges["lb"].to_pylist()
        now: dict = {}  # a name's node: the last merge that made it, or none for a leaf
        below = []
        for k in range(len(a)):
            below.append(((a[k], now.get(a[k]), la[k]), (b[k], now.get(b[k]), lb[k])))
            now[a[k]] = k
        parts, leaves, depths = [], [], []
        stack: list = [(a[-1], len(a) - 1, 0.0, 0.0)]
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                parts.append(top)
                continue
            name, made, length, depth = top
            if made is None:
                parts.append(f"{name}:{length:.3f}")
                leaves.append(name)
                depths.append(depth)
                continue
            (x, of_x, lx), (y, of_y, ly) = below[made]
            parts.append("(")
            stack += [f"):{length:.3f}", (y, of_y, ly, depth + ly), ",", (x, of_x, lx, depth + lx)]
        label = merges[cluster].slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(leaves) + 1, np.int64)))
        kind = merges.schema.field("a").type
        return pa.table({cluster: label, "leaf": pa.array([*leaves, None], kind), "depth": pa.array([*depths, None], pa.float64()), "newick": pa.array([None] * len(leaves) + ["".join(parts) + ";"], pa.string())})

    return run


def _average_round(d: DataFrame, nodes: DataFrame, cluster: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges of all mutually nearest pairs, and the distances and nodes after them."""
    h = nodes.select(cluster, "node", "height", "size")
    ends = [h.select(cluster, F.col("node").alias(c), F.col("height").alias(f"h{c}"), F.col("size").alias(f"s{c}")) for c in "ab"]
    half = F.col("d") / 2
    merges = mutual_nearest(d, cluster).join(ends[0], [cluster, "a"]).join(ends[1], [cluster, "b"])
    merges = cut_lineage(merges.select(cluster, "a", "b", *[F.greatest(F.lit(0.0), half - F.col(f"h{c}")).alias(f"l{c}") for c in "ab"], half.alias("height"), (F.col("sa") + F.col("sb")).alias("size")))
    to = merges.select(cluster, F.col("b").alias("node"), F.col("a").alias("target"))
    shares = nodes.join(to, [cluster, "node"], "left").select(cluster, "node", F.coalesce("target", "node").alias("target"), "size")
    of = [shares.select(cluster, F.col("node").alias(c), F.col("target").alias(f"t{c}"), F.col("size").alias(f"w{c}")) for c in "ab"]
    weight = F.col("wa") * F.col("wb")
    moved = d.join(of[0], [cluster, "a"]).join(of[1], [cluster, "b"]).filter("ta <> tb")
    new = moved.groupBy(cluster, F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).agg(F.round(F.sum(weight * F.col("d")) / F.sum(weight), 12).alias("d"))
    gone = merges.select(cluster, F.explode(F.array("a", "b")).alias("node"))
    made = merges.select(cluster, F.col("a").alias("node"), "size", "height")
    return merges.select(cluster, F.lit(0).alias("step"), "a", "b", "la", "lb"), new, nodes.join(gone, [cluster, "node"], "left_anti").select(cluster, "node", "size", "height").unionByName(made)


def _certain_rows(d: DataFrame, cluster: str, whole: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (total, known, least) and pairs of large clusters: known are the nodes of the least criterion, as many as fit."""
    q = q_criterion(d, cluster).withColumn("q", F.round(F.col("d") - F.col("ra") - F.col("rb") + TIE_SHIFT, 9))
    both = F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("r")), F.struct(F.col("b").alias("node"), F.col("rb").alias("r")))
    best = q.select(cluster, "q", "a", "b", "n", F.inline(both)).groupBy(cluster, "node").agg(F.min(F.struct("q", "a", "b")).alias("best"), F.first("r").alias("r"), F.first("n").alias("n"))
    place = F.row_number().over(Window.partitionBy(cluster).orderBy("best", "node"))
    nodes = cut_lineage(best.select(cluster, "node", (F.col("r") * (F.col("n") - 2)).alias("total"), (place <= F.greatest(F.lit(2), F.expr(f"{whole * whole} div n"))).alias("known")))
    ends = [nodes.select(cluster, F.col("node").alias(c), F.col("known").alias(f"k{c}")) for c in "ab"]
    marked = d.join(ends[0], [cluster, "a"]).join(ends[1], [cluster, "b"])
    least = symmetric(marked.filter("not ka and not kb"), cluster).groupBy(cluster, "node").agg(F.min("d").alias("least"))
    nodes = nodes.join(least, [cluster, "node"], "left").na.fill(float("inf"), ["least"])
    return nodes, marked.filter("ka or kb").select(cluster, "a", "b", "d")


def tree_merges(pairs: DataFrame, cluster: str = "cluster", method: str = "upgma", whole: int = WHOLE) -> tuple[DataFrame, int]:
    """(cluster, round, step, a, b, la, lb), in the order of the merges, and the number of rounds.

    b joins a, whose name the new node keeps; la and lb are the lengths of the two branches.
    """
    if method not in ("upgma", "neighbor-joining"):
        raise ValueError(f"unknown method {method!r}")
    d = cut_lineage(pairs.select(cluster, "a", "b", F.col("d").cast("double").alias("d")))
    nodes = cut_lineage(d.select(cluster, F.explode(F.array("a", "b")).alias("node")).distinct().select(cluster, "node", F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("height")))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    merged_schema = f"{cluster} {kinds[cluster]}, step int, a {kinds['a']}, b {kinds['b']}, la double, lb double"
    done, round_no = [], 0
    while True:
        sizes = nodes.groupBy(cluster).agg(F.count("*").alias("n"))
        large = cut_lineage(sizes.filter(F.col("n") > whole).select(cluster))
        some_large = not large.isEmpty()
        small_d, small_nodes = d.join(large, cluster, "left_anti") if some_large else d, nodes.join(large, cluster, "left_anti") if some_large else nodes
        if method == "neighbor-joining":
            sums = symmetric(small_d, cluster).groupBy(cluster, "node").agg(F.sum("d").alias("total"))
            small_nodes = small_nodes.join(sums, [cluster, "node"])
        ready = small_nodes.withColumn("known", F.lit(True)).withColumn("least", F.lit(float("inf")))
        if some_large and method == "neighbor-joining":
            big_nodes, big_d = _certain_rows(d.join(large, cluster), cluster, whole)
            ready = ready.select(cluster, "node", "total", "known", "least").unionByName(big_nodes.select(cluster, "node", "total", "known", "least"))
            small_d = small_d.unionByName(big_d)
        found = cut_lineage(small_d.groupBy(cluster).cogroup(ready.groupBy(cluster)).applyInArrow(_merging(method, cluster), merged_schema))
        done.append(found.filter("step >= 0").withColumn("round", F.lit(round_no)))
        round_no += 1
        if not some_large:
            break
        if method == "upgma":
            merges, d, nodes = _average_round(d.join(large, cluster), nodes.join(large, cluster), cluster)
            done.append(merges.withColumn("round", F.lit(round_no)))
        else:
            gone = found.filter("step >= 0").select(cluster, F.explode(F.array("a", "b")).alias("node")).distinct()
            left = d.join(large, cluster)
            for c in "ab":
                left = left.join(gone.withColumnRenamed("node", c), [cluster, c], "left_anti")
            d = left.select(cluster, "a", "b", "d").unionByName(found.filter("step = -1").select(cluster, "a", "b", F.col("la").alias("d")))
            joined = found.filter("step >= 0").select(cluster, F.col("b").alias("node"))
            nodes = nodes.join(large, cluster).join(joined, [cluster, "node"], "left_anti")
        d, nodes = cut_lineage(d), cut_lineage(nodes)
        round_no += 1
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every, round_no


def cluster_tree(pairs: DataFrame, cluster: str = "cluster", method: str = "upgma", whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Trees of all clusters: (cluster, leaves, max_depth, newick) and per-leaf depths (cluster, leaf, depth).

    ``pairs`` holds (cluster, a, b, d) with a < b for every pair of a cluster.
    """
    merges, _ = tree_merges(pairs, cluster, method, whole)
    kinds = {f.name: f.dataType.simpleString() for f in merges.schema.fields}
    drawn = cut_lineage(merges.groupBy(cluster).applyInArrow(_drawing(cluster), f"{cluster} {kinds[cluster]}, leaf {kinds['a']}, depth double, newick string"))
    depths = drawn.filter("newick is null").select(cluster, "leaf", "depth")
    trees = drawn.groupBy(cluster).agg(F.count("depth").alias("leaves"), F.max("depth").alias("max_depth"), F.max("newick").alias("newick"))
    return trees, depths
