"""Near-duplicate vectors: one navigable small-world graph a shard, every shard of a label queried, links verified.

Equal vectors of a label are one class with a count. The classes of a label are dealt by hash over shards of about
``SHARD``; a task builds a shard's graph, whose nodes are leaders of balls (`small_world`). A tile is a shard and another
one of the same label (or itself): the balls of the second query the graph of the first. A beam is widened for a query
while it is full of candidates, and for the whole tile until its audits find everything: `AUDIT` queries compared with
all leaders, and as many planted vectors that lie at the link angle from a node. Two balls are all linked, or not at
all, by the triangle inequality of angles, or their members are compared in double precision. Every pair of shards meets
in one tile, so each link counts once for both its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotally.llm.components import components
from biotally.llm.small_world import BATCH, Graph, build
from biotally.llm.vectors import finite, matrix
from biotally.session import cut_lineage

COSINE = 0.93
SHARD = 16384  # distinct vectors of a shard, about: 16 MB of numbers and links at 64 dimensions
BEAM, AUDIT, RECALL = 32, 64, 0.999
SLACK = 1e-6  # angles this close to a bound are settled by comparing members

NODES = "key long, copies long, vector array<double>, ball int, row int, level int, links array<array<int>>"


def _graph_rows(table: pa.Table, angle: float) -> pa.Table:
    """A shard's rows with their ball; a ball's leader carries its level and links."""
    table = table.sort_by([("draw", "ascending"), ("key", "ascending")])
    x = matrix(table["vector"])
    draw = table["draw"].to_numpy().view(np.uint64).astype(np.float64) / 2.0**64
    graph, row_of, ball = build(x, draw, math.cos(angle / 2 - SLACK))
    n = len(x)
    level, links = np.full(n, -1, np.int32), [None] * n
    level[row_of] = graph.level[: graph.size]
    for node, r in enumerate(row_of.tolist()):
        links[r] = [(found := graph.links[k][node])[found >= 0].tolist() for k in range(int(graph.level[node]) + 1)]
    kept = table.select(["label", "dim", "shards", "shard", "key", "copies", "vector"])
    added = {"ball": pa.array(ball.astype(np.int32)), "row": pa.array(np.arange(n, dtype=np.int32)), "level": pa.array(level), "links": pa.array(links, pa.list_(pa.list_(pa.int32())))}
    return pa.table({**{c: kept[c] for c in kept.column_names}, **added})


class _Shard:
    """Members of a shard by ball, in the order of its rows."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("row")
        self.key, self.copies = table["key"].to_numpy(), table["copies"].to_numpy()
        self.x, self.ball = matrix(table["vector"]), table["ball"].to_numpy()
        self.leads = np.flatnonzero(table["level"].to_numpy() >= 0)
        self.leads = self.leads[np.argsort(self.ball[self.leads], kind="stable")]  # row of each node
        self.leader = self.x[self.leads]
        self.order = np.argsort(self.ball, kind="stable")
        self.size = np.bincount(self.ball, minlength=len(self.leads))
        self.at = np.cumsum(self.size) - self.size
        toward = np.clip(np.einsum("ij,ij->i", self.x, self.leader[self.ball]), -1, 1)
        angle = np.arccos(toward)
        angle[self.leads] = 0
        self.radius = np.maximum.reduceat(angle[self.order], self.at) if len(self.leads) else np.zeros(0)
        self.weight = np.bincount(self.ball, self.copies, minlength=len(self.leads)).astype(np.int64)
        self.table = table

    def members(self, ball: int) -> np.ndarray:
        return self.order[self.at[ball] : self.at[ball] + self.size[ball]]

    def graph(self) -> Graph:
        n, d = self.leader.shape
        graph = Graph.empty(n, d)
        graph.size, graph.x = n, self.leader.astype(np.float32)
        graph.level = self.table["level"].to_numpy()[self.leads]
        for node, levels in enumerate(self.table["links"].take(pa.array(self.leads)).to_pylist()):
            for k, found in enumerate(levels):
                graph.links[k][node, : len(found)] = found
        graph.entry = int(np.argmax(graph.level))
        return graph


def _within(graph: Graph, q: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs that the beams find at a cosine of ``least`` (one a query) or more; full beams are widened."""
    out_q, out_n, todo = [], [], np.arange(len(q))
    while len(todo):
        again = []
        for a in range(0, len(todo), BATCH):
            part = todo[a : a + BATCH]
            ids, sims = graph.search(q[part].astype(np.float32), width)
            inside = (ids >= 0) & (sims >= least[part, None] - 1e-5)
            full = inside.all(axis=1) & (width < graph.size)
            again.append(part[full])
            r, c = np.nonzero(inside & ~full[:, None])
            out_q.append(part[r])
            out_n.append(ids[r, c])
        todo, width = np.concatenate(again), 2 * width
    return np.concatenate(out_q), np.concatenate(out_n)


def _all_within(x: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same pairs by comparing every query with every node."""
    out_q, out_n = [], []
    for a in range(0, len(q), BATCH):
        r, c = np.nonzero(q[a : a + BATCH] @ x.T >= least[a : a + BATCH, None] - 1e-5)
        out_q.append(a + r)
        out_n.append(c)
    return np.concatenate(out_q), np.concatenate(out_n)


def audited(graph: Graph, x: np.ndarray, q: np.ndarray, least: np.ndarray, angle: float, width: int, audit: int, recall: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of queries and nodes, and the beam that passed the audits (0: every node was compared)."""
    sample = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int))
    true_q, true_n = _all_within(x, q[sample], least[sample])
    true = set(zip(sample[true_q].tolist(), true_n.tolist(), strict=True))
    probe = np.unique(np.linspace(0, len(x) - 1, min(audit, len(x))).astype(int))
    away = np.random.default_rng(len(x)).normal(size=(len(probe), x.shape[1]))
    away -= np.einsum("ij,ij->i", away, x[probe])[:, None] * x[probe]
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    planted = math.cos(angle) * x[probe] + math.sin(angle) * away
    while width < len(x):
        found_q, found_n = _within(graph, q, least, width)
        pairs = set(zip(found_q.tolist(), found_n.tolist(), strict=True))
        at, to = _within(graph, planted, np.full(len(probe), math.cos(angle)), width)
        hits = len(true & pairs) + len(set(at[to == probe[at]].tolist()))
        if hits >= recall * (len(true) + len(probe)):
            return found_q, found_n, width
        width *= 2
    return *_all_within(x, q, least), 0


def _joined(pairs: Iterable[tuple[int, int]], n: int) -> np.ndarray:
    """The smallest node that links reach from each of ``n`` nodes."""
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return np.array([root(v) for v in range(n)], np.int64)


def _tile(table: pa.Table, cosine: float, width: int, audit: int, recall: float) -> pa.Table:
    """key, links (other vectors found in this tile), peer (a key it is linked to, or its own), beam."""
    angle = math.acos(cosine)
    lo, hi, shard = table["lo"][0].as_py(), table["hi"][0].as_py(), table["shard"].to_numpy()
    b = _Shard(table.filter(pa.array(shard == lo)))
    a = b if lo == hi else _Shard(table.filter(pa.array(shard == hi)))
    if not len(a.leads) or not len(b.leads):
        return pa.table({"key": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "peer": pa.array([], pa.int64()), "beam": pa.array([], pa.int32())})
    widest = b.radius.max(initial=0)
    least = np.cos(np.minimum(angle + a.radius + widest + SLACK, math.pi))
    qs, ns, used = audited(b.graph(), b.leader, a.leader, least, angle, width, audit, recall)
    if lo == hi:
        qs, ns = np.minimum(qs, ns), np.maximum(qs, ns)
        qs, ns = qs[qs < ns], ns[qs < ns]
        pair = np.unique(qs.astype(np.int64) * len(b.leads) + ns)
        qs, ns = pair // len(b.leads), pair % len(b.leads)
    found_a, found_b = np.zeros(len(a.key), np.int64), np.zeros(len(b.key), np.int64)
    if lo == hi:
        found_a += a.weight[a.ball] - a.copies
    between = np.arccos(np.clip(np.einsum("ij,ij->i", a.leader[qs], b.leader[ns]), -1, 1))
    whole = between + a.radius[qs] + b.radius[ns] <= angle - SLACK
    maybe = ~whole & (between - a.radius[qs] - b.radius[ns] <= angle + SLACK)
    by_ball_a, by_ball_b = np.zeros(len(a.leads), np.int64), np.zeros(len(b.leads), np.int64)
    np.add.at(by_ball_a, qs[whole], b.weight[ns[whole]])
    np.add.at(by_ball_b, ns[whole], a.weight[qs[whole]])
    found_a += by_ball_a[a.ball]
    found_b += by_ball_b[b.ball]
    linked = [(qs[whole], ns[whole])]
    lone = maybe & (a.size[qs] == 1) & (b.size[ns] == 1)
    ra, rb = a.leads[qs[lone]], b.leads[ns[lone]]
    close = np.einsum("ij,ij->i", a.x[ra], b.x[rb]) >= cosine
    np.add.at(found_a, ra[close], b.copies[rb[close]])
    np.add.at(found_b, rb[close], a.copies[ra[close]])
    linked.append((qs[lone][close], ns[lone][close]))
    more = []
    for q, n in zip(qs[maybe & ~lone].tolist(), ns[maybe & ~lone].tolist(), strict=True):
        left, right = a.members(q), b.members(n)
        any_link = False
        for s in range(0, len(left), 1024):
            rows = left[s : s + 1024]
            close = a.x[rows] @ b.x[right].T >= cosine
            found_a[rows] += close @ b.copies[right]
            found_b[right] += a.copies[rows] @ close
            any_link |= bool(close.any())
        if any_link:
            more.append((q, n))
    linked.append(tuple(np.array(more, np.int64).reshape(-1, 2).T))
    qs, ns = np.concatenate([x[0] for x in linked]), np.concatenate([x[1] for x in linked])
    if lo == hi:
        root = _joined(zip(qs.tolist(), ns.tolist(), strict=True), len(a.leads))
        key, links, peer = a.key, found_a + found_b, a.key[a.leads][root][a.ball]
    else:
        root = _joined(zip(qs.tolist(), (ns + len(a.leads)).tolist(), strict=True), len(a.leads) + len(b.leads))
        lead_keys = np.concatenate([a.key[a.leads], b.key[b.leads]])
        key, links = np.concatenate([a.key, b.key]), np.concatenate([found_a, found_b])
        peer = lead_keys[root][np.concatenate([a.ball, b.ball + len(a.leads)])]
    return pa.table({"key": key, "links": links, "peer": peer, "beam": np.full(len(key), used, np.int32)})


def vector_links(classes: DataFrame, cosine: float = COSINE, shard: int = SHARD, width: int = BEAM, audit: int = AUDIT, recall: float = RECALL) -> DataFrame:
    """(key, links, peer, beam) a row of ``classes`` (key, label, vector of length one, copies, draw) and tile."""
    angle = math.acos(cosine)
    sized = classes.withColumn("dim", F.size("vector"))
    counts = cut_lineage(sized.groupBy("label", "dim").agg(F.expr(f"cast(ceil(count(*) / {shard}) as int)").alias("shards")))
    dealt = sized.join(counts, ["label", "dim"]).withColumn("shard", F.expr("cast(pmod(xxhash64(draw, key), shards) as int)"))

    def graph_rows(table: pa.Table) -> pa.Table:
        return _graph_rows(table, angle)

    groups = f"label {classes.schema['label'].dataType.simpleString()}, dim int, shards int, shard int, "
    built = cut_lineage(dealt.groupBy("label", "dim", "shard").applyInArrow(graph_rows, groups + NODES))
    others = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    tiles = built.withColumn("other", others).select("*", F.least("shard", "other").alias("lo"), F.greatest("shard", "other").alias("hi"))

    def tile(table: pa.Table) -> pa.Table:
        return _tile(table, cosine, width, audit, recall)

    return tiles.groupBy("label", "dim", "lo", "hi").applyInArrow(tile, "key long, links long, peer long, beam int")


def vector_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard: int = SHARD, width: int = BEAM, audit: int = AUDIT, recall: float = RECALL
) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is ``cosine`` or more.
    Vectors that are null, empty, all zero or hold null or non-finite entries link with nothing: n_links 0 and their own
    component. Rows of one vector and label link with each other; repeated rows are rows of their own. Rows with a null
    id belong to their component without naming it, and are not kept; ids that repeat are kept on each of their rows if
    they name the component. An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    usable = finite("raw") & F.col("label").isNotNull() & F.exists("raw", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # + 0.0: a negative zero counts as zero, so equal vectors have equal digests.
    keyed = rows.where("usable").withColumn("raw", F.transform("raw", lambda v: v + F.lit(0.0)))
    keyed = keyed.select("vec_id", "label", F.xxhash64(F.lit(1), "raw").alias("h1"), F.xxhash64(F.lit(2), "raw").alias("h2"), "raw")
    # Scaled by the largest entry first, so that squares neither overflow nor vanish.
    scaled = F.transform("raw", lambda v: v / F.array_max(F.transform("raw", lambda w: F.abs(w))))
    grouped = keyed.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    grouped = grouped.withColumn("raw", scaled)
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, v: s + v * v))
    grouped = grouped.withColumn("size", length).withColumn("vector", F.transform("raw", lambda v: v / F.col("size"))).drop("raw", "size")
    classes = cut_lineage(grouped.withColumn("key", F.monotonically_increasing_id()))
    found = cut_lineage(vector_links(classes.select("key", "label", "vector", "copies", F.col("h1").alias("draw")), cosine, shard, width, audit, recall))
    roots = components(found.where("key <> peer").select(F.col("key").alias("a"), F.col("peer").alias("b")))
    counted = found.groupBy(F.col("key").alias("k")).agg(F.sum("links").alias("links"))
    placed = classes.drop("vector").join(counted, F.col("key") == F.col("k")).join(roots, F.col("key") == F.col("node"), "left")
    placed = cut_lineage(placed.select("label", "h1", "h2", "least", F.coalesce("root", "key").alias("root"), (F.col("links") + F.col("copies") - 1).alias("n_links")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = placed.join(named, "root").select("label", "h1", "h2", "n_links", "component_id")
    linked = keyed.drop("raw").join(of_class, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = linked.unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
