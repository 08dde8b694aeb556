"""Exact near-duplicate links of embeddings by dual traversal of cover trees.

Unit vectors have distance sqrt(2 - 2 cos). Equal vectors are one point with a number of copies. A
bounded sample gives centres that split the points into cells; a cell's blocks hold a bounded number
of points each. Cells whose centres are further apart than both covering radii and the threshold
distance are never compared. For each pair of blocks that is left, one task builds a cover tree on
either block (nested nets with halving radii) and descends both trees together: a pair of nodes
is dropped when its centres are further apart than the two covering radii allow, taken whole when
all its points must be linked, and split otherwise. Tasks return the number of links of each point
and one edge to a linked point per point, never the links themselves.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RowKeys, kept_by_worker, scratch
from .components import components

_EPS = 1e-9
_KEPT = 32


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded by zeros to ``width``."""
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n])] = flat
    return out


class Tree:
    """Levels of a cover tree: each has centre rows, covering radii, and the points in node order."""

    def __init__(self, x: np.ndarray, least: float):
        self.x, self.short, self.levels, self.parents = x, x.astype(np.float32), [], []
        near = self.short @ self.short.T  # only shapes the nets; covering radii are taken in doubles
        node, centres, radius = np.zeros(len(x), np.int64), np.array([0]), 2.0
        while True:
            cover = np.zeros(len(centres))
            np.maximum.at(cover, node, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[centres[node]]))))
            order = np.argsort(node, kind="stable")
            self.levels.append((centres, cover, order, np.searchsorted(node[order], np.arange(len(centres) + 1))))
            if radius < least or len(centres) == len(x):
                break
            while radius >= least and cover.max() <= radius:
                radius /= 2
            upper = node
            node, centres = self._split(near, radius)
            self.parents.append(upper[centres])

    def _split(self, near: np.ndarray, radius: float):
        """The next net: each node's centre, then in turn the points of the node that none covers yet."""
        centres, cover, order, at = self.levels[-1]
        own, out, least = np.empty(len(order), np.int64), [], np.float32(1 - radius * radius / 2)
        for c, r, s, e in zip(centres, cover, at[:-1], at[1:], strict=True):
            rows = order[s:e]
            if r <= radius:
                own[rows] = len(out)
                out.append(c)
                continue
            whole = len(rows) == len(near)
            if whole:
                rows = np.arange(len(near))
            free = np.ones(len(rows), bool)
            nxt = c
            while True:
                line = near[nxt] if whole else near[nxt, rows]
                taken = free & (line >= least)
                taken[rows == nxt] = True
                own[rows[taken]] = len(out)
                out.append(nxt)
                free &= ~taken
                first = int(free.argmax())
                if not free[first]:
                    break
                nxt = rows[first]
        return own, np.array(out)


def dual(a: Tree, b: Tree | None, reach: float):
    """Node pairs that remain at the last levels: (i, j) to verify and (i, j) to take whole, with their
    levels. ``b`` None compares the tree with itself, each pair once."""
    same = b is None
    b = a if same else b
    i = j = np.zeros(1, np.int64)
    whole = []
    depth = max(len(a.levels), len(b.levels))
    for k in range(depth):
        la, lb = min(k, len(a.levels) - 1), min(k, len(b.levels) - 1)
        (ca, ra, *_), (cb, rb, *_) = a.levels[la], b.levels[lb]
        if k and len(i) * 20 > before and not any(len(w[2]) for w in whole):
            # most parents remain: all pairs of children by one product, with room for its rounding; what
            # fails here needs no arrays
            widest = float(reach + ra.max() + rb.max())
            least = 1 - widest * widest / 2 if widest < 1 else 1 - np.square(np.float32(reach) + ra.astype(np.float32)[:, None] + rb.astype(np.float32)) / 2
            i, j = np.nonzero(a.short[ca] @ b.short[cb].T >= least - np.float32(1e-4))
            if same:
                keep = i <= j
                i, j = i[keep], j[keep]
        elif k:
            i, j = _children(i, j, a, la if la == k else None, b, lb if lb == k else None)
            if same:
                keep = i <= j
                i, j = i[keep], j[keep]
        before = len(ca) * len(cb)
        cos = np.concatenate([np.einsum("ij,ij->i", a.x[ca[i[s : s + 65536]]], b.x[cb[j[s : s + 65536]]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        d = np.sqrt(np.maximum(0, 2 - 2 * cos))
        spread = ra[i] + rb[j]
        near = d <= reach + spread + _EPS
        all_in = (np.where(same & (i == j), 2 * ra[i], d + spread) <= reach - _EPS) & near
        whole.append((la, lb, i[all_in], j[all_in]))
        rest = near & ~all_in
        i, j = i[rest], j[rest]
    return (depth - 1, i, j), whole


def _children(i, j, a, la, b, lb):
    """All pairs of children; a tree whose last level is reached keeps its nodes."""

    def kids(tree, level, nodes):
        if level is None:
            return np.ones(len(nodes), np.int64), nodes, np.arange(nodes.max(initial=0) + 1)
        parent = tree.parents[level - 1]
        order = np.argsort(parent, kind="stable")
        at = np.searchsorted(parent[order], np.arange(parent.max() + 2))
        return (at[1:] - at[:-1])[nodes], at[:-1][nodes], order

    (na, sa, oa), (nb, sb, ob) = kids(a, la, i), kids(b, lb, j)
    return product(na, sa, oa, nb, sb, ob)


def product(na, sa, oa, nb, sb, ob):
    """For each k all combinations of oa[sa[k] : sa[k]+na[k]] and ob[sb[k] : sb[k]+nb[k]]."""
    n = na * nb
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(nb, n)
    return oa[np.repeat(sa, n) + within // np.maximum(width, 1)], ob[np.repeat(sb, n) + within % np.maximum(width, 1)]


def grown(x: np.ndarray, threshold: float) -> Tree:
    return Tree(x, float(np.sqrt(2 - 2 * threshold)) / 4)


def kept(key: tuple, x: np.ndarray, threshold: float) -> Tree:
    """The tree of a block; a worker keeps the last ones."""
    trees = kept_by_worker("trees")
    if key not in trees:
        while len(trees) >= _KEPT:
            trees.pop(next(iter(trees)))
        trees[key] = grown(x, threshold)
    return trees[key]


def links(a: Tree, nx: np.ndarray, b: Tree | None, ny: np.ndarray | None, threshold: float):
    """Numbers of linked vectors (copies counted) of the points of two trees, and a label for each point
    that linked points share. ``b`` None compares a tree with itself."""
    reach, same, x = float(np.sqrt(2 - 2 * threshold)), b is None, a.x
    (last, i, j), whole = dual(a, b, reach)
    b, ny = (a, nx) if same else (b, ny)
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(b.x), np.int64)
    shift = 0 if same else len(x)
    edges = []

    def add(p, q):
        if len(p):
            np.add.at(cx, p, ny[q])
            np.add.at(cx if same else cy, q, nx[p])
            edges.append((p, q + shift))

    for la, lb, wi, wj in whole:
        (_, _, oa, aa), (_, _, ob, ab) = a.levels[la], b.levels[lb]
        for u, v in zip(wi, wj, strict=True):
            p, q = oa[aa[u] : aa[u + 1]], ob[ab[v] : ab[v + 1]]
            if same and u == v and la == lb:
                cx[p] += nx[p].sum() - nx[p]
                edges.append((np.full(len(p) - 1, p[0]), p[1:]))
            else:
                cx[p] += ny[q].sum()
                (cx if same else cy)[q] += nx[p].sum()
                edges.append((p, np.full(len(p), q[0] + shift)))
                edges.append((np.full(len(q), p[0]), q + shift))
    la, lb = min(last, len(a.levels) - 1), min(last, len(b.levels) - 1)
    (_, _, oa, aa), (_, _, ob, ab) = a.levels[la], b.levels[lb]
    for s in range(0, len(i), 4096):
        u, v = i[s : s + 4096], j[s : s + 4096]
        p, q = product(np.diff(aa)[u], aa[u], oa, np.diff(ab)[v], ab[v], ob)
        if same:
            once = (np.repeat(u < v, np.diff(aa)[u] * np.diff(ab)[v])) | (p < q)
            p, q = p[once], q[once]
        for t in range(0, len(p), 65536):
            pp, qq = p[t : t + 65536], q[t : t + 65536]
            hit = np.einsum("ij,ij->i", x[pp], b.x[qq]) >= threshold
            add(pp[hit], qq[hit])
    label = np.arange(len(x) + (0 if same else len(b.x)))
    if edges:
        p, q = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
        while True:
            low = np.minimum(label[p], label[q])
            new = label.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return cx, None if same else cy, label


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, sample: int = 4096, block: int = 4096, cells: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links and groups of the vectors with a cosine of ``threshold`` (above 0) or more, in doubles.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing.
    Shorter vectors count as padded by zeros. Repeated rows are vectors of their own that link with
    each other. Other columns, such as labels, are not read. The sample of ``sample`` distinct
    vectors only places the cells; all vectors are compared.

    Returns one row per input row: ``id_col``, n_links (long, other rows linked directly), component_id
    (smallest id reachable, itself included, nulls ignored), kept (id = component_id, false for null).
    """
    spark = vectors.sparkSession
    v = F.col("v")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = F.coalesce(v.isNotNull() & finite & F.exists("v", lambda c: c != 0), F.lit(False))
    # -0.0 and 0.0 make one point
    rows = source.select("id", F.when(good, F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c))).alias("v"))
    points = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    points = scratch(points, "points")
    n, width = points.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    some = points.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(sample).collect()
    base = unit_rows(np.array([np.pad(r.v, (0, width - len(r.v))) for r in some])) if some else np.zeros((0, width))
    wanted, centres = max(1, min(cells, n // (4 * block))), base[:1]
    best = np.full(len(base), np.inf)
    while len(centres) < min(wanted, len(base)):
        best = np.minimum(best, 2 - 2 * base @ centres[-1])
        centres = np.vstack([centres, base[np.argmax(best)]])
    shared = spark.sparkContext.broadcast(centres)

    def place(batches):
        keys = RowKeys()
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(matrix(b.column(0), width))
            cos = x @ shared.value.T
            cell = cos.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.take(len(x))), b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(np.maximum(0, 2 - 2 * cos.max(axis=1))))], names=["node", "v", "head", "copies", "cell", "far"])

    placed = scratch(points.mapInArrow(place, "node long, v array<double>, head long, copies long, cell int, far double"), "placed")
    # at most `cells` rows
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()
    reach = float(np.sqrt(2 - 2 * threshold))
    parts = {r.cell: -(-r.n // block) for r in stats}
    pairs = [(s.cell, t.cell) for k, s in enumerate(stats) for t in stats[k:] if s.cell == t.cell or np.sqrt(max(0.0, 2 - 2 * float(centres[s.cell] @ centres[t.cell]))) <= s.radius + t.radius + reach + _EPS]
    near = spark.createDataFrame([(a, b, parts[a], parts[b]) for a, b in pairs], "a int, b int, na int, nb int")
    blocks = near.select("a", "b", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ka")).select("a", "b", "ka", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("kb")).where("a < b or ka <= kb")
    blocks = blocks.withColumn("task", F.concat_ws(" ", "a", "ka", "b", "kb"))
    held = placed.join(F.broadcast(spark.createDataFrame(list(parts.items()), "cell int, parts int")), "cell").withColumn("k", F.pmod(F.hash("node"), F.col("parts"))).select("cell", "k", "node", "copies", "v")
    left = held.join(blocks, (held.cell == blocks.a) & (held.k == blocks.ka)).select("task", F.lit(0).alias("side"), "node", "copies", "v")
    right = held.join(blocks.where("a < b or ka < kb"), (held.cell == blocks.b) & (held.k == blocks.kb)).select("task", F.lit(1).alias("side"), "node", "copies", "v")

    call = uuid.uuid4().hex

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")  # a block's points are always in this order
        side, node, copies = (t.column(c).to_numpy() for c in ("side", "node", "copies"))
        x = unit_rows(matrix(t.column("v").combine_chunks(), width))
        one, two = side == 0, side == 1
        empty = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if not one.any():
            return empty
        alone = t.column("task")[0].as_py().split(" ")
        if alone[:2] == alone[2:]:
            count, _, label = links(kept((call, *alone[:2]), x[one], threshold), copies[one], None, None, threshold)
            ids = node[one]
        elif two.any():
            cx, cy, label = links(kept((call, *alone[:2]), x[one], threshold), copies[one], kept((call, *alone[2:]), x[two], threshold), copies[two], threshold)
            count, ids = np.concatenate([cx, cy]), np.concatenate([node[one], node[two]])
        else:
            return empty
        hit = count > 0
        return pa.table({"node": ids[hit], "links": count[hit], "other": ids[label[hit]]})

    found = scratch(left.union(right).groupBy("task").applyInArrow(compare, "node long, links long, other long"), "found")
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = placed.select("v", "node", "head", "copies").join(counts, "node", "left").join(roots, "node", "left").select("v", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = scratch(named, "named")
    heads = scratch(named.groupBy("root").agg(F.min("head").alias("component_id")), "heads")
    named = named.join(heads, "root").select("v", "n_links", "component_id")
    linked = rows.where("v is not null").join(named, "v").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
