"""Embedding near-duplicates by dual traversal of cover trees (operator 3).

Vectors are scaled to length 1, where cosine >= c means a distance of at most
``sqrt(2 - 2 c)``.  A cover tree has nested levels whose radii halve: a level's
centres lie more than its radius apart, every point is within the radius of a
centre, and centres of one level stay centres of the next.  Two trees are
traversed together, and a pair of nodes is dropped when its centres are further
apart than the threshold plus both nodes' covering radii (the exact distance to
their furthest point).  What is left is checked by cosine in double precision,
so pairs are exact.

Over the cluster, the upper levels come from a bounded sample (``sample``
vectors) and end at the deepest level of at most ``most_cells`` centres; every
vector belongs to its nearest centre's cell, and cells have exact covering
radii over all data.  Cells of more than ``cell_rows`` vectors are cut into
slices.  Each pair of slices whose cells pass the same bound meets in one task,
which holds one slice and reads the other side in batches; a vector goes only
to the cells whose ball it can reach.  Equal vectors are one point that counts
with its copies, so a large group of copies never meets itself.

Vectors of different lengths never link; each length found gets a job of its
own, one after the other.

Defined results: a vector that is null, empty, zero, or holds a null or
non-finite component, and one with a null id link with nothing: 0 links, a
component of their own; rows of a repeated id are vectors of their own, which
link and have a component each by themselves; an empty table gives an empty
result.  Only vec_id and embedding are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import materialize
from tessera.llm.components import Links, connected

SLACK = 1e-3            # more than single-precision distances can be wrong
DEEPEST = 5             # levels of radius 2, 1, 1/2, ... 2 ** (1 - DEEPEST)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component so that tiny
    and huge vectors keep their direction."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit rows (single precision)."""
    d = a @ b.T
    d *= -2
    d += 2
    np.maximum(d, 0, out=d)
    return np.sqrt(d, out=d)


def cover(points: np.ndarray, radius: float, centres: list[int], step: int = 256) -> list[int]:
    """Indices of centres, starting with the given ones, such that every point
    lies within ``radius`` of one and no two added ones lie within it."""
    found = list(centres)
    for at in range(0, len(points), step):
        part = points[at:at + step]
        far = np.ones(len(part), dtype=bool)
        for lo in range(0, len(found), 4096):
            far &= (distances(part, points[found[lo:lo + 4096]]) > radius).all(axis=1)
        rest = np.flatnonzero(far)
        if len(rest):
            apart = distances(part[rest], part[rest]) > radius
            open_ = np.ones(len(rest), dtype=bool)
            for i in range(len(rest)):
                if open_[i]:
                    found.append(at + int(rest[i]))
                    open_ &= apart[i]
    return found


class CoverTree:
    """Levels of a cover tree over unit vectors, as flat arrays.

    Level k has ``centre`` (point indices), ``radius`` (exact covering radii of
    all points below), ``members`` (point indices, node by node) with ``start``,
    and the nodes of level k + 1 lie in the order of their parents, with
    ``child`` holding where each parent's children start."""

    def __init__(self, points: np.ndarray, deepest: int = DEEPEST):
        self.points = points.astype(np.float32)
        n = len(points)
        owner = np.zeros(n, dtype=np.int64)
        self.levels = [self._level(np.array([0]), owner)]
        for k in range(1, deepest):
            radius, nodes, parents = 2.0 ** (1 - k), [], []
            at = np.zeros(n, dtype=np.int64)
            top = self.levels[-1]
            for node in range(len(top["centre"])):
                own = top["members"][top["start"][node]:top["start"][node + 1]]
                if len(own) == 1:
                    at[own] = len(nodes)
                    nodes.append(own[0])
                    parents.append(node)
                    continue
                first = int(np.flatnonzero(own == top["centre"][node])[0])
                chosen = cover(self.points[own], radius, [first])
                nearest = np.concatenate([distances(self.points[own[lo:lo + 1024]], self.points[own[chosen]]).argmin(axis=1)
                                          for lo in range(0, len(own), 1024)])
                nearest[chosen] = np.arange(len(chosen))
                at[own] = len(nodes) + nearest
                nodes.extend(own[chosen])
                parents.extend([node] * len(chosen))
            top["child"] = np.searchsorted(parents, np.arange(len(top["centre"]) + 1))
            self.levels.append(self._level(np.array(nodes), at))

    def _level(self, centre: np.ndarray, owner: np.ndarray) -> dict:
        order = np.argsort(owner, kind="stable")
        start = np.searchsorted(owner[order], np.arange(len(centre) + 1))
        d2 = 2 - 2 * np.einsum("ij,ij->i", self.points, self.points[centre[owner]])
        radius = np.sqrt(np.maximum(np.maximum.reduceat(d2[order], start[:-1]), 0))
        radius[np.diff(start) == 1] = 0
        return {"centre": centre, "radius": radius.astype(np.float32), "members": order, "start": start}


def near_nodes(a: CoverTree, b: CoverTree, reach: float, side: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the trees' last-level nodes that may hold points at most
    ``reach`` apart, by dual traversal from the roots."""
    x, y = np.array([0]), np.array([0])
    for k in range(1, len(a.levels)):
        up_a, up_b, now_a, now_b = a.levels[k - 1], b.levels[k - 1], a.levels[k], b.levels[k]
        n_x, n_y = np.diff(up_a["child"])[x], np.diff(up_b["child"])[y]
        kept_x, kept_y = [], []
        narrow = n_x * n_y <= 4096
        # Small families of children: all pairs as flat lists.
        rows = np.flatnonzero(narrow)
        for part in np.array_split(rows, max(1, int((n_x * n_y)[rows].sum()) // 200_000)):
            many = (n_x * n_y)[part]
            if not many.sum():
                continue
            of = np.repeat(np.arange(len(part)), many)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            i = up_a["child"][x[part][of]] + nth // n_y[part][of]
            j = up_b["child"][y[part][of]] + nth % n_y[part][of]
            d = np.sqrt(np.maximum(2 - 2 * np.einsum(
                "ij,ij->i", a.points[now_a["centre"][i]], b.points[now_b["centre"][j]]), 0))
            near = d <= reach + SLACK + now_a["radius"][i] + now_b["radius"][j]
            kept_x.append(i[near])
            kept_y.append(j[near])
        # Large families: matrices, one comparison tile at a time.
        for p, q in zip(x[~narrow], y[~narrow], strict=True):
            for lo in range(up_a["child"][p], up_a["child"][p + 1], side):
                i = np.arange(lo, min(lo + side, up_a["child"][p + 1]))
                for lo_b in range(up_b["child"][q], up_b["child"][q + 1], side):
                    j = np.arange(lo_b, min(lo_b + side, up_b["child"][q + 1]))
                    d = distances(a.points[now_a["centre"][i]], b.points[now_b["centre"][j]])
                    d -= now_a["radius"][i][:, None]
                    d -= now_b["radius"][j]
                    r, c = np.nonzero(d <= reach + SLACK)
                    kept_x.append(i[r])
                    kept_y.append(j[c])
        x = np.concatenate(kept_x) if kept_x else np.zeros(0, dtype=np.int64)
        y = np.concatenate(kept_y) if kept_y else np.zeros(0, dtype=np.int64)
    return x, y


def threshold_pairs(a: CoverTree, rows_a: np.ndarray, b: CoverTree, rows_b: np.ndarray, cosine: float,
                    side: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all points with a cosine of at least ``cosine``, in parts.
    ``rows_a`` and ``rows_b`` are the points in double precision."""
    x, y = near_nodes(a, b, float(np.sqrt(2 - 2 * cosine)))
    low_a, low_b = a.levels[-1], b.levels[-1]
    single = (np.diff(low_a["start"])[x] == 1) & (np.diff(low_b["start"])[y] == 1)
    for lo in range(0, int(single.sum()), 100_000):
        i = low_a["members"][low_a["start"][x[single][lo:lo + 100_000]]]
        j = low_b["members"][low_b["start"][y[single][lo:lo + 100_000]]]
        near = np.einsum("ij,ij->i", rows_a[i], rows_b[j]) >= cosine
        yield i[near], j[near]
    for p, q in zip(x[~single], y[~single], strict=True):
        own, other = (t["members"][t["start"][k]:t["start"][k + 1]] for t, k in ((low_a, p), (low_b, q)))
        for lo in range(0, len(own), side):
            for lo_b in range(0, len(other), side):
                i, j = own[lo:lo + side], other[lo_b:lo_b + side]
                r, c = np.nonzero(rows_a[i] @ rows_b[j].T >= cosine)
                yield i[r], j[c]


# --- Spark jobs -----------------------------------------------------------

def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Double-precision rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def upper_centres(points: np.ndarray, most_cells: int) -> np.ndarray:
    """Centres of the deepest cover-tree level with at most ``most_cells``."""
    tree = CoverTree(points)
    fits = [level for level in tree.levels if len(level["centre"]) <= most_cells]
    return points[fits[-1]["centre"]]


def links_between(points: DataFrame, cosine: float, sample: int, most_cells: int, cell_rows: int) -> DataFrame:
    """Rows (a, b, n): with b, a link that components need; without, n copies
    linked to the point a.  ``points`` has node, copies, embedding, k1, k2."""
    chosen = points.orderBy("k1", "k2").limit(sample).select("embedding").toPandas()["embedding"]
    centres = upper_centres(unit(np.stack(chosen.to_numpy()).astype(np.float64)), most_cells)

    @F.arrow_udf("struct<cell:int,far:double>")
    def nearest(batch: pa.Array) -> pa.Array:
        d = distances(unit(matrix(batch)), centres) if len(batch) else np.zeros((0, 1))
        return pa.StructArray.from_arrays([pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))],
                                          names=["cell", "far"])

    placed = materialize(points.withColumn("at", nearest("embedding"))
                         .select("node", "copies", "embedding", "at.cell", "at.far"), "placed-vectors")
    sizes = {r["cell"]: (r["far"], r["n"]) for r in placed.groupBy("cell").agg(
        F.max("far").alias("far"), F.count("*").alias("n")).collect()}       # at most most_cells rows
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    cells = sorted(sizes)
    slices = {c: -(-sizes[c][1] // cell_rows) for c in cells}
    number = {}
    for c in cells:
        for s in range(slices[c]):
            number[c, s] = len(number)
    total = len(number)

    def deal(batches: Iterator) -> Iterator:
        """Each vector to its own slice (role 0) and, as a visitor (role 1), to
        half of the slices it can reach: of two slices, the one that comes
        within half a round after the other is visited."""
        order = list(number)
        for batch in batches:
            node, cell = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            d = distances(unit(matrix(batch.column(2))), centres)
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = np.array([number[c, int(m % slices[c])] for c, m in zip(cell.tolist(), mixed, strict=True)])
            for k, (c, _) in enumerate(order):
                ahead = (k - own) % total
                visits = (d[:, c] <= sizes[c][0] + reach) & (ahead > 0) & (2 * ahead <= total)
                visits &= (2 * ahead < total) | (own < k)
                for role, rows in ((0, np.flatnonzero(own == k)), (1, np.flatnonzero(visits))):
                    if len(rows):
                        part = batch.take(pa.array(rows))
                        yield pa.record_batch(
                            [pa.array(np.full(len(rows), k)), pa.array(np.full(len(rows), role, dtype=np.int32)),
                             *(part.column(i) for i in range(3))], names=["slice", "role", "node", "copies", "embedding"])

    def compare(batches: Iterator) -> Iterator:
        links = Links()
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        here, held = None, []
        tree = rows = node = copies = found = None

        def finish():
            if node is not None:
                counts.append((node, found))

        def settle():
            """The slice is complete: build its tree and link it with itself."""
            nonlocal tree, rows, node, copies, found, held
            node, copies, rows = (np.concatenate([h[i] for h in held]) for i in range(3))
            held, found, tree = [], np.zeros(len(node), dtype=np.int64), CoverTree(rows)
            for i, j in threshold_pairs(tree, rows, tree, rows, cosine):
                np.add.at(found, i, copies[j])
                links.add(node[i], node[j])

        for batch in batches:
            slice_id, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.flatnonzero((np.diff(slice_id) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(slice_id)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                own = (part.column(2).to_numpy(), part.column(3).to_numpy(), unit(matrix(part.column(4))))
                if slice_id[lo] != here:
                    if held:
                        settle()
                    finish()
                    here, node = slice_id[lo], None
                if role[lo] == 0:
                    held.append(own)
                    continue
                if held:
                    settle()
                if node is None:
                    continue
                for at in range(0, hi - lo, cell_rows):
                    guest, guest_copies, guest_rows = (o[at:at + cell_rows] for o in own)
                    theirs = np.zeros(len(guest), dtype=np.int64)
                    for i, j in threshold_pairs(tree, rows, CoverTree(guest_rows), guest_rows, cosine):
                        np.add.at(found, i, guest_copies[j])
                        np.add.at(theirs, j, copies[i])
                        links.add(node[i], guest[j])
                    some = theirs > 0
                    counts.append((guest[some], theirs[some]))
        if held:
            settle()
        finish()
        a, b = links.pack()
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())],
                              names=["a", "b", "n"])
        for own, n in counts:
            yield pa.record_batch([pa.array(own, pa.int64()), pa.nulls(len(own), pa.int64()), pa.array(n, pa.int64())],
                                  names=["a", "b", "n"])

    kind = dict(points.dtypes)["embedding"]
    dealt = (placed.mapInArrow(deal, f"slice long, role int, node long, copies long, embedding {kind}")
             .repartition(F.col("slice")).sortWithinPartitions("slice", "role"))
    return dealt.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, sample: int = 2048, most_cells: int = 256,
                    cell_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    own = vectors.select(F.col("vec_id").cast("long"), "embedding")
    compared = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    # Two independent 64-bit hashes stand for a vector's components, with their number.
    keys = [F.when(compared, F.size("embedding")).alias("width"), F.when(compared, F.xxhash64("embedding")).alias("k1"),
            F.when(compared, F.xxhash64("embedding", F.lit(31))).alias("k2")]
    points = materialize(
        own.where(compared).select("vec_id", "embedding", *keys).groupBy("width", "k1", "k2")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        .withColumn("node", F.monotonically_increasing_id()), "points")     # one node per different vector, written once
    widths = [r["width"] for r in points.groupBy("width").count().orderBy("width").collect()]   # one row per width
    if not widths:
        alone = own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    counts, component = [], []
    for width in widths:
        found = materialize(links_between(points.where(F.col("width") == width).select("node", "copies", "embedding", "k1", "k2"),
                                          cosine, sample, most_cells, cell_rows), "vector-links")
        counts.append(found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")))
        component.append(connected(found.where("b is not null").select("a", "b")))
    counts, component = (functools.reduce(DataFrame.unionByName, parts) for parts in (counts, component))
    placed = (points.select("width", "k1", "k2", "node", "least").join(counts, "node", "left").join(component, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    # A component goes by its smallest vec_id.
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_point = placed.join(named, "component").select(
        "width", "k1", "k2", F.greatest(F.coalesce("n", F.lit(1)) - 1, F.lit(0)).alias("n_links"), "component_id")
    # The copies of a frequent vector are on the left side only, which adaptive
    # execution splits.
    return (own.select("vec_id", *keys).join(of_point, ["width", "k1", "k2"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
