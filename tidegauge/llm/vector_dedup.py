"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside a cell.

Equal vectors are one node from the start. Every node has a home, the cell of its nearest centre.
Two nodes meet in the lower of their two homes: there the one is at home, and the other has been
copied in if it lies near enough to the border. If the angle of a pair is ``t``, ``x`` is at home
in ``c`` and ``y`` in ``h``, then ``y . (h - c) / |h - c|`` is at most ``sin t`` times the cosine
between two directions, the one from ``x`` to ``y`` and the border's normal; ``slack`` says how many
standard errors of that cosine a copy allows for. Nothing is compared twice, and no pair leaves
a task: a task returns link counts and a spanning forest of what it has linked.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import col, cut_lineage, drawn
from tidegauge.llm.components import star_components
from tidegauge.llm.vectors import finite, matrices, nonzero, unit
from tidegauge.operators.ordering import join_facts

THRESHOLD = 0.95
CELL_ROWS = 1024  # wanted rows of a cell
CENTRE_BYTES = 16 << 20  # of all centres, which every task holds: this bounds the number of cells
TILE_BYTES = 8 << 20  # of the rows on one side of a product
SAMPLE_PER_CELL = 32  # rows that the centres are fitted on, for each cell
ROUNDS = 6
SLACK = 4.0
_PROBE_ROWS = 512  # rows that show how many directions the vectors really use
_SUB_ROWS = 1024
_MIX = 0x9E3779B97F4A7C15  # scatters node numbers over tiles

_UNITS = "dim int, cell int, unit long, side int, node long, weight long, u binary"
_FOUND = "a long, b long, n long"


def _pad(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def _centres(sample: DataFrame, k: int, width: int, rounds: int) -> np.ndarray:
    """Spherical k-means over the sample; a centre that loses all rows stays where it is."""
    first = sample.orderBy("h2", "h1").limit(k).select("v").collect()
    centres = np.concatenate([_pad(unit(np.array([r.v])), width) for r in first])

    def partial(batches):
        sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            for _, m in matrices(batch.column(0)):
                u = _pad(unit(m), width)
                home = (u @ centres.T).argmax(axis=1)
                np.add.at(sums, home, u)
                counts += np.bincount(home, minlength=len(centres))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([sums[c].tobytes() for c in met], pa.binary())], ["cell", "total"])

    def whole(key, table):
        total = sum(np.frombuffer(x) for x in table["total"].to_pylist())
        return pa.table({"cell": [key[0].as_py()], "total": [total.tobytes()]}, schema=pa.schema([("cell", pa.int32()), ("total", pa.binary())]))

    kind = "cell int, total binary"
    for _ in range(rounds if k > 1 else 0):
        moved = sample.select("v").mapInArrow(partial, kind).groupBy("cell").applyInArrow(whole, kind)
        for row in moved.collect():  # one a centre, bounded by CENTRE_BYTES
            total = np.frombuffer(row.total)
            if total.any():
                centres[row.cell] = total / np.linalg.norm(total)
    return centres


def _margin(sample: DataFrame, threshold: float, slack: float | None, width: int) -> float:
    """How far inside its home a node may lie and still be copied over a border."""
    farthest = sqrt(1 - threshold**2)
    if slack is None:
        return farthest
    probe = [unit(np.array([r.v])) for r in sample.orderBy("h1", "h2").limit(_PROBE_ROWS).select("v").collect()]
    u = np.concatenate([_pad(p, width) for p in probe])
    cosines = (u @ u.T)[np.triu_indices(len(u), 1)]
    cosines = cosines[cosines < threshold]  # links say nothing about the directions in use
    spread = float((cosines**2).mean()) if len(cosines) else 1.0
    return farthest * min(1.0, slack * sqrt(spread))


class _Cells:
    """Homes and copies of vectors among the centres."""

    def __init__(self, centres: np.ndarray, margin: float):
        self.centres, self.margin = centres, margin
        square = np.einsum("ij,ij->i", centres, centres)
        self.square, self.width = square, centres.shape[1]

    def of(self, u: np.ndarray):
        """(home, (row, cell) of copies) of unit vectors."""
        dots = u @ self.centres[:, : u.shape[1]].T
        home = dots.argmax(axis=1)
        rows, cells = [], []
        for h in np.unique(home):
            if h:
                mine = np.flatnonzero(home == h)
                apart = np.sqrt(np.maximum(0, self.square[:h] + self.square[h] - 2 * self.centres[:h] @ self.centres[h]))
                near = dots[mine, h][:, None] - dots[mine, :h] <= self.margin * apart + 1e-12
                r, c = np.nonzero(near)
                rows.append(mine[r])
                cells.append(c)
        return home, np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cells or [np.zeros(0, int)])


def _units(tiles: int, copied: int, tile: int, copy: bool) -> list[tuple[int, int]]:
    """(unit, side) that a row takes part in: a unit compares side 0 with itself (its first one) and with side 1."""
    wide = tiles + copied + 1
    if copy:
        return [(i * wide + (tiles + tile if tile else 0), 1) for i in range(tiles)]
    later = [*range(tile + 1, tiles), *range(tiles + 1, tiles + copied)]
    return [(tile * wide + k, 0) for k in [0, *later]] + [(i * wide + tile, 1) for i in range(tile)]


def _links(a: np.ndarray, b: np.ndarray, threshold: float):
    """Blocks (first row, boolean links) of the rows of ``a`` with those of ``b``, as double precision says."""
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    unsure = (a.shape[1] + 8) * 1.2e-7
    for at in range(0, len(a), _SUB_ROWS):
        got = a32[at : at + _SUB_ROWS] @ b32.T
        linked = got >= threshold
        i, j = np.nonzero(np.abs(got - threshold) <= unsure)
        for s in range(0, len(i), 1 << 16):
            p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            linked[p, q] = np.einsum("ij,ij->i", a[at + p], b[q]) >= threshold
        yield at, linked


class _Forest:
    """Union-find over the rows of a unit that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.parent, self.seen, self.edges = list(range(n)), np.arange(n), []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, i: int, others: np.ndarray) -> None:
        for tree, at in zip(*np.unique(self.seen[others], return_index=True), strict=True):
            mine, its = self.find(i), self.find(int(tree))
            if mine != its:
                self.parent[its] = mine
                self.edges.append((i, int(others[at])))
        self.seen[others] = self.seen[i] = self.find(i)


def compare(u0, w0, u1, w1, within: bool, threshold: float = THRESHOLD):
    """(links of side 0, links of side 1, edges between places 0.. of both sides together)."""
    n0, n1 = np.zeros(len(u0), np.int64), np.zeros(len(u1), np.int64)
    forest = _Forest(len(u0) + len(u1))
    for own in (True, False):
        other, weights, base = (u0, w0, 0) if own else (u1, w1, len(u0))
        if (own and not within) or not len(other):
            continue
        for at, linked in _links(u0, other, threshold):
            if own:
                linked[np.arange(len(linked)), at + np.arange(len(linked))] = False
            i, j = np.nonzero(linked)
            if not len(i):
                continue
            n0[at : at + len(linked)] += np.bincount(i, weights[j], len(linked)).astype(np.int64)
            if not own:
                n1 += np.bincount(j, w0[at + i], len(n1)).astype(np.int64)
            for row in np.unique(i):
                forest.join(at + int(row), base + np.flatnonzero(linked[row]))
    return n0, n1, forest.edges


def near_duplicate_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    cell_rows: int = CELL_ROWS,
    tile_bytes: int = TILE_BYTES,
    slack: float | None = SLACK,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Two vectors of one length link if their cosine, in double precision, is ``threshold`` or more;
    vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Every other row counts as a vector of its own, repeated rows and ids too. ``component_id`` is
    the smallest id among the rows linked directly or through others (null if none has one), and
    ``kept`` says that the row has this id; a row without an id is never kept. ``slack`` None finds
    every link for certain; a number misses links only beyond so many standard errors (see above).
    Centres are fitted on ``SAMPLE_PER_CELL`` rows a cell; every row is placed and compared. A group
    of n different near copies takes n * n / 2 products, as ``n_links`` counts them all, in tiles of
    bounded size. An empty table gives an empty one; other columns are ignored.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold between 0 and 1")
    v = F.col("v")
    given = rows.select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("v"))
    given = given.withColumn("usable", finite(v) & nonzero(v))
    hashes = {"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}
    nodes = given.where("usable").groupBy("v").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    nodes = cut_lineage(nodes.withColumns(hashes | {"node": F.monotonically_increasing_id()}))
    n, widest = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n:
        facts = _linked(nodes, n, widest, threshold, cell_rows, tile_bytes, slack, rounds)
    else:
        facts = nodes.selectExpr("h1", "h2", "weight - 1 as more", "least as component_id")
    narrow = given.withColumns({k: F.when(F.col("usable"), h) for k, h in hashes.items()}).select("id", "h1", "h2")
    found = join_facts(narrow, facts, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("more", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return found.withColumn("kept", F.coalesce(col(id_col) == F.col("component_id"), F.lit(False)))


def _linked(nodes, n, width, threshold, cell_rows, tile_bytes, slack, rounds) -> DataFrame:
    """(h1, h2, more, component_id) of every node."""
    k = max(1, min(-(-n // cell_rows), CENTRE_BYTES // (8 * width)))
    sample = cut_lineage(nodes.where(drawn("h2", SAMPLE_PER_CELL * k, n)).select("h1", "h2", "v"))
    cells = _Cells(_centres(sample, k, width, rounds), _margin(sample, threshold, slack, width))
    shared = nodes.sparkSession.sparkContext.broadcast(cells)

    def placed(batches):
        for batch in batches:
            for places, m in matrices(batch.column(batch.schema.get_field_index("v"))):
                u = unit(m)
                yield batch, places, u, shared.value.of(u)

    def count(batches):
        for _, _, u, (home, _, copies) in placed(batches):
            for copied, at in ((False, home), (True, copies)):
                met, many = np.unique(at, return_counts=True)
                size = len(met)
                arrays = [pa.array([u.shape[1]] * size, pa.int32()), pa.array(met, pa.int32()), pa.array([copied] * size, pa.bool_()), pa.array(many, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["dim", "cell", "copied", "n"])

    columns = nodes.select("node", "weight", "v")
    sizes = columns.mapInArrow(count, "dim int, cell int, copied boolean, n long").groupBy("dim", "cell", "copied").agg(F.sum("n").alias("n"))
    tiles = {}  # at most two a centre and length
    for r in sizes.collect():
        tiles[r.dim, r.cell, r.copied] = -(-r.n // max(1, tile_bytes // (8 * r.dim)))
    tiles = nodes.sparkSession.sparkContext.broadcast(tiles)

    def deal(batches):
        for batch, places, u, (home, copied, copies) in placed(batches):
            dim, got = u.shape[1], tiles.value
            ids, weights = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[places] for c in ("node", "weight"))
            out: list[tuple] = []
            spots = [(i, int(c), False) for i, c in enumerate(home)] + [(int(i), int(c), True) for i, c in zip(copied, copies, strict=True)]
            for i, cell, copy in spots:
                a, b = got.get((dim, cell, False), 0), got.get((dim, cell, True), 0)
                tile = (int(ids[i]) * _MIX >> 32) % (b if copy else a)
                out += [(cell, part, side, i) for part, side in _units(a, b, tile, copy)]
            for s in range(0, len(out), 1 << 14):
                cell, part, side, i = map(np.array, zip(*out[s : s + (1 << 14)], strict=True))
                arrays = [pa.array(np.full(len(i), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(part, pa.int64()), pa.array(side, pa.int32()),
                          pa.array(ids[i], pa.int64()), pa.array(weights[i], pa.int64()), pa.array([u[x].tobytes() for x in i], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["dim", "cell", "unit", "side", "node", "weight", "u"])

    def meet(key, table):
        dim, cell, part = (x.as_py() for x in key)
        a, b = tiles.value.get((dim, cell, False), 0), tiles.value.get((dim, cell, True), 0)
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        first = int((side == 0).sum())
        ids, weights = table["node"].to_numpy()[order], table["weight"].to_numpy()[order]
        u = np.frombuffer(b"".join(table["u"].to_pylist())).reshape(-1, dim)[order]
        n0, n1, edges = compare(u[:first], weights[:first], u[first:], weights[first:], part % (a + b + 1) == 0, threshold)
        links = np.concatenate([n0, n1])
        met = np.flatnonzero(links)
        left, right = (ids[[e[s] for e in edges]] if edges else np.zeros(0, np.int64) for s in (0, 1))
        return pa.table({
            "a": pa.array(np.concatenate([ids[met], left]), pa.int64()),
            "b": pa.concat_arrays([pa.nulls(len(met), pa.int64()), pa.array(right, pa.int64())]),
            "n": pa.array(np.concatenate([links[met], np.zeros(len(left), np.int64)]), pa.int64()),
        })

    dealt = columns.mapInArrow(deal, _UNITS).groupBy("dim", "cell", "unit")
    found = cut_lineage(dealt.applyInArrow(meet, _FOUND))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    labels = star_components(found.where("b is not null").select("a", "b"))
    named = cut_lineage(
        nodes.drop("v").join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    more = (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("more")
    return join_facts(named, ids, ["label"]).select("h1", "h2", more, "component_id")
