"""Regression trees, forests and boosted trees from histograms, many candidates at once.

Features are cut into bins once. Rows that fall into the same bins are the same to every tree, so the
table shrinks to cells: a row a combination of bins and a hash part, with a count and a label sum.
Row samples are whole parts, drawn anew for every tree: a share of them without, or as many as there
are with replacement. Split search sees sums by (tree, node, feature, bin) only.

A table of cells of bounded size travels to the tasks, and each grows some candidates' trees; a
larger one stays where it is, and one job a level adds up the histograms of all candidates. Both
ways grow the same trees. Candidates that differ in their number of trees share one chain of
them, forests of different depths one set of trees, which is read down to the depth wanted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.models.sums import array_matrix, matrix_sums
from tidegauge.session import cut_lineage, ship_package

MAX_BINS = 256
PARTS = 20  # hash parts of the rows: a share of 0.8 is 16 of them
TABLE_BYTES = 64 << 20  # of a table of cells that every task may hold
TREES_A_TASK = 50  # of a forest
KEPT_ROUNDS = 25  # boosting rounds between two writes of the predictions, for tables that stay spread
LEVEL_TREES = 16  # forest trees that one job grows by a level
_NOISE = 1e-12  # of the summed squares of the label: smaller gains are rounding


@dataclass(frozen=True)
class Settings:
    """How trees are grown; ``mode`` is boost, forest or tree."""

    mode: str
    rounds: int = 1
    depth: int = 6
    rate: float = 1.0
    least: float = 1.0  # rows of a leaf
    l2: float = 0.0  # leaf penalties: the leaf of gradient sum g and n rows is -soft(g, l1) / (n + l2)
    l1: float = 0.0
    rows: float = 1.0  # share of the parts a tree sees
    columns: float = 1.0  # share of the features a tree sees
    seed: int = 0

    def __post_init__(self):
        if self.rounds < 1 or self.depth < 1 or min(self.l1, self.l2) < 0 or not (0 < self.rows <= 1 and 0 < self.columns <= 1):
            raise ValueError(f"no such trees: {self}")

    def chain(self) -> Settings:
        """What candidates share that differ only in how much of the trees they read."""
        return replace(self, rounds=1, depth=self.depth if self.mode == "boost" else 1)

    def draw(self, number: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(weight of each part, which features) of a tree."""
        rng = np.random.default_rng([self.seed, number])
        parts, columns = np.ones(PARTS), np.ones(width, bool)
        if self.mode == "forest":
            parts = rng.multinomial(PARTS, [1 / PARTS] * PARTS).astype(float)
        elif self.rows < 1:
            parts = np.zeros(PARTS)
            parts[rng.permutation(PARTS)[: max(1, round(self.rows * PARTS))]] = 1
        if self.columns < 1:
            columns = np.zeros(width, bool)
            columns[rng.permutation(width)[: max(1, int(self.columns * width))]] = True
        return parts, columns


@dataclass
class Tree:
    """Nodes in order of their level; children stand side by side."""

    feature: np.ndarray  # -1: a leaf
    cut: np.ndarray  # bins up to this one go left
    left: np.ndarray
    value: np.ndarray

    def step(self, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
        f = self.feature[at]
        right = bins[np.arange(len(at)), np.maximum(f, 0)] > self.cut[at]
        return np.where(f >= 0, self.left[at] + right, at)

    def depths(self, bins: np.ndarray, depths: Sequence[int]) -> list[np.ndarray]:
        """Values at the nodes reached after so many steps."""
        at, out = np.zeros(len(bins), np.int64), {}
        for level in range(max(depths) + 1):
            if level in depths:
                out[level] = self.value[at]
            at = self.step(at, bins)
        return [out[d] for d in depths]


class Growing:
    """A tree that grows by a level with each set of histograms."""

    def __init__(self, settings: Settings, columns: np.ndarray, noise: float):
        self.settings, self.columns, self.noise = settings, columns, noise
        self.tree = Tree(np.array([-1]), np.array([0]), np.array([-1]), np.zeros(1))
        self.first, self.level = 0, 0

    @property
    def width(self) -> int:
        """Nodes of the newest level."""
        return len(self.tree.value) - self.first

    def _soft(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.settings.l1, 0) if self.settings.l1 else g

    def _score(self, n: np.ndarray, g: np.ndarray) -> np.ndarray:
        return self._soft(g) ** 2 / np.maximum(n + self.settings.l2, 1e-300)

    def extend(self, n: np.ndarray, g: np.ndarray) -> bool:
        """Take the (node, feature, bin) sums of rows and gradients of the newest level; is there another one?"""
        s, t = self.settings, self.tree
        whole_n, whole_g = n[:, 0].sum(axis=1), g[:, 0].sum(axis=1)
        t.value[self.first :] = np.where(whole_n > 0, -self._soft(whole_g) / np.maximum(whole_n + s.l2, 1e-300), 0.0)
        if self.level == s.depth:
            return False
        left_n, left_g = n.cumsum(axis=2)[:, :, :-1], g.cumsum(axis=2)[:, :, :-1]
        right_n, right_g = whole_n[:, None, None] - left_n, whole_g[:, None, None] - left_g
        gain = self._score(left_n, left_g) + self._score(right_n, right_g) - self._score(whole_n, whole_g)[:, None, None]
        fits = (left_n >= s.least) & (right_n >= s.least) & (left_n > 0) & (right_n > 0) & self.columns[None, :, None]
        gain = np.where(fits, gain, -inf).reshape(len(gain), -1)
        if not gain.shape[1]:
            return False
        best = gain.argmax(axis=1)  # ties: the first feature, then the lowest cut
        split = np.flatnonzero(gain[np.arange(len(gain)), best] > self.noise)
        if not len(split):
            return False
        bins = left_n.shape[2]
        count = len(t.value)
        nodes = self.first + split
        t.feature[nodes], t.cut[nodes] = best[split] // bins, best[split] % bins
        t.left[nodes] = count + 2 * np.arange(len(split))
        more = 2 * len(split)
        self.tree = Tree(*(np.concatenate([a, np.full(more, v, a.dtype)]) for a, v in ((t.feature, -1), (t.cut, 0), (t.left, -1), (t.value, 0))))
        self.first, self.level = count, self.level + 1
        return True

    def histograms(self, at: np.ndarray, bins: np.ndarray, n: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
        """Sums of rows and gradients by (node of the newest level, feature, bin)."""
        mine = np.flatnonzero((at >= self.first) & (n > 0))
        features = bins.shape[1]
        place = (((at[mine] - self.first)[:, None] * features + np.arange(features)) * size + bins[mine]).ravel()
        shape = (self.width, features, size)
        total = [np.bincount(place, np.repeat(w[mine], features), int(np.prod(shape))) for w in (n, g)]
        return np.stack(total).reshape(2, *shape)


@dataclass
class Cells:
    """Cells of a table in one task: bins, and (cell, part, rows, label sum) entries."""

    bins: np.ndarray
    cell: np.ndarray
    part: np.ndarray
    n: np.ndarray
    y: np.ndarray

    @staticmethod
    def read(batch) -> Cells:
        keys = batch.column(0).to_pylist()
        numbers: dict[bytes, int] = {}
        cell = np.fromiter((numbers.setdefault(k, len(numbers)) for k in keys), np.int64, len(keys))
        bins = np.frombuffer(b"".join(numbers), np.uint16).reshape(len(numbers), -1) if numbers else np.zeros((0, 0), np.uint16)
        rest = (batch.column(i).to_numpy() for i in (1, 2, 3))
        return Cells(bins, cell, *rest)

    def weighed(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, label sum) of every cell under a draw."""
        w = parts[self.part]
        size = len(self.bins)
        return np.bincount(self.cell, self.n * w, size), np.bincount(self.cell, self.y * w, size)


@dataclass(frozen=True)
class Table:
    """The binned training rows, as cells."""

    cells: DataFrame  # cell binary, part int, n double, y double; written once
    cuts: tuple[np.ndarray, ...]  # of every feature: a value goes to the bin of cuts below it
    size: int  # bins of the widest feature
    base: float  # mean label
    noise: float
    entries: int

    def small(self, most: int) -> bool:
        return self.entries * (2 * len(self.cuts) + 24) <= most


def _x(frame: DataFrame) -> DataFrame:
    return frame.select(vector_to_array("features").alias("x"), "label")


def find_cuts(frame: DataFrame, max_bins: int = MAX_BINS) -> tuple[np.ndarray, ...]:
    """Cuts of every feature of a ``(features, label)`` frame.

    A feature of few distinct values is cut half-way between neighbours; another one at
    approximate quantiles, which are values of it.
    """
    rows = _x(frame)
    first = rows.first()
    if first is None:
        raise ValueError("no rows to fit on")
    columns = [F.get("x", F.lit(i)) for i in range(len(first.x))]
    about = rows.agg(*[F.approx_count_distinct(c, 0.02) for c in columns]).first()
    few = [i for i, n in enumerate(about) if n <= 2 * max_bins]
    many = [i for i, n in enumerate(about) if n > 2 * max_bins]
    shares = [(k + 1) / max_bins for k in range(max_bins - 1)]
    sets = rows.agg(*[F.sort_array(F.collect_set(columns[i])) for i in few]).first() if few else ()
    known = dict(zip(few, sets, strict=True))
    many += [i for i, s in known.items() if len(s) > max_bins]
    quantiles = rows.agg(*[F.percentile_approx(columns[i], shares, 10_000) for i in many]).first() if many else ()
    told = dict(zip(many, quantiles, strict=True))
    out = []
    for i in range(len(columns)):
        if i in told:
            out.append(np.unique(np.array(told[i], float))[:-1] if len(set(told[i])) > 1 else np.array(told[i][:1], float))
        else:
            v = np.array([x for x in known[i] if x == x], float)
            out.append((v[1:] + v[:-1]) / 2)
    return tuple(out)


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of a matrix; NaN goes where the largest values go."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint16)


def packed(bins: np.ndarray) -> pa.Array:
    """The bins of a row as bytes."""
    return pa.array([b.tobytes() for b in bins], pa.binary())


def unpacked(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint16).reshape(len(keys), -1)


def tabulate(frame: DataFrame, max_bins: int = MAX_BINS) -> Table:
    """Cells of a ``(features, label)`` frame, from three passes over it."""
    ship_package(frame.sparkSession)
    cuts = find_cuts(frame, max_bins)
    row = frame.agg(F.avg("label").alias("m"), F.var_pop("label").alias("v"), F.count("label").alias("n")).first()
    base = row.m

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                keys = packed(binned(array_matrix(batch.column(0)), cuts))
                yield pa.RecordBatch.from_arrays([keys, batch.column(1), batch.column(2)], ["cell", "part", "label"])

    part = F.pmod(F.xxhash64("x", "label"), F.lit(PARTS)).cast("int").alias("part")
    rows = _x(frame).select("x", part, "label").mapInArrow(pack, "cell binary, part int, label double")
    # Labels are counted from their mean, which keeps the sums small.
    summed = rows.groupBy("cell", "part").agg(F.count("label").cast("double").alias("n"), F.sum(F.col("label") - F.lit(base)).alias("y"))
    cells = cut_lineage(summed)
    size = max(len(c) for c in cuts) + 1
    return Table(cells, cuts, size, base, _NOISE * (row.v or 0.0) * row.n, cells.count())


def _grow(cells: Cells, s: Settings, number: int, table_size: int, noise: float, predicted: np.ndarray) -> Tree:
    parts, columns = s.draw(number, cells.bins.shape[1])
    n, y = cells.weighed(parts)
    g = n * predicted - y
    growing, at = Growing(s, columns, noise), np.zeros(len(cells.bins), np.int64)
    while growing.extend(*growing.histograms(at, cells.bins, n, g, table_size)):
        at = growing.tree.step(at, cells.bins)
    return growing.tree


def grow_chain(cells: Cells, s: Settings, table_size: int, noise: float, first: int = 0, count: int | None = None) -> list[Tree]:
    """The trees of one candidate from cells that lie in one place; ``first`` and ``count`` pick some of a forest's."""
    predicted, out = np.zeros(len(cells.bins)), []
    for number in range(first, first + (count or s.rounds)):
        tree = _grow(cells, s, number, table_size, noise, predicted)
        if s.mode == "boost":
            predicted += s.rate * tree.depths(cells.bins, [s.depth])[0]
        out.append(tree)
    return out


_TREE = "chain int, number int, feature binary, cut binary, left_ binary, value binary"


def _grow_held(table: Table, chains: Sequence[Settings]) -> list[list[Tree]]:
    """Every task holds all cells and grows a chain, or some trees of a forest."""
    spark = table.cells.sparkSession
    units = []
    for c, s in enumerate(chains):
        step = TREES_A_TASK if s.mode == "forest" else s.rounds
        units += [(c, a, min(step, s.rounds - a)) for a in range(0, s.rounds, step)]
    units.sort(key=lambda u: -u[2] * 2.0 ** chains[u[0]].depth)
    held = spark.sparkContext.broadcast(table.cells.toArrow().combine_chunks())
    size, noise = table.size, table.noise

    def work(batches):
        cells = None
        for batch in batches:
            for unit in batch.to_pylist():
                cells = cells or Cells.read(held.value)
                trees = grow_chain(cells, chains[unit["chain"]], size, noise, unit["first"], unit["count"])
                cols = zip(*[[a.astype(k).tobytes() for a, k in zip((t.feature, t.cut, t.left, t.value), _KINDS, strict=True)] for t in trees], strict=True)
                numbers = range(unit["first"], unit["first"] + len(trees))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit["chain"]] * len(trees), pa.int32()), pa.array(numbers, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]],
                    [f.split()[0] for f in _TREE.split(", ")],
                )

    asked = spark.createDataFrame([(i, *u) for i, u in enumerate(units)], "unit int, chain int, first int, count int")
    spread = asked.repartitionByRange(len(units), "unit") if len(units) > 1 else asked
    out: list[dict[int, Tree]] = [{} for _ in chains]
    for r in spread.select("chain", "first", "count").mapInArrow(work, _TREE).collect():
        arrays = (np.frombuffer(x, k).astype(w) for x, k, w in zip((r.feature, r.cut, r.left_, r.value), _KINDS, (int, int, int, float), strict=True))
        out[r.chain][r.number] = Tree(*arrays)
    held.unpersist()
    return [[trees[i] for i in sorted(trees)] for trees in out]


_KINDS = (np.int16, np.uint16, np.int32, np.float64)


def _grow_spread(table: Table, chains: Sequence[Settings]) -> list[list[Tree]]:
    """Cells stay in their tasks; a job a level adds up the histograms of all chains."""
    width, size, noise = len(table.cuts), table.size, table.noise
    done: list[list[Tree]] = [[] for _ in chains]
    boosts = [c for c, s in enumerate(chains) if s.mode == "boost"]
    state = table.cells.select("cell", "part", "n", "y", F.array(*[F.lit(0.0) for _ in boosts]).cast("array<double>").alias("p"))
    since = 0  # trees of a chain that the written predictions know

    def predictions(batch, cells: Cells, trees: dict[int, list[Tree]]) -> np.ndarray:
        """Of every entry (not cell) and boosted chain."""
        old = array_matrix(batch.column(4)) if boosts else np.zeros((batch.num_rows, 0))
        for k, c in enumerate(boosts):
            for tree in trees[c]:
                old[:, k] += chains[c].rate * tree.depths(cells.bins, [chains[c].depth])[0][cells.cell]
        return old

    def level(growing: dict[tuple[int, int], Growing], trees: dict[int, list[Tree]]) -> dict[int, np.ndarray]:
        keys = list(growing)

        def sums(batch):
            cells = Cells.read(batch)
            guess = predictions(batch, cells, trees)
            for i, (c, number) in enumerate(keys):
                own, (parts, _) = growing[c, number], chains[c].draw(number, width)
                w = parts[cells.part]
                y = cells.y - (cells.n * guess[:, boosts.index(c)] if c in boosts else 0)
                n, g = (np.bincount(cells.cell, v * w, len(cells.bins)) for v in (cells.n, -y))
                at = np.zeros(len(cells.bins), np.int64)
                for _ in range(own.level):
                    at = own.tree.step(at, cells.bins)
                yield i, own.histograms(at, cells.bins, n, g, size)

        got = matrix_sums(state, sums)
        return {key: got[i].reshape(2, growing[key].width, width, size) for i, key in enumerate(keys) if i in got}

    def grow(wanted: list[tuple[int, int]]) -> dict[tuple[int, int], Tree]:
        trees = {c: done[c][since:] for c in boosts}
        growing = {(c, n): Growing(chains[c], chains[c].draw(n, width)[1], noise) for c, n in wanted}
        out = {}
        while growing:
            for key, (n, g) in level(growing, trees).items():
                if not growing[key].extend(n, g):
                    out[key] = growing.pop(key).tree
        return out

    for number in range(max((chains[c].rounds for c in boosts), default=0)):
        for (c, _), tree in grow([(c, number) for c in boosts if number < chains[c].rounds]).items():
            done[c].append(tree)
        if number - since + 1 == KEPT_ROUNDS:
            trees = {c: done[c][since:] for c in boosts}

            def keep(batches, trees=trees):
                for batch in batches:
                    if batch.num_rows:
                        now = predictions(batch, Cells.read(batch), trees)
                        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(now) + 1) * now.shape[1], pa.int32()), pa.array(now.ravel()))
                        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], cells], ["cell", "part", "n", "y", "p"])

            state, since = cut_lineage(state.mapInArrow(keep, "cell binary, part int, n double, y double, p array<double>")), number + 1
    for c, s in enumerate(chains):
        if s.mode != "boost":
            for a in range(0, s.rounds, LEVEL_TREES):
                got = grow([(c, n) for n in range(a, min(s.rounds, a + LEVEL_TREES))])
                done[c] += [got[key] for key in sorted(got)]
    return done


@dataclass(frozen=True)
class Reading:
    """What a candidate reads of a chain: so many trees, down to a depth."""

    chain: int
    rounds: int
    depth: int


@dataclass(frozen=True)
class Ensemble:
    """The chains of all candidates of one fit, and what each candidate reads."""

    cuts: tuple[np.ndarray, ...]
    base: float
    chains: tuple[Settings, ...]
    trees: tuple[tuple[Tree, ...], ...]
    readings: tuple[Reading, ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column a candidate."""
        bins, back = np.unique(binned(x, self.cuts), axis=0, return_inverse=True)
        return self.predict_bins(bins)[back.ravel()]

    def predict_bins(self, bins: np.ndarray) -> np.ndarray:
        out = np.empty((len(bins), len(self.readings)))
        for c, (s, trees) in enumerate(zip(self.chains, self.trees, strict=True)):
            wanted = [(i, r) for i, r in enumerate(self.readings) if r.chain == c]
            depths = sorted({r.depth for _, r in wanted})
            totals = {d: np.zeros(len(bins)) for d in depths}
            for number, tree in enumerate(trees, 1):
                for d, got in zip(depths, tree.depths(bins, depths), strict=True):
                    totals[d] += got
                for i, r in wanted:
                    if r.rounds == number:
                        out[:, i] = self.base + totals[r.depth] * (s.rate if s.mode == "boost" else 1 / number)
        return out

    def nodes(self, candidate: int = 0) -> list[tuple[int, int, int | None, float | None, int | None, float]]:
        """(tree, node, feature, cut, left child, value) of a candidate's trees; values up to a cut go left, the right child is the next."""
        r = self.readings[candidate]
        out = []
        for number, t in enumerate(self.trees[r.chain][: r.rounds]):
            for i, (f, c, left, v) in enumerate(zip(t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.value.tolist(), strict=True)):
                inner = f >= 0
                out.append((number, i, f if inner else None, float(self.cuts[f][c]) if inner else None, left if inner else None, v))
        return out


def fit_trees(frame: DataFrame, candidates: Sequence[Settings], max_bins: int = MAX_BINS, table_bytes: int = TABLE_BYTES) -> Ensemble:
    """Fit all candidates on a ``(features, label)`` frame at once.

    Trees are equal to those of a fit of one candidate alone, and of either way of growing up to
    the rounding of sums. Rows without a label count for nothing.
    """
    table = tabulate(frame.where("label is not null"), max_bins)
    chains: dict[Settings, list[int]] = {}
    for i, s in enumerate(candidates):
        chains.setdefault(s.chain(), []).append(i)
    readings: list = [None] * len(candidates)
    whole = []
    for c, members in enumerate(chains.values()):
        own = [candidates[i] for i in members]
        whole.append(replace(own[0], rounds=max(s.rounds for s in own), depth=max(s.depth for s in own)))
        for i, s in zip(members, own, strict=True):
            readings[i] = Reading(c, s.rounds, s.depth)
    grown = (_grow_held if table.small(table_bytes) else _grow_spread)(table, whole)
    return Ensemble(table.cuts, table.base, tuple(whole), tuple(map(tuple, grown)), tuple(readings))


@dataclass(frozen=True)
class TreeModel:
    """One candidate of a fit, used like a model of Spark's."""

    ensemble: Ensemble
    prediction: str = "prediction"

    def setPredictionCol(self, name: str) -> TreeModel:  # noqa: N802, as Spark's models have it
        return replace(self, prediction=name)

    def transform(self, df: DataFrame) -> DataFrame:
        return with_predictions(df, "features", self.ensemble.predict, 1, "__p").withColumn(self.prediction, F.col("__p")[0]).drop("__p")


def with_predictions(df: DataFrame, features: str, predict: Callable[[np.ndarray], np.ndarray], width: int, name: str) -> DataFrame:
    """Append the array of predictions for a vector column; the other columns pass through."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(predict)
    source = df.withColumn("__x", vector_to_array(features))
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.UserDefinedType)]
    schema = T.StructType([df.schema[c] for c in plain] + [T.StructField("__x", T.ArrayType(T.DoubleType())), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = np.ascontiguousarray(shared.value(array_matrix(batch.column(batch.num_columns - 1))))
                offsets = pa.array(np.arange(len(got) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))], schema.names)

    out = source.select(*[F.col(f"`{c}`") for c in plain], "__x").mapInArrow(run, schema)
    lost = [c for c in df.columns if c not in plain]
    return out.withColumns({c: array_to_vector("__x") for c in lost if c == features}).select(*[F.col(f"`{c}`") for c in df.columns if c in plain or c == features], name)
