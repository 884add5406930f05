"""Periodic runs of words, by tiles whose size goes with the period.

Periods are cut into octaves ``P <= q < 2P``. In each octave a text is cut at boundaries ``P`` words
apart. A run of at least three periods holds two of them, so it is enough to look at boundaries: the
Z-function at one says for every ``q`` of the octave how far the words from the boundary on agree
with those ``q`` further on, and the same backwards. Both together are the longest stretch of period
``q`` that crosses the boundary. A tile holds some boundaries and the words that their stretches
need; a longer run leaves fragments in several tiles, which are stitched by document and period.

Z-values of all boundaries of a tile are found at once, by binary search over block hashes; every
run is then compared word by word, and a tile where a hash has lied is solved again without hashes.
"""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import TEXT, col, cut_lineage, others, slices

LEAST, TIMES = 24, 3  # a run has so many words and so many periods at least
LOCAL_BYTES = 32 << 10  # texts up to this size are one tile for every octave, solved where they lie
TILE_WORDS = 8192  # words of the core of a tile, unless its octave needs more
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_COUNTS = "n_runs start length period exponent_milli".split()
_TEXTS = ["runs_sha256", "collapsed_sha256"]
ADDED = T.StructType(
    [T.StructField(c, T.LongType()) for c in _COUNTS] + [T.StructField(c, T.StringType()) for c in _TEXTS] + [T.StructField("n_words", T.LongType())]
)
_TILE = "doc long, octave int, tile long, at long, words binary, first boolean, last boolean"
_FRAGMENT = "doc long, period long, lo long, hi long"


def words_of(text: str | None, seed: int | None) -> list[bytes]:
    """The words of a text; ``seed``, if a multiple of ten, makes those from some place on periodic."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if n and seed is not None and seed % 10 == 0:
        g = seed // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        cycle = words[a : a + p]
        words[a:] = (cycle * (-(-(n - a) // p)))[: n - a]
    return words


def seed_of(doc) -> int | None:
    return None if doc is None else crc32(str(doc).encode())


def numbered(words: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))


class _Hashes:
    """Hashes of all blocks of a tile from sums of powers; equal blocks have equal hashes."""

    def __init__(self, w: np.ndarray):
        n = len(w)
        x = w.astype(np.uint64)
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):  # scatter word numbers
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        self.power = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, _BASE), out=self.power[1:])
        self.sums = np.zeros(n + 1, np.uint64)
        np.add.accumulate(x * self.power[:n], out=self.sums[1:])
        self.n = n

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Blocks from ``i`` and from ``j`` (further on) of ``size`` words have one hash."""
        left, right = self.sums[i + size] - self.sums[i], self.sums[j + size] - self.sums[j]
        return left * self.power[j - i] == right

    def grams(self, size: int) -> np.ndarray:
        """Of the blocks of ``size`` words, brought to one power."""
        count = self.n - size + 1
        return (self.sums[size:] - self.sums[:count]) * self.power[self.n - np.arange(count)]

    def _longest(self, most: np.ndarray, fits) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            good = fits(middle)
            low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
        return low

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Z-value: words that agree from ``i`` and ``j`` > ``i`` on."""
        return self._longest(self.n - j, lambda size: self.equal(i, j, size))

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before ``i`` and ``j`` > ``i``."""
        return self._longest(i.copy(), lambda size: self.equal(i - size, j - size, size))


def _octave_stretches(h: _Hashes, p: int, core: tuple[int, int], origin: int, grams: np.ndarray, size: int):
    """Distinct (lo, hi, period) of the stretches with a period of the octave that cross boundaries of the core."""
    first = core[0] + (-(core[0] + origin)) % p  # boundaries lie at multiples of p in the document
    at = np.arange(first, min(core[1], len(grams) - p), p)
    found = []
    step = max(1, (1 << 20) // p)
    for s in range(0, len(at), step):
        b = at[s : s + step, None]
        there = b + np.arange(p, 2 * p)
        same = (there < len(grams)) & (grams[b] == grams[np.minimum(there, len(grams) - 1)])
        i, k = np.nonzero(same)
        found.append((at[s + i], k + p))
    if not found:
        return np.zeros((0, 3), np.int64)
    b, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, q))
    b, q = b[order], q[order]
    # Of boundaries in one stretch of a period the first will do.
    again = q[1:] == q[:-1]
    i, size = b[:-1][again], (b[1:] - b[:-1])[again]
    again[again] = h.equal(i, i + q[:-1][again], size)
    head = np.concatenate([[True], ~again]) if len(b) else again
    b, q = b[head], q[head]
    lo, hi = b - h.back(b, b + q), b + q + h.ahead(b, b + q)
    one = np.unique(q * (h.n + 1) + lo, return_index=True)[1]
    return np.stack([lo, hi, q], axis=1)[one]


def _primitive(h: _Hashes, runs: np.ndarray) -> np.ndarray:
    """The period is the smallest: no period that it is a prime multiple of holds."""
    lo, hi, q = runs.T
    keep, rest = np.ones(len(runs), bool), q.copy()
    divisor = 2
    top = int(q.max(initial=1))
    while divisor <= top and (rest > 1).any():
        if divisor * divisor > top:  # what is left of each period is one or a prime
            step = rest > 1
            primes = rest
        else:
            step, primes = rest % divisor == 0, np.full_like(rest, divisor)
        at = np.flatnonzero(step & keep)
        if len(at):
            r = q[at] // primes[at]
            keep[at] = ~h.equal(lo[at], lo[at] + r, hi[at] - lo[at] - r)
        if divisor * divisor > top:
            break
        while (again := rest % divisor == 0).any():
            rest = np.where(again, rest // divisor, rest)
        divisor += 1
    return runs[keep]


def stretches(w: np.ndarray, octaves, core: tuple[int, int] | None = None, origin: int = 0, open_ends=(False, False)) -> np.ndarray:
    """(lo, hi, period) in the tile of all runs, and of their fragments at open ends, that cross boundaries of the core.

    Runs lie inside the tile or end where the text ends. A fragment touches an open end of the
    tile and has two periods at least. Separators, numbers that occur once, keep texts apart.
    """
    core = core or (0, len(w))
    if len(w) < LEAST:
        return np.zeros((0, 3), np.int64)
    h, out, size, grams = _Hashes(w), [], 0, None
    for p in octaves:
        if len(w) < 2 * p or len(w) <= 16 + p:
            continue
        if size != (8 if p <= 8 else 16):
            size = 8 if p <= 8 else 16
            grams = h.grams(size)
        got = _octave_stretches(h, p, core, origin, grams, size)
        lo, hi, q = got.T
        length = hi - lo
        cut = (open_ends[0] & (lo == 0)) | (open_ends[1] & (hi == len(w)))
        got = got[(length >= np.maximum(LEAST, TIMES * q)) | (cut & (length >= 2 * q))]
        got = _primitive(h, got)
        for a, z, q in got.tolist():
            if not np.array_equal(w[a : z - q], w[a + q : z]) or (a and w[a - 1] == w[a - 1 + q]) or (z < len(w) and w[z] == w[z - q]):
                return _plain(w, octaves, open_ends)
        out.append(got)
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def _plain(w: np.ndarray, octaves, open_ends) -> np.ndarray:
    """The same for all places of the tile, period by period and without hashes."""
    out = []
    for q in range(1, min(len(w) // 2, 2 * max(octaves) - 1) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], w[:-q] == w[q:], [0]]).astype(np.int8)))
        for a, z in edges.reshape(-1, 2).tolist():
            z += q
            cut = (open_ends[0] and a == 0) or (open_ends[1] and z == len(w))
            if z - a < (2 * q if cut else max(LEAST, TIMES * q)):
                continue
            small = any(q % r == 0 and np.array_equal(w[a : z - r], w[a + r : z]) for r in range(1, q // 2 + 1))
            if not small and any(p <= q < 2 * p for p in octaves):
                out.append((a, z, q))
    return np.array(out, np.int64).reshape(-1, 3)


def octaves_of(n: int) -> list[int]:
    """The octaves that periods of a text of ``n`` words can lie in."""
    return [1 << k for k in range(max(1, n // TIMES).bit_length())]


def local_runs(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of whole texts, in order; one tile holds them all."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    fresh = 1 + max((int(d.max()) for d in docs if len(d)), default=0)
    tile = np.concatenate([np.append(d, np.int32(fresh + i)) for i, d in enumerate(docs)]) if docs else np.zeros(0, np.int32)
    out: list[list] = [[] for _ in docs]
    longest = int(sizes.max(initial=0))
    if longest >= LEAST:
        for lo, hi, q in stretches(tile, octaves_of(longest)).tolist():
            doc = int(np.searchsorted(starts, lo, side="right")) - 1
            out[doc].append((lo - int(starts[doc]), hi - lo, q))
    return [sorted(set(o), key=lambda r: (r[0], r[2])) for o in out]


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The result's columns of one text from its words and its runs, in order of start and period."""
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:  # ties: the earlier start, then the smaller period
            best = s, length, q
    said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    dropped = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        dropped[s + q] += 1
        dropped[s + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    left = words if kept.all() else [w for w, k in zip(words, kept.tolist(), strict=True) if k]
    first = (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])
    return len(runs), *first, sha256(said.encode()).hexdigest(), sha256(b" ".join(left)).hexdigest(), len(words)


def _local(rows: list[tuple]) -> list[tuple]:
    ids: dict[bytes, int] = {}
    words = [words_of(text, seed_of(doc)) for doc, text in rows]
    found = local_runs([numbered(w, ids) for w in words])
    return [digest(w, r) for w, r in zip(words, found, strict=True)]


def tiles_of(n: int, tile_words: int) -> list[tuple[int, list[int], int, int, int, int]]:
    """(band, octaves, lo, hi, core start, core end) of all tiles of a text of ``n`` words.

    Octaves whose boundaries need little room share the tiles of the first band; a higher octave
    has tiles of its own, with cores four times its period. Around its core a tile has two periods
    before and four behind, so that fragments of one run overlap by a period at least.
    """
    octaves = octaves_of(n)
    low = [p for p in octaves if 8 * p <= tile_words] or octaves[:1]
    bands = [low] + [[p] for p in octaves if p > low[-1]]
    out = []
    for band, own in enumerate(bands):
        p = own[-1]
        core = max(tile_words, 4 * p)
        for at in range(0, n, core):
            out.append((band, own, max(0, at - 2 * p - 16), min(n, at + core + 4 * p + 16), at, min(n, at + core)))
    return out


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    local_bytes: int = LOCAL_BYTES,
    tile_words: int = TILE_WORDS,
) -> DataFrame:
    """``keep`` (the id) and n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words of every row.

    Words are cut at ASCII white space. If the CRC-32 of the id's decimal text is divisible by ten,
    the words from some place on are first made periodic; a null id changes nothing. A run is a
    stretch of at least 24 words and three times its smallest period that no neighbour extends.
    Texts up to ``local_bytes`` are solved where they lie; longer ones are cut into tiles, whose
    fragments are stitched by text and period. The result does not depend on either setting. Null
    and empty texts have no words and no runs; repeated rows are all kept; an empty table gives an
    empty one; other columns matter only if named in ``keep``, those with a result's name go.
    """
    keep = [id_col] if keep is None else keep
    kept = others(docs.select(*[col(c) for c in keep]), ADDED.names)
    safe = {c: f"k{i}" for i, c in enumerate(kept)}
    base = docs.select(*[col(c).alias(s) for c, s in safe.items()], col(id_col).cast("string").alias("doc_text"), col(text_col).cast("string").alias("body"))
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    back = [F.col(s).alias(c) for c, s in safe.items()] + ADDED.names
    short = _solved(base.where(size <= local_bytes), list(safe.values()))
    long_ = cut_lineage(base.where(size > local_bytes).withColumn("row", F.monotonically_increasing_id()))
    if long_.isEmpty():
        return short.select(*back)
    runs = stitched(fragments(long_, tile_words))
    whole = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    told = long_.join(whole, F.col("row") == F.col("doc"), "left")
    return short.select(*back).unionByName(_told(told, list(safe.values())).select(*back))


def _solved(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Every text is a part of one tile."""
    width = len(keep)
    source = docs.select(*keep, F.col("doc_text").alias("__doc"), F.col("body").alias(TEXT))
    schema = T.StructType([source.schema[c] for c in keep] + list(ADDED.fields))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            rows: list[tuple] = []
            for at, part in slices(texts):
                rows += _local(list(zip(ids[at : at + len(part)], part, strict=True)))
            if rows:
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(width)] + arrays, schema.names)

    return source.mapInArrow(run, schema)


_KINDS = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]


def fragments(docs: DataFrame, tile_words: int) -> DataFrame:
    """(doc, period, lo, hi) of the fragments that the tiles of long texts find, each on its own."""

    def explode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = numbered(words_of(row["body"], seed_of(row["doc_text"])), {})
                for band, own, lo, hi, a, z in tiles_of(len(words), tile_words):
                    cells = [row["row"], own[-1], a, lo, words[lo:hi].tobytes(), lo == 0, hi == len(words)]
                    yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names)

    names = "doc octave tile at words first last".split()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]

    def solve(batches):
        for batch in batches:
            for t in batch.to_pylist():
                w, lo, top = np.frombuffer(t["words"], np.int32), t["at"], t["octave"]
                low = max(1, tile_words // 8)
                own = [p for p in octaves_of(TIMES * top) if p <= top and (p == top or top <= low)]
                core = max(tile_words, 4 * top)
                begin = t["tile"] - lo
                got = stretches(w, own, (begin, min(len(w), begin + core)), lo, (not t["first"], not t["last"]))
                if len(got):
                    arrays = [pa.array(np.full(len(got), t["doc"])), pa.array(got[:, 2]), pa.array(got[:, 0] + lo), pa.array(got[:, 1] + lo)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc", "period", "lo", "hi"])

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    tiles = docs.select("row", "doc_text", "body").mapInArrow(explode, _TILE)
    return tiles.repartition(parts, "doc", "octave", "tile").mapInArrow(solve, _FRAGMENT)


def stitched(found: DataFrame) -> DataFrame:
    """(doc, start, length, period) of runs: fragments of one text and period that overlap by a period are one."""
    by = Window.partitionBy("doc", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(reach - F.col("lo") < F.col("period"), F.lit(True)).cast("int")
    islands = found.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by))
    joined = islands.groupBy("doc", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("stop"))
    length = (F.col("stop") - F.col("start")).alias("length")
    return joined.select("doc", "start", length, "period").where(
        (F.col("length") >= LEAST) & (F.col("length") >= TIMES * F.col("period"))
    )


def _told(docs: DataFrame, keep: list[str]) -> DataFrame:
    width = len(keep)
    source = docs.select(*keep, "doc_text", "body", "runs")
    schema = T.StructType([source.schema[c] for c in keep] + list(ADDED.fields))

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.select(["doc_text", "body", "runs"]).to_pylist():
                runs = [(x["start"], x["length"], x["period"]) for x in r["runs"] or []]
                rows.append(digest(words_of(r["body"], seed_of(r["doc_text"])), runs))
            if rows:
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(width)] + arrays, schema.names)

    return source.mapInArrow(run, schema)
