"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Every language has a model of four-character sequences over letters and single spaces. Sequences
are hashed by a one-to-one mix of their four 16-bit symbols and kept in sorted arrays, which are
searched by bisection for whole batches at once. A text gets the language whose model gives it the
lowest cross-entropy per character; the margin to the next is mapped to a confidence that is
calibrated on training texts, and texts unlike those of their language are marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import col, cut_lineage, drawn, held_out, map_texts, slices

ORDER = 4
MAX_NGRAMS = 400_000  # of all languages together that are kept at least; a language with more text keeps more
GROWTH = 40  # a language keeps this many sequences times the root of its counts, if that is more
MODEL_CELLS = 16_000_000  # n-grams times languages that are tabled ahead; others are worked out when met
CALIBRATION_ROWS = 5_000  # training texts that the confidence is fitted on, drawn by hash
REJECT_DEVIATIONS = 5.0
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that products are one-to-one
_SYMBOL = np.uint64(16)
_SLICE = 1_000_000

PREDICTED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)
_COUNTS = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]
)


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of every code point: letters their own (folded into 16 bits), 0 the text's end, others a space."""
    letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    points = np.arange(0x110000, dtype=np.uint32)
    folded = np.where(points > 0xFFFF, 0xE000 + points % 0x1800, points)
    out = np.where(letters, folded, 32).astype(np.uint16)
    out[0] = 0
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-symbol sequences that end in a symbol of each text, and the text of each.

    Letters in lower case, runs of anything else as one space; zeros stand before a text.
    """
    low = [t.replace("\0", " ").lower() for t in texts]
    gap = "\0" * (ORDER - 1)
    points = np.frombuffer((gap + gap.join(low)).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbols()[points]
    text = np.repeat(np.arange(len(low)), [len(t) + ORDER - 1 for t in low])
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 32) | (symbols[:-1] != 32)
    symbols, text = symbols[keep].astype(np.uint64), text[keep]
    packed = np.zeros(len(symbols), np.uint64)
    for back in range(ORDER):
        packed[back:] |= symbols[: len(symbols) - back] << np.uint64(16 * back)
    real = symbols != 0
    return packed[real], text[real]


def _add(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all texts with a language; added up in every task first."""

    def run(batches):
        import pyarrow as pa

        found: dict[str, tuple[list, list]] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, part in slices(texts, _SLICE):
                key, text = grams(part)
                names = sorted(set(langs[start : start + len(part)]))
                lang = np.array([names.index(x) for x in langs[start : start + len(part)]])[text]
                for i, name in enumerate(names):
                    got, n = np.unique(key[lang == i], return_counts=True)
                    keys, counts = found.setdefault(name, ([], []))
                    keys.append(got)
                    counts.append(n)
                    if len(keys) >= 16:
                        merged = _add(keys, counts)
                        found[name] = ([merged[0]], [merged[1]])
        for name, (keys, counts) in found.items():
            key, n = _add(keys, counts)
            if len(key):
                arrays = [pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, _COUNTS.names)

    rows = docs.select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _find(keys: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) in a sorted array."""
    if not len(keys):
        return np.zeros(len(hashed), np.int64), np.zeros(len(hashed), bool)
    at = np.searchsorted(keys, hashed)
    at[at == len(keys)] = 0
    return at, keys[at] == hashed


@dataclass
class Level:
    """Sequences of one order and language that the model keeps, and figures of all that were counted."""

    keys: np.ndarray
    counts: np.ndarray
    totals: np.ndarray  # of the sequence's context, over all sequences
    once: int
    twice: int
    rows: int


def _context(key: np.ndarray, n: int) -> np.ndarray:
    return key >> _SYMBOL if n > 1 else key * np.uint64(0)


def _all_levels(keys: np.ndarray, counts: np.ndarray) -> list[Level]:
    """All orders, lowest first, where every sequence of the highest order is here."""
    found = [(keys, counts)]
    for n in range(ORDER - 1, 0, -1):
        found.append(np.unique(found[-1][0] & np.uint64((1 << (16 * n)) - 1), return_counts=True))
    out = []
    for n, (key, count) in enumerate(reversed(found), 1):
        _, where = np.unique(_context(key, n), return_inverse=True)
        out.append(Level(key, count, np.bincount(where, count)[where], (count == 1).sum(), (count == 2).sum(), len(key)))
    return out


@dataclass
class KneserNey:
    """One language: by order the hashes of sequences and their log probabilities, and of contexts and their weights."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    unseen: float = -20.0

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From counts of the highest order; lower orders count the different symbols before a sequence."""
        return cls.of_levels(_all_levels(keys, counts))

    @classmethod
    def of_levels(cls, levels: list[Level]) -> KneserNey:
        """From the kept sequences of every order, lowest first, with figures of all that were counted.

        What the sequences that are not kept had of a context goes to its backoff weight, so that
        probabilities add up to one.
        """
        model = cls()
        for n, level in enumerate(levels, 1):
            key, once = level.keys, level.once
            discount = min(0.95, max(0.05, once / (once + 2 * level.twice))) if once else 0.5
            context, where = np.unique(_context(key, n), return_inverse=True)
            own = (level.counts - discount) / level.totals
            weight = np.maximum(1e-12, 1 - np.bincount(where, own))
            if n == 1:
                lower = np.full(len(key), 1 / (level.rows + 1))
                model.unseen = float(np.log(weight[0] / (level.rows + 1)))
            else:
                lower = np.exp(model.log_p(key & np.uint64((1 << (16 * (n - 1))) - 1), n - 1))
            model.grams.append(_sorted(key, np.log(own + weight[where] * lower)))
            model.contexts.append(_sorted(context, np.log(weight)))
        return model

    def log_p(self, packed: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log probability of the last symbol after the others."""
        if n == 0:
            return np.full(len(packed), self.unseen)
        key = packed & np.uint64((1 << (16 * n)) - 1) if n < ORDER else packed
        at, found = _find(self.grams[n - 1][0], key * _MIX)
        out = self.grams[n - 1][1][at]
        if not found.all():
            rest = ~found
            shorter = self.log_p(packed[rest], n - 1)
            if n > 1:
                c, known = _find(self.contexts[n - 1][0], (key[rest] >> _SYMBOL) * _MIX)
                shorter = shorter + np.where(known, self.contexts[n - 1][1][c], 0.0)
            out[rest] = shorter
        return out


def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashed = key * _MIX
    order = np.argsort(hashed)
    return hashed[order], value[order]


@dataclass
class Model:
    """All languages; sequences that any of them has seen are tabled for all."""

    langs: list[str]
    models: list[KneserNey]
    hashes: np.ndarray
    table: np.ndarray
    slope: tuple[float, float] = (50.0, 0.0)
    limits: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, counted: dict[str, list[Level]]) -> Model:
        langs = sorted(counted)
        models = [KneserNey.of_levels(counted[x]) for x in langs]
        every = np.zeros(0, np.uint64)
        if langs:
            every, n = _add([counted[x][-1].keys for x in langs], [counted[x][-1].counts for x in langs])
            every = np.sort(every[np.argsort(-n, kind="stable")[: MODEL_CELLS // len(langs)]])
        table = np.array([m.log_p(every) for m in models], np.float32).T if langs else np.zeros((0, 0), np.float32)
        hashed = every * _MIX
        order = np.argsort(hashed)
        return cls(langs, models, hashed[order], np.ascontiguousarray(table[order]) if langs else table)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language, symbols and letters by text."""
        key, text = grams(texts)
        total = np.zeros((len(texts), len(self.langs)))
        size = np.bincount(text, minlength=len(texts))
        letters = np.bincount(text[(key & np.uint64(0xFFFF)) != 32], minlength=len(texts))
        for a in range(0, len(key), _SLICE):
            part, of = key[a : a + _SLICE], text[a : a + _SLICE]
            at, found = _find(self.hashes, part * _MIX)
            logs = self.table[at]
            if not found.all():
                rest = part[~found]
                logs[~found] = np.array([m.log_p(rest) for m in self.models], np.float32).T
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[first]] += np.add.reduceat(logs, first, axis=0, dtype=np.float64)
        return -total / np.maximum(1, size)[:, None], size, letters

    def margins(self, texts: list[str]) -> list[tuple[int, float, float]]:
        """(language, its cross-entropy, evidence) of each text; language -1 without letters.

        Evidence is the lead over the next language times the square root of the length.
        """
        if not self.langs:
            return [(-1, 0.0, 0.0)] * len(texts)
        entropy, size, letters = self.entropies(texts)
        out = []
        for row, n, some in zip(entropy, size, letters, strict=True):
            if not some:
                out.append((-1, 0.0, 0.0))
                continue
            order = np.argsort(row, kind="stable")
            lead = row[order[1]] - row[order[0]] if len(row) > 1 else 1.0
            out.append((int(order[0]), float(row[order[0]]), float(lead * np.sqrt(n))))
        return out

    def predict(self, texts: list[str | None]) -> list[list]:
        rows = []
        a, b = self.slope
        for _, part in slices(texts, _SLICE):
            for lang, entropy, evidence in self.margins(part):
                if lang < 0:
                    rows.append((UNKNOWN, 0.0, None, True))
                    continue
                name = self.langs[lang]
                score = 1 / (1 + np.exp(-np.clip(a * evidence + b, -30, 30)))
                rows.append((name, float(score), entropy, bool(score < 0.5 or entropy > self.limits.get(name, np.inf))))
        return [list(x) for x in zip(*rows, strict=True)]


def _calibrate(evidence: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the confidence: logistic, with one right and one wrong case added."""
    x = np.r_[evidence, evidence.mean() if len(evidence) else 1.0, 0.0]
    y = np.r_[right.astype(float), 1.0, 0.0]
    scale = max(1e-9, np.abs(x).mean())
    z = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0] / scale)), float(w[1])


def _most_frequent(counted: DataFrame, sizes: dict[str, int], share: int | dict[str, int]) -> DataFrame:
    """The ``share`` (of all languages, or by language) most frequent sequences of each language, ties to the smaller one."""
    shares = share if isinstance(share, dict) else dict.fromkeys(sizes, share)
    if all(n <= shares[x] for x, n in sizes.items()):
        return counted
    # The cut (count, sequence) of each language, digit by digit from counts of ranges: no task sorts a language.
    left = {x: shares[x] for x, n in sizes.items() if n > shares[x]}
    some = counted.where(F.col("lang").isin(list(left)))
    cut_n, left = _cut(some, "n", left, falling=True)
    ties = some.where(F.col("n") == _of(cut_n))
    cut_gram, _ = _cut(ties, "gram", left, falling=False)
    n, gram = _of(cut_n), _of(cut_gram)
    return counted.where(n.isNull() | (F.col("n") > n) | ((F.col("n") == n) & (F.col("gram") <= gram)))


def _of(values: dict[str, int]):
    """The value of the row's language, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(y) for x in values.items() for y in x]), F.col("lang")).cast("bigint")


def _cut(rows: DataFrame, name: str, wanted: dict[str, int], falling: bool) -> tuple[dict[str, int], dict[str, int]]:
    """The value of each language's last wanted row in order of ``name``, and how many are wanted of that value."""
    prefix, left = dict.fromkeys(wanted, 0), dict(wanted)
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(name, shift)
        inside = rows if shift == 48 else rows.where(F.shiftright(name, shift + 16) == _of(prefix))
        counts: dict[str, list] = {}
        for lang, d, n in inside.groupBy("lang", digit.alias("d")).agg(F.count(F.lit(1))).collect():  # at most 65,536 a language
            counts.setdefault(lang, []).append((d, n))
        for lang, found in counts.items():
            for d, n in sorted(found, reverse=falling):
                if n >= left[lang]:
                    break
                left[lang] -= n
            prefix[lang] = d
    return prefix, left


def _by_language(rows: DataFrame) -> dict[str, tuple[np.ndarray, ...]]:
    """Sequences in order with the other columns beside them, by language."""
    out = {}
    for lang, part in rows.toPandas().groupby("lang"):
        keys = part.pop("gram").to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        out[lang] = (keys[order], *(part[c].to_numpy(np.int64)[order] for c in part.columns if c != "lang"))
    return out


def levels(counted: DataFrame, sizes: dict[str, tuple[int, int]], max_ngrams: int | None = MAX_NGRAMS) -> dict[str, list[Level]]:
    """All orders of each language, lowest first, from (lang, gram, n) of the highest.

    ``sizes`` has the rows and the sum of the counts by language. Totals of contexts, continuation
    counts and counts of one and two are of all rows. Of each order a language keeps the most
    frequent sequences, as many as its share of ``max_ngrams`` or ``GROWTH`` times the root of its
    counts, if that is more; all of them if ``max_ngrams`` is None.
    """
    if max_ngrams is None:
        return {lang: _all_levels(*x) for lang, x in _by_language(counted).items()}
    share = max(1_000, max_ngrams // max(1, len(sizes)))
    most = {x: max(share, int(GROWTH * total**0.5)) for x, (_, total) in sizes.items()}
    if all(n <= most[x] for x, (n, _) in sizes.items()):  # the lower orders follow from what is here
        return {lang: _all_levels(*x) for lang, x in _by_language(counted).items()}
    out = {x: [] for x in sizes}
    rows = counted
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            rows = cut_lineage(rows.groupBy("lang", F.col("gram").bitwiseAND((1 << (16 * n)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        figures = {
            r.lang: r
            for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
        }
        context = F.shiftrightunsigned("gram", 16).alias("context") if n > 1 else F.lit(0).cast("bigint").alias("context")
        kept = cut_lineage(_most_frequent(rows, {x: r["size"] for x, r in figures.items()}, most).select("lang", "gram", "n", context))
        # One row a context on either side.
        wanted = kept.select("lang", "context").distinct()
        totals = rows.select("lang", context, "n").groupBy("lang", "context").agg(F.sum("n").alias("total")).join(wanted, ["lang", "context"], "left_semi")
        total_of = _by_language(totals.withColumnRenamed("context", "gram"))
        for lang, (keys, counts) in _by_language(kept.drop("context")).items():
            at, total = total_of[lang]
            r = figures[lang]
            out[lang].insert(0, Level(keys, counts, total[np.searchsorted(at, _context(keys, n))], r.once, r.twice, r["size"]))
    return out


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_ngrams: int | None = MAX_NGRAMS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> Model:
    """Learn from all rows that are not held out and have a text and a language.

    Counts, discounts and totals cover all of them; see ``levels`` for the sequences that are kept.
    """
    train = docs.where(~held_out(id_col))
    counted = count_grams(train, text_col, lang_col).persist()
    try:
        sizes = {r.lang: (r[1], r[2]) for r in counted.groupBy("lang").agg(F.count(F.lit(1)), F.sum("n")).collect()}
        model = Model.of(levels(counted, sizes, max_ngrams))
    finally:
        counted.unpersist()
    known = train.where(col(text_col).isNotNull() & col(lang_col).isNotNull())
    n = known.count()
    if not model.langs or not n:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = known.where(drawn(id_col, calibration_rows, n))
    added = T.StructType(
        [T.StructField("__l", T.IntegerType()), T.StructField("__e", T.DoubleType()), T.StructField("__m", T.DoubleType())]
    )

    def measured():
        own = shared.value
        return lambda texts: [list(x) for x in zip(*(r for _, p in slices(texts, _SLICE) for r in own.margins(p)), strict=True)]

    part = part.select(col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"))
    got = [r for r in map_texts(part, "text", ["lang"], added, measured).collect() if r[1] >= 0]
    right = np.array([model.langs[r[1]] == r[0] for r in got], bool)
    model.slope = _calibrate(np.array([r[3] for r in got]), right)
    for i, lang in enumerate(model.langs):
        own = np.array([r[2] for r, ok in zip(got, right, strict=True) if r[1] == i and ok])
        if len(own) > 1:
            model.limits[lang] = float(own.mean() + REJECT_DEVIATIONS * max(0.05, own.std()))
    return model


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and lang_pred, score, cross_entropy, rejected of every whole text.

    A null text and one without letters get ``und``, score 0, no cross-entropy, and are rejected;
    so does every text if there was nothing to learn from. Repeated rows get the same; an empty
    table gives an empty one; kept columns that clash with a result are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text_col, keep, PREDICTED, lambda: shared.value.predict)


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(id, held_out, lang_pred, score, cross_entropy, rejected) of every row; a null id is not held out."""
    model = fit(docs, id_col, text_col, lang_col, **options)
    got = predict(docs, model, [id_col], text_col)
    return got.select(col(id_col), held_out(id_col).alias("held_out"), *[f.name for f in PREDICTED.fields])
