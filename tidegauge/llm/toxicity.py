"""Toxicity from a learned lexicon, found with spelling errors and weighed by context.

Terms are words and word beginnings that mark labelled texts. They form a trie; Levenshtein
automata intersected with it, made deterministic as far as texts need it, read a word and end in
the terms within its edit budget. Every hit is weighed by its evidence and by a window of words
around it: quotation marks and verbs of reporting stand for quotation, address of a person for
abuse. A logistic model on a few sums of such weights gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import col, cut_lineage, drawn, held_out, map_texts, slices

MAX_TERMS = 2_000
MIN_SUPPORT = 5  # toxic training texts with a term
MIN_LOG_ODDS = 1.5
STEM_LENGTHS = (4, 5, 6)  # letters of word beginnings that may be terms
ERRORS = ((9, 2), (4, 1))  # letters of a term from, edits it may have; two neighbours that change places are one
LABEL_ROWS = 200_000  # labelled training rows learned from at most, drawn by hash of the id if there are more
FIT_ROWS = 50_000  # of these, rows that the few coefficients of the logistic model are fitted on
SKETCH_WORDS = 2  # smallest word hashes by which copies are known
WINDOW = 8  # words on either side
CACHE_WORDS = 200_000
WANTED_UNITS = 200_000  # units that travel to the tasks; if there are more, clean texts give all of theirs

# Marks of quotation and of address.
QUOTES = "\"“”„«»‘’'`"
REPORTING = frozenset(
    "said says say quote quoted quotes called calling word term wrote writes reported according "
    "dijo dice palabra citado llamado dit parole mot cité appelé sagte sagt wort zitat nannte".split()
)
ADDRESS = frozenset("you your you're u ur yourself tu te ton usted tú vous votre toi du dich dein ihr sie".split())

_WORD = re.compile(r"[^\W_]+")
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[str]:
    """Lower-cased words of letters and digits of any script, in order."""
    low = text.lower()
    if low.isascii():
        return low.encode().translate(_LETTERS).decode().split()
    return _WORD.findall(low)


def edits(term: str) -> int:
    return next((e for n, e in ERRORS if len(term) >= n), 0)


class Automaton:
    """The trie of all terms run against Levenshtein automata of their edit budgets.

    A state holds the cost of each node it may be at. A pair of a node and a letter waits for that
    letter: the one before it came too early.
    """

    DEAD = -1

    def __init__(self, terms: list[str], budget=edits):
        self.children: list[dict[str, int]] = [{}]
        self.terms: list[str | None] = [None]
        self.most = [0]  # largest budget of the terms below
        for term in sorted(set(terms)):
            node, allowed = 0, budget(term)
            self.most[0] = max(self.most[0], allowed)
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.terms.append(None)
                    self.most.append(0)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], allowed)
            self.terms[node] = term
        self.budget = {t: budget(t) for t in terms}
        self.states: list[dict[int, int]] = []
        self.numbers: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, cost: dict) -> int:
        todo = [n for n in cost if not isinstance(n, tuple)]
        while todo:  # letters of the term that the word leaves out
            node = todo.pop()
            for child in self.children[node].values():
                c = cost[node] + 1
                if c <= self.most[child] and c < cost.get(child, 99):
                    cost[child] = c
                    todo.append(child)
        if not cost:
            return self.DEAD
        key = frozenset(cost.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(dict(key))
            self.moves.append({})
        return self.numbers[key]

    def _step(self, state: int, ch: str) -> int:
        cost: dict = {}

        def reach(node, c, at=None):
            if c <= self.most[node if at is None else at] and c < cost.get(node, 99):
                cost[node] = c

        for node, c in self.states[state].items():
            if isinstance(node, tuple):
                if node[1] == ch:
                    reach(node[0], c)
                continue
            reach(node, c + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, c if letter == ch else c + 1)
                after = self.children[child].get(ch)
                if after is not None and letter != ch:
                    reach((after, letter), c + 1, after)
        self.moves[state][ch] = got = self._state(cost)
        return got

    def find(self, word: str) -> list[tuple[str, int]]:
        """(term, edits) of all terms within their budgets."""
        state, moves = self.start, self.moves
        for ch in word:
            if state < 0:
                return []
            after = moves[state].get(ch)
            state = self._step(state, ch) if after is None else after
        if state < 0:
            return []
        ends = [(self.terms[n], c) for n, c in self.states[state].items() if not isinstance(n, tuple) and self.terms[n] is not None]
        return sorted(((t, c) for t, c in ends if c <= self.budget[t]), key=lambda x: (x[1], x[0]))


@dataclass
class Lexicon:
    """Weights of words, of beginnings and of misspellings seen in labelled texts."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    spelled: dict[str, float] = field(default_factory=dict)  # misspellings known from training texts
    coefficients: tuple[float, ...] = (-2.2,)

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Looks words up; answers are cached per worker."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = Automaton([w for w in lexicon.words if edits(w)])
        self.known: dict[str, tuple[float, bool] | None] = {}
        self.marked: set[str] = set()

    def weigh(self, word: str) -> tuple[float, bool] | None:
        """(weight, spelled as the term is) of the best term that the word stands for."""
        lex = self.lexicon
        best = max([lex.words.get(word, 0.0), *(lex.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if len(word) >= n)])
        if best > 0:
            return best, True
        if word in lex.spelled:
            got = lex.spelled[word]
            return (got, False) if got > 0 else None
        found = self.automaton.find(word)
        if not found:
            return None
        return max(lex.words[t] * (0.75**e) for t, e in found), False

    def learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.marked.clear()
        for w in set(words).difference(self.known):
            got = self.known[w] = self.weigh(w)
            if got:
                self.marked.add(w)

    def hits(self, text: str) -> tuple[list[tuple[str, float, bool, float]], int]:
        """(word, weight, exact, context) of every hit, and the number of words.

        Context is from 0, quotation, to 1, abuse; 0.5 without a sign of either.
        """
        words = words_of(text)
        self.learn(words)
        marked = self.marked
        if marked.isdisjoint(words):
            return [], len(words)
        low = text.lower()
        places = list(_WORD.finditer(low)) if any(q in low for q in QUOTES) else []
        out = []
        for i in [i for i, w in enumerate(words) if w in marked]:
            weight, exact = self.known[words[i]]
            around = set(words[max(0, i - WINDOW) : i + WINDOW + 1])
            quoted = False
            if places:
                first, last = places[max(0, i - WINDOW)].start(), places[min(len(places), i + WINDOW + 1) - 1].end()
                before, after = low[first : places[i].start()], low[places[i].end() : last]
                quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
            context = 0.5 - 0.25 * quoted - 0.25 * (not around.isdisjoint(REPORTING)) + 0.25 * (not around.isdisjoint(ADDRESS))
            out.append((words[i], weight, exact, min(1.0, max(0.0, context))))
        return out, len(words)


FEATURES = 6


def features(reader: Reader, text: str | None) -> list[float]:
    """Sums that the logistic model weighs; all zero for a text without hits."""
    hits, n = reader.hits(text or "")
    if not hits:
        return [0.0] * FEATURES
    exact, wrong, quoted = {}, {}, 0.0
    for word, weight, spelled, context in hits:
        side = exact if spelled else wrong
        side[word] = max(side.get(word, 0.0), weight * min(1.0, 0.5 + context))
        quoted += context < 0.5
    return [
        min(12.0, sum(exact.values())),
        min(12.0, sum(wrong.values())),
        max([0.0, *exact.values()]),
        math.log1p(sum(exact.values()) + sum(wrong.values())),
        math.log1p(100.0 * sum(w for _, w, _, _ in hits) / max(20, n)),
        quoted / len(hits),
    ]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Newton steps with a ridge penalty; coefficients of sums of evidence are kept non-negative."""
    z = np.hstack([np.ones((len(x), 1)), x])
    free = np.ones(z.shape[1], bool)
    penalty = np.full(z.shape[1], ridge)
    penalty[0] = 1e-6
    b = np.zeros(z.shape[1])
    for _ in range(z.shape[1]):
        b[~free] = 0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            g = z.T @ (y - p) - penalty * b
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.zeros_like(b)
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        wrong = free & (b < 0)
        wrong[0] = wrong[FEATURES] = False  # the base rate, and the share of quotations
        if not wrong.any():
            break
        free &= ~wrong
    return tuple(float(v) for v in b)


def _units(words: set[str]) -> set[tuple[str, str]]:
    return {("w", w) for w in words if len(w) > 2} | {
        ("s", w[:n]) for n in STEM_LENGTHS for w in words if len(w) >= n
    }


_COUNT = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("toxic", T.IntegerType()), T.StructField("n", T.LongType())]
)


def _count(rows: DataFrame, make_units) -> DataFrame:
    """(kind, unit, toxic, n): labelled texts that hold a unit, added up in the tasks first."""

    def run(batches):
        import pyarrow as pa

        units, seen = make_units(), Counter()

        def flush():
            keys = list(seen)
            arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                      pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(arrays, _COUNT.names)

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, unit in units(text or ""):
                    seen[kind, unit, toxic] += 1
                if len(seen) > 500_000:
                    yield flush()
        if seen:
            yield flush()

    return rows.select("text", "toxic").mapInArrow(run, _COUNT).groupBy("kind", "unit", "toxic").agg(F.sum("n").alias("n"))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(id, text, toxic) of labelled rows that are not held out; the labels are bounded and travel, not the texts."""
    marks = labels.where(~held_out(id_col)).select(col(id_col).alias("id"), col(label_col).cast("int").alias("toxic"))
    # Of labels that contradict each other the toxic one counts.
    marks = cut_lineage(marks.where("toxic in (0, 1) and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic")))
    n = marks.count()
    marks = marks.where(drawn("id", most, n))
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(marks), "id")


def _one_of_copies(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """One row of the copies, and most near copies, of a text with one label: those with the same smallest word hashes.

    A term is evidence if different texts hold it; a text that was copied a thousand times shows its words once.
    Only hashes and row numbers (``at``) are shuffled; the numbers of the rows that stay are as bounded as the
    labels and travel, so that the texts lie where they are. Also the number of rows that stay, by label.
    """
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    sketch = F.slice(F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))), 1, SKETCH_WORDS)
    keys = rows.select("toxic", sketch.alias("sketch"), F.struct("id", F.xxhash64("text").alias("hash"), "at").alias("r"))
    least = cut_lineage(keys.groupBy("toxic", "sketch").agg(F.min("r").alias("r")).select("toxic", "r.at"))
    return rows.join(F.broadcast(least.select("at")), "at", "left_semi"), dict(least.groupBy("toxic").count().collect())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_terms: int = MAX_TERMS,
    label_rows: int = LABEL_ROWS,
    fit_rows: int = FIT_ROWS,
) -> Lexicon:
    """Learn terms and model from labelled texts that are not held out.

    Terms are counted over all different texts learned from: units of toxic texts with enough
    support, the same units in the others, and misspellings of the chosen ones that clean texts hold
    too. ``label_rows`` bounds the labelled rows, and with them the misspellings, ``max_terms`` the
    terms, ``fit_rows`` the rows that the few coefficients are fitted on.
    """
    spark = docs.sparkSession
    rows = cut_lineage(_labelled(docs, labels, id_col, text_col, label_col, label_rows).withColumn("at", F.monotonically_increasing_id()))
    sizes = dict(rows.groupBy("toxic").count().collect())
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon(coefficients=(math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -2.2, *[0.0] * FEATURES))
    labelled, all_rows = rows, n1 + n0
    rows, sizes = _one_of_copies(rows)
    n1, n0 = sizes[1], sizes[0]
    ones = _count(rows.where("toxic = 1"), lambda: lambda text: _units(set(words_of(text)))).where(F.col("n") >= MIN_SUPPORT)
    ones = cut_lineage(ones.select("kind", "unit", F.col("n").alias("a")))
    odds = lambda a, b: F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    # Evidence that a chance surplus would not give: five standard errors of the log odds.
    error = lambda a, b: F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    a, b = F.col("a"), F.col("b")
    none = F.lit(0)
    # Units too rare to be sure even if no clean text holds them need no count in clean texts.
    ones = ones.where((odds(a, none) >= MIN_LOG_ODDS) & (odds(a, none) >= 2 * error(a, none)))
    few = [(r.kind, r.unit) for r in ones.select("kind", "unit").limit(WANTED_UNITS + 1).collect()]
    wanted = spark.sparkContext.broadcast(frozenset(few) if len(few) <= WANTED_UNITS else None)

    def clean_units():
        known = wanted.value
        return lambda text: _units(set(words_of(text))) & known if known is not None else _units(set(words_of(text)))

    zeros = _count(rows.where("toxic = 0"), clean_units).select("kind", "unit", F.col("n").alias("b"))
    both = ones.join(zeros, ["kind", "unit"], "left").withColumn("b", F.coalesce(b, none)).withColumn("w", odds(a, b))
    sure = both.where((F.col("w") >= MIN_LOG_ODDS) & (F.col("w") >= F.when(b > 0, 5).otherwise(2) * error(a, b)))
    lexicon = Lexicon()
    for r in sure.orderBy(F.desc(F.col("w") * F.sqrt(a)), "kind", "unit").limit(max_terms).collect():
        (lexicon.words if r.kind == "w" else lexicon.stems)[r.unit] = r.w
    # A beginning within a stronger one, or a word that has one, says nothing new.
    shared = spark.sparkContext.broadcast(lexicon)

    def misspelled():
        reader = shared.value.reader()

        def units(text):
            words = words_of(text)
            reader.learn(words)
            return {("m", w) for w in reader.marked.intersection(words) if not reader.known[w][1]}

        return units

    seen: dict[str, list[int]] = {}
    found = _count(rows, misspelled).groupBy("unit").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    for r in found.where("b > 0").collect():  # of others the guess stands, as for any new one
        seen[r.unit] = [r.a, r.b]
    reader = lexicon.reader()
    for word, (a, b) in seen.items():
        guess = reader.weigh(word)[0]
        evidence = math.log((a + 1) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        lexicon.spelled[word] = max(0.0, min(guess, evidence - 2 / math.sqrt(a + b)))
    shared = spark.sparkContext.broadcast(lexicon)
    part = labelled.where(drawn("id", fit_rows, all_rows, seed=1))
    wide = T.StructType([T.StructField("f", T.ArrayType(T.DoubleType()))])

    def measured():
        reader = shared.value.reader()
        return lambda texts: [[features(reader, t) for t in texts]]

    got = map_texts(part, "text", ["toxic"], wide, measured).collect()
    x, y = np.array([r.f for r in got]).reshape(-1, FEATURES), np.array([r.toxic for r in got], float)
    lexicon.coefficients = _logistic(x, y)
    return lexicon


def score(
    docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str = "text", score_col: str = "score", label_col: str = "predicted"
) -> DataFrame:
    """``keep`` and the score from 0 to 1 of every whole text, with 1 from 0.5 on.

    A null or empty text has no hits and gets the base score of such texts. Repeated rows get the
    same; an empty table gives an empty one; kept columns that clash with a result are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    added = T.StructType([T.StructField(score_col, T.DoubleType()), T.StructField(label_col, T.IntegerType())])

    def make():
        reader, b = shared.value.reader(), np.array(shared.value.coefficients)

        def work(texts):
            rows = [features(reader, t) for _, run in slices(texts) for t in run]
            z = b[0] + np.array(rows).reshape(-1, FEATURES) @ b[1:] if len(b) > 1 else np.full(len(rows), b[0])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            return [p.tolist(), (p >= 0.5).astype(int).tolist()]

        return work

    return map_texts(docs, text_col, keep, added, make)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """(id, held_out, score, predicted) of every row; see ``fit`` and ``score``.

    A null id is not held out and cannot be labelled. Without labels of both kinds every text gets
    the same score. Columns other than id, text and the label are ignored.
    """
    lexicon = fit(docs, labels, id_col, text_col, **options)
    scored = score(docs, lexicon, [id_col], text_col)
    return scored.select(col(id_col), held_out(id_col).alias("held_out"), "score", "predicted")
