"""Benchmark decontamination by random-walk embedding and bit-sampling search.

Texts and items are sequences of normalised words. The walk of Chakraborty, Goldenberg and Koucky
reads a sequence through a pointer that a random function of step and word moves on or not; two
sequences that share their randomness fall into step again after an edit, so edit distance becomes
Hamming distance of the walks. Each repetition draws the walk anew and samples some of its steps;
a window of a text is a candidate if its sampled words, and how far the pointer went, equal those
of an item's window. The windows of an item begin at places spread over it, shifted from one
repetition to the next, so an edit at one place spoils few of them, and there are as many
repetitions as the target recall asks for. Candidates are verified by exact edit distance in
a window of the item's size.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import col, map_texts, slices

MAX_EDIT_RATE = 0.2  # word edits over words of the item
TARGET_RECALL = 0.99  # of passages with that many edits, wherever they lie
ANCHORS = 12  # windows of an item in one repetition
CHUNK_CHARACTERS = 8 << 20  # of items held by every task at once
CACHE_ENTRIES = 250_000

HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("item_words", T.IntegerType()),
            T.StructField("start_word", T.IntegerType()),
            T.StructField("end_word", T.IntegerType()),
        ]
    )
)

_ASCII = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_PUNCTUATION = re.compile("[ -©«-±´-¸»¿ -⁯⸀-⹿　-〿]")


class WordHashes(dict):
    """64-bit hashes of words as bytes; never zero, which stands for the end of a text."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        got = (xxhash.xxh64_intdigest(word) | 1).to_bytes(8, "little")
        if len(self) < CACHE_ENTRIES:
            self[word] = got
        return got

    def of(self, text: str | None) -> bytes:
        """Lower case, punctuation as spaces, hashes of the words in a row."""
        low = (text or "").lower()
        if not low.isascii():
            low = _PUNCTUATION.sub(" ", low)
        return b"".join(map(self.__getitem__, low.encode().translate(_ASCII).split()))


@dataclass(frozen=True)
class Walks:
    """How items from ``least`` words on are walked: steps, how many are sampled, and the words that a walk may span."""

    least: int
    steps: int
    samples: int
    low: int
    high: int


#: Long spans ask for many words without an edit, short ones find too much by chance.
CLASSES = (Walks(12, 8, 4, 3, 5), Walks(5, 5, 3, 2, 3), Walks(2, 3, 2, 2, 2), Walks(1, 1, 1, 1, 1))


def repetitions(walks: Walks, words: int, rate: float, recall: float) -> int:
    """So many that a passage of ``words`` words with edits at the full rate turns up with the target recall.

    A window is found if no edit lies in it. Windows of one item overlap, so only every
    third counts as a draw of its own.
    """
    edits = int(words * rate)
    if not edits:
        return 2
    clear = (1 - edits / words) ** ((walks.low + walks.high) / 2)
    own = max(1.0, min(ANCHORS, words - walks.low + 1) / 3)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - clear) / own))


_MORE_DRAWS = 32


@dataclass
class Repetition:
    """One draw of the walk, with the sampled words of all items of a class."""

    sampled: list[int]
    factor: np.uint64  # the word's random bits come from the high end of hash times factor
    seen: list[np.ndarray]  # for each sampled step: may a word with these 16 bits be right
    keys: np.ndarray
    items: np.ndarray
    offsets: np.ndarray


def _mix(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word


def _moves(words: np.ndarray, step: int, factor: np.uint64) -> np.ndarray:
    """Does the pointer move after this step; at the end of a text (zero) it never does."""
    return ((words * factor) >> np.uint64(63 - step)) & np.uint64(1) != 0


class Index:
    """Items by their sampled walks, for windows of any text."""

    def __init__(self, items: Sequence[tuple[int, str | None]], rate: float, recall: float = TARGET_RECALL, seed: int = 7):
        hashes = WordHashes()
        self.rate = rate
        self.ids, self.words = [], []
        for item_id, text in items:
            words = np.frombuffer(hashes.of(text), np.uint64)
            if len(words):
                self.ids.append(item_id)
                self.words.append(words)
        draw = random.Random(seed)
        self.runs: list[Repetition] = []
        most = math.inf
        for walks in CLASSES:
            chosen = [i for i, w in enumerate(self.words) if walks.least <= len(w) < most]
            most = walks.least
            asked = [repetitions(walks, len(self.words[i]), rate, recall) for i in chosen]
            for r in range(max(asked, default=0)):
                self.runs.append(self._repetition([i for i, n in zip(chosen, asked, strict=True) if r < n], walks, r, draw))
            # An item that no walk has suited yet gets more of them, so that its exact copies are found.
            for r in range(_MORE_DRAWS):
                chosen = sorted(set(chosen) - {int(i) for run in self.runs for i in run.items})
                if not chosen:
                    break
                self.runs.append(self._repetition(chosen, walks if r < _MORE_DRAWS - 1 else CLASSES[-1], r, draw))

    def _repetition(self, chosen, walks: Walks, number: int, draw) -> Repetition:
        # The first step and one from each equal part of the rest.
        edges = [1 + (walks.steps - 1) * i // max(1, walks.samples - 1) for i in range(walks.samples)]
        sampled = [0, *(draw.randrange(a, b) for a, b in zip(edges, edges[1:], strict=False))]
        factor = np.uint64(draw.getrandbits(64) | 1)
        starts = np.cumsum([0, *(len(self.words[i]) + 1 for i in chosen)])
        text = np.concatenate([x for i in chosen for x in (self.words[i], np.zeros(1, np.uint64))])
        items, offsets, at = [], [], []
        for i, start in zip(chosen, starts, strict=False):
            places = len(self.words[i]) - walks.low + 1
            for o in sorted({(k * places // ANCHORS + number * 7) % places for k in range(ANCHORS)}):
                items.append(i)
                offsets.append(o)
                at.append(start + o)
        at = np.array(at, np.int64)
        walk, pointer = _walk(text, at, sampled, factor)
        span = pointer - at + 1
        # A walk that reads too few words finds too much; one that reads many, or beyond the item, is spoilt by edits.
        good = (span >= walks.low) & (span <= walks.high) & (text[pointer] != 0)
        walk, span = [w[good] for w in walk], span[good]
        seen = []
        for words in walk:
            table = np.zeros(1 << 16, bool)
            table[(words >> np.uint64(48)).astype(np.uint16)] = True
            seen.append(table)
        keys = span.astype(np.uint64)
        for words in walk:
            keys = _mix(keys, words)
        order = np.argsort(keys, kind="stable")
        return Repetition(sampled, factor, seen, keys[order], np.array(items, np.int64)[good][order], np.array(offsets, np.int64)[good][order])

    def candidates(self, text: np.ndarray):
        """(item, place of the item's first word, place of its window) for windows at every word of a text."""
        high = (text >> np.uint64(48)).astype(np.uint16)
        for run in self.runs:
            at = np.nonzero(run.seen[0][high] & (text != 0))[0]
            words = [text[at]]
            pointer, step = at, 0
            for place, table in zip(run.sampled[1:], run.seen[1:], strict=True):
                while step < place:
                    pointer = pointer + _moves(text[pointer], step, run.factor)
                    step += 1
                keep = table[high[pointer]]
                at, pointer, words = at[keep], pointer[keep], [w[keep] for w in words]
                words.append(text[pointer])
            key = (pointer - at + 1).astype(np.uint64)
            for w in words:
                key = _mix(key, w)
            low = np.searchsorted(run.keys, key, "left")
            hit = np.nonzero((low < len(run.keys)) & (run.keys[np.minimum(low, len(run.keys) - 1)] == key))[0] if len(run.keys) else []
            for i in hit:
                for j in range(low[i], np.searchsorted(run.keys, key[i], "right")):
                    yield int(run.items[j]), int(at[i] - run.offsets[j]), int(at[i])

    def hits(self, text: np.ndarray, bounds: list[int]) -> dict[int, list[tuple]]:
        """Verified items by text number; ``bounds`` are the places where texts begin in ``text``."""
        near: dict[tuple[int, int], set[int]] = {}
        for item, at, window in self.candidates(text):
            near.setdefault((bisect_right(bounds, window) - 1, item), set()).add(at)
        out: dict[int, list[tuple]] = {}
        for (t, item), places in near.items():
            words, end = self.words[item], bounds[t + 1] - 1 if t + 1 < len(bounds) else len(text) - 1
            most = int(len(words) * self.rate)
            windows: list[list[int]] = []
            for at in sorted(places):
                low, top = max(bounds[t], at - most - 1), min(end, at + len(words) + most + 1)
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], top)
                else:
                    windows.append([low, top])
            best = None
            for low, top in windows:
                # Words of the item that no edit touches are in the window.
                if np.isin(text[low:top], words).sum() < len(words) - most:
                    continue
                got = nearest(words, text[low:top])
                if got and got[0] <= most and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1], low + got[2])
            if best:
                row = (self.ids[item], best[0], len(words), best[1] - bounds[t], best[2] - bounds[t])
                out.setdefault(t, []).append(row)
        return {t: sorted(rows) for t, rows in out.items()}


def _walk(text, at, sampled, factor) -> tuple[list[np.ndarray], np.ndarray]:
    """(words at the sampled steps, places of the last one)."""
    pointer, step, out = at.copy(), 0, []
    for place in sampled:
        while step < place:
            pointer = pointer + _moves(text[pointer], step, factor)
            step += 1
        out.append(text[pointer])
    return out, pointer


def _best_end(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end) of the stretch of the text nearest to the pattern, its start free.

    Bit-parallel: bit i of ``up`` and ``down`` says that row i + 1 of the edit table is one more or
    one less than row i.
    """
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score = full, 0, n
    best = (n, 0)
    for j, w in enumerate(text):
        same = where.get(w, 0)
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        more = (down | ~(diagonal | up)) & full
        less = up & diagonal
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1) & full, (less << 1) & full
        up = (less | ~(diagonal | more)) & full
        down = more & diagonal
        if score < best[0]:
            best = (score, j + 1)
    return best


def nearest(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch nearest to the pattern, the first such end."""
    p, t = pattern.tolist(), text.tolist()
    if not p or not t:
        return None
    distance, end = _best_end(p, t)
    _, length = _best_end(p[::-1], t[:end][::-1]) if end else (0, 0)
    return distance, end - length, end


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: Sequence[str],
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = MAX_EDIT_RATE,
    recall: float = TARGET_RECALL,
    chunk_characters: int = CHUNK_CHARACTERS,
) -> DataFrame:
    """``keep`` and ``hits``: the benchmark items that a text holds with few word edits.

    An item of n words counts where a stretch of the text is within ``rate * n`` word edits, rounded
    down. ``recall`` is the share of such stretches, with edits at the full rate, that the search
    aims for; those with fewer edits are found more surely, exact copies always. Of several places
    found the nearest counts. Words are compared in lower case without
    punctuation. Items travel to the tasks in chunks of a bounded size, one pass over the texts
    each. Null or empty texts and items without words have no hits; repeated rows get the same;
    empty tables give empty ones. Kept columns named ``hits`` are left out.
    """
    items = benchmark.select(col(item_id_col).cast("bigint").alias("item"), col(item_text_col).cast("string").alias("text"))
    items = items.where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_characters))
    kept = [c for c in keep if c.lower() != "hits"]
    out = docs
    for k in range(chunks):
        chunk = items if chunks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == k)
        index = Index([(r.item, r.text) for r in chunk.orderBy("item", "text").collect()], rate, recall)
        shared = docs.sparkSession.sparkContext.broadcast(index)
        name = f"__hits{k}"

        def make(shared=shared):
            own, hashes = shared.value, WordHashes()

            def work(texts):
                found = [[] for _ in texts]
                for start, run in slices(texts):
                    parts, bounds, at = [], [], 0
                    for t in run:
                        words = hashes.of(t)
                        parts += [words, bytes(8)]
                        bounds.append(at)
                        at += len(words) // 8 + 1
                    for t, rows in own.hits(np.frombuffer(b"".join(parts), np.uint64), bounds).items():
                        found[start + t] = rows
                    if len(hashes) >= CACHE_ENTRIES:
                        hashes.clear()
                return [found]

            return work

        inner = list(dict.fromkeys([*kept, text_col, *[f"__hits{i}" for i in range(k)]])) if chunks > 1 else kept
        out = map_texts(out, text_col, inner, T.StructType([T.StructField(name, HITS)]), make)
    hits = F.concat(*[F.col(f"__hits{k}") for k in range(chunks)]) if chunks > 1 else F.col("__hits0")
    return out.select(*[col(c) for c in kept], hits.alias("hits"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row for each document and benchmark item that it holds; see ``with_hits``."""
    return with_hits(docs, benchmark, [id_col], **options).select(col(id_col), F.inline("hits"))
