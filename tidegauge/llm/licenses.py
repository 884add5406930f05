"""License mentions: exact phrases, and short notices with a few typing errors.

A phrase of which at most ``k`` characters may be wrong is cut into ``k + 1`` seeds; wherever it
stands, at least one seed stands unchanged (pigeonhole). The seeds are searched exactly; only the
surroundings of a hit are given to the regex library's bounded-error matching.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegauge.llm.common import map_texts

# Phrases and the labels they stand for.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further short notices, searched with errors only.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
}
CHARACTERS_PER_ERROR = 8  # of a phrase, rounded down: "mit license" may have one

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("errors", T.IntegerType()),
                    ]
                )
            ),
        ),
    ]
)

# Everything but digits, small letters and what is outside ASCII becomes a space.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Fuzzy:
    """A phrase with its bounded-error pattern and seeds."""

    label: str
    size: int
    errors: int
    seeds: tuple[tuple[bytes, int], ...]  # with their places in the phrase
    pattern: regex.Pattern

    @classmethod
    def of(cls, phrase: str, label: str, errors: int) -> Fuzzy:
        raw = phrase.encode()
        cuts = [len(raw) * i // (errors + 1) for i in range(errors + 2)]
        seeds = tuple((raw[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False))
        # Words as a whole: the match begins and ends at a space.
        pattern = regex.compile(rb"(?b)(?<= )(?:" + regex.escape(raw) + b"){e<=%d}(?= )" % errors)
        return cls(label, len(raw), errors, seeds, pattern)

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, errors) in a text of words between single spaces, in order.

        Of all that match the ones with the fewest errors come first, of equals the earliest; what
        overlaps one of them is out. Only windows of bounded length around the seeds are searched.
        """
        open_ = sorted({p for seed, at in self.seeds for p in _places(text, seed, at)})
        taken: list[tuple[int, int, int]] = []
        while open_:
            found, more = set(), []
            for p in open_:
                low, high = max(0, p - self.errors - 2), min(len(text), p + self.size + 2 * self.errors + 2)
                # Matches that count already bound the window; one in its midst ends the search there.
                i = bisect_right(taken, (p + self.size // 2,))
                if i:
                    low = max(low, taken[i - 1][1])
                if i < len(taken):
                    high = min(high, taken[i][0])
                m = self.pattern.search(text, low, high) if high - low > self.size - self.errors else None
                if m:
                    found.add((sum(m.fuzzy_counts), m.start(), m.end()))
                    more.append(p)
            for errors, start, end in sorted(found):
                i = bisect_right(taken, (start,))
                if (not i or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                    insort(taken, (start, end, errors))
            open_ = more
        return taken


def _places(text: bytes, seed: bytes, shift: int):
    at = text.find(seed)
    while at >= 0:
        yield at - shift
        at = text.find(seed, at + 1)


def _fuzzy(phrases: dict[str, str], per_error: int) -> list[Fuzzy]:
    return [Fuzzy.of(p, label, len(p.encode()) // per_error) for p, label in phrases.items()]


def scan(text: str | None, base, exact, fuzzy) -> tuple:
    """One text: the row of FOUND. Spans are in words; equal ones with fewer errors win."""
    # Lower-casing bytes touches A-Z only.
    words = b" " + b" ".join((text or "").encode().lower().translate(_WORD_BYTES).split()) + b" "
    n_words = words.count(b" ") - 1 if len(words) > 2 else 0
    if not exact.search(words) and not any(s in words for f in fuzzy for s, _ in f.seeds):
        return n_words, 0, None, None, "", "", 0.0, []
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)
    word_at = lambda p: int(np.searchsorted(gaps, p, "right"))  # noqa: E731  words that start up to p, the gap included
    starts, labels, best = [], set(), 0.0
    spans: dict[tuple[str, int, int], int] = {}
    for phrase, label, size in base:
        at = words.find(phrase)
        while at >= 0:
            first = word_at(at) - 1
            starts.append(first)
            labels.add(label)
            spans[label, first, first + size] = 0
            at = words.find(phrase, at + 1)
    for f in fuzzy:
        for a, b, errors in f.matches(words):
            first, end = word_at(a - 1) - 1, word_at(b) - 1
            key = (f.label, first, end)
            spans[key] = min(errors, spans.get(key, errors))
            best = max(best, 1 - errors / f.size)
    best = 1.0 if starts else best
    nearest: dict[tuple[int, int], int] = {}  # of phrases that fit the same words the closest ones count
    for (_, a, b), e in spans.items():
        nearest[a, b] = min(e, nearest.get((a, b), e))
    spans = {k: e for k, e in spans.items() if e == nearest[k[1], k[2]]}
    listed = [(label, a, b, e) for (label, a, b), e in sorted(spans.items(), key=lambda x: (x[0][1], x[0][2], x[0][0]))]
    every = sorted(labels | {s[0] for s in listed})
    return (
        n_words, len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(labels)), ",".join(every), best, listed,
    )


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base_phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    characters_per_error: int = CHARACTERS_PER_ERROR,
) -> DataFrame:
    """License labels of every whole text, with the spans in words that show them.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` come from phrases that stand
    word for word; ``labels`` and ``spans`` also from phrases and notices with one error for each
    ``characters_per_error`` characters at most, at word boundaries. Of several that fit the same
    words those with the fewest errors count. ``score`` is 1 for a phrase word for word, else the
    largest share of right characters of a match, else 0. A null or empty text has no words,
    labels or spans; null ids and repeated rows are kept; an empty table gives an empty one; other
    columns, whatever their names, are ignored.
    """
    phrases = BASE_PHRASES if base_phrases is None else base_phrases
    extra = NOTICES if notices is None else notices

    def make():
        base = [(b" " + p.encode() + b" ", label, p.count(" ") + 1) for p, label in phrases.items()]
        exact = re.compile(b"|".join(re.escape(p) for p, _, _ in base) or b"(?!)")
        fuzzy = [f for f in _fuzzy(phrases | extra, characters_per_error) if f.errors]
        return lambda texts: [list(x) for x in zip(*(scan(t, base, exact, fuzzy) for t in texts), strict=True)]

    return map_texts(docs, text_col, [id_col], FOUND, make)
