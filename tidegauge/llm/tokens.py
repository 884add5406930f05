"""Token counts of whole texts with a byte-level pair-merge vocabulary.

Two tiers answer how many tokens a pre-token has. The first is a table of the corpus's frequent
words, sent to every task; the second is a cache in each Python worker, which the tokenizer
library fills on a miss. Pre-tokens are never shuffled: to find the frequent words each task
keeps a Misra-Gries summary of bounded size, and only the heads of these summaries are added up.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import col, map_texts, slices

TABLE_ENTRIES = 32_768  # first tier
SUMMARY_ENTRIES = 65_536  # held by a task while it counts
HEAD_ENTRIES = 2_048  # sent on by a task
CACHE_ENTRIES = 1_000_000  # second tier, per Python worker
CACHED_LENGTH = 64  # longer pre-tokens are encoded each time

# The split of byte-level pre-tokenizers, for the characters that SURE allows.
PATTERN = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Characters that Python and the tokenizer library class alike (a test compares them one by one);
# a text with any other goes to the library whole.
SURE = "\t-\r\x20-±´-¸º»¿-ɏͰ-ϿЀ-ԯ‐-‧‰-⁞₠-₿぀-ゖ一-龥가-힣"
UNSURE = re.compile(f"[^{SURE}]")

COUNTED = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)
_HEAD = T.StructType([T.StructField("piece", T.StringType()), T.StructField("n", T.LongType())])


@lru_cache(maxsize=4)
def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceLengths(dict):
    """Token counts of pre-tokens: the shared table, and what this worker has encoded itself."""

    def __init__(self, table: dict[str, int], tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__(table)
        letters = set(ByteLevel.alphabet())
        plain = [b for b in range(256) if chr(b) in letters]
        shifted = [b for b in range(256) if b not in set(plain)]
        self._letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}
        self._table, self._encode = table, tokenizer.model.tokenize

    def __missing__(self, piece: str) -> int:
        n = len(self._encode(piece.encode().decode("latin-1").translate(self._letters)))
        if len(piece) <= CACHED_LENGTH:
            self[piece] = n
        return n

    def trim(self) -> None:
        if len(self) > len(self._table) + CACHE_ENTRIES:
            self.clear()
            self.update(self._table)


def frequent_words(docs: DataFrame, text_col: str, entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent words of all texts, each with the space before it."""

    def heads(batches):
        import pyarrow as pa

        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.split())
                if len(seen) > 4 * SUMMARY_ENTRIES:  # take off the count of the first one left out
                    floor = sorted(seen.values(), reverse=True)[SUMMARY_ENTRIES]
                    seen = Counter({w: n - floor for w, n in seen.items() if n > floor})
        top = [x for x in seen.most_common(2 * HEAD_ENTRIES) if x[0].isalpha() and len(x[0]) < CACHED_LENGTH]
        top = top[:HEAD_ENTRIES]
        if top:
            arrays = [pa.array([" " + w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["piece", "n"])

    found = (
        docs.select(col(text_col).cast("string").alias("text"))
        .where("text is not null")
        .mapInArrow(heads, _HEAD)
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(entries)
    )
    return [r.piece for r in found.collect()]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    table_entries: int = TABLE_ENTRIES,
) -> DataFrame:
    """Bytes and tokens of every text, as the library counts them without added tokens.

    The file must be a byte-level ``tokenizers`` vocabulary that every worker can open. Strings of
    special tokens inside a text count as the library's default has them. A null or empty text has
    0 bytes and 0 tokens; null ids and repeated rows are kept as they are; an empty table gives an
    empty one; other columns, whatever their names, are ignored.
    """
    words = frequent_words(docs, text_col, table_entries)
    lengths = PieceLengths({}, tokenizer_of(tokenizer_path))
    shared = docs.sparkSession.sparkContext.broadcast({w: lengths[w] for w in words})

    def make():
        own = tokenizer_of(tokenizer_path)
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        known = PieceLengths(shared.value, own)
        look_up = known.__getitem__

        def count(text: str) -> int:
            if UNSURE.search(text) or any(s in text for s in special):
                return len(own.encode(text, add_special_tokens=False))
            return sum(map(look_up, PATTERN.findall(text)))

        def work(texts):
            total = []
            for _, run in slices(texts):
                total += map(count, run)
                known.trim()
            sizes = [len((t or "").encode()) for t in texts]
            return [sizes, total, [n > limit for n in total]]

        return work

    return map_texts(docs, text_col, [id_col], COUNTED, make)
