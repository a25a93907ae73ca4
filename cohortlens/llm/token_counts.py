"""Token counts of whole texts by a two-tier look-up in the map stage.

Tier one is a table of the lengths of frequent pre-tokens, broadcast once. The frequent ones are the
vocabulary's own whole words: the training of the tokenizer merged a word into one entry because it
is frequent, so they come without a pass over the corpus and their number is bounded by the
vocabulary (about 50,000, under 1 MB). Tier two is each worker's cache, filled by the library on a
miss. Nothing is shuffled and no text leaves its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import TwoGenerations, text_or_empty
from cohortlens.llm.word_bpe import LETTERS, PLAIN, WordEncoder, chunks, encoder, pre_tokens

WORD_END = "</w>"


class LengthTable:
    """Lengths of pre-tokens as two flat buffers; each worker process unfolds them into a hash table once."""

    def __init__(self, lengths: dict[str, int]) -> None:
        self.words = "\n".join(lengths).encode()
        self.lengths = np.fromiter(lengths.values(), np.uint8, len(lengths)).tobytes()

    def unfold(self) -> dict[str, int]:
        return dict(zip(self.words.decode().split("\n"), self.lengths)) if self.lengths else {}


def frequent_lengths(path: str) -> LengthTable:
    """The library's token counts of the vocabulary's whole words."""
    words = WordEncoder(path)
    bytes_of = {letter: byte for byte, letter in LETTERS.items()}
    lengths = {}
    for entry in words.library.get_vocab(with_added_tokens=False):
        if not entry.endswith(WORD_END):
            continue
        raw = bytes(bytes_of[ord(letter)] for letter in entry.removesuffix(WORD_END))
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue
        if PLAIN.fullmatch(word) and pre_tokens(word) == [word]:
            lengths[word] = len(words.pre_token_ids(word))
    return LengthTable(lengths)


class Counter:
    """Token counts of chunks: the table first, then a cache of what the library says."""

    def __init__(self, path: str, frequent: LengthTable) -> None:
        words, table = encoder(path), frequent.unfold()
        by_word = TwoGenerations(lambda word: len(words.pre_token_ids(word)))

        def miss(chunk: str) -> int:
            parts = pre_tokens(chunk)
            if parts is None:
                return len(words.chunk_ids(chunk))
            return sum(table.get(part) or by_word[part] for part in parts)

        self.by_chunk = TwoGenerations(miss)


#: The counter of this worker process, by vocabulary file; its caches stay from one task to the next.
COUNTERS: dict[str, Counter] = {}


def held_counter(path: str, frequent) -> Counter:
    """Not inside the UDF: that would bring a copy of ``COUNTERS`` along."""
    if path not in COUNTERS:
        COUNTERS.clear()
        COUNTERS[path] = Counter(path, frequent.value)
    return COUNTERS[path]


def token_counter(spark, path: str):
    """A Pandas UDF from a text to its number of tokens, without begin, end or added special tokens."""
    frequent = spark.sparkContext.broadcast(frequent_lengths(path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        length = held_counter(path, frequent).by_chunk.__getitem__
        for texts in batches:
            yield pd.Series([sum(map(length, chunks(text))) for text in texts], dtype="int64")

    return count


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row of ``docs``: the id, bytes in UTF-8, tokens, and whether they exceed ``limit``.

    A NULL text counts as empty: 0 bytes and 0 tokens. Rows with a NULL or repeated id stay rows of
    their own. Other columns of ``docs`` are ignored. An empty table gives an empty table. A text is
    never cut, whatever its length.
    """
    count = token_counter(docs.sparkSession, path)
    text: Column = text_or_empty(text_column)
    counted = docs.select(
        F.col(id_column),
        F.octet_length(text).cast("long").alias("n_bytes"),
        count(text).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
