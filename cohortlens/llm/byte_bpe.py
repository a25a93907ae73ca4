"""Byte-level BPE by a rank file: texts to token ids and back.

A text is cut into pre-tokens by the pattern. Tier one resolves a whole pre-token that is in the
vocabulary by a minimal perfect hash, broadcast as flat arrays (its size is that of the vocabulary).
Tier two merges the bytes of any other pre-token: the bytes form a linked list, a heap holds the rank
of each neighbouring pair, and the pair of lowest rank, leftmost at ties, is merged until no pair has
a rank. Each worker process keeps the ids of recent pieces in bounded caches, also from one task to the
next. Rows never leave their task.
"""

from __future__ import annotations

import re
from array import array
from base64 import b64decode
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import TwoGenerations, kept_for, text_or_empty
from cohortlens.llm.perfect_hash import PerfectHash

#: A space next to other white space, or at an end: there a pre-token may span what lies beside a space.
SPACES_MEET = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
RARE_SPACE = re.compile("[\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens with their ranks, ready to broadcast."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = PerfectHash(list(ranks))
        self.ranks = np.fromiter(ranks.values(), np.int64, len(ranks))

    def rank_reader(self):
        position, ranks = self.tokens.reader(), self.ranks.tolist()

        def rank(token: bytes) -> int | None:
            found = position(token)
            return None if found is None else ranks[found]

        return rank

    def by_rank(self) -> dict[int, bytes]:
        blob, ends = self.tokens.blob, self.tokens.ends.tolist()
        positions, ranks = self.tokens.positions.tolist(), self.ranks.tolist()
        return {ranks[positions[s]]: blob[ends[s] : ends[s + 1]] for s in range(self.tokens.size)}

    def array(self) -> pa.BinaryArray:
        """The tokens in the order of their ranks; NULL where a rank has none."""
        tokens = self.by_rank()
        return pa.array(map(tokens.get, range(max(tokens, default=-1) + 1)), pa.binary())


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of the tokens that the merges leave of ``piece``."""
    size = len(piece)
    rank = ranks.get
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    pair = [rank(piece[i : i + 2]) for i in range(size - 1)]
    pair.append(None)
    heap = [(r, i) for i, r in enumerate(pair) if r is not None]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if pair[i] != r:
            continue  # the pair went when a neighbour was merged
        gone = after[i]
        pair[gone] = None
        end = after[i] = after[gone]
        if end < size:
            before[end] = i
            pair[i] = found = rank(piece[i : after[end]])
            if found is not None:
                heappush(heap, (found, i))
        else:
            pair[i] = None
        left = before[i]
        if left >= 0:
            pair[left] = found = rank(piece[left:end])
            if found is not None:
                heappush(heap, (found, left))
    ids, i = [], 0
    while i < size:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class ByteEncoder:
    """Texts to token ids, packed as 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.find = regex.compile(pattern).findall
        whole = vocabulary.rank_reader()
        ranks = {token: rank for rank, token in vocabulary.by_rank().items()}

        def pre_token(text: str) -> bytes:
            piece = text.encode()
            found = whole(piece)
            return array("i", merge_bytes(piece, ranks) if found is None else (found,)).tobytes()

        self.by_pre_token = TwoGenerations(pre_token, 1 << 17)
        self.after_space = TwoGenerations(lambda chunk: self.cut(" " + chunk))

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.by_pre_token.__getitem__, self.find(text)))

    def packed(self, text: str) -> bytes:
        """The ids of ``text``.

        A pre-token reaches over a space only if it begins with it, as long as no other white space is
        next to it. Then the chunks between spaces can be cut, and kept, one by one.
        """
        if (
            RARE_SPACE.search(text)
            or text[:1] == " "
            or text[-1:] == " "
            or any(both in text for both in SPACES_MEET)
        ):
            return self.cut(text)
        first, *rest = text.split(" ")
        return self.cut(first) + b"".join(map(self.after_space.__getitem__, rest))

    def ids(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text."""
        packed = [self.packed(text) for text in texts.to_pylist()]
        ends = np.cumsum([0, *(len(own) // 4 for own in packed)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


class Decoder:
    """Lists of token ids to bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.tokens = vocabulary.array()

    def decoded(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes each list stands for; no ids give no bytes, NULL gives NULL."""
        taken = self.tokens.take(ids.flatten())
        if taken.null_count:
            raise ValueError("an id stands for no token")
        # The tokens taken lie one after the other: a row's bytes are those between two offsets.
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        places = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :]
        ends = places[np.concatenate([[0], np.cumsum(lengths)])]
        data = taken.buffers()[2] or pa.py_buffer(b"")
        whole = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends.astype(np.int32)), data])
        return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.binary()))


def held(kind: type, vocabulary, *key: str):
    """A ``ByteEncoder`` or ``Decoder`` of this worker process, the last one used of its kind."""
    mine = kept_for("byte_bpe")
    if mine.get(kind, (None, None))[0] != key:
        mine[kind] = key, kind(vocabulary.value, *key[1:])
    return mine[kind][1]


def encode(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row of ``docs``: the id and ``ids``, the token ids of the whole text, as ``array<int>``.

    A NULL or empty text has no ids. Rows with a NULL or repeated id stay rows of their own. Other
    columns of ``docs`` are ignored. An empty table gives an empty table.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(path)))
    chosen = docs.select(F.col(id_column), text_or_empty(text_column).alias("text"))
    id_type = chosen.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(ByteEncoder, vocabulary, path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.ids(batch.column(1))], [id_column, "ids"])

    return chosen.mapInArrow(run, f"`{id_column}` {id_type}, ids array<int>")


def decoder(spark, path: str):
    """An Arrow UDF from token ids to the bytes they stand for; no ids give no bytes, NULL gives NULL."""
    vocabulary = spark.sparkContext.broadcast(Vocabulary(load_ranks(path)))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(held(Decoder, vocabulary, path).decoded, batches)

    return decode


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """``encode`` with ``decoded``, the bytes that the ids stand for, as ``decoder`` gives them.

    Both in one pass: with a Python function each, a task would hold two worker processes, and since workers
    are handed out in turn, every one of them would come to keep an encoder and its caches.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(path)))
    chosen = docs.select(F.col(id_column), text_or_empty().alias("text"))
    id_type = chosen.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder_ = held(ByteEncoder, vocabulary, path, pattern), held(Decoder, vocabulary, path)
        for batch in batches:
            ids = encoder.ids(batch.column(1))
            columns = [batch.column(0), ids, decoder_.decoded(ids)]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "ids", "decoded"])

    return chosen.mapInArrow(run, f"`{id_column}` {id_type}, ids array<int>, decoded binary")
