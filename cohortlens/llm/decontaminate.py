"""Benchmark decontamination by a generalised suffix automaton of the test items' words.

Items are normalised to words and dealt to blocks of bounded size; a very long item is dealt in pieces
that overlap by a window less one word, which have the same windows. A task builds the generalised
automaton of a block (a state per class of word sequences with the same ends) and stores it in the shared
folder. Documents stream through the automata in one map stage: after each word an automaton gives the
longest sequence ending there that occurs in an item. Where that length reaches the window, the window's
words are hit. A worker process holds one automaton; with several blocks it takes them in turn for each
portion of documents. No text is shuffled, and the driver sees only the names of the stored automata.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cohortlens.llm.common import kept_for, open_folder, text_or_empty
from cohortlens.session import cut_lineage, scratch_path

WINDOW = 10
#: Characters of items in one automaton, and words of an item's piece; they bound what a worker holds.
BLOCK_CHARS = 2_000_000
PIECE_WORDS = 50_000
#: Bytes of documents that go through one automaton before the next is loaded.
PORTION_BYTES = 32_000_000
MAX_COVERAGE = 0.5

#: Bytes to the same bytes in lower case (A-Z only), all that separates words to spaces.
NORMAL = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
WORD = re.compile("[^\x00-/:-@\\[-`{-\x7f]+")

STATE = "hit_n_words long, hit_spans array<struct<first:long,end:long>>, hit_items array<string>"


def words_of(text: str) -> list[bytes]:
    """The normalised words, in UTF-8."""
    return text.encode().translate(NORMAL).split()


class SuffixAutomaton:
    """All word sequences of the items. State 0 is the empty sequence."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.follow: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for name, words in items:
            codes = [self.vocabulary.setdefault(word, len(self.vocabulary)) for word in words]
            if codes:
                coded.append((name, codes))
                last = 0
                for code in codes:
                    last = self._extend(last, code)
        self.shortest = min([window, *(len(codes) for _, codes in coded)])
        self._label(coded)

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.follow.append(follow)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, source: int, target: int, code: int) -> int:
        """The state for sequences of ``target`` no longer than ``source`` and one word; split off if needed."""
        if self.length[target] == self.length[source] + 1:
            return target
        part = self._state(self.length[source] + 1, dict(self.follow[target]), self.link[target])
        self.link[target] = part
        while source >= 0 and self.follow[source].get(code) == target:
            self.follow[source][code] = part
            source = self.link[source]
        return part

    def _extend(self, last: int, code: int) -> int:
        if code in self.follow[last]:
            return self._split(last, self.follow[last][code], code)
        new = self._state(self.length[last] + 1, {}, 0)
        source = last
        while source >= 0 and code not in self.follow[source]:
            self.follow[source][code] = new
            source = self.link[source]
        if source >= 0:
            self.link[new] = self._split(source, self.follow[source][code], code)
        return new

    def _label(self, coded: list[tuple[str, list[int]]]) -> None:
        """The items of each window, and the short items that end in each state."""
        size = len(self.length)
        self.items: dict[int, set[str]] = {}
        whole: dict[int, dict[int, set[str]]] = {}
        for name, codes in coded:
            state = 0
            for n, code in enumerate(codes, 1):
                state = self.follow[state][code]
                if n >= self.window:
                    self.items.setdefault(self.at_window(state), set()).add(name)
            if len(codes) < self.window:
                whole.setdefault(state, {}).setdefault(len(codes), set()).add(name)
        self.whole: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * size
        if whole:
            for state in sorted(range(1, size), key=self.length.__getitem__):
                own = tuple((n, frozenset(names)) for n, names in whole.get(state, {}).items())
                self.whole[state] = own + self.whole[self.link[state]]

    def at_window(self, state: int) -> int:
        """The state of the last ``window`` words of a sequence of ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit word ranges (first, end), merged and in order, and the items with occurring windows."""
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]])))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for first, end in edges.reshape(-1, 2).tolist():
            if end - first >= self.shortest:
                self._run(codes[first:end].tolist(), first, spans, items)
        return merged(spans), items

    def _run(self, codes: list[int], at: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        follow, link, length, window = self.follow, self.link, self.length, self.window
        state = matched = 0
        for end, code in enumerate(codes, at + 1):
            while state and code not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state].get(code, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                spans.append((end - window, end))
                items |= self.items[self.at_window(state)]
            for n, names in self.whole[state]:
                if n <= matched:
                    spans.append((end - n, end))
                    items |= names


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch made one."""
    joined: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if joined and first <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((first, end))
    return joined


def pieces(words: list[bytes], window: int, size: int) -> Iterator[list[bytes]]:
    """``words`` in pieces with the same windows: each but the last ``size`` words longer than its step."""
    step = max(size, window)
    first = 0
    while len(words) - first > step + window - 1:
        yield words[first : first + step + window - 1]
        first += step
    yield words[first:]


def stored_automata(items: DataFrame, window: int, block_chars: int, piece_words: int = PIECE_WORDS) -> tuple[str, list[str]]:
    """The folder and the names of the automata of all blocks of items with words."""
    spark = items.sparkSession
    folder = scratch_path(spark, "automata")
    chosen = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_or_empty().alias("text")
    )
    chars = chosen.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = 1 + chars // block_chars

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [b" ".join(piece).decode() for piece in pieces(words_of(text), window, piece_words)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts)), pa.array(parts)], ["item_id", "text"])

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (pair for batch in batches for pair in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()))
        automaton = SuffixAutomaton([(item, text.encode().split(b" ")) for item, text in rows], window)
        name = f"block-{key[0].as_py()}-{TaskContext.get().taskAttemptId()}"
        system, path = open_folder(folder)
        with system.open_output_stream(f"{path}/{name}") as stream:
            pickle.dump(automaton, stream, pickle.HIGHEST_PROTOCOL)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    blocks = (
        chosen.mapInArrow(cut, "item_id string, text string")
        .where("text <> ''")
        .withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
        .groupBy("block")
        .applyInArrow(build, "name string")
    )
    return folder, sorted(row["name"] for row in cut_lineage(blocks).collect())


def held_automaton(folder: str, name: str) -> SuffixAutomaton:
    """The automaton of a file; this worker process keeps the last one used."""
    mine = kept_for("decontaminate")
    if (folder, name) not in mine:
        mine.clear()
        system, path = open_folder(folder)
        with system.open_input_stream(f"{path}/{name}") as stream:
            mine[folder, name] = pickle.load(stream)
    return mine[folder, name]


def found_in(texts: list[str | None], folder: str, names: list[str]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: number of words, merged hit word ranges, items with occurring windows."""
    words = [words_of(text or "") for text in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for name in names:
        find = held_automaton(folder, name).find
        for own, ranges, names_ in zip(words, spans, items):
            if own:
                more, others = find(own)
                ranges += more
                names_ |= others
    return [(len(own), merged(ranges), names_) for own, ranges, names_ in zip(words, spans, items)]


def portions(batches: Iterable[pa.RecordBatch], joined: bool) -> Iterator[pa.RecordBatch]:
    """Batches as they come, or ``joined`` to about ``PORTION_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if not joined or size >= PORTION_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def with_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with the columns of ``STATE``: number of words, merged hit word ranges, hit item ids."""
    folder, names = stored_automata(items, window, block_chars)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(STATE).fields])
    text_at = docs.columns.index("text")
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), span, pa.list_(pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, len(names) > 1):
            found = found_in(batch.column(text_at).to_pylist(), folder, names)
            added = (
                [n for n, _, _ in found],
                [[{"first": a, "end": b} for a, b in spans] for _, spans, _ in found],
                [sorted(others) for _, _, others in found],
            )
            columns = [*batch.columns, *(pa.array(*pair) for pair in zip(added, types))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``item_ids`` and ``spans`` (word ranges).

    A window is ``window`` consecutive words of an item, or all words of a shorter item. A NULL or
    empty text has no words and no hits; an item without words is never found; a NULL item id counts
    as the empty id, and rows of one item id as one item. Repeated documents are reported as often as
    they occur. Other columns of ``docs`` are ignored. No items, or no documents, give no hits.
    """
    found = with_hits(docs.select("doc_id", "text"), items, window)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    return found.select(
        "doc_id",
        F.col("hit_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.col("hit_items").alias("item_ids"),
        F.col("hit_spans").alias("spans"),
    )


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the ranges and what stands between them."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    parts, at = [], 0
    for first, end in spans:
        parts.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join([*parts, text[at:]])


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without hit spans, and without documents more than ``max_coverage`` of whose words are hit.

    Same columns as ``docs``; ``n_chars``, if there, follows the text. Texts without hits stay as they are,
    NULL and empty ones included; repeated rows are treated alike and stay as often as they occur. Without
    items nothing changes; an empty table gives an empty table. Each text goes to Python and back once.
    """
    folder, names = stored_automata(items, window, block_chars)
    # The other columns travel as one, so that none can clash with a working column.
    others = [F.col(f"`{name}`") for name in docs.columns if name != "text"] or [F.lit(None).cast("int").alias("none")]
    beside = docs.select(F.struct(*others).alias("row"), "text")
    schema = StructType([*beside.schema.fields, StructField("changed", BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, len(names) > 1):
            texts = batch.column(1).to_pylist()
            found = found_in(texts, folder, names)
            hit = [sum(end - first for first, end in spans) for _, spans, _ in found]
            keep = [k for k, (n, _, _) in enumerate(found) if hit[k] <= max_coverage * n]
            kept = [without_spans(texts[k], found[k][1]) if hit[k] else texts[k] for k in keep]
            changed = pa.array([hit[k] > 0 for k in keep], pa.bool_())
            rows = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(kept, pa.string()), changed], ["row", "text", "changed"])

    cleaned = beside.mapInArrow(run, schema)
    values = {name: F.col("text") if name == "text" else F.col(f"row.`{name}`") for name in docs.columns}
    if "n_chars" in values:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.col("changed"), length).otherwise(values["n_chars"])
    return cleaned.select(*(value.alias(name) for name, value in values.items()))
