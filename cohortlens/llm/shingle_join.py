"""Exact Jaccard join of documents on word shingles, by joins of block signatures.

Documents are the rows and shingles the columns of a 0/1 matrix; the product with its transpose would hold
the overlaps. That product is not accumulated here: rows meet by signatures of whole blocks of columns, and
only pairs that can reach the link threshold are compared:

1. Equal sets are one row (a class). A class goes on as a 64-bit hash of its set.
2. The columns are cut into blocks by hash, their number following from the sizes: linked sets of a size
   class differ in at most so many shingles, hence agree on some whole block. Each row signs its strongest
   blocks; rows are brought together by signature (``signed`` to ``buckets``).
3. Within a bucket the first row is compared with the others (a star, not all pairs). A sketch of the
   row, a parity bit for each of many cells of its columns, accumulates a lower bound of the difference;
   pairs above what their sizes allow are discarded, the others verified on the whole texts.
4. The links so far give components. Only buckets that hold several components are compared further, all
   pairs across components, in blocks of ``CHUNK`` rows; the sketches discard nearly all of them inside
   the task, and what is left is verified: first as many pairs as would span a dense group, then, with the
   components that gives, every pair still across. Pairs within a component cannot change the result.

No link is lost: a linked pair shares a bucket, and every pair of a bucket is either within a component or
tested. No pairs of copies are written out, and no list of documents, links or components reaches the
driver. Two different sets could share their 64-bit hash and be taken for copies; among ten billion
distinct sets about three such pairs are to be expected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from cohortlens.llm.common import kept_for, packed, text_or_empty
from cohortlens.llm.components import components
from cohortlens.llm.shingles import (
    LINK,
    SHINGLE_WORDS,
    class_of,
    classes_of,
    differing,
    linked,
    most_different,
    shingle_set,
    signatures,
    sizes_fit,
    sketch,
)
from cohortlens.session import cut_lineage

#: Rows of a bucket multiplied with each other at a time.
CHUNK = 1024
#: Frequent shingles kept: a bound of what is broadcast. They only order blocks by strength.
MAX_FREQUENT = 100_000
#: A shingle in this part of the distinct sets of a batch, and in at least so many, counts as frequent.
FREQUENT_SHARE, FREQUENT_LEAST = 0.005, 4
#: Documents whose signatures are held at a time.
DOCUMENTS_AT_ONCE = 256
#: Class ids up to which the list of those to verify is broadcast; beyond, Spark joins as it sees fit.
SMALL_LIST = 500_000


def class_id(members: np.ndarray) -> int:
    """A set's hash as a signed integer."""
    return xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def measured(docs: DataFrame, words: int) -> DataFrame:
    """Per row: ``doc_id``, ``mark`` (a hash of the text), ``n`` shingles, ``node`` (the class) and, on the
    first row of a batch, ``often``: the shingles that many distinct sets of the batch share, with the number
    of sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for("shingle_join")
        for batch in batches:
            sets = [shingle_set(text, words) for text in batch.column(2).to_pylist()]
            nodes = [class_id(members) for members in sets]
            distinct = list(dict(zip(nodes, sets)).values())
            values, counts = np.unique(np.concatenate(distinct), return_counts=True) if distinct else ([], [])
            many = np.flatnonzero(np.asarray(counts) >= max(FREQUENT_LEAST, FREQUENT_SHARE * len(distinct)))
            often = [{"shingle": int(np.int64(np.uint64(values[k]))), "sets": int(counts[k])} for k in many]
            lists = [often or None, *[None] * (len(sets) - 1)] if sets else []
            kind = pa.list_(pa.struct([("shingle", pa.int64()), ("sets", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([len(members) for members in sets], pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(lists, kind),
                ],
                ["doc_id", "mark", "n", "node", "often"],
            )

    chosen = docs.select("doc_id", F.xxhash64("text").alias("mark"), text_or_empty().alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, mark long, n long, node long, often array<struct<shingle:long,sets:long>>"
    return chosen.mapInArrow(run, schema)


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """The shingles found often in most batches, sorted; at most ``MAX_FREQUENT``."""
    often = (
        rows.select(F.explode("often").alias("one"))
        .groupBy("one.shingle")
        .agg(F.sum("one.sets").alias("sets"))
        .orderBy(F.desc("sets"), "shingle")
        .limit(MAX_FREQUENT)
    )
    return np.sort(np.array([row["shingle"] for row in often.collect()], np.int64).astype(np.uint64))


def signed(docs: DataFrame, frequent: np.ndarray, words: int, link: int) -> DataFrame:
    """Signature, class and size for each signed block; a task signs each class once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start in range(0, len(batch), DOCUMENTS_AT_ONCE):
                found, nodes, sizes = [], [], []
                for text in batch.column(0).slice(start, DOCUMENTS_AT_ONCE).to_pylist():
                    members = shingle_set(text, words)
                    node = class_id(members)
                    if node not in seen:
                        seen.add(node)
                        found.append(signatures(members, shared.value, link))
                        nodes.append(node)
                        sizes.append(len(members))
                times = [len(own) for own in found]
                if sum(times):
                    columns = [np.concatenate(found).astype(np.int64), np.repeat(nodes, times), np.repeat(sizes, times)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sig", "node", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "sig long, node long, n long")


BUCKET = "bucket long, node long, n long, size_class long, first long, first_n long, members long"


#: Rows of signatures looked at together.
ROWS_TOGETHER = 1 << 16


def by_signature(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first one, in portions that end where a signature ends."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(column) for column in zip(*held))

    for batch in batches:
        own = tuple(column.to_numpy() for column in batch.columns)
        if not len(own[0]):
            continue
        held.append(own)
        size += len(own[0])
        if size >= ROWS_TOGETHER and held[0][0][0] != own[0][-1]:
            whole = joined()
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # where the last signature begins
            yield tuple(column[:cut] for column in whole)
            held = [tuple(column[cut:].copy() for column in whole)]
            size = len(held[0][0])
    if held:
        yield joined()


def buckets(signatures_: DataFrame) -> DataFrame:
    """The rows of signatures that several classes share. Buckets of the same classes found in one task
    become one. Rows come sorted by signature, and a task holds those of a signature and a portion more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for sig, node, n in by_signature(batches):
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, n = sig[fresh], node[fresh], n[fresh]
            starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            ends = np.append(starts[1:], len(sig))
            rows: list[tuple[np.ndarray, ...]] = []
            held = 0
            for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                bucket = xxh3_64_intdigest(node[start:end].tobytes()) - (1 << 63)
                if bucket in seen:
                    continue
                seen.add(bucket)
                own, sizes, m = node[start:end], n[start:end], end - start
                fixed = (np.full(m, v, np.int64) for v in (class_of(sizes.min()), own[0], sizes[0], m))
                rows.append((np.full(m, bucket, np.int64), own, sizes, *fixed))
                held += m
                if held > 1 << 14:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(column), pa.int64()) for column in zip(*rows)]
        return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in BUCKET.split(", ")])

    return signatures_.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, BUCKET)


def listed(docs: DataFrame, nodes: DataFrame, classes: DataFrame, words: int, link: int) -> DataFrame:
    """For the classes in ``nodes``: a text and the sketch per size class, stored.

    One document stands for a class. The list of those documents is broadcast if it is small.
    """
    wanted = cut_lineage(nodes.join(classes, "node").select("node", F.col("rep").alias("rep_id"), "rep_mark"))
    small = F.broadcast(wanted) if wanted.count() <= SMALL_LIST else wanted

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts, sketches = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                members = shingle_set(text, words)
                if class_id(members) == node:  # the hash of another text may be the same
                    nodes.append(node)
                    texts.append(text)
                    own = classes_of(len(members), link)
                    sketches.append([{"size_class": c, "bytes": sketch(members, c)} for c in own])
            kind = pa.list_(pa.struct([("size_class", pa.int64()), ("bytes", pa.binary())]))
            columns = [pa.array(nodes, pa.int64()), pa.array(texts, pa.string()), pa.array(sketches, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "text", "sketches"])

    chosen = docs.select("doc_id", F.xxhash64("text").alias("mark"), text_or_empty().alias("text"))
    same = [chosen["doc_id"].eqNullSafe(small["rep_id"]), chosen["mark"] == small["rep_mark"]]
    found = chosen.join(small, same).select("node", "text")
    schema = "node long, text string, sketches array<struct<size_class:long,bytes:binary>>"
    return cut_lineage(found.mapInArrow(run, schema).dropDuplicates(["node"]))


def verified(pairs: DataFrame, texts: DataFrame, words: int, link: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole texts are linked, stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def members(node: int, text: str) -> np.ndarray:
            if node not in held:
                if len(held) >= 64:
                    held.clear()
                held[node] = shingle_set(text, words)
            return held[node]

        for batch in batches:
            a, b, text_a, text_b = (column.to_pylist() for column in batch.columns)
            keep = [linked(members(x, s), shingle_set(t, words), link) for x, s, t in zip(a, text_a, text_b)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = (texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}")) for name in "ab")
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")
    return cut_lineage(both.mapInArrow(run, "a long, b long"))


def star_pairs(found: DataFrame, sketches: DataFrame, link: int) -> DataFrame:
    """The first class of each bucket with the others, less those that sizes or sketches rule out, stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                differing(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= most_different(m, n, link)
                for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)))
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    smaller, larger = F.least("n", "first_n"), F.greatest("n", "first_n")
    pairs = cut_lineage(
        found.where((F.col("first") != F.col("node")) & (100 * smaller >= link * larger))
        .select(F.col("first").alias("a"), F.col("node").alias("b"), smaller.alias("smaller"), larger.alias("larger"))
        .distinct()
        .mapInArrow(with_class, "a long, b long, smaller long, larger long, size_class long")
    )
    of_a, of_b = (sketches.select(F.col("node").alias(x), "size_class", F.col("bytes").alias(f"bytes_{x}")) for x in "ab")
    both = pairs.join(of_b, ["b", "size_class"]).join(of_a, ["a", "size_class"])
    return cut_lineage(both.select("a", "b", "smaller", "larger", "bytes_a", "bytes_b").mapInArrow(run, "a long, b long"))


def with_class(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the size class of the column ``smaller``."""
    for batch in batches:
        classes = pa.array(class_of(batch.column("smaller").to_numpy()), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, classes], [*batch.schema.names, "size_class"])


def cross_pairs(found: DataFrame, labels: DataFrame, sketches: DataFrame, spanning: bool, link: int) -> DataFrame:
    """Pairs of classes of one bucket that are in different components and not ruled out, stored.

    A bucket is dealt out in pairs of chunks, so a large one is spread over many tasks. With ``spanning``
    only as many pairs as would join what they can join: of a dense group a row less than its members.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j"))))
            begin = 0
            for end in [*(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]:
                if last is not None and keys[begin] != last:
                    yield from multiplied(held)
                    held = []
                last = keys[begin]
                held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield from multiplied(held)

    def multiplied(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        node, n, component, chunk = (rows.column(c).to_numpy() for c in ("node", "n", "component", "chunk"))
        bytes_ = np.stack([np.frombuffer(one, np.uint8) for one in rows.column("bytes").to_pylist()])
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        a, b = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        group = component.copy()
        found = []
        for x in a:
            others = b[(group[b] != group[x]) & ((node[b] > node[x]) | (i != j))]
            others = others[sizes_fit(n[x], n[others], link)]
            others = others[differing(bytes_[others], bytes_[x]) <= most_different(n[x], n[others], link)]
            if spanning and len(others):
                groups, first = np.unique(group[others], return_index=True)
                others = others[first]
                group[np.isin(group, groups)] = group[x]
            found.extend((min(node[x], node[y]), max(node[x], node[y])) for y in others)
        if found:
            columns = [pa.array(column, pa.int64()) for column in zip(*set(found))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    labelled = cut_lineage(
        found.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    mixed_ = cut_lineage(
        labelled.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("bucket")
    )
    open_rows = labelled.join(mixed_, "bucket").select("bucket", "node", "n", "size_class", "component", "members").distinct()
    with_sketch = cut_lineage(open_rows).join(sketches, ["node", "size_class"])
    n_chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("node"), n_chunks).cast("int")
    dealt = (
        with_sketch.withColumns({"n_chunks": n_chunks, "chunk": chunk})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
        .select("bucket", "i", "j", "node", "n", "component", "chunk", "bytes")
    )
    return cut_lineage(
        dealt.repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(run, "a long, b long")
        .distinct()
    )


def linked_classes(docs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, link: int) -> DataFrame:
    """Per class that is linked to another: ``node`` and ``component``, the smallest class of its component."""
    found = cut_lineage(buckets(signed(docs, frequent_shingles(rows), words, link)))
    texts = listed(docs, found.select("node").distinct(), classes, words, link)
    sketches = cut_lineage(texts.select("node", F.explode("sketches").alias("s")).select("node", "s.*"))
    stars = verified(star_pairs(found, sketches, link), texts, words, link)
    labels = components(stars)
    for spanning in (True, False):
        across = cross_pairs(found, labels, sketches, spanning, link)
        labels = with_links(labels, verified(across, texts, words, link))
    return labels


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after more links (a, b) have joined components, stored."""
    if links.isEmpty():
        return labels
    of_a, of_b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    between = links.join(of_a, "a", "left").join(of_b, "b", "left")
    edges = between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
    joined = components(edges)
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("merged"))
    old = labels.join(renamed, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    return cut_lineage(old.union(joined.join(labels, "node", "left_anti").select("node", "component")))


def first_row() -> Column:
    """The smallest (id, hash of the text) of a group's rows; a NULL id only if there is no other."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("first")


def classes_of_rows(rows: DataFrame) -> DataFrame:
    """Per class that has shingles: ``node``, and id and text hash of the row that stands for it, stored."""
    first = rows.where("n > 0").groupBy("node").agg(first_row())
    return cut_lineage(
        first.select("node", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("rep_mark"))
    )


def shingle_components(docs: DataFrame, words: int = SHINGLE_WORDS, link: int = LINK) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``.

    A text's set is its distinct runs of ``words`` words (all its words, if fewer). Sets are linked if their
    intersection is at least ``link`` percent of their union. ``component_id`` is the smallest id reachable by links.

    A NULL or empty text has an empty set, is linked with nothing and keeps its own id. Repeated rows and
    copies are linked. Rows that repeat an id with another text are linked only by their texts. NULL ids
    are passed over for the smallest, unless a component has no other. Other columns of ``docs`` are
    ignored. An empty table gives an empty table.
    """
    rows = cut_lineage(measured(docs, words))
    classes = classes_of_rows(rows)
    labels = linked_classes(docs, rows, classes, words, link)
    smallest = cut_lineage(
        classes.join(labels, "node").groupBy("component").agg(F.min("rep").alias("smallest"))
    )
    of_linked = labels.join(smallest, "component").select("node", "smallest")
    of_class = cut_lineage(
        classes.join(of_linked, "node", "left").select("node", F.coalesce("smallest", "rep").alias("smallest"))
    )
    return rows.join(of_class, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, link: int = LINK) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, a NULL id only if the component has no other.

    Rows are told apart by id and text, so of rows that repeat an id each stays or goes by its own text;
    of rows equal in both one stays. Documents without shingles all stay. The texts are not shuffled but
    for those repeated rows: rows to drop are found by id and a hash of the text, and their list is
    broadcast if it is small.
    """
    rows = cut_lineage(measured(docs, words))
    classes = classes_of_rows(rows)
    labels = linked_classes(docs, rows, classes, words, link)
    kept = cut_lineage(
        classes.select("node", F.col("rep").alias("doc_id"), F.col("rep_mark").alias("mark"))
        .join(labels, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(first_row())
        .select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"))
    )
    counted = rows.where("n > 0").groupBy("doc_id", "mark").agg(F.count("*").alias("times"))
    is_kept = [counted["doc_id"].eqNullSafe(kept["kept_id"]), counted["mark"] == kept["kept_mark"]]
    judged = counted.join(kept, is_kept, "left").withColumn("drop", F.col("kept_mark").isNull())
    found = cut_lineage(
        judged.where("drop OR times > 1").select(F.col("doc_id").alias("found_id"), F.col("mark").alias("found_mark"), "drop")
    )
    small = F.broadcast(found) if found.count() <= SMALL_LIST else found
    marked = docs.select(packed(docs).alias("row"), "doc_id", F.xxhash64("text").alias("mark"))
    is_found = [marked["doc_id"].eqNullSafe(small["found_id"]), marked["mark"] == small["found_mark"]]
    stays = marked.join(small, is_found, "left_anti").select("row.*")
    if found.where("NOT drop").isEmpty():
        return stays
    repeated = marked.join(small.where("NOT drop"), is_found, "left_semi").dropDuplicates(["doc_id", "mark"])
    return stays.unionByName(repeated.select("row.*"))
