"""How far the sources of a language differ in their words, and which words make a source stand out.

A ``CountVectorizer`` with a minimum document frequency and no limit on the vocabulary says which terms
count, and the texts become exact sparse count vectors over them. A term is counted under its
language, so that one fit gives each language its own vocabulary, however many languages there are. The
vectors are summed per source and term like ``Summarizer`` does, but without its dense buffer per group:
only occurring terms are rows.

A group's probability of a term is an integer of billionths, ``1 + floor(10^9 (count + 5) / (N + 5 V))``,
so a term that does not occur has a positive one too, the same for all of them: the group's floor.
The distance of two groups over the whole vocabulary is then evaluated sparsely:

    V |floor_a - floor_b|                                          no term occurs
    + sum over the terms of a of |p_a - floor_b| - |floor_a - floor_b|      and the same with a, b swapped
    + sum over shared terms of |p_a - p_b| - |p_a - floor_b| - |floor_a - p_b| + |floor_a - floor_b|

The second line needs only how many terms of a group have which probability, a short list by Zipf's law;
only the third joins terms, and each pair of groups is summed in the map stage. All numbers are integers
held in longs, and in decimals where 10^9 times a count exceeds one.

Large intermediate rows name a group by a number and a term by its index in the vocabulary, which implies the
language; names come back once the rows are few.

The vocabulary (terms in at least ``min_df`` documents of a language) is held by the driver and sent to
the executors: that is how ``CountVectorizer`` works, and it is the one thing here that grows with the
number of different terms.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from cohortlens.llm.common import text_or_empty
from cohortlens.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Per UTF-8 byte: ASCII letters in lower case, bytes of other characters as they are, the rest separates.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
MIN_DF, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
LARGEST_INT = 2**31 - 1
#: Stands between a language (in hexadecimal) and a term; neither contains it, nor a space.
MARK = ":"
#: Stands for languages without kept terms; no language in hexadecimal.
NO_LANGUAGE = "none"


#: Terms not yet listed often enough that a task remembers; beyond, it starts to count anew.
LISTED_AT_ONCE = 1 << 18


def different_terms(at_most: int | None, remembered: int) -> Callable[..., Column]:
    """A function of texts and their tags: the terms of each text, each once and behind the tag; NULL for none.

    With ``at_most``, a task leaves out a term that it has listed for so many texts of the tag already. So a term
    is listed for at least ``at_most`` texts in all if and only if it is in so many, and else for all it is in.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        listed: defaultdict[bytes, dict[bytes, int]] = defaultdict(dict)
        enough: defaultdict[bytes, set[bytes]] = defaultdict(set)
        size = 0
        for texts, tags in batches:
            out = []
            for text, tag in zip(texts.cast(pa.binary()).to_pylist(), tags.cast(pa.binary()).to_pylist()):
                own = dict.fromkeys(text.translate(LETTERS).split())
                if at_most is not None:
                    own = own.keys() - enough[tag]
                    times = listed[tag]
                    size -= len(times)
                    for term in own:
                        time = times.get(term, 0) + 1
                        if time < at_most:
                            times[term] = time
                        else:
                            enough[tag].add(term)
                            times.pop(term, None)
                    size += len(times)
                    if size >= remembered:
                        listed.clear()
                        size = 0
                out.append((b" " + tag).join([b"", *own])[1:] or None)
            # Split here: Spark's own split makes a Java string of the text and of each term, and encodes them again.
            yield pc.split_pattern(pa.array(out, pa.binary()).cast(pa.string()), " ")

    return F.arrow_udf(run, ArrayType(StringType()))


def tag_of(lang: Column) -> Column:
    return F.concat(F.hex(lang), F.lit(MARK))


def term_lists(at_most: int | None = None, remembered: int = LISTED_AT_ONCE) -> Column:
    """The different terms of a row's text, tagged; an empty list for none. See ``different_terms``."""
    found = different_terms(at_most, remembered)(text_or_empty("text"), tag_of(text_or_empty("lang")))
    return F.coalesce(found, F.array().cast("array<string>"))


def kept_terms(docs: DataFrame, min_df: int) -> list[str]:
    """The tagged terms in at least ``min_df`` documents of their language: a ``CountVectorizer``'s vocabulary.

    ``min_df`` rows with one term of their own keep the vocabulary from being empty, which the fit
    refuses. A document frequency counts a term of a document once, however often it occurs there, so
    the fit gets each only once. Whether a term is kept is known after ``min_df`` documents, so a task lists
    none for more: frequent terms are most of what the fit would hash as Java strings.
    """
    spark = docs.sparkSession
    terms = docs.select(term_lists(min_df).alias("terms"))
    filler = spark.range(0, min_df, 1, 1).select(F.array(F.lit(MARK)).alias("terms"))
    vectorizer = CountVectorizer(inputCol="terms", outputCol="counts", minDF=float(min_df), vocabSize=LARGEST_INT)
    return vectorizer.fit(terms.unionByName(filler)).vocabulary


#: Bytes of texts that a task holds before it counts their terms by group.
BYTES_AT_ONCE = 16 << 20


def group_vectors(docs: DataFrame, words: list[str], at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """Sparse sums of document vectors over ``words``, several rows per group: ``lang, source, entries``; stored.

    A sum is what the vectorizer's own model and ``Summarizer`` give, with whole numbers, but a task takes the texts of
    a portion together: their terms are split, numbered and looked up as Arrow columns, where the model looks up every
    occurrence as a string of its own and makes a row of every document.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: defaultdict[str, list[str]] = defaultdict(list)
        indices: defaultdict[str, list[int]] = defaultdict(list)
        for index, word in enumerate(shared.value):
            tag, _, term = word.partition(MARK)
            if term:  # not that of the rows that fill up the fit
                terms[tag].append(term)
                indices[tag].append(index)
        # The last place, -1, is that of terms that are not kept.
        known = {t: (pa.array(terms[t], pa.large_string()), np.array([*indices[t], -1], np.int32)) for t in [NO_LANGUAGE, *terms]}
        texts: defaultdict[str, defaultdict[tuple[str, str], list[bytes]]] = defaultdict(lambda: defaultdict(list))
        size = 0
        for batch in batches:
            columns = (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3))
            for lang, source, text, tag in zip(*(column.to_pylist() for column in columns)):
                texts[tag[: -len(MARK)]][lang, source].append(text)
                size += len(text) + 1
                if size >= at_once:
                    yield summed(texts, known)
                    texts.clear()
                    size = 0
        if texts:
            yield summed(texts, known)

    def summed(texts: dict[str, dict[tuple[str, str], list[bytes]]], known: dict[str, tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        names, indices, counts, ends = [], [], [], [0]
        for tag, groups in texts.items():
            joined = pa.array([b" ".join(group).translate(LETTERS) for group in groups.values()], pa.large_binary())
            lists = pc.ascii_split_whitespace(joined.cast(pa.large_string()))
            # Text without a term at its start or end leaves an empty one, which is not kept.
            found = lists.values.dictionary_encode()
            kept, index_of = known.get(tag, known[NO_LANGUAGE])
            place = pc.fill_null(pc.index_in(found.dictionary, value_set=kept), -1).to_numpy()
            index = index_of[place][found.indices.to_numpy()]
            for group, start, end in zip(groups, lists.offsets.to_numpy(), lists.offsets.to_numpy()[1:]):
                own = index[start:end]
                different, times = np.unique(own[own >= 0], return_counts=True)
                names.append(group)
                indices.append(different)
                counts.append(times.astype(np.int64))
                ends.append(ends[-1] + len(different))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(part)) for part in (indices, counts)], ["index", "count"])
        entries = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([*(pa.array(n, pa.string()) for n in zip(*names)), entries], ["lang", "source", "entries"])

    lang = text_or_empty("lang")
    chosen = docs.select(
        lang.alias("lang"), text_or_empty("source").alias("source"), text_or_empty("text").alias("text"), tag_of(lang).alias("tag")
    )
    return cut_lineage(chosen.mapInArrow(run, "lang string, source string, entries array<struct<index: int, count: long>>"))


def vocabulary_of(docs: DataFrame, words: list[str]) -> DataFrame:
    """``index``, ``lang`` and ``term`` of the kept terms."""
    table = pd.DataFrame({"index": range(len(words)), "word": words})
    parts = F.split("word", MARK)
    return (
        docs.sparkSession.createDataFrame(table, "index int, word string")
        .where(F.col("word") != MARK)
        .select("index", F.unhex(parts[0]).cast("string").alias("lang"), parts[1].alias("term"))
    )


#: Up to here, ``SCALE (count + SMOOTHING)`` is a long.
LARGEST_SLIM = (2**63 - 1) // SCALE - SMOOTHING


def probability(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE (count + SMOOTHING) / (total + SMOOTHING terms))`` in exact integers."""
    more, below = count.cast("long") + SMOOTHING, total.cast("long") + SMOOTHING * terms
    slim = F.call_function("div", F.lit(SCALE) * more, below)
    top = F.lit(SCALE).cast("decimal(10,0)") * more.cast("decimal(20,0)")
    wide = F.call_function("div", top, below.cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + F.when(count <= LARGEST_SLIM, slim).otherwise(wide))


def numbered_groups(vectors: DataFrame) -> DataFrame:
    """``lang, source, group``: each occurring group with a number of its own; stored, so that the numbers stay."""
    return cut_lineage(vectors.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()))


def term_counts(vectors: DataFrame, names: DataFrame) -> DataFrame:
    """Occurrences per ``group`` and term ``index``, summed in the map stage first."""
    return (
        vectors.join(names, ["lang", "source"])
        .select("group", F.inline("entries"))
        .groupBy("group", "index")
        .agg(F.sum("count").alias("count"))
    )


def pair_values(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Per pair ``a < b`` of groups of a language: ``value``, the summed distance over all kept terms.

    ``groups``: group, lang, terms (V), floor; ``counts``: group, index, p, floor. A group's probabilities sum
    to at most 10^9 + V, so no sum here comes near the bound of a long. An index belongs to one language.
    """
    a = groups.select("lang", F.col("group").alias("a"), F.col("floor").alias("floor_a"), "terms")
    b = groups.select("lang", F.col("group").alias("b"), F.col("floor").alias("floor_b"))
    apart = F.abs(F.col("floor_a") - F.col("floor_b"))
    both_ways = a.join(b, "lang").where("a <> b")
    spectrum = counts.groupBy(F.col("group").alias("a"), "p").agg(F.count("*").alias("n"))
    one_sided = (
        both_ways.join(spectrum, "a")
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.sum(F.col("n") * (F.abs(F.col("p") - F.col("floor_b")) - apart)).alias("part"))
    )
    empty = both_ways.where("a < b").select("a", "b", (F.col("terms") * apart).alias("part"))
    left = counts.select("index", F.col("group").alias("a"), F.col("p").alias("p_a"), F.col("floor").alias("floor_a"))
    right = counts.select("index", F.col("group").alias("b"), F.col("p").alias("p_b"), F.col("floor").alias("floor_b"))
    overlap = (
        F.abs(F.col("p_a") - F.col("p_b"))
        - F.abs(F.col("p_a") - F.col("floor_b"))
        - F.abs(F.col("floor_a") - F.col("p_b"))
        + apart
    )
    shared = left.join(right, "index").where("a < b").groupBy("a", "b").agg(F.sum(overlap).alias("part"))
    return (
        empty.unionByName(one_sided)
        .unionByName(shared)
        .groupBy("a", "b")
        .agg(F.coalesce(F.sum("part"), F.lit(0)).cast("long").alias("value"))
    )


def source_divergence(docs: DataFrame, min_df: int = MIN_DF, top_terms: int = TOP_TERMS) -> DataFrame:
    """Per (lang, source) group the distance to each other source of its language, and its strongest terms.

    Columns: ``lang, source, part, item, value, rank``. Part ``pair``: every other source, by distance.
    Part ``term``: the ``top_terms`` kept terms that the group has and that are likelier in it than in its
    language, by the difference. Ranks go by value descending, then item by its UTF-8 bytes.

    A NULL text, lang or source counts as an empty one; an empty text still makes its group occur; repeated
    rows count each; a language without kept terms has distances 0 and no terms; a language with one source
    has no pairs. Other columns are ignored. An empty table gives an empty table.
    """
    words = kept_terms(docs, min_df)
    vectors, vocabulary = group_vectors(docs, words), vocabulary_of(docs, words)
    names = numbered_groups(vectors)
    counted = cut_lineage(term_counts(vectors, names))
    terms = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counted.groupBy("group").agg(F.sum("count").alias("total"))
    no_terms = F.coalesce("terms", F.lit(0))
    groups = cut_lineage(
        names.join(totals, "group", "left")
        .join(terms, "lang", "left")
        .select("group", "lang", F.coalesce("total", F.lit(0)).alias("total"), no_terms.alias("terms"))
        .withColumn("floor", probability(F.lit(0), F.col("total"), F.col("terms"))),
    )
    likely = cut_lineage(
        counted.join(groups, "group").select(
            "group", "index", "floor", probability(F.col("count"), F.col("total"), F.col("terms")).alias("p")
        ),
    )
    # Distances need a floor; without kept terms there is none, and no distance either.
    pairs = pair_values(groups.withColumn("floor", F.coalesce("floor", F.lit(0))), likely)
    mirrored = pairs.select(F.col("a").alias("group"), F.col("b").alias("other"), "value").unionByName(
        pairs.select(F.col("b").alias("group"), F.col("a").alias("other"), "value")
    )
    others = names.select(F.col("group").alias("other"), F.col("source").alias("item"))

    by_lang = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.max("terms").alias("all_terms"))
    overall = (
        counted.groupBy("index")
        .agg(F.sum("count").alias("all_count"))
        .join(vocabulary, "index")
        .join(by_lang, "lang")
        .select("index", "term", probability(F.col("all_count"), F.col("all_total"), F.col("all_terms")).alias("q"))
    )
    above = (
        likely.join(overall, "index")
        .where("p > q")
        .select("group", F.col("term").alias("item"), (F.col("p") - F.col("q")).cast("long").alias("value"))
    )

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("group").orderBy(F.desc("value"), F.asc("item"))
        return rows.select("group", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    parts = ranked(mirrored.join(others, "other"), "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top_terms))
    return parts.join(names, "group").select("lang", "source", "part", "item", "value", "rank")
