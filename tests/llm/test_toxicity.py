"""Toxicity: held-out accuracy on texts with known words, and edge rows."""

from __future__ import annotations

from random import Random

from pyspark.sql import functions as F

from cohortlens.llm import toxicity as tox
from cohortlens.llm.common import ship_code

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
PLAIN = "the river of stones and small green birds that went home for tea with an old friend by rail".split()
RUDE = ["zorgmuck", "blithead", "quagface"]


def corpus(n=1500, seed=4):
    random = Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = random.choices(PLAIN, k=random.randint(20, 90))
        toxic = int(random.random() < 0.25)
        for _ in range(random.randint(2, 6) * toxic):
            words.insert(random.randrange(len(words)), random.choice(RUDE) + random.choice(["", "s", "ish"]))
        docs.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, toxic))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    ship_code(spark)
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DOCS).select("*", *(F.lit(1.0).alias(n) for n in ("features", "raw", "score", "label")))
    result = tox.toxicity(frame, spark.createDataFrame(labels, LABELS))
    assert result.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    truth = {doc: toxic for doc, _, toxic in labels}
    rows = result.collect()
    held = [row for row in rows if row["held_out"]]
    assert len(rows) == len(docs) and 200 < len(held) < 400
    assert sum(row["predicted"] == truth[row["doc_id"]] for row in held) >= 0.97 * len(held)
    assert all(0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5) for row in rows)


def test_held_out_labels_language_and_source_have_no_say(spark):
    ship_code(spark)
    docs, labels = corpus(400)
    first = tox.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    held = {row["doc_id"] for row in first if row["held_out"]}
    flipped = [(doc, 0, 1 - toxic if doc in held else toxic) for doc, _, toxic in labels]
    renamed = [(doc, text, "xx", str(doc), 9) for doc, text, *_ in docs]
    second = tox.toxicity(spark.createDataFrame(renamed, DOCS), spark.createDataFrame(flipped, LABELS)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_edge_rows_and_missing_labels(spark):
    ship_code(spark)
    docs, labels = corpus(300)
    edges = [(None, "no id", None, None, None), (9001, None, None, None, None), (9002, "", "", "", 0), (9003, " \n ", "", "", 0),
             (9004, "!" * 50_000, "", "", 0), (9005, "you zorgmuck " * 30_000, "", "", 0), (7, "again", "", "", 0)]
    frame = spark.createDataFrame(docs + edges + edges, DOCS)
    odd = [(None, 1, 1), (3, 1, None), (4, None, 1), (4, 1, 0), (10**12, 1, 1)]
    rows = tox.toxicity(frame, spark.createDataFrame(labels + odd, LABELS)).collect()
    assert len(rows) == len(docs) + 2 * len(edges) and all(0 <= row["score"] <= 1 for row in rows)
    none = spark.createDataFrame([], LABELS)
    assert {row["score"] for row in tox.toxicity(frame, none).collect()} == {0.0}
    clean = spark.createDataFrame([(doc, 1, 0) for doc, *_ in docs], LABELS)
    assert {row["score"] for row in tox.toxicity(frame, clean).collect()} == {0.0}
    assert tox.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).collect() == []


def test_the_sample_bound_holds(spark):
    ship_code(spark)
    docs, labels = corpus(300)
    known = tox.labelled(spark.createDataFrame(docs * 3, DOCS), spark.createDataFrame(labels * 2, LABELS), max_labelled=50)
    rows = known.collect()
    assert len(rows) == 50 == len({row["doc_id"] for row in rows})
    assert all(row["fold"] != tox.HELD_OUT for row in rows)


def test_features_of_obfuscated_and_addressed_words():
    marks = tox.Marks({"zorgmuck": 3.0, "blit*": 2.0})
    names = dict(zip(tox.FEATURES, marks.features("You are a zorgmuck, said ANN!! z0rgmuck z.o.r.g.m.u.c.k BLITHEAD soooo")))
    assert names["hits_per_word"] == 2 / 10 and names["weight_per_word"] == 0.5 and names["strongest_hit"] == 3.0
    assert names["hidden_hits"] == 0.6 and names["hits_near_second_person"] == 0.5
    assert names["capital_words"] == 0.2 and names["exclamations"] == 0.2 and names["letter_runs"] == 0.1
    assert marks.features("") == [0.0] * len(tox.FEATURES)
