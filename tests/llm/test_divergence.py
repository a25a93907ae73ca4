"""Source divergence against a brute-force count in exact integers."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from random import Random

from pyspark.sql import functions as F

from cohortlens.llm import source_divergence as sd
from conftest import plan_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def by_force(rows, min_df, top):
    lower = str.maketrans(sd.UPPER, sd.LOWER)
    docs = [((lang or "", source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)))
            for _, text, lang, source, _ in rows]
    frequency = defaultdict(Counter)
    counts = defaultdict(Counter)
    for (lang, source), terms in docs:
        frequency[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in frequency:
        kept = [term for term, n in frequency[lang].items() if n >= min_df]
        sources = sorted({s for la, s in counts if la == lang})

        def spread(counter):
            total = sum(counter[term] for term in kept)
            return {term: 1 + sd.SCALE * (counter[term] + 5) // (total + 5 * len(kept)) for term in kept}

        p = {s: spread(counts[lang, s]) for s in sources}
        q = spread(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def messy(seed=6):
    random = Random(seed)
    words = "Ab ab aB zed über ÜBER 世界 it's x9y stop a_b \x00nul é".split()
    rows = []
    for k in range(400):
        lang, source = random.choice(["en", "de", "", None, "e\x00n"]), random.choice(["s1", "s2", "", None, "src\x003"])
        rows.append((k, " ".join(random.choices(words + [f"w{'abcdefghij'[k % 7]}"], k=random.randint(0, 25))), lang, source, 0))
    rows += [(1, None, "en", "s1", None), (None, None, None, None, None), (5, "", "solo", "one", 0), (6, "only once", "solo", "one", 0)]
    rows += [(7, "", "bare", "x", 0), (8, "y", "bare", "z", 0), (9, "ab " * 30_000, "en", "s2", 0)]
    return rows + rows[3:6]


def test_all_rows_against_brute_force(spark):
    rows = messy()
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(n) for n in ("terms", "counts", "index", "p", "item")))
    for min_df, top in ((1, 3), (4, 50), (30, 50), (1000, 50)):
        result = sd.source_divergence(frame, min_df, top)
        assert result.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"),
                                 ("value", "bigint"), ("rank", "int")]
        assert sorted(map(tuple, result.collect())) == by_force(rows, min_df, top)


def test_an_empty_table(spark):
    assert sd.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_probabilities_are_exact_beyond_doubles(spark):
    big = 10**15 + 7
    row = spark.range(1).select(
        sd.probability(F.lit(big), F.lit(3 * big), F.lit(1000)).alias("p"), sd.probability(F.lit(0), F.lit(0), F.lit(0)).alias("none")
    ).first()
    assert row["p"] == 1 + sd.SCALE * (big + 5) // (3 * big + 5000) and row["none"] is None


def test_terms_arrive_as_a_list_that_spark_does_not_split(spark):
    """A text without terms has an empty list; Spark's own split would copy each term several times."""
    texts = [("a B a-b \u00c9\u00e9", "x"), ("", "x"), (None, None), ("1 2", ""), (" c", None)]
    docs = spark.createDataFrame([(k, text, lang, "s", 0) for k, (text, lang) in enumerate(texts)], SCHEMA)
    listed = docs.select("doc_id", sd.term_lists().alias("terms"))
    got = {row["doc_id"]: row["terms"] for row in listed.collect()}
    assert got == {0: ["78:a", "78:b", "78:\u00c9\u00e9"], 1: [], 2: [], 3: [], 4: [":c"]}
    assert "split(" not in plan_of(listed)


def test_a_task_lists_a_term_only_until_it_is_known_to_be_kept(spark):
    """The fit need not see a frequent term more than ``min_df`` times a task, and keeps the same terms."""
    texts = [(f"the The of w{'abcdefghij'[k % 10]} {'x' * (k + 1)}", "en" if k % 4 else "de") for k in range(200)]
    docs = spark.createDataFrame([(k, text, lang, "s", 0) for k, (text, lang) in enumerate(texts)], SCHEMA).coalesce(1)
    different = Counter(term for k, (text, lang) in enumerate(texts)
                        for term in {f"{lang.encode().hex().upper()}:{word}" for word in text.lower().split()})
    for min_df, remembered in ((1, 1 << 18), (4, 1 << 18), (4, 7), (30, 50)):
        listed = Counter(term for row in docs.select(sd.term_lists(min_df, remembered).alias("t")).collect() for term in row["t"])
        if remembered > len(different):
            assert listed == {term: min(n, min_df) for term, n in different.items()}
        assert {term for term, n in listed.items() if n >= min_df} == {term for term, n in different.items() if n >= min_df}
        assert sorted(sd.kept_terms(docs, min_df)) == sorted([sd.MARK, *(t for t, n in different.items() if n >= min_df)])


def test_probabilities_on_both_sides_of_the_bound_of_a_long(spark):
    for count in (0, sd.LARGEST_SLIM - 1, sd.LARGEST_SLIM, sd.LARGEST_SLIM + 1, sd.LARGEST_SLIM + 2):
        row = spark.createDataFrame([(count, 3 * count, 11)], "c long, t long, v long").select(
            sd.probability(F.col("c"), F.col("t"), F.col("v")).alias("p")
        ).first()
        assert row["p"] == 1 + sd.SCALE * (count + 5) // (3 * count + 55)


def test_texts_counted_together_keep_their_groups(spark):
    """A portion's texts share one dictionary of terms; empty texts, unkept languages and byte 0x85 change nothing."""
    texts = [("b a B", "en", "s"), (" a\u0085b a\u00a0 ", "en", "t"), ("", "en", "none"), ("a", "fr", "s"), ("c 1 a", "en", "s"),
             (" 1 d ", None, None), ("zz a", "e:n", "s"), ("\u00c9 a\u0085b", "en", "s")]
    docs = spark.createDataFrame([(k, *row, 0) for k, row in enumerate(texts)], SCHEMA).coalesce(1)
    words = [sd.MARK, "656E:b", "656E:a\u0085b", "656E:a", "653A6E:a", ":a", ":d"]
    wanted = {("en", "s"): {1: 2, 2: 1, 3: 2}, ("en", "t"): {2: 1}, ("en", "none"): {}, ("fr", "s"): {}, ("", ""): {6: 1}, ("e:n", "s"): {4: 1}}
    for at_once in (1, 9, sd.BYTES_AT_ONCE):
        got = defaultdict(Counter)
        rows = sd.group_vectors(docs, words, at_once).collect()
        for lang, source, entries in rows:
            got[lang, source].update(dict(map(tuple, entries)))
        assert got == wanted and (len(rows) == len(wanted) or at_once < sd.BYTES_AT_ONCE)
