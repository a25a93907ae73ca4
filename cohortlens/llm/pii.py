"""Personal data found and sanitised, by patterns and by what terms disclose about it.

Only DataFrame functions. The base spans are e-mail addresses, IP addresses, card and telephone numbers
found by pattern. Each distinct value is a protected entity. Terms that stand near an entity may
disclose it; how strongly is estimated from the whole corpus as the share of the entity's information
that the term gives away,

    PMI(term; entity) / IC(entity) = log(P(entity | term) / P(entity)) / -log P(entity)

over documents, which is 1 if the term occurs only with the entity. A term that reaches
``GENERALISE_AT`` in enough independent contexts is generalised in the documents that hold the entity,
and removed from ``REMOVE_AT`` on. Copies of a passage are one context, so boilerplate around a copied
address discloses nothing.

The patterns are written so that each text is read in linear time: a run that could be re-entered at
every character can only be entered at its first one, and loops are possessive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.sized import small_side
from cohortlens.llm.common import packed, text_or_empty
from cohortlens.session import cut_lineage

#: Code points on either side of a span whose words are its context, and words taken of them.
REACH = 64
CONTEXT_WORDS = 5
#: Independent contexts a term needs before anything is concluded from it.
MIN_CONTEXTS = 3
GENERALISE_AT = 0.9
REMOVE_AT = 0.98
TERM = r"[\p{L}\p{N}]++"
#: Numbers summed at a time where positions are added up; keeps the work near linear in the matches.
RUN = 512
#: Candidate terms up to which their table is broadcast to the corpus count.
SMALL_TERMS = 100_000


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def passes_luhn(value: Column) -> Column:
    def counted(digit: Column, place: Column) -> Column:
        twice = digit.cast("int") * (1 + place % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    backwards = F.split(F.reverse(digits(value)), "")
    weights = F.transform(F.filter(backwards, lambda digit: digit != ""), counted)
    return F.aggregate(weights, F.lit(0), lambda total, weight: total + weight) % 10 == 0


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: its pattern, which matches count, and how a value is compared."""

    pattern: str
    counts: Callable[[Column], Column]
    value: Callable[[Column], Column]


KINDS = {
    "email": Kind(
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda value: F.lit(True),
        F.lower,
    ),
    "ip": Kind(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", is_ip, lambda value: value),
    # A chain of digits with single separators; only chains of 12 to 19 digits, from first to last.
    "card": Kind(
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", passes_luhn, digits
    ),
    "phone": Kind(
        r"\+[0-9][\x20().0-9-]+[0-9]", lambda value: F.length(digits(value)).between(9, 15), digits
    ),
}


def running(values: str, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The running sums (or another combination) of an array column of numbers from 0 on.

    Each step copies what was gathered so far, so steps go in runs of ``RUN`` and the runs are joined.
    """

    def scan(numbers: Column) -> Column:
        zero = F.array().cast("array<bigint>")

        def step(sums: Column, x: Column) -> Column:
            last = F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0).cast("long"))
            return F.concat(sums, F.array(combine(last, x)))

        return F.aggregate(numbers, zero, step)

    n_runs = F.ceil(F.size(values) / RUN).cast("int")
    starts = F.when(n_runs > 0, F.sequence(F.lit(1), n_runs * RUN, F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda start: scan(F.slice(values, start, RUN)))
    totals = scan(F.transform(runs, lambda sums: F.element_at(sums, -1)))
    before = F.concat(F.array(F.lit(0).cast("long")), totals)
    joined = F.zip_with(
        runs, F.slice(before, 1, n_runs), lambda sums, start: F.transform(sums, lambda x: combine(start, x))
    )
    return F.flatten(joined)


def with_places(df: DataFrame, text: str, pattern: dict[str, str], where: Column | None = None) -> DataFrame:
    """``df`` with, per name in ``pattern``, the matches in column ``text`` as an array of
    (start, end, value, before, after): code points, end exclusive, and the text beside the match.

    The pieces between matches give the places: the length of what came before is the start.
    """
    columns = df.columns
    found = {f"{name}_found": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for name, p in pattern.items()}
    if where is not None:
        found = {name: F.when(where, value) for name, value in found.items()}
    df = df.withColumns(found)
    df = df.withColumns(
        {
            f"{name}_pieces": F.when(F.size(f"{name}_found") > 0, F.split(text, p, -1)).otherwise(F.array(F.lit("")))
            for name, p in pattern.items()
        }
    )
    df = df.withColumns(
        {
            f"{name}_sizes": F.zip_with(
                F.slice(f"{name}_pieces", 1, F.size(f"{name}_pieces") - 1),
                F.coalesce(f"{name}_found", F.array().cast("array<string>")),
                lambda piece, match: (F.length(piece) + F.length(match)).cast("long"),
            )
            for name in pattern
        }
    )
    df = df.withColumns({f"{name}_ends": running(f"{name}_sizes") for name in pattern})

    def places(name: str) -> Column:
        pieces, matches = F.col(f"{name}_pieces"), F.size(f"{name}_ends")
        together = F.arrays_zip(
            F.col(f"{name}_ends").alias("end"),
            F.coalesce(f"{name}_found", F.array().cast("array<string>")).alias("value"),
            F.slice(pieces, 1, matches).alias("left"),
            F.slice(pieces, 2, matches).alias("right"),
        )
        return F.transform(
            together,
            lambda m: F.struct(
                (m["end"] - F.length(m["value"])).alias("start"),
                m["end"].alias("end"),
                m["value"].alias("value"),
                m["left"].substr(F.lit(-REACH), F.lit(REACH)).alias("before"),
                m["right"].substr(F.lit(1), F.lit(REACH)).alias("after"),
            ),
        )

    return df.select(*columns, *(places(name).alias(name) for name in pattern))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with an array column of base spans per kind."""

    def counted(name: str, kind: Kind) -> Column:
        return F.filter(f"pii_{name}", lambda span: kind.counts(span["value"]))

    found = with_places(df, text, {f"pii_{name}": kind.pattern for name, kind in KINDS.items()})
    return found.withColumns({f"pii_{name}": counted(name, kind) for name, kind in KINDS.items()})


def marked(name: str, rank: int, kind: str) -> Column:
    """The spans of one kind as (start, rank of the kind, end, kind, value, before, after)."""
    return F.transform(
        name,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(rank).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            s["value"].alias("value"),
            s["before"].alias("before"),
            s["after"].alias("after"),
        ),
    )


def entities(found: DataFrame) -> DataFrame:
    """A row per span: document key, protected entity, and the distinct terms near it."""

    def terms(text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))

    spans = found.select("key", "content", F.explode("base").alias("span"))
    value = F.lit(None)
    for name, kind in KINDS.items():
        value = F.when(F.col("span.kind") == name, kind.value(F.col("span.value"))).otherwise(value)
    before, after = terms(F.col("span.before")), terms(F.col("span.after"))
    near = F.concat(F.reverse(F.slice(F.reverse(before), 1, CONTEXT_WORDS)), F.slice(after, 1, CONTEXT_WORDS))
    return spans.select(
        "key", "content", F.concat("span.kind", F.lit(":"), value).alias("entity"), F.array_distinct(near).alias("near")
    )


def disclosing_terms(docs: DataFrame, mentions: DataFrame, n_docs: int, least: float) -> DataFrame:
    """Terms that give away at least ``least`` of an entity's information: ``entity``, ``term``, ``share``.

    Documents of the entity and of the pair are counted among the mentions. A term is in at least as many
    documents as it is near any entity, which bounds its share from above and settles most pairs, common
    words first; only the others are counted over all texts of the corpus. Every count starts in the map
    stage.
    """
    doc = F.struct("key", "content")

    def share(n_term: str) -> Column:
        information = -F.log2(F.col("n_entity") / n_docs)
        mutual = F.log2(F.col("n_pair") * F.lit(float(n_docs)) / (F.col(n_term) * F.col("n_entity")))
        return F.when(information > 0, mutual / information).otherwise(0.0)

    held = mentions.groupBy("entity").agg(F.count_distinct(doc).alias("n_entity"))
    near = cut_lineage(
        mentions.select("key", "content", "entity", F.xxhash64("near").alias("context"), F.explode("near").alias("term"))
    )
    near_any = near.groupBy("term").agg(F.count_distinct(doc).alias("n_near"))
    pairs = cut_lineage(
        near.groupBy("entity", "term")
        .agg(F.count_distinct(doc).alias("n_pair"), F.count_distinct("context").alias("n_contexts"))
        .where(F.col("n_contexts") >= MIN_CONTEXTS)
        .join(held, "entity")
        .join(near_any, "term")
        .where(share("n_near") >= least)
    )
    wanted = small_side(pairs.select("term").distinct(), SMALL_TERMS)
    in_corpus = (
        docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )
    shares = pairs.join(in_corpus, "term").select("entity", "term", share("n_term").alias("share"))
    return cut_lineage(shares.where(F.col("share") >= least))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with hashes of id and text; rows equal in both have equal spans."""
    return docs.withColumns(
        {
            "pii_key": F.xxhash64(F.col("doc_id").cast("string")),
            "pii_content": F.xxhash64("text"),
            "pii_text": text_or_empty(),
        }
    )


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_base``, the base spans of all kinds in order.

    Worked out in several projections, so that each match is made once; a filter on the spans would be
    pushed below them and repeat the work, so none stands above this before the spans are stored.
    """
    merged = F.concat(*(marked(f"pii_{name}", rank, name) for rank, name in enumerate(KINDS)))
    found = base_spans(docs, "pii_text").withColumn("pii_base", F.array_sort(merged))
    return found.drop(*(f"pii_{name}" for name in KINDS))


def bare(spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(*(s[name].alias(name) for name in ("start", "rank", "end", "kind"))))


def stored_spans(docs: DataFrame) -> DataFrame:
    """Per row: id, the hashes and the base spans, written once. Small beside the texts."""
    return cut_lineage(with_base(keyed(docs.select("doc_id", "text"))).drop("text", "pii_text"))


def disclosing_spans(docs: DataFrame, stored: DataFrame, generalise_at: float, remove_at: float) -> DataFrame:
    """Per document (by its hashes) with any: ``pii_extra``, the spans of terms that disclose one of its entities.

    Kind ``term`` is to be generalised, ``secret`` to be removed. Words inside base spans are left out.
    Only texts that hold such a term are read again with their places.
    """
    found = stored.select(F.col("pii_key").alias("key"), F.col("pii_content").alias("content"), F.col("pii_base").alias("base"))
    mentions = cut_lineage(entities(found))
    texts = keyed(docs.select("doc_id", "text")).select("pii_key", "pii_content", F.col("pii_text").alias("text"))
    terms = disclosing_terms(texts, mentions, max(1, stored.count()), generalise_at)
    per_doc = cut_lineage(
        mentions.select("key", "content", "entity")
        .distinct()
        .join(terms, "entity")
        .groupBy("key", "content", "term")
        .agg(F.max("share").alias("share"))
        .groupBy(F.col("key").alias("pii_key"), F.col("content").alias("pii_content"))
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("pii_terms"))
    )
    same = ["pii_key", "pii_content"]
    held = per_doc.join(stored.select(*same, "pii_base").dropDuplicates(same), same)
    words = with_places(texts.join(held, same).dropDuplicates(same), "text", {"pii_words": TERM})

    def outside(word: Column) -> Column:
        clash = F.exists("pii_base", lambda s: (s["start"] < word["end"]) & (word["start"] < s["end"]))
        return F.col("pii_terms")[F.lower(word["value"])].isNotNull() & ~clash

    def added(word: Column) -> Column:
        remove = F.col("pii_terms")[F.lower(word["value"])] >= remove_at
        kind = F.when(remove, "secret").otherwise("term")
        rank = F.when(remove, len(KINDS) + 1).otherwise(len(KINDS))
        return F.struct(word["start"].alias("start"), rank.alias("rank"), word["end"].alias("end"), kind.alias("kind"))

    return cut_lineage(words.select(*same, F.transform(F.filter("pii_words", outside), added).alias("pii_extra")))


def every_span() -> Column:
    """Base and added spans in order."""
    return F.when(F.col("pii_extra").isNull(), bare("pii_base")).otherwise(
        F.array_sort(F.concat(bare("pii_base"), F.col("pii_extra")))
    )


def as_text(spans: str) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(
    docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the number of base spans per kind, ``base`` and ``spans`` as text.

    A NULL or empty text has no spans. Repeated rows have the same spans; rows that repeat an id with
    another text are documents of their own. Other columns of ``docs`` are ignored. An empty table gives
    an empty table.
    """

    def count(name: str) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    stored = stored_spans(docs)
    extra = disclosing_spans(docs, stored, generalise_at, remove_at)
    found = stored.join(extra, ["pii_key", "pii_content"], "left").withColumn("pii_spans", every_span())
    return found.select(
        "doc_id", *map(count, KINDS), as_text("pii_base").alias("base"), as_text("pii_spans").alias("spans")
    )


#: What stands for a span; a term is generalised to the kind of word it is.
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "", "term": None}


def sanitise(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """``docs`` with all spans replaced: base spans by their kind, generalised terms by the kind of word
    (number, name, word), removed terms by nothing. Of spans that overlap, the union is replaced, by the
    mask of the first. Texts without spans stay as they are; ``n_chars``, if there, follows the text.
    """

    def mask(kind: Column, value: Column) -> Column:
        masked = (
            F.when(value.rlike(r"^\p{N}+$"), "<NUMBER>").when(value.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
        )
        for name, string in MASKS.items():
            if string is not None:
                masked = F.when(kind == name, string).otherwise(masked)
        return masked

    def cut(start: Column, end: Column) -> Column:
        return F.array_join(F.slice("pii_chars", (start + 1).cast("int"), (end - start).cast("int")), "")

    extra = disclosing_spans(docs, stored_spans(docs), generalise_at, remove_at)
    spanned = (
        with_base(keyed(docs.select(packed(docs).alias("row"), "doc_id", "text")))
        .join(extra, ["pii_key", "pii_content"], "left")
        .withColumn("pii_spans", every_span())
        .withColumn("pii_far", F.col("pii_spans.end"))
        .withColumn("pii_far", running("pii_far", F.greatest))
    )
    # A span that starts at or after the furthest end so far begins a new union.
    reached = F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col("pii_far")), 1, F.size("pii_far"))
    zipped = F.arrays_zip(F.col("pii_spans").alias("span"), reached.alias("reached"))
    heads = spanned.withColumn("pii_heads", F.filter(zipped, lambda z: z["span"]["start"] >= z["reached"]))
    last = F.slice("pii_far", F.greatest(F.size("pii_far"), F.lit(1)), 1)
    ends = F.concat(F.slice(F.col("pii_heads.reached"), 2, F.greatest(F.size("pii_heads"), F.lit(1))), last)
    unions = F.arrays_zip(F.col("pii_heads.span").alias("span"), F.col("pii_heads.reached").alias("from"), ends.alias("end"))
    some = F.size("pii_spans") > 0
    # Characters as an array: each slice costs its own length, so the text is rebuilt in linear time.
    ready = heads.withColumns(
        {"pii_unions": unions, "pii_chars": F.when(some, F.filter(F.split("text", ""), lambda c: c != ""))}
    )
    parts = F.transform(
        "pii_unions",
        lambda u: F.concat(
            cut(u["from"], u["span"]["start"]), mask(u["span"]["kind"], cut(u["span"]["start"], u["end"]))
        ),
    )
    tail = cut(F.array_max("pii_far"), F.size("pii_chars").cast("long"))
    replaced = ready.withColumn("pii_new", F.when(some, F.concat(F.array_join(parts, ""), tail)))
    values = {name: F.col(f"row.`{name}`") for name in docs.columns}
    values["text"] = F.when(some, F.col("pii_new")).otherwise(F.col("text"))
    if "n_chars" in values:
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(some, F.length("pii_new").cast(kind)).otherwise(values["n_chars"])
    return replaced.select(*(value.alias(name) for name, value in values.items()))
