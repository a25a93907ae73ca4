"""Repair of damaged conversations at the least cost, by a grammar-compressed dynamic programme.

1. Turns become slim rows (no texts), sorted over the whole table by conversation, turn, role and the
   MD5 of the text. A row's place in that order says which rows of a conversation come before it, so a
   conversation may lie in any number of partitions.
2. Faults: blank and truncated are seen on the row, a duplicate is any row behind the first place of its
   (conversation, role, text), which is a minimum taken in the map stage.
3. Each conversation's turns become a text of one symbol per turn, in blocks of ``BLOCK`` places.
4. Re-Pair: the most frequent pairs of neighbouring symbols over all different block texts, weighted by
   how often each text occurs, become rules and are replaced; then again, until no pair occurs twice.
   Only pair counts reach the driver, at most one per pair of symbols.
5. Each rule gets its min-plus transfer matrix once, from those of its two symbols
   (``repair_grammar``); each different block text gets the product of its few symbols' matrices; each
   conversation is the product of its blocks.
6. Edits go back to the turns by their place, and meet the texts in one sorted stream.

Texts are shuffled once. The audit of a conversation is one value with a letter per turn, so a
conversation's symbols are no longer than its result; nothing else of a conversation is ever held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from cohortlens.llm import repair_grammar as grammar
from cohortlens.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

#: Places per block, and limits of the grammar. The limits only bound the compression, no result.
BLOCK_BITS = 12
MAX_RULES, MAX_ROUNDS = 256, 8

#: How rows are damaged: by the remainder of a checksum.
DAMAGES = 20
DROPPED, EMPTIED, UNENDED, REPEATED, TURNED_USER = range(5)


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(chats: DataFrame) -> DataFrame:
    """The rows left of ``chats`` after damage: ``conv_id, turn, role, text``, a repeated one twice.

    A NULL role or text becomes one space; a NULL id or turn stays and counts as one space in the checksum.
    """
    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % DAMAGES
    text = (
        F.when(F.col("draw") == EMPTIED, "")
        .when(F.col("draw") == UNENDED, F.translate(spaced("text"), "".join(ENDS), ""))
        .otherwise(spaced("text"))
    )
    return (
        chats.select("conv_id", "turn", "role", "text", draw.alias("draw"))
        .where(F.col("draw") != DROPPED)
        .select(
            "conv_id",
            "turn",
            F.when(F.col("draw") == TURNED_USER, "user").otherwise(spaced("role")).alias("role"),
            text.alias("text"),
            F.explode(F.when(F.col("draw") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
        )
        .drop("again")
    )


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Slim rows in the order of the whole table, with their ``place`` in it; stored.

    The last sort column is only there to let very many equal rows be dealt to several tasks.
    """
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    slim = rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.md5("text")).alias("digest"),
        F.when(end == "", "blank").when(end.isin(*ENDS), "whole").otherwise("truncated").alias("state"),
        F.monotonically_increasing_id().alias("spread"),
    )
    order = ["conv_id", "turn", "role", "digest", "spread"]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(placed.drop("spread").withColumn("place", F.monotonically_increasing_id()))


def with_faults(turns: DataFrame) -> DataFrame:
    """``turns`` with ``fault`` (blank, duplicate, truncated or whole) and ``symbol``."""
    key = ["conv_id", "role", "digest"]
    firsts = (
        turns.where("state <> 'blank'")
        .groupBy(*key)
        .agg(F.min("place").alias("first_place"), F.count("*").alias("rows"))
        .where("rows > 1")
        .select(*(F.col(name).alias(f"first_{name}") for name in key), "first_place")
    )
    same = F.lit(True)
    for name in key:
        same = same & F.col(name).eqNullSafe(F.col(f"first_{name}"))
    repeated = F.coalesce((F.col("state") != "blank") & (F.col("place") > F.col("first_place")), F.lit(False))
    fault = F.when(repeated, "duplicate").otherwise(F.col("state"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = (
        F.when(F.col("fault").isin("blank", "duplicate"), grammar.GONE)
        .when(F.col("fault") == "truncated", F.upper("kind"))
        .otherwise(F.col("kind"))
    )
    return (
        turns.join(firsts, same, "left")
        .select("conv_id", "turn", "role", "digest", "place", fault.alias("fault"), kind.alias("kind"))
        .withColumn("symbol", symbol)
    )


def legal(before: Column, after: Column) -> Column:
    return F.concat(before, after).isin("su", "ua", "au")


def blocks_of(turns: DataFrame) -> DataFrame:
    """Per conversation and block: its ``symbols``, ``kinds``, ``first_place``, counts of faults and of illegal neighbours."""
    kinds = F.col("sorted.kind")
    n = F.size("sorted")
    pairs = F.zip_with(F.slice(kinds, F.lit(1), n - 1), F.slice(kinds, F.lit(2), n), lambda a, b: a.isNotNull() & b.isNotNull() & ~legal(a, b))
    return (
        turns.groupBy("conv_id", F.shiftright("place", BLOCK_BITS).alias("block"))
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "symbol", "kind"))).alias("sorted"),
            *(F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")),
        )
        .select(
            "conv_id",
            "block",
            F.array_join("sorted.symbol", "").alias("symbols"),
            F.element_at(kinds, 1).alias("first_kind"),
            F.element_at(kinds, -1).alias("last_kind"),
            F.element_at("sorted.place", 1).alias("first_place"),
            F.size(F.filter(pairs, lambda wrong: wrong)).cast("long").alias("illegal"),
            "blank",
            "duplicate",
            "truncated",
        )
    )


def replaced(rules: list[tuple[str, str]]) -> Column:
    """``symbols`` with the rules applied in their order."""
    if not rules:
        return F.col("symbols")
    pairs = F.lit([left + right for left, right in rules])
    names = F.lit([chr(grammar.FIRST_RULE + place) for place in range(len(rules))])
    return F.aggregate(
        F.arrays_zip(pairs.alias("pair"), names.alias("name")), F.col("symbols"), lambda text, r: F.replace(text, r["pair"], r["name"])
    )


def re_pair(texts: DataFrame) -> tuple[list[tuple[str, str]], DataFrame]:
    """The rules, and the different ``symbols`` of ``texts`` (with how ``often``) with their ``packed`` form."""
    rules: list[tuple[str, str]] = []
    for _ in range(MAX_ROUNDS):
        characters = F.split("packed", "")
        n = F.size("characters")
        neighbours = F.zip_with(
            F.slice("characters", F.lit(1), n - 1), F.slice("characters", F.lit(2), n), lambda a, b: F.concat(a, b)
        )
        counts = (
            texts.select(replaced(rules).alias("packed"), "often")
            .where(F.length("packed") > 1)
            .select(characters.alias("characters"), "often")
            .select(F.explode(F.slice(neighbours, F.lit(1), n - 1)).alias("pair"), "often")
            .groupBy("pair")
            .agg(F.sum("often").alias("often"))
            .where("often > 1")
        )
        found = [(row["pair"], row["often"]) for row in counts.collect()]
        pairs = grammar.chosen_pairs(found, MAX_RULES - len(rules))
        if not pairs:
            break
        rules += [(pair[0], pair[1]) for pair in pairs]
    return rules, texts.select("symbols", replaced(rules).alias("packed"))


WAY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
MATRIX = "array<struct<start:int,end:int,cost:long,audit:string>>"


def matrices_of(packed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``symbols`` and the transfer ``matrix`` of each different block text, by the shared matrices of the rules."""

    @F.arrow_udf(MATRIX)
    def evaluated(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = grammar.rule_matrices(rules)
        for texts in batches:
            found = (sorted(grammar.sequence_matrix(text, known).items()) for text in texts.to_pylist())
            yield pa.array(
                [[(*ends, cost, grammar.flat(audit)) for ends, (cost, audit) in matrix] for matrix in found], pa.list_(WAY)
            )

    return packed.select("symbols", evaluated("packed").alias("matrix"))


TEXTS = pa.list_(pa.string())
SOLUTION = pa.struct([("cost", pa.int64()), ("audits", TEXTS), ("roles", TEXTS)])
REPAIR = StructType(
    [
        StructField("cost", LongType()),
        StructField("audits", ArrayType(StringType())),
        StructField("roles", ArrayType(StringType())),
    ]
)


@F.arrow_udf(REPAIR)
def solved(parts: pa.Array, symbols: pa.Array) -> pa.Array:
    """The cheapest repair from the matrices of a conversation's blocks, cut at the blocks again."""
    out = []
    for matrices, texts in zip(parts.to_pylist(), symbols.to_pylist()):
        blocks = [{(w["start"], w["end"]): (w["cost"], w["audit"]) for w in matrix} for matrix in matrices]
        cost, audits, states = grammar.cheapest(blocks)
        out.append((cost, audits, [grammar.roles_after(a, t, s) for a, t, s in zip(audits, texts, states)]))
    return pa.array(out, SOLUTION)


def repairs(turns: DataFrame) -> DataFrame:
    """Per conversation with turns: its blocks (with audit and roles each), ``cost``, ``audit`` and counts; stored.

    ``turns`` is the result of ``with_faults``.
    """
    blocks = cut_lineage(blocks_of(turns))
    texts = cut_lineage(blocks.groupBy("symbols").agg(F.count("*").alias("often")))
    rules, packed = re_pair(texts)
    solved_blocks = blocks.join(matrices_of(packed, rules), "symbols")
    part = F.struct("block", "symbols", "first_kind", "last_kind", "first_place", "matrix")
    grouped = solved_blocks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        *(F.sum(name).alias(name) for name in ("illegal", "blank", "duplicate", "truncated")),
    )
    joints = F.size(
        F.filter(
            F.sequence(F.lit(1), F.size("parts")),
            lambda k: (k > 1)
            & ~legal(F.element_at("parts.last_kind", F.greatest(k - 1, F.lit(1))), F.element_at("parts.first_kind", k)),
        )
    )
    return cut_lineage(
        grouped.withColumn("repair", solved("parts.matrix", "parts.symbols")).select(
            "conv_id",
            "blank",
            "duplicate",
            "truncated",
            (F.col("illegal") + joints).alias("illegal"),
            "repair.cost",
            F.array_join("repair.audits", "").alias("audit"),
            F.arrays_zip(F.col("parts.first_place").alias("place"), F.col("repair.audits").alias("audit"), F.col("repair.roles").alias("roles")).alias("blocks"),
        )
    )


#: One turn's letters of an audit: inserts before it, its own, and after the last turn also those behind.
LETTERS = r"I*[DKR](?:I+$)?"


def edits_of(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """Per turn its ``letters`` of the audit and the ``roles`` they give, by its place in its block."""
    blocks = repaired.select("conv_id", F.explode("blocks").alias("b")).select(
        F.shiftright(F.col("b.place"), BLOCK_BITS).alias("block"),
        F.col("conv_id").alias("of_conv"),
        F.col("b.place").alias("first_place"),
        F.regexp_extract_all(F.col("b.audit"), F.lit(LETTERS), F.lit(0)).alias("letters"),
        F.col("b.roles").alias("roles"),
    )
    # Where each turn's letters begin in the block's audit.
    starts = F.expr("aggregate(letters, array(1), (s, l) -> array_append(s, element_at(s, -1) + length(l)))")
    index = (F.col("place") - F.col("first_place") + 1).cast("int")
    return (
        turns.withColumn("block", F.shiftright("place", BLOCK_BITS))
        .join(
            blocks.withColumn("starts", starts).withColumnRenamed("block", "of_block"),
            (F.col("block") == F.col("of_block")) & F.col("conv_id").eqNullSafe(F.col("of_conv")),
        )
        .select(
            "conv_id",
            "turn",
            "role",
            "digest",
            "place",
            F.element_at("letters", index).alias("letters"),
            F.expr(
                "substring(roles, element_at(starts, cast(place - first_place + 1 AS int)),"
                " length(element_at(letters, cast(place - first_place + 1 AS int))))"
            ).alias("roles"),
        )
    )


ROLE_OF = {"u": "user", "a": "assistant"}
LINE = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("edit", pa.string()),
                  ("role", pa.string()), ("text", pa.string())])
LINES = "conv_id long, turn long, place long, edit string, role string, text string"


def stream(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with texts and their edits, to be sorted by ``KEY``: a text stands right before its edits."""
    texts = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.unhex(F.md5("text")).alias("digest"), F.lit(-1).cast("long").alias("place"), "text",
        F.lit(None).cast("string").alias("letters"), F.lit(None).cast("string").alias("roles"),
    )
    return texts.unionByName(
        edits.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "digest",
            "place", F.lit(None).cast("string").alias("text"), "letters", "roles",
        )
    )


KEY = ["conv_id", "turn", "role", "digest"]


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, place, edit, role, text) per edit, deletions too, from a sorted stream; holds one text."""
    text = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["letters"] is None:
                text = row["text"]
                continue
            for edit, initial in zip(row["letters"], row["roles"]):
                role = row["role"] if edit in "KD" else ROLE_OF[initial]
                yield row["conv_id"], row["turn"], row["place"], edit, role, "" if edit == "I" else text


def repaired_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for line in applied(batches):
        if line[3] == "D":
            continue
        held.append(line)
        size += len(line[5])
        if len(held) >= 2000 or size > 1 << 22:
            yield pa.RecordBatch.from_pylist([dict(zip(LINE.names, x)) for x in held], schema=LINE)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(LINE.names, x)) for x in held], schema=LINE)


DIGEST = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the SHA-256 of its ``role:text`` lines, fed line by line."""
    done: list[tuple] = []
    current, lines, digest = (), 0, hashlib.sha256()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(DIGEST.names, x)) for x in done], schema=DIGEST)

    for conv_id, _, _, edit, role, text in applied(batches):
        if current != (conv_id,):
            if current:
                done.append((current[0], digest.hexdigest()))
            current, lines, digest = (conv_id,), 0, hashlib.sha256()
            if len(done) >= 5000:
                yield batch()
                done.clear()
        if edit != "D":
            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
    if current:
        done.append((current[0], digest.hexdigest()))
    if done:
        yield batch()


class Repaired:
    """The repair of conversations: ``report()``, ``lines()`` and ``sha256()`` share the stored steps."""

    def __init__(self, rows: DataFrame) -> None:
        """``rows``: ``conv_id, turn, role, text`` (numbers and texts), roles and texts without NULLs."""
        self.rows = rows.select("conv_id", "turn", "role", "text")
        self.turns = cut_lineage(with_faults(ordered_turns(self.rows)))
        self.found = repairs(self.turns)
        self.edits = edits_of(self.turns.select(*KEY, "place"), self.found)

    def report(self) -> DataFrame:
        """Per conversation with rows: gaps, counts of faults, illegal neighbours, cost and audit."""
        turns = (
            self.turns.groupBy("conv_id", "turn")
            .agg(F.count("*").alias("rows"))
            .groupBy("conv_id")
            .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
            .withColumnRenamed("conv_id", "of_conv")
        )
        return (
            self.found.join(turns, F.col("conv_id").eqNullSafe(F.col("of_conv")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        )

    def lines(self) -> DataFrame:
        """The repaired conversations: ``conv_id, turn, place, edit, role, text``, sorted within ranges of the order.

        An inserted turn has the turn number and place of the row it was inserted beside.
        """
        both = stream(self.rows, self.edits).repartitionByRange(*KEY).sortWithinPartitions(*KEY, "place")
        return both.mapInArrow(repaired_lines, LINES)

    def sha256(self) -> DataFrame:
        """``conv_id`` and ``repaired_sha256``. A digest is sequential: a conversation streams through one task."""
        both = stream(self.rows, self.edits).repartition("conv_id").sortWithinPartitions(*KEY, "place")
        return both.mapInArrow(digests, "conv_id long, repaired_sha256 string")


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def conversation_repair(chats: DataFrame) -> DataFrame:
    """Damages ``chats`` (``damaged``) and repairs them: one row per conversation of ``chats``.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows go by turn, NULL first; rows of the same turn by role, then by the MD5 of their text, so that a
    repeated row follows its first; which of equal rows comes first makes no difference. NULL ids are one
    conversation. A NULL role or text is one space, so such a text is blank; an empty or unknown role has
    no legal neighbour and is kept nowhere. Conversations left without rows have zeros, an empty audit and
    the digest of an empty text. Other columns are ignored. An empty table gives an empty table.
    """
    repaired = Repaired(damaged(chats))
    report = repaired.report().withColumnRenamed("conv_id", "report_conv")
    hashes = repaired.sha256().withColumnRenamed("conv_id", "hash_conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return (
        chats.select("conv_id")
        .distinct()
        .join(report, F.col("conv_id").eqNullSafe(F.col("report_conv")), "left")
        .join(hashes, F.col("conv_id").eqNullSafe(F.col("hash_conv")), "left")
        .select(
            "conv_id",
            *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in numbers),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"),
        )
    )
