"""Main text of web pages by differencing each page with the nearest page of its host.

Pages of a site share what is not article: menus, notices, footers. Pages are ordered by host and
path, and each is paired with the page of its host that is nearest in that order (the longer common path
at ties, then the earlier) and no copy of it. Their lines are aligned by longest common subsequence and the
shared lines are deleted, inside a named article too.

A copy is told by its rare lines, those on at most a third of the host's pages: two pages are copies if
more than half of the one's rare text is on the other too, or if neither has any. So an article under two
addresses stays, however much menu surrounds it. Pages are compared in blocks of ``BLOCK``; a block sees
the blocks beside it, and two pages of the host with different rare lines for pages amid copies.

Mark-up comes before and after: elements that are by name, class or role a menu, header, footer, sidebar,
notice, advert, form or comment are dropped first. Of what the difference leaves, the lines inside the
named article (``article``, ``main``) are taken if they are at least half of the text. Mark-up alone
decides where there is no page to compare with or the difference leaves nothing of the named article.

The heavy html is not shuffled: a first pass reduces each page to fingerprints of its lines, only those
are ordered and paired, and the line numbers to delete are joined back to the texts of the lines, which a
second pass takes from the html again and compresses page by page.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StringType
from xxhash import xxh3_64_intdigest

from cohortlens.llm.common import text_or_empty
from cohortlens.llm.lcs import common_places
from cohortlens.llm.page_lines import Line, page_lines
from cohortlens.session import cut_lineage

BLOCK = 32
#: A line on more than one in so many pages of a host belongs to the host.
RARE_PART = 3
#: A page with more than this part of another's rare text is a copy of it.
COPY_SHARE = 0.5


def fingerprint(line: Line) -> int:
    """64 bits of the line's text, as a signed integer."""
    return xxh3_64_intdigest(line.text.encode()) - (1 << 63)


def fingerprints(pages: DataFrame) -> DataFrame:
    """Per page its key, host, path, and for its lines whether they are in a named article, fingerprint and length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [page_lines(html) for html in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array([[line.in_main for line in own] for own in lines], pa.list_(pa.bool_())),
                    pa.array([[fingerprint(line) for line in own] for own in lines], pa.list_(pa.int64())),
                    pa.array([[len(line.text) for line in own] for own in lines], pa.list_(pa.int32())),
                ],
                ["page", "content", "host", "path", "main", "lines", "sizes"],
            )

    return keyed(pages).mapInArrow(
        run,
        "page long, content long, host string, path string, main array<boolean>, lines array<long>, sizes array<int>",
    )


def keyed(pages: DataFrame) -> DataFrame:
    """A page's id and content hash (equal rows share them), host, path and html."""
    url = F.coalesce(F.col("url"), F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    html = text_or_empty("html")
    return pages.select(
        F.col("page_id").cast("long").alias("page"),
        F.xxhash64("url", "html").alias("content"),
        F.lower(F.substring_index(bare, "/", 1)).alias("host"),
        F.regexp_replace(bare, r"^[^/]*|/+$", "").alias("path"),
        html.alias("html"),
    )


def ranked(light: DataFrame) -> DataFrame:
    """``light`` stored in the order of host, path and key, with ``block``, the number of its block.

    Ranges of the order are sorted apart; only the row count of each range, not rows, goes to the driver
    to number the rows through.
    """
    order = ["host", "path", "page", "content"]
    stored = cut_lineage(
        light.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = stored.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for row in counts:
        before.append((row["part"], total))
        total += row["count"]
    offsets = stored.sparkSession.createDataFrame(before, "part long, before long")
    return (
        stored.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn("rank", F.col("before") + within)
        .withColumn("block", F.floor(F.col("rank") / BLOCK))
        .drop("part", "before", "place")
    )


@F.arrow_udf(ArrayType(BooleanType()))
def among(lines: pa.Array, some: pa.Array) -> pa.Array:
    """For each line of a page whether it is one of ``some``."""
    flags = [[line in held for line in own] for own, held in zip(lines.to_pylist(), map(set, some.to_pylist()))]
    return pa.array(flags, pa.list_(pa.bool_()))


def with_rare(pages: DataFrame) -> DataFrame:
    """``pages`` with ``is_rare``, for each line whether at most one in ``RARE_PART`` pages of the host has it, and
    ``rare_hash``, a hash of the rare lines.

    The other lines are at most ``RARE_PART`` times as many a host as an average page has. A flag a line is
    stored and sent on, not the fingerprints of the rare lines a second time.
    """
    distinct = cut_lineage(pages.select("host", "page", "content", F.array_distinct("lines").alias("own")).distinct())
    n_pages = distinct.groupBy("host").agg(F.count("*").alias("n_pages"))
    counted = distinct.select("host", F.explode("own").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    common = (
        counted.join(n_pages, "host")
        .where(F.col("n") > F.floor(F.col("n_pages") / RARE_PART))
        .groupBy("host")
        .agg(F.collect_list("line").alias("common"))
    )
    none = F.array().cast("array<bigint>")
    rare = F.array_sort(F.array_except("lines", F.coalesce("common", none)))
    flagged = pages.join(cut_lineage(common), "host", "left").withColumn("rare", rare)
    return cut_lineage(
        flagged.withColumn("is_rare", among("lines", "rare")).withColumn("rare_hash", F.xxhash64("rare")).drop("common", "rare")
    )


def seen_by_blocks(pages: DataFrame) -> DataFrame:
    """The rows that each block sees, with ``seen_by`` its number: its own, the two blocks beside it, and of
    each of its hosts the pages of the smallest and the largest hash of the rare lines."""
    columns = ["page", "content", "host", "path", "main", "lines", "sizes", "is_rare", "rank", "block"]
    beside = F.explode(F.array(*(F.col("block") + k for k in (-1, 0, 1)))).alias("seen_by")
    key, row = F.struct("rare_hash", "rank"), F.struct(*(name for name in columns if name != "host"))
    # The two rows of a host come out of the grouping: a join by rank would shuffle every page for them.
    ends = pages.groupBy("host").agg(F.min_by(row, key).alias("low"), F.max_by(row, key).alias("high"))
    shown = ends.select("host", F.inline(F.array("low", "high")))
    hosts = pages.select("host", F.col("block").alias("seen_by")).distinct()
    return pages.select(*columns, beside).unionByName(shown.join(hosts, "host").select(*columns, "seen_by"))


def is_copy(page: dict, other: dict) -> bool:
    if not page["rare"] and not other["rare"]:
        return True
    shared = sum(size for line, size in page["rare"].items() if line in other["rare"])
    return shared > COPY_SHARE * sum(page["rare"].values())


def partner(pages: list[dict], page: dict) -> dict | None:
    """The page nearest in the order that is no copy."""

    def far(other: dict) -> tuple[int, int, int]:
        return abs(other["rank"] - page["rank"]), -len(commonprefix([page["path"], other["path"]])), other["rank"]

    others = (other for other in sorted(pages, key=far) if other["rank"] != page["rank"] and other["lines"])
    return next((other for other in others if not is_copy(page, other)), None)


def shared_lines(pages: list[dict], page: dict) -> list[int] | None:
    """The numbers of the lines that a page shares with its partner; None if mark-up alone decides."""
    other = partner(pages, page)
    if other is None:
        return None
    places = common_places(page["lines"], other["lines"])
    inside = {place for place, in_main in enumerate(page["main"]) if in_main}
    return None if inside and inside <= set(places) else places


def deletions(light: DataFrame) -> DataFrame:
    """Per page that the difference decides: its key and the numbers of the lines to delete."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[-1]["seen_by"] != row["seen_by"]:
                    yield from differenced(held)
                    held = []
                held.append(row)
        yield from differenced(held)

    def differenced(block: list[dict]) -> Iterator[pa.RecordBatch]:
        by_host: dict[str, dict[int, dict]] = {}
        for row in block:
            row["rare"] = {line: size for line, size, rare in zip(row["lines"], row["sizes"], row["is_rare"]) if rare}
            by_host.setdefault(row["host"], {})[row["rank"]] = row
        found: list[tuple[int | None, int, list[int]]] = []
        for by_rank in by_host.values():
            pages = list(by_rank.values())
            for page in pages:
                if page["block"] == page["seen_by"] and (places := shared_lines(pages, page)) is not None:
                    found.append((page["page"], page["content"], places))
        if found:
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            columns = [pa.array(*pair) for pair in zip(zip(*found), types)]
            yield pa.RecordBatch.from_arrays(columns, ["page", "content", "deleted"])

    return (
        seen_by_blocks(with_rare(ranked(light)))
        .repartition("seen_by")
        .sortWithinPartitions("seen_by", "rank")
        .mapInArrow(run, "page long, content long, deleted array<int>")
        .dropDuplicates(["page", "content"])
    )


def packed(lines: list[Line]) -> bytes:
    """Lines as compressed bytes, each behind a mark whether it is in a named article.

    Spark compresses what it shuffles in short blocks for speed; a page's text is about a third smaller so.
    """
    return zlib.compress("\n".join(("+" if line.in_main else "-") + line.text for line in lines).encode(), 1)


def unpacked(data: bytes) -> list[Line]:
    """The lines of ``packed``; a line has no break inside."""
    text = zlib.decompress(data).decode()
    return [Line(line[1:], line[0] == "+") for line in text.split("\n")] if text else []


@F.arrow_udf(BinaryType())
def lines_of(htmls: pa.Array) -> pa.Array:
    """The lines of each page, packed."""
    return pa.array([packed(page_lines(html)) for html in htmls.to_pylist()], pa.binary())


@F.arrow_udf(StringType())
def main_text_of(pages: pa.Array, deleted: pa.Array) -> pa.Array:
    texts = []
    for own, gone in zip(pages.to_pylist(), deleted.to_pylist()):
        without = set(gone or ())
        kept = [line for k, line in enumerate(unpacked(own)) if k not in without]
        inside = [line for line in kept if line.in_main]
        named = sum(len(line.text) for line in inside)
        teaser = gone is not None and 2 * named < sum(len(line.text) for line in kept)
        texts.append(" ".join(line.text for line in (inside if inside and not teaser else kept)))
    return pa.array(texts, pa.string())


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id``, ``url``, ``text`` and ``n_chars``, its code points.

    A NULL or empty html has an empty text. Pages with a NULL url form a host of their own; repeated
    rows get the same text. Other columns of ``pages`` are ignored. An empty table gives an empty table.
    """
    gone = cut_lineage(deletions(fingerprints(pages)))
    content = F.xxhash64("url", "html")
    held = pages.select(
        "page_id", "url", F.col("page_id").cast("long").alias("page"), content.alias("content"), lines_of(text_or_empty("html")).alias("own")
    )
    # A row per page is too long for a broadcast as soon as there are many pages.
    same = [held["page"].eqNullSafe(gone["page"]), held["content"] == gone["content"]]
    return (
        held.join(gone.hint("merge"), same, "left")
        .select("page_id", "url", main_text_of("own", "deleted").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
