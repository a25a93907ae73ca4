"""The operators against brute force, on rows that are meant to break them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import comb
from random import Random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlens.llm import byte_bpe, chat_format, decontaminate, lcs, pii, quality_rules, shingles, warc
from cohortlens.llm.components import components
from conftest import plan_of
from cohortlens.llm.main_text import deletions, fingerprints, lines_of, main_text, packed, ranked, unpacked, with_rare
from cohortlens.llm.page_lines import Line, page_lines
from cohortlens.llm.perfect_hash import PerfectHash
from cohortlens.llm.queries import ORACLES, QUERIES
from cohortlens.llm.shingle_join import one_of_each, shingle_components
from cohortlens.llm.token_counts import token_counts
from cohortlens.llm.token_files import Shard, read_tokens, token_files, write_tokens
from cohortlens.llm.common import kept_for, open_folder
from cohortlens.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = "the of And write zed yax qui amet Über naïve 世界 it's we'll x9 #1".split()
CLASHING = {"n_tokens": "x", "spans": 1, "kept": "no", "features": "f", "row": "r", "ids": 0, "component_id": 5,
            "pii_text": "p", "hit_spans": 7, "stratum": "s", "node": 3}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(random: Random, n: int) -> str:
    return " ".join(random.choices(WORDS, k=n))


def messy_rows() -> list[tuple]:
    """NULLs in every column, empty, white-space-only, very long and repeated texts, repeated ids."""
    random = Random(5)
    long = "  ".join(random.choices(WORDS, k=30_000))
    texts = [None, "", " \n\t ", "a", "<|endoftext|> x<|startoftext|>", "x\x1cy z", "q" * 40_000, long, long,
             "tab\there  two\n\nlines \n end ", prose(random, 80), prose(random, 80) + "\n" + prose(random, 60)]
    rows = [(k, text, "en", "s", len(text or "")) for k, text in enumerate(texts)]
    rows += [(10, "again", None, None, None), (None, "no id", "de", "s", 5), (None, None, None, None, None)]
    return rows + rows[9:11]


@pytest.fixture(scope="module")
def messy(spark):
    frame = spark.createDataFrame(messy_rows(), SCHEMA)
    return frame.select("*", *(F.lit(value).alias(name) for name, value in CLASHING.items()))


@pytest.fixture(scope="module")
def nothing(messy):
    return messy.limit(0)


def multiset(df, *columns):
    return Counter(tuple(row) for row in df.select(*columns).collect())


# Token counts, token files and byte-level BPE


def test_token_counts(messy, nothing):
    library = Tokenizer.from_file(WORD_BPE)
    expected = Counter()
    for doc_id, text, *_ in messy_rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[doc_id, len((text or "").encode()), n, n > 2048] += 1
    got = token_counts(messy, WORD_BPE)
    assert multiset(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts(nothing, WORD_BPE).count() == 0


def test_token_files(spark, messy, nothing):
    library = Tokenizer.from_file(WORD_BPE)
    folder = scratch_path(spark, "test")
    manifest = write_tokens(messy, WORD_BPE, folder, length=64)
    rows = read_tokens(manifest, folder).orderBy("start").collect()
    at, expected = 0, Counter()
    for doc_id, text, *_ in messy_rows():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    for row in rows:
        assert row["start"] == at
        at += row["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i or 0))
    real = 0
    for name, n_tokens in manifest.select("name", "n_tokens").collect():
        shard = Shard(open_folder(folder), name)
        masks = [shard.sequence(k) for k in range(-(-n_tokens // 64))]
        assert all(len(ids) == len(mask) == 64 for ids, mask in masks)
        real += sum(int(mask.sum()) for _, mask in masks)
    assert real == at
    assert token_files(nothing, WORD_BPE).count() == 0


def test_byte_bpe(messy, nothing):
    ranks = byte_bpe.load_ranks(BYTE_BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = byte_bpe.round_trip(messy, BYTE_BPE, public_tokenizers.PATTERN)
    expected = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in messy_rows())
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in done.collect()) == expected
    assert byte_bpe.round_trip(nothing, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_cuts_as_the_library_does():
    ranks = byte_bpe.load_ranks(BYTE_BPE)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.ByteEncoder(byte_bpe.Vocabulary(ranks), public_tokenizers.PATTERN)
    random = Random(1)
    letters = [*"ab's  \n\t\r09éß.,\xa0\u2003\u4e16", "'ll", "  ", " \n", "\u0301"]
    for _ in range(3000):
        text = "".join(random.choices(letters, k=random.randint(0, 40)))
        assert np.frombuffer(own.packed(text), np.int32).tolist() == library.encode_ordinary(text), text


def test_ids_decode_apart_from_encoding(messy):
    both = byte_bpe.round_trip(messy, BYTE_BPE, public_tokenizers.PATTERN)
    ids = byte_bpe.encode(messy, BYTE_BPE, public_tokenizers.PATTERN)
    apart = ids.withColumn("decoded", byte_bpe.decoder(messy.sparkSession, BYTE_BPE)("ids"))
    rows = [Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in df.collect()) for df in (both, apart)]
    assert rows[0] == rows[1]


def test_a_task_has_one_python_process(spark):
    docs = spark.createDataFrame([(1, "word " * 60, "en", "s", 300)], SCHEMA)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    encoded = byte_bpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN)
    for stage in (quality_rules.keep_good(docs, labels), encoded):
        plan = plan_of(stage)
        assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1, plan


def test_an_operator_lets_go_what_another_kept():
    kept_for("one")["key"] = "value"
    assert kept_for("one") == {"key": "value"}
    assert kept_for("two") == {} and kept_for("one") == {}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_perfect_hash_is_minimal_and_knows_strangers(n):
    keys = [f"key {k}".encode() for k in range(n)]
    table = PerfectHash(keys)
    position = table.reader()
    assert [position(key) for key in keys] == list(range(n))
    assert len(table.positions) == max(1, n)
    assert position(b"stranger") is None


# Web archives and page text


def page_rows():
    same = "<p>" + "same " * 400
    return [(1, "u", same), (2, "v\r\nx", same), (3, None, None), (None, "q", same), (5, "z", "short"),
            (6, "z", "short"), (7, "u", ""), (8, "w", "é" * 30_000), (8, "w", "é" * 30_000)]


def test_archives(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = scratch_path(spark, "test")
    index = warc.write_archives(pages, folder)
    read = warc.read_records(index, folder, max_gap=0, max_range=1000, keep_payload=True)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read.collect())
    expected = Counter()
    known: set = set()
    holder = {"<p>" + "same " * 400: 2, "é" * 30_000: 8}
    for page_id, _, html in page_rows():
        data = (html or "").encode()
        ref = holder.get(html)
        revisit = ref is not None and (page_id != ref or page_id in known)
        known.add(page_id)
        kind = "revisit" if revisit else "response"
        expected[page_id, len(data), hashlib.sha1(data).hexdigest(), kind, ref if revisit else None] += 1
    assert got == expected
    stored = {r["payload_digest"]: bytes(r["payload"]) for r in read.collect() if r["record_type"] == "response"}
    assert all(hashlib.sha1(data).hexdigest() == digest for digest, data in stored.items())
    one = warc.read_records(index.where("page_id = 5"), folder).collect()
    assert [(r["page_id"], r["payload_bytes"]) for r in one] == [(5, 5)]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_ranges_merge_neighbours_only():
    records = [(0, 10), (10, 5), (30, 5), (200, 5)]
    merged = [(start, end, len(inside)) for start, end, inside in warc.ranges(records, 20, 100)]
    assert merged == [(0, 35, 3), (200, 205, 1)]


def test_longest_common_subsequence(monkeypatch):
    def length(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    random = Random(2)
    for bits in (lcs.MAX_BITS, 20):
        monkeypatch.setattr(lcs, "MAX_BITS", bits)
        for _ in range(400):
            a, b = (random.choices(range(5), k=random.randint(0, 14)) for _ in range(2))
            places = lcs.common_places(a, b)
            rest = iter(b)
            assert len(places) == length(a, b) and all(a[place] in rest for place in places)


def test_page_lines_leave_out_what_stands_beside():
    html = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>N</ul></nav>"
        "<!-- c > --><div class='cookie-notice'><div>C</div>c</div><script>var t='</p>';</script>"
        "<article><h1>One &amp;\n two</h1><p>a<b>b</b>c<p>d<br>e<div id=ad><p>x</div><section class='comments'>"
        "<article>r</article></section><form><input>f</form><p hidden>h<p>last</article><footer>F</footer>"
    )
    lines = [line.text for line in page_lines(html) if line.in_main]
    assert lines == ["One & two", "abc", "d", "e", "last"]
    assert page_lines("") == [] and page_lines("<") != [] and page_lines("<!-- never closed") == []


TEXT = "Real text here."


@pytest.mark.parametrize(
    "html",
    [
        f'<body class="page has-sidebar"><article>{TEXT}</article></body>',
        f'<html class="no-js cookie-consent"><body><p>{TEXT}</p>',
        f'<div class="container with-sidebar"><p>{TEXT}</p></div>',
        f'<div class="sidebar menu"><main>{TEXT}</main></div>',
        f'<form action="x"><div><article>{TEXT}</article></div></form>',
        f'<article class="post share-price">{TEXT}</article>',
        f'<section id="related-work">{TEXT}</section>',
        f'<p title="a hidden gem">{TEXT}</p>',
        f'<p data-role="menu" data-style="display:none">{TEXT}</p>',
        f'<div aria-hidden="false">{TEXT}</div>',
        f'<p><a href="/hidden/valley">{TEXT}</a></p>',
        f'<ul><li class="menu">Home<li class="menu">About</ul><article>{TEXT}</article>',
        f'<p class="ad">buy<p>{TEXT}',
        f'<p>{TEXT}<div class="comments"><article class="comment">no</article></div><main></main>',
        f'<dl><dt class="ad">x<dd>{TEXT}</dl></span></b>',
    ],
)
def test_ordinary_names_and_open_elements_lose_no_text(html):
    assert [line.text for line in page_lines(html)] == [TEXT]


@pytest.mark.parametrize(
    "html",
    [
        '<div class="cookie-banner">x</div>', "<nav>x</nav>", '<div id="sidebar">x</div>', '<div class="main-nav">x',
        "<p hidden>x</p>", '<div style="display: none">x</div>', "<div role=navigation>x</div>", "<div class=ad-slot-2>x</div>",
        '<div class="cookieBanner">x</div>', "<form>x</form>", "<header>x</header>", '<span class="share">x</span>',
    ],
)
def test_what_stands_beside_is_left_out(html):
    assert page_lines(html) == []


def test_very_long_and_deep_pages():
    deep = "<div><b>" * 30_000 + "z" + "</p></i>" * 30_000
    assert [line.text for line in page_lines(deep)] == ["z"]
    long = "<ul>" + "<li><b>w" * 50_000 + "</ul><article>" + "<p>v" * 50_000
    lines = page_lines(long)
    assert len(lines) == 100_000 and lines[0] == ("w", False) and lines[-1] == ("v", True)


def test_main_text_shuffles_lines_instead_of_html(spark):
    """At every size: the html stays where it is read, and no list as long as the pages is broadcast."""
    rows = [(k, f"http://h/{k}", f"<p>menu</p><p>text {k}</p>") for k in range(6)] + [(None, None, None)]
    df = main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {(row["page_id"], row["text"]) for row in df.collect()} == {(None, ""), *((k, f"text {k}") for k in range(6))}
    plan = plan_of(df).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    above = plan[: plan.index("Exchange hashpartitioning")]
    assert "html#" not in above


def test_main_text_shuffles_packed_lines(spark):
    """What the join and the blocks shuffle of a page: packed texts, and no line's fingerprint twice."""
    odd = "<p>a\x1fb\u2028c &amp; d</p><article>+ in it</article><p>- &#10; \U0001f600</p>"
    for html in ("", "<p> </p>", odd):
        assert unpacked(packed(page_lines(html))) == page_lines(html)
    assert unpacked(packed([Line("+", False), Line("-", True)])) == [Line("+", False), Line("-", True)]
    random = Random(5)
    words = ["".join(random.choices("etaoinshrdlu", k=random.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(random.choices(words, k=700)) for _ in range(6)]
    rows = [(k, f"http://h/{k}", f"<p>{text}</p><p>menu</p>") for k, text in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sizes = pages.select(F.octet_length(lines_of("html")).alias("n")).collect()
    assert sum(row["n"] for row in sizes) < 0.5 * sum(map(len, texts))
    seen = with_rare(ranked(fingerprints(pages)))
    assert [name for name, kind in seen.dtypes if kind == "array<bigint>"] == ["lines"]
    assert {tuple(row["is_rare"]) for row in seen.collect()} == {(True, False)}
    assert plan_of(deletions(fingerprints(pages))).count("Join") == 1  # only the hosts' two rows meet the blocks


def test_main_text_by_differencing(spark):
    def page(k, body):
        return k, f"http://h.example/a/{k:03d}", f"<div>Home</div><div>Terms</div><p>{body}</p><div>Foot</div>"

    rows = [page(k, f"story {k} in words of its own") for k in range(5)] + [page(70, "twin " * 9), page(71, "twin " * 9)]
    rows += [(90, "http://alone.example/x", "<p>only</p>"), (91, None, None), (92, "http://h.example/a/zz", "")]
    rows += [(93, "http://h.example/b", "<nav>m</nav><article>Home</article>"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("x"))
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    assert [got[k] for k in range(5)] == [f"story {k} in words of its own" for k in range(5)]
    assert got[90] == "only" and got[91] == got[92] == "" and got[93] == "Home"
    assert "twin" in got[70] and "twin" in got[71]  # a copy is no partner
    assert main_text(pages).count() == len(rows)
    assert main_text(pages.limit(0)).count() == 0
    assert deletions(fingerprints(pages)).where("page = 93").count() == 0


def test_differencing_on_named_pages_and_across_blocks(spark):
    menu = "".join(f"<div>menu entry {k} of the long shared list</div>" for k in range(20))
    rows = [(k, f"http://heavy.example/{k:03d}", f"{menu}<p>short {k}</p>") for k in range(6)]
    rows += [(100 + k, f"http://n.example/{k:03d}", f"<main><div>Top</div><p>own {k} text</p><div>End</div></main>") for k in range(6)]
    teaser = "<article>see also</article><div>Top</div><div>the text of this page stands in plain parts</div><div>End</div>"
    rows.append((120, "http://n.example/002b", teaser))
    # More copies than three blocks hold, and the only other page of the host behind them.
    rows += [(200 + k, f"http://run.example/{k:03d}", "<div>Top</div><p>copied article</p><div>End</div>") for k in range(120)]
    rows += [(400, "http://run.example/zz", "<div>Top</div><p>another</p><div>End</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    assert [got[k] for k in range(6)] == [f"short {k}" for k in range(6)]
    assert [got[100 + k] for k in range(6)] == [f"own {k} text" for k in range(6)]
    assert "the text of this page stands in plain parts" in got[120]
    assert {got[200 + k] for k in range(120)} == {"copied article"} and got[400] == "another"


# Personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PATTERNS = {"email": EMAIL, "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(number: str) -> bool:
    doubled = (int(d) * (1 + k % 2) for k, d in enumerate(reversed(number)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_by_force(text: str) -> list[tuple]:
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for match in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", match[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(part) <= 255 for part in match[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((match.start(), rank, match.end(), kind))
    return sorted(found)


def pii_texts() -> list[str | None]:
    random = Random(3)
    letters = [*"0123456789..--  +@ab@.é𝄞(", "10.0.0.1", "4111 1111 1111 1111", "+1 (487) 555-7209",
               "+4111 1111 1111 1111", "a@b.co", "1.2.3", "@x.y"]
    return ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(1500)] + [
        None, "", "1.2.3.4 " * 3000, "a" * 100_000, "1" * 100_000, "a.b@" * 2000, "+1" + "(" * 50_000]


def test_base_spans_and_replacement(spark):
    texts = pii_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii_text", F.lit(1))
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs, generalise_at=9.0).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, generalise_at=9.0).collect()}
    for k, text in enumerate(texts):
        spans = base_by_force(text or "")
        assert got[k]["base"] == got[k]["spans"] == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans), text
        assert got[k]["n_card"] == sum(kind == "card" for *_, kind in spans)
        unions: list = []
        for a, _, b, kind in spans:
            if unions and a < unions[-1][1]:
                unions[-1][1] = max(unions[-1][1], b)
            else:
                unions.append([a, b, kind])
        at, parts = 0, []
        for a, b, kind in unions:
            parts += [text[at:a], f"<{kind.upper()}>"]
            at = b
        assert clean[k] == (None if text is None else "".join(parts) + text[at:])


def test_terms_that_disclose(spark):
    random = Random(4)
    fill = "lorem ipsum dolor sit amet zed yax qui".split()

    def pick():
        return random.choice(fill)

    rows = [(k, f"{pick()} {pick()} write Zorgon {pick()} at boss@corp.com {pick()} end.", 1) for k in range(30)]
    rows += [(100 + k, " ".join(random.choices(fill, k=30)) + " write", 1) for k in range(300)]
    rows += [(500 + k, f"copied Unique passage near a{k}@b.com", 1) for k in range(3)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    text = rows[0][1]
    assert f"secret:{text.index('Zorgon')}:{text.index('Zorgon') + 6}" in spans[0]
    assert "write" in text and f":{text.index('write')}:" not in spans[0]
    assert all(spans[100 + k] == "" for k in range(300))
    assert "secret" not in spans[500]  # copies are one context
    clean = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert "Zorgon" not in clean[0]["text"] and "<EMAIL>" in clean[0]["text"] and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[100]["text"] == rows[30][1] and clean[100]["n_chars"] == 1


def test_personal_data_edges(messy, nothing):
    assert pii.find_personal_data(messy).count() == messy.count()
    clean = pii.sanitise(messy)
    assert clean.columns == messy.columns and multiset(clean, *clean.columns) == multiset(messy, *messy.columns)
    assert pii.find_personal_data(nothing).count() == pii.sanitise(nothing).count() == 0


# Quality rules


def features_by_force(text: str) -> tuple:
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search("[^\x20\x09-\x0d]", line)) and line in lines[:k] for k, line in enumerate(lines))
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {k + o for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for o in range(3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(inside)


def test_quality_features(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0), (3, 1)], "doc_id long, quality int")
    got = quality_rules.quality_rules(messy, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = Counter((i, *features_by_force(t or "")) for i, t, *_ in messy_rows())
    assert Counter((r["doc_id"], *(r[name] for name in names)) for r in got) == expected
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    kept = quality_rules.keep_good(messy, labels)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert quality_rules.keep_good(messy, labels.limit(0)).count() == kept.count()


@pytest.mark.parametrize("k, n, p", [(0, 20, 0.3), (2, 50, 0.1), (3, 1000, 0.005), (49, 50, 0.9), (50, 50, 0.9)])
def test_binomial_tail(k, n, p):
    exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality_rules.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoffs_need_proof():
    none = [0] * len(quality_rules.CUTOFFS)
    assert quality_rules.strictest_proven(none, 10, 0.01, 0.01) is None
    assert quality_rules.strictest_proven(none, 2000, 0.01, 0.01) == quality_rules.CUTOFFS[-1]
    steps = [0, 0, 1, 500] + [500] * (len(quality_rules.CUTOFFS) - 4)
    assert quality_rules.strictest_proven(steps, 2000, 0.01, 0.01) == quality_rules.CUTOFFS[2]


def test_cutoffs_hold_per_stratum(spark):
    random = Random(6)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(2400):
        clean = random.sample(words, 60)
        lang = "aa" if k < 1500 else "bb"
        if k % 3 == 0:
            clean = [word + "###" for word in clean]
        rows.append((k, " ".join(clean), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality"))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs, labels, risk=0.03).collect()}
    assert all(got[k] == (k % 3 != 0) for k in range(1500))
    assert all(got[k] for k in range(1500, 2400) if k % 3)  # too few labels prove nothing


# Decontamination


def hits_by_force(text: str, items: list[tuple], window: int) -> tuple:
    def words_of(value):
        value = re.sub("[A-Z]", lambda m: m[0].lower(), value or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", value)

    windows = defaultdict(set)
    for item, value in items:
        words = words_of(value)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[k : k + window])].add("" if item is None else str(item))
    words = words_of(text)
    hit, names = set(), set()
    for size in {len(w) for w in windows}:
        for k in range(len(words) - size + 1):
            found = windows.get(tuple(words[k : k + size]))
            if found:
                names |= found
                hit.update(range(k, k + size))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 150])
def test_contamination(spark, messy, nothing, block_chars):
    random = Random(7)
    letters = ["a", "B", "c", "dé", "e-f"]
    items = [(k, " ".join(random.choices(letters, k=random.randint(0, 12)))) for k in range(12)]
    items += [(None, "a b c"), (3, "c c c c"), (50, None), (51, "...")]
    texts = [" ".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(200)] + [None, "", items[0][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_hits(docs, bench, window=6, block_chars=block_chars).collect()
    for row in found:
        n_hit = sum(s["end"] - s["first"] for s in row["hit_spans"])
        expected = hits_by_force(texts[row["doc_id"]], items, 6)
        assert (row["hit_n_words"], n_hit, row["hit_items"]) == expected
    assert decontaminate.contamination(messy, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(nothing, bench).count() == 0


def test_blocks_share_one_python_node(spark):
    """Twenty blocks, built in tasks; long items in pieces; documents go through Python once."""
    random = Random(9)
    letters = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    items = [(k, " ".join(random.choices(letters, k=random.randint(8, 40)))) for k in range(60)]
    items.append((99, " ".join(random.choices(letters, k=900))))
    texts = [" ".join(random.choices(letters, k=40)) + " " + " ".join(random.choice(items)[1].split()[3:25]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    chars = sum(len(text) for _, text in items)
    folder, names = decontaminate.stored_automata(bench, 6, chars // 20, piece_words=50)
    assert len(names) >= 18
    found = decontaminate.with_hits(docs, bench, window=6, block_chars=chars // 20)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for row in found.collect():
        n_hit = sum(s["end"] - s["first"] for s in row["hit_spans"])
        assert (row["hit_n_words"], n_hit, row["hit_items"]) == hits_by_force(texts[row["doc_id"]], items, 6)


@pytest.mark.parametrize("n", [0, 1, 5, 6, 54, 55, 56, 105, 300])
def test_pieces_have_the_windows_of_the_whole(n):
    words = [str(k).encode() for k in range(n)]
    parts = list(decontaminate.pieces(words, 6, 50))
    windows = {tuple(part[k : k + 6]) for part in parts for k in range(len(part) - 5)}
    assert windows == {tuple(words[k : k + 6]) for k in range(n - 5)}
    assert len(parts) == 1 or all(6 <= len(part) <= 55 for part in parts)


def test_passages_are_cut_out(spark, messy):
    passage = "One two, three four five six seven eight nine TEN eleven"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    own = " ".join(f"own{k}" for k in range(20))
    rows = [(1, f"{own} ({passage.upper()}!) {own}", 9), (2, passage, 9), (3, own, 9), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("hit_spans", F.lit("x"))
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["hit_spans"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    cut = f"{own} (!) {own}"
    assert got == {1: (cut, len(cut), "x"), 3: (own, 9, "x"), 4: (None, None, "x")}
    same = decontaminate.decontaminate(messy, bench)
    assert multiset(same, *messy.columns) == multiset(messy, *messy.columns)


# Chat formatting


def test_chats(spark):
    rows = [
        (1, 0, "user", "a\\[INST] <</s>s> \\"),
        (1, 1, "assistant", "\\<s>[/ROLE:x] é𝄞\n[[INST]]</s>"),
        (1, 1, "assistant", "<"),
        (2, None, "to]ol] ", None),
        (2, 3, None, "/s>"),
        (None, 0, "user", "x"),
        (3, 0, "ROLE:", "[/"),
        (3, 1, "\\", "\\\\<s>"),
        (4, 0, "system", "s"),
        (4, 1, "user", "u" * 50_000),
        (4, 2, "assistant", "</s>[INST] ok [/INST]"),
        (4, 2, "assistant", "</s>[INST] ok [/INST]"),
        (5, 1, "user", "u"),
        (5, 2, "assistant", "a"),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    done = chat_format.format_chats(chats).select(
        "*", chat_format.read_chat(F.col("formatted")).alias("back"), chat_format.learned_text(F.col("segments")).alias("learned")
    )
    got = {r["conv_id"]: r for r in done.collect()}
    for conv_id in {row[0] for row in rows}:
        turns = sorted(
            ((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv_id)
        )
        row = got[conv_id]
        assert [(t["role"], t["text"]) for t in row["back"]] == [(r, x) for _, _, r, x in turns]
        assert row["learned"] == "".join(x for _, _, r, x in turns if r == "assistant")
        assert row["formatted"] == "".join(s["text"] for s in row["segments"])
    assert {k: r["valid"] for k, r in got.items()} == {1: False, 2: False, None: False, 3: False, 4: False, 5: True}
    assert (got[1]["n_valid"], got[4]["n_valid"], got[5]["n_valid"]) == (2, 3, 2)
    assert chat_format.format_chats(chats.limit(0)).count() == 0


# Shingle join


def components_by_force(rows: list[tuple]) -> Counter:
    sets = []
    for doc_id, text, *_ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc_id, {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()))
    group = list(range(len(sets)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                group[root(i)] = root(j)
    smallest: dict = {}
    for k, (doc_id, own) in enumerate(sets):
        if doc_id is not None:
            smallest[root(k)] = min(doc_id, smallest.get(root(k), doc_id))
    return Counter((d, len(s), smallest.get(root(k), d) if s else d) for k, (d, s) in enumerate(sets))


def test_shingle_join(spark, messy, nothing):
    random = Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = list(messy_rows())
    for group in range(12):
        base = random.choices(vocabulary, k=random.choice([3, 6, 12, 40, 120, 400]))
        for _ in range(25):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((len(rows) + 100, " ".join(copy).title(), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x"))
    got = shingle_components(docs)
    assert multiset(got, "doc_id", "n_shingles", "component_id") == components_by_force(rows)
    assert shingle_components(nothing).count() == 0


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (3, text.upper()), (9, text + " more"), (4, "other words stand here now"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("dropped_id", F.lit(1))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7]


def test_one_of_each_decides_per_row(spark):
    a, b, c, d = (" ".join(f"{letter}{k}" for k in range(40)) for letter in "abcd")
    rows = [(3, a), (7, a.upper()), (7, b), (3, a), (3, a), (8, b + " more"), (3, a + " x")]
    rows += [(None, c)] * 50 + [(None, c + " y"), (None, a), (None, d), (9, d), (None, None), (None, ""), (9, d)]
    rows += [(None, f"{c} {c[::-1]} {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    for frame in (docs, docs.repartition(7)):
        kept = one_of_each(frame)
        assert kept.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        alike = {k: [(i, t) for i, t in got if t and t.startswith(k)] for k in ("a0", "b0", "c0", "d0")}
        assert len(alike["a0"]) == 1 and alike["a0"][0][0] == 3
        assert alike["b0"] == [(7, b)] and alike["d0"] == [(9, d)]
        assert len(alike["c0"]) == 2 and all(i is None for i, _ in alike["c0"])  # c, and c with its reverse
        assert len(got) == 7  # and the two without shingles


@pytest.mark.parametrize("n", [8, 17, 60, 200])
def test_linked_sets_share_a_signature(n):
    random = Random(n)
    none = np.empty(0, np.uint64)
    for _ in range(200):
        a = {random.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(random.randint(0, n // 8)):
            if random.random() < 0.5:
                b.discard(random.choice(sorted(b)))
            else:
                b.add(random.getrandbits(64))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if a != b and shingles.linked(x, y):
            frequent = np.array(sorted(random.sample(sorted(a), n // 2)), np.uint64)
            for often in (none, frequent):
                assert np.intersect1d(shingles.signatures(x, often), shingles.signatures(y, often)).size
            size_class = int(shingles.class_of(min(len(x), len(y))))
            one, other = (np.frombuffer(shingles.sketch(s, size_class), np.uint8) for s in (x, y))
            assert shingles.differing(one, other) <= len(a ^ b) <= shingles.most_different(len(a), len(b))


def kept_by_force(texts: dict[int, str], words: int, percent: int) -> set[int]:
    sets = {}
    for i, text in texts.items():
        own = text.lower().split()
        sets[i] = {tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))}
    group = {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if group[i] != group[j] and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())


def test_near_duplicates_stage_links_five_words_from_80_percent(spark, folder):
    random = Random(80)
    texts = {}
    for n in (12, 30, 100, 400):
        for group in range(8):
            base = [f"g{n}x{group}w{k}" for k in range(n)]
            for _ in range(4):
                copy = list(base)
                for _ in range(random.choice([0, 1, 1, 2, 2, max(2, n // 40)])):
                    copy[random.randrange(n)] = f"u{random.getrandbits(40)}"
                texts[len(texts)] = " ".join(copy)
    # Five words: 86 of 106 are common; four words: 89 of 105, under 85 %.
    base = [f"b{k}" for k in range(100)]
    pair = {1000: " ".join(base), 1001: " ".join("new" + w if k in (30, 60) else w for k, w in enumerate(base))}
    texts |= pair
    assert kept_by_force(pair, 5, 80) == {1000} and kept_by_force(pair, 4, 85) == {1000, 1001}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {row["doc_id"] for row in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert kept == kept_by_force(texts, 5, 80) != kept_by_force(texts, 4, 85)


@pytest.mark.parametrize("n", [4, 8, 17, 60, 200])
def test_linked_sets_share_a_signature_at_80_percent(n):
    random = Random(n)
    none = np.empty(0, np.uint64)
    for _ in range(200):
        a = {random.getrandbits(64) for _ in range(n)}
        b = set(random.sample(sorted(a), n - random.randint(0, n // 5))) | {random.getrandbits(64) for _ in range(n // 16)}
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if a != b and shingles.linked(x, y, 80):
            assert np.intersect1d(shingles.signatures(x, none, 80), shingles.signatures(y, none, 80)).size
            assert len(a ^ b) <= shingles.most_different(len(a), len(b), 80)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (300, 200), (-5, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | dict.fromkeys((100, 200, 300, -5), -5)


# Queries and the pipeline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, duck, folder, name):
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert multiset(got, *columns) == Counter(map(tuple, expected))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op11_conversation_repair"}))
def test_queries_return_a_row_per_document(spark, folder, name):
    table = "pages" if name == "op4_main_text" else "documents"
    key = "page_id" if name == "op4_main_text" else "doc_id"
    source = spark.read.parquet(f"{folder}/{table}.parquet")
    assert multiset(QUERIES[name](spark, folder), key) == multiset(source, key)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":  # too few labels here to prove a cutoff
            features = ((i, features_by_force(t)) for i, t in rows)
            assert set(now) == {i for i, f in features if f[0] >= 50 and 100 * f[4] <= 50 * f[0]}
        elif name == "near_duplicates":
            assert set(now) == kept_by_force(dict(rows), 5, 80)
        elif name == "decontamination":
            before = {i: hits_by_force(t, items, 10) for i, t in rows}
            assert set(now) == {i for i, (n, hit, _) in before.items() if hit <= 0.5 * n}
            assert all(now[i] == t for i, t in rows if before[i][1] == 0)
            assert all(now[i] != t for i, t in rows if before[i][1] and i in now)
        elif name == "personal_data":
            assert all((now[i] == t) == (not base_by_force(t)) for i, t in rows)
            assert not any(EMAIL.search(t) for t in now.values())
        else:
            assert now == dict(rows)
        if name != "token_ids":
            assert docs.columns == columns
        rows = sorted(now.items())


def test_pipeline_passes_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        assert docs.count() == 0
