"""The registered queries column by column against brute force, on the smallest test tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from cohortlens.llm import byte_bpe
from cohortlens.llm.queries import BYTE_BPE, QUERIES, WORD_BPE
from test_llm import base_by_force, components_by_force, features_by_force, hits_by_force


@pytest.fixture(scope="module")
def documents(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return sorted((row["doc_id"], row["text"] or "") for row in rows)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def result(spark, folder, name, *columns):
    rows = QUERIES[name](spark, folder).select("doc_id", *columns).collect()
    assert len({row["doc_id"] for row in rows}) == len(rows)
    return {row["doc_id"]: tuple(row)[1:] for row in rows}


def test_op1(spark, folder, documents):
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    count = {k: len(library.encode(text, add_special_tokens=False).ids) for k, text in documents}
    expected = {k: (len(text.encode()), count[k], count[k] > 2048) for k, text in documents}
    assert result(spark, folder, "op1_token_counts", "n_bytes", "n_tokens", "over_limit") == expected


def test_op3_base(spark, folder, documents):
    got = result(spark, folder, "op3_pii", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for k, text in documents:
        spans = base_by_force(text)
        kinds = [kind for _, _, _, kind in spans]
        base = [f"{kind}:{start}:{end}" for start, _, end, kind in spans]
        assert got[k][:5] == (*(kinds.count(kind) for kind in ("email", "ip", "card", "phone")), sha256(",".join(base)))
        assert set(base) <= set(got[k][5].split(",")) | {""}


def test_op5_base(spark, folder, documents):
    got = result(spark, folder, "op5_quality_rules", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for k, text in documents:
        features = features_by_force(text)
        failed = features[0] < 50 or 100 * features[4] > 50 * features[0]
        assert got[k][:6] == (*features[:5], failed) and not (failed and got[k][6])


def test_op6(spark, folder, documents):
    items = [tuple(row) for row in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    expected = {}
    for k, text in documents:
        n, hit, names = hits_by_force(text, items, 10)
        expected[k] = (n, hit, len(names), sha256(",".join(names)), hit > 0)
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert result(spark, folder, "op6_decontaminate", *columns) == expected
    assert any(row[4] for row in expected.values())


def test_op8(spark, folder, documents):
    got = result(spark, folder, "op8_shingle_join", "n_shingles", "component_id")
    assert sorted((k, *row) for k, row in got.items()) == sorted(components_by_force(documents))


def test_op9(spark, folder, documents):
    library = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    expected, at = {}, 0
    for k, text in documents:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        expected[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert result(spark, folder, "op9_token_files", "start", "n_tokens", "ids_crc32") == expected


def test_op10(spark, folder, documents):
    ranks = byte_bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for k, text in documents:
        ids = library.encode_ordinary(text)
        expected[k] = (len(ids), sha256(" ".join(map(str, ids))), sha256(text))
    assert result(spark, folder, "op10_byte_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_op12(spark, folder, documents):
    got = result(spark, folder, "op12_toxicity", "held_out", "score", "predicted")
    assert set(got) == {k for k, _ in documents}
    for k, (held_out, score, predicted) in got.items():
        assert held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.5)
