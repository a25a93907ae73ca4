"""Conversation repair against a plain dynamic programme over whole strings."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from functools import cache
from random import Random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import conversation_repair as repair
from cohortlens.llm import repair_grammar as grammar
from cohortlens.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"u": "user", "a": "assistant"}


def after_damage(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        left = chats[conv]
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        left += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    for left in chats.values():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    return chats


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.strip(repair.SPACE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_force(rows):
    """The expected row of each conversation, keeping whole audits and outputs per state."""
    out = {}
    for conv, left in after_damage(rows).items():
        faults = faults_of(left)
        turns = {turn for turn, _, _ in left if turn is not None}
        best = {"": (0, "", ())}

        def offer(states, state, way):
            if state not in states or way[:2] < states[state][:2]:
                states[state] = way

        def with_inserts(states):
            for _ in range(3):
                for state, (cost, audit, lines) in list(states.items()):
                    for role in "ua":
                        if (state, role) in STEP:
                            offer(states, STEP[state, role], (cost + 3, audit + "I", (*lines, FULL[role] + ":")))
            return states

        with_inserts(best)
        for (_, role, text), fault in zip(left, faults):
            following = {}
            for state, (cost, audit, lines) in best.items():
                offer(following, state, (cost + 4, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                cost += 3 * (fault == "truncated")
                if (state, role[:1]) in STEP:
                    offer(following, STEP[state, role[:1]], (cost, audit + "K", (*lines, f"{role}:{text}")))
                for new in "ua":
                    if (state, new) in STEP:
                        offer(following, STEP[state, new], (cost + 3, audit + "R", (*lines, f"{FULL[new]}:{text}")))
            best = with_inserts(following)
        cost, audit, lines = min(best[state] for state in ("", "a") if state in best)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            faults.count("blank"),
            faults.count("duplicate"),
            faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def got(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(row) for row in df.collect()]
    assert len({row[0] for row in rows}) == len(rows)
    return {row[0]: row[1:] for row in rows}


def messy():
    random = Random(11)
    texts = ["Yes.", "no", "", " \n", "Why?", "Über 世界!", "tail. \t", "cut. off", None, "x" * 30_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "ubermensch"]
    rows = [(c, t, random.choice(roles[:3]), random.choice(texts)) for c in range(60) for t in range(random.randint(1, 9))]
    rows += [(c, random.choice([None, 1, 2, 2, 7]), random.choice(roles), random.choice(texts)) for c in range(60, 110) for _ in range(6)]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Ho.")]
    rows += [(777, 5, "user", "Same.")] * 40 + [(778, t, "user", "Same.") for t in range(400)]
    rows += [(779, t, random.choice(roles[:4]), random.choice(texts)) for t in range(700)]
    # Ids of which every row is dropped.
    rows += [(c, 0, "user", "Gone.") for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    return rows


def test_repairs_are_those_of_the_plain_programme(spark, folder):
    rows = messy()
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(n) for n in ("place", "symbol", "digest", "cost")))
    assert got(repair.conversation_repair(frame)) == by_force(rows)
    chats = table(spark, folder, "conversations")
    assert got(repair.conversation_repair(chats)) == by_force([tuple(row) for row in chats.collect()])


def test_blocks_and_rules_change_nothing(spark, monkeypatch):
    rows = messy()
    expected = by_force(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    assert got(repair.conversation_repair(frame)) == expected
    monkeypatch.setattr(repair, "MAX_RULES", 0)
    assert got(repair.conversation_repair(frame)) == expected


def test_lines_are_the_repaired_turns(spark):
    rows = messy()
    lines = repair.Repaired(repair.damaged(spark.createDataFrame(rows, SCHEMA))).lines().collect()
    by_conv = defaultdict(list)
    for row in lines:  # the rows of one conversation lie in order
        by_conv[row["conv_id"]].append((row["place"], f"{row['role']}:{row['text']}"))
    for conv, expected in by_force(rows).items():
        chat = by_conv[conv]
        text = "\n".join(line for _, line in sorted(chat, key=lambda x: x[0]))
        assert hashlib.sha256(text.encode()).hexdigest() == expected[-1]


def test_an_empty_table(spark):
    assert repair.conversation_repair(spark.createDataFrame([], SCHEMA)).collect() == []


def plain(symbols):
    @cache
    def rest(k, state, inserted):
        ways = [(0, "")] if k == len(symbols) and state in grammar.FINAL else []
        for role in "ua" if inserted < 4 else "":
            if (state, role) in grammar.STEP:
                cost, audit = rest(k, grammar.STEP[state, role], inserted + 1)
                ways.append((cost + 3, "I" + audit))
        if k < len(symbols):
            symbol = symbols[k]
            cost, audit = rest(k + 1, state, 0)
            ways.append((cost + 4, "D" + audit))
            for role in "sua" if symbol != "d" else "":
                extra = 3 * symbol.isupper() + 3 * (role != symbol.lower())
                if (state, role) in grammar.STEP and (role != "s" or symbol.lower() == "s"):
                    cost, audit = rest(k + 1, grammar.STEP[state, role], 0)
                    ways.append((cost + extra, ("K" if role == symbol.lower() else "R") + audit))
        return min(ways, default=(10**9, ""))

    return rest(0, grammar.EMPTY, 0)


def test_products_are_the_cheapest_and_ascii_least():
    random = Random(3)
    sequences = ["".join(s) for n in range(4) for s in itertools.product(grammar.SYMBOLS, repeat=n)]
    sequences += ["".join(random.choices(grammar.SYMBOLS, k=random.randint(4, 25))) for _ in range(1500)]
    one, two = chr(grammar.FIRST_RULE), chr(grammar.FIRST_RULE + 1)
    rules = [("u", "a"), (one, one), ("s", "U"), (two, "d")]
    matrices = grammar.rule_matrices(rules)
    for symbols in sequences:
        packed = symbols
        for place, pair in enumerate(rules):
            packed = packed.replace("".join(pair), chr(grammar.FIRST_RULE + place))
        cut = random.randint(0, len(packed))
        cost, audits, _ = grammar.cheapest(grammar.sequence_matrix(part, matrices) for part in (packed[:cut], packed[cut:]))
        assert (cost, "".join(audits)) == plain(symbols), symbols


@pytest.mark.parametrize("room", [0, 1, 9])
def test_chosen_pairs_share_no_symbol(room):
    counts = [("ua", 9), ("au", 9), ("dd", 5), ("xs", 2), ("XX", 1)]
    chosen = grammar.chosen_pairs(counts, room)
    assert len(chosen) <= room and chosen == ["au", "dd", "xs"][: len(chosen)]
