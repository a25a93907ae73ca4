"""Cheapest repairs of turn sequences: a min-plus automaton over symbols, and a Re-Pair grammar of symbols.

A turn is one symbol: what its role starts with, whether its text is cut off, or that it must go. The
legal sequences of roles are ``(s?(ua)+)?``, an automaton of four states. A symbol's transfer matrix has
for each pair of states the cheapest way to spend that turn, as cost and audit: one letter per edit, of
ways that cost the same the one whose letters come first in ASCII. A sequence's matrix is the min-plus product of its
symbols' matrices, and products may be grouped in any way: so a rule of the grammar (a pair of symbols
that occurs often, in all sequences together) gets its matrix once, from those of its two symbols, and
every sequence that contains the pair uses it.

Audits are ropes: a product only notes its two parts, and a rope becomes a text where it is compared or
returned. No way can be a beginning of another one that costs the same, since letters beyond the last
turn are inserts, which cost something; so the first letters that differ decide, also after more is
appended, and products keep the ASCII-least way.
"""

from __future__ import annotations

from collections.abc import Iterable

#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. A repair may end in the first or last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FINAL = (EMPTY, ASSISTANT)
STEP = {
    (EMPTY, "s"): SYSTEM,
    (EMPTY, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Symbols of whole and of truncated turns by the role's initial (x: any other), and of turns that must go.
WHOLE, CUT, GONE = "suax", "SUAX", "d"
SYMBOLS = WHOLE + CUT + GONE

#: Rules are named by code points from here on (private use).
FIRST_RULE = 0xE000

Rope = str | tuple
Way = tuple[int, Rope]
Matrix = dict[tuple[int, int], Way]


def flat(rope: Rope) -> str:
    """The text of a rope."""
    if isinstance(rope, str):
        return rope
    out, left = [], [rope]
    while left:
        part = left.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            left += (part[1], part[0])
    return "".join(out)


def better(a: Way | None, b: Way) -> Way:
    """The cheaper way; of equal ones that whose audit comes first."""
    if a is None or b[0] < a[0]:
        return b
    if b[0] > a[0]:
        return a
    text_a, text_b = flat(a[1]), flat(b[1])
    return (a[0], text_a) if text_a <= text_b else (b[0], text_b)


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = {}
    for (start, middle), (cost, audit) in left.items():
        for end in STATES:
            if (middle, end) in right:
                more, rest = right[middle, end]
                out[start, end] = better(out.get((start, end)), (cost + more, (audit, rest) if audit and rest else audit or rest))
    return out


IDENTITY: Matrix = {(state, state): (0, "") for state in STATES}


def inserts() -> Matrix:
    """Any number of inserted turns; more than three in a row only go round in circles."""
    one = {(state, end): (INSERT, "I") for (state, role), end in STEP.items() if role in "ua"}
    out = dict(IDENTITY)
    for _ in range(3):
        grown = product(out, one)
        out = {key: better(out.get(key), grown[key]) if key in grown else out[key] for key in {*out, *grown}}
    return out


INSERTS = inserts()


def symbol_matrix(symbol: str) -> Matrix:
    """Inserts, then the turn itself: kept, given another role, or deleted."""
    turn: Matrix = {(state, state): (DELETE, "D") for state in STATES}
    if symbol != GONE:
        extra = TRUNCATED if symbol in CUT else 0
        for (state, role), end in STEP.items():
            if role == symbol.lower():
                turn[state, end] = better(turn.get((state, end)), (KEEP + extra, "K"))
            elif role in "ua":
                turn[state, end] = better(turn.get((state, end)), (REROLE + extra, "R"))
    return product(INSERTS, turn)


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """The matrix of each symbol and, bottom-up, of each rule; a rule's audits are kept as one text."""
    out = {symbol: symbol_matrix(symbol) for symbol in SYMBOLS}
    for place, (left, right) in enumerate(rules):
        both = product(out[left], out[right])
        out[chr(FIRST_RULE + place)] = {key: (cost, flat(audit)) for key, (cost, audit) in both.items()}
    return out


def sequence_matrix(symbols: str, matrices: dict[str, Matrix]) -> Matrix:
    """The product over a sequence of symbols and rules."""
    out = IDENTITY
    for symbol in symbols:
        out = product(out, matrices[symbol])
    return out


def cheapest(parts: Iterable[Matrix]) -> tuple[int, list[str], list[int]]:
    """The cheapest repair of a sequence in parts: cost, each part's audit, and the state before each part."""
    best: dict[int, tuple[int, tuple]] = {EMPTY: (0, ())}
    # The way so far per state: its cost, and its parts as a chain of (chain before, state before, audit).
    for matrix in parts:
        following: dict[int, tuple[int, tuple]] = {}
        for (start, end), (cost, audit) in matrix.items():
            if start in best:
                way = (best[start][0] + cost, (best[start][1], start, flat(audit)))
                if end not in following or less(way, following[end]):
                    following[end] = way
        best = following
    tail: tuple[int, tuple] | None = None
    for state, (cost, chain) in best.items():
        for end in FINAL:
            if (state, end) in INSERTS:
                more, audit = INSERTS[state, end]
                way = (cost + more, (chain, state, flat(audit)))
                tail = way if tail is None or less(way, tail) else tail
    cost, chain = tail
    steps = []
    while chain:
        chain, state, audit = chain
        steps.append((audit, state))
    steps.reverse()
    if len(steps) > 1:  # inserts after the last turn belong to the last part
        (audit, state), (end, _) = steps[-2:]
        steps[-2:] = [(audit + end, state)]
    return cost, [audit for audit, _ in steps], [state for _, state in steps]


def less(a: tuple[int, tuple], b: tuple[int, tuple]) -> bool:
    if a[0] != b[0]:
        return a[0] < b[0]
    return chain_text(a[1]) < chain_text(b[1])


def chain_text(chain: tuple) -> str:
    out = []
    while chain:
        chain, _, audit = chain
        out.append(audit)
    return "".join(reversed(out))


def roles_after(audit: str, symbols: str, state: int) -> str:
    """Per letter of an audit the initial of the role that the turn then has; ``-`` for a deleted one."""
    out = []
    turns = iter(symbols)
    for letter in audit:
        turn = next(turns) if letter != "I" else ""
        if letter == "D":
            out.append("-")
            continue
        role = turn.lower() if letter == "K" else "a" if state == USER else "u"
        state = STEP[state, role]
        out.append(role)
    return "".join(out)


def chosen_pairs(counts: list[tuple[str, int]], room: int, least: int = 2) -> list[str]:
    """The most frequent pairs, none of which shares a symbol with another one chosen in the same round.

    Pairs without a symbol in common never overlap, so they can all be replaced in one pass.
    """
    out: list[str] = []
    used: set[str] = set()
    for pair, count in sorted(counts, key=lambda c: (-c[1], c[0])):
        if len(out) == room or count < least:
            break
        if used.isdisjoint(pair):
            out.append(pair)
            used.update(pair)
    return out
