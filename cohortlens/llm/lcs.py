"""Longest common subsequence of two lists, by bit-parallel rows."""

from __future__ import annotations

from collections.abc import Sequence

#: Bits of rows held at once; larger tables are split, so that memory stays linear in the lists.
MAX_BITS = 1 << 24


def positions(items: Sequence) -> dict:
    """For each item, the bits of its places."""
    bits: dict = {}
    for place, item in enumerate(items):
        bits[item] = bits.get(item, 0) | 1 << place
    return bits


def rows(a: Sequence, b: Sequence):
    """After each item of ``b``: the places of ``a`` (as zero bits) where the common length rises."""
    where, full = positions(a), (1 << len(a)) - 1
    row = full
    for item in b:
        matches = row & where.get(item, 0)
        row = ((row + matches) | (row - matches)) & full
        yield row


def rises(a: Sequence, b: Sequence) -> list[int]:
    """Common length of ``b`` and each prefix of ``a``, the empty one included."""
    row = (1 << len(a)) - 1
    for row in rows(a, b):
        pass
    lengths, total = [0], 0
    for bit in reversed(f"{row:0{len(a)}b}" if a else ""):
        total += bit == "0"
        lengths.append(total)
    return lengths


def common_places(a: Sequence, b: Sequence) -> list[int]:
    """The places in ``a`` of a longest common subsequence of ``a`` and ``b``, in order."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    middle_a, middle_b = a[start : len(a) - stop], b[start : len(b) - stop]
    middle = split(middle_a, middle_b) if len(middle_a) * len(middle_b) > MAX_BITS else trace(middle_a, middle_b)
    return [*range(start), *(start + place for place in middle), *range(len(a) - stop, len(a))]


def split(a: Sequence, b: Sequence) -> list[int]:
    """Halve ``b``, find where ``a`` divides best, and join the answers of the halves."""
    if len(b) == 1:
        return [a.index(b[0])] if b[0] in a else []
    half = len(b) // 2
    ahead = rises(a, b[:half])
    behind = rises(a[::-1], b[half:][::-1])[::-1]
    cut = max(range(len(a) + 1), key=lambda place: ahead[place] + behind[place])
    return common_places(a[:cut], b[:half]) + [cut + place for place in common_places(a[cut:], b[half:])]


def trace(a: Sequence, b: Sequence) -> list[int]:
    table = list(rows(a, b))
    places, column, row = [], len(a), len(b)
    while row and column:
        bit = 1 << (column - 1)
        if table[row - 1] & bit:
            column -= 1
            continue
        row -= 1
        if row == 0 or table[row - 1] & bit:
            column -= 1
            places.append(column)
    return places[::-1]
