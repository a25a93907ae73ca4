"""Sets of word shingles as sorted 64-bit hashes, and signatures of blocks of such sets."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from xxhash import xxh3_64_intdigest

#: Words of a shingle and link threshold in percent, unless a caller names others.
SHINGLE_WORDS = 4
#: Seeds of the hash of byte strings; any odd base and table will do.
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.array([xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
#: Links: 100 * intersection >= link * union.
LINK = 85


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as texts have asked for them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(max(size, 2 * len(self.up)), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


POWERS = Powers()


def shingle_set(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``words`` words; of all words, if there are fewer.

    Words are what stands between ASCII white space, with A-Z in lower case. A run's hash is taken from
    running sums over the bytes of the text, so a text costs its length, whatever the run.
    """
    data = b" ".join(text.encode().lower().split())
    if not data:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    up, down = POWERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    spaces = np.flatnonzero(raw == 0x20)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(raw)]])
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mixed((sums[ends] - sums[starts]) * down[starts]))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    places = np.searchsorted(b, a)
    places[places == len(b)] = 0
    return int((b[places] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, link: int = LINK) -> bool:
    both = common(a, b)
    return both > 0 and 100 * both >= link * (len(a) + len(b) - both)


def sizes_fit(a, b, link: int = LINK):
    """Whether sets of these sizes may be linked: the union has the larger size at least."""
    return 100 * np.minimum(a, b) >= link * np.maximum(a, b)


@lru_cache(maxsize=1)
def size_classes() -> list[int]:
    """Lower bounds of the size classes, each half as large again as the one before."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))
    return bounds


def blocks_of(size_class: int, link: int = LINK) -> tuple[int, int]:
    """Number of blocks of a size class and how many of them a set signs.

    If the smaller of two linked sets has ``m`` members, they differ in at most
    ``(100 - link) / link * m`` (15 of 85, 20 of 80). With more blocks than that, some block is the same in both; with ``spare`` more blocks each set may
    leave its ``spare`` weakest blocks unsigned, and of the blocks that are the same the strongest is
    still signed by both.
    """
    largest = size_classes()[size_class + 1] - 1
    differ = (100 - link) * largest // link
    spare = 0 if differ == 0 else max(1, differ // 8)
    return differ + 1 + spare, differ + 1


def class_of(sizes):
    """The size class of each size from 1 on."""
    return np.searchsorted(size_classes(), sizes, side="right") - 1


def classes_of(n: int, link: int = LINK) -> list[int]:
    """The size classes in which a set of ``n`` members may meet a linked set: its own, and those below
    if a set there can be linked to it. Classes in which linked sets are equal are left out."""
    if n == 0:
        return []
    lowest = int(class_of(max(1, -(-link * n // 100))))
    return [c for c in range(int(class_of(n)), lowest - 1, -1) if blocks_of(c, link)[0] > 1]


def block_edges(members: np.ndarray, blocks: int) -> np.ndarray:
    """Where the blocks of a sorted set begin and end: hashes in order fall into blocks in order."""
    bounds = (np.arange(blocks + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(blocks)
    edges = np.searchsorted(members >> np.uint64(32), bounds)
    edges[-1] = len(members)
    return edges


def block_contents(members: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A hash of the members of each block."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(members ^ BASE), dtype=np.uint64)])
    return mixed(sums[edges[1:]] - sums[edges[:-1]])


def signatures(members: np.ndarray, frequent: np.ndarray, link: int = LINK) -> np.ndarray:
    """Hashes of the signed blocks of a sorted set, over its size classes.

    ``frequent`` holds sorted hashes of shingles that many documents share; a block is the stronger the
    more other shingles it holds, so that a passage which very many documents share signs no block.
    """
    rare = np.ones(len(members), bool)
    if len(frequent) and len(members):
        places = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
        rare = frequent[places] != members
    rares = np.concatenate([[0], np.cumsum(rare)])
    found = [np.empty(0, np.uint64)]
    for size_class in classes_of(len(members), link):
        blocks, signed = blocks_of(size_class, link)
        edges = block_edges(members, blocks)
        strength = (rares[edges[1:]] - rares[edges[:-1]]) * (len(members) + 1) + np.diff(edges)
        strongest = np.argsort(strength, kind="stable")[blocks - signed :]
        place = strongest.astype(np.uint64) + np.uint64(size_class << 40) + np.uint64(1)
        found.append(mixed(block_contents(members, edges)[strongest] + mixed(place)))
    return np.concatenate(found)


def sketch(members: np.ndarray, size_class: int) -> bytes:
    """A bit per cell: whether an odd number of members fall into it. A member that only one of two sets
    has changes one bit, so no more bits differ than members do, and with two cells for each member of
    the largest set of the class hardly fewer."""
    cells = 2 * (size_classes()[size_class + 1] - 1)
    counts = np.bincount((mixed(members ^ BASE) % np.uint64(cells)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits sketches (rows of bytes) differ: at most as many as the sets' members that differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def most_different(a, b, link: int = LINK):
    """In how many members linked sets of these sizes differ at most."""
    return (100 - link) * (a + b) // (100 + link)
