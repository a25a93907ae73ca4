"""A minimal perfect hash of byte strings: hash and displace, at one slot per key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from xxhash import xxh3_128_intdigest

MASK = (1 << 64) - 1
#: Any odd number with well mixed bits.
STEP = 0x9E3779B97F4A7C15
KEYS_PER_BUCKET = 4
TRIES_AT_ONCE = 256


class PerfectHash:
    """The position of each key among ``keys``, in flat arrays that are cheap to broadcast.

    Keys are dealt to buckets by one half of their hash. The fullest buckets come first; each gets the
    first displacement that sends all its keys to free slots. Buckets of one key come last and name
    their slot outright (as a negative number), so that no slot stays empty. The key kept beside each
    slot tells keys from strangers.
    """

    def __init__(self, keys: Sequence[bytes]) -> None:
        self.size = len(keys)
        self.buckets = max(1, self.size // KEYS_PER_BUCKET)
        self.displacements = np.zeros(self.buckets, np.int64)
        slots = np.full(max(1, self.size), -1, np.int64)
        halves = np.array(
            [(h & MASK, h >> 64) for h in map(xxh3_128_intdigest, keys)], np.uint64
        ).reshape(-1, 2)
        members: dict[int, list[int]] = {}
        for key, bucket in enumerate((halves[:, 0] % np.uint64(self.buckets)).tolist()):
            members.setdefault(bucket, []).append(key)
        single = []
        for bucket, own in sorted(members.items(), key=lambda item: (-len(item[1]), item[0])):
            if len(own) == 1:
                single.append((bucket, own[0]))
                continue
            displacement, places = self._place(halves[own], slots)
            self.displacements[bucket] = displacement
            slots[places] = own
        free = np.flatnonzero(slots < 0).tolist()
        for (bucket, key), slot in zip(single, free):
            self.displacements[bucket] = -slot - 1
            slots[slot] = key
        self.positions = slots
        ordered = [keys[key] for key in slots[: self.size]]
        self.blob = b"".join(ordered)
        self.ends = np.cumsum([0, *map(len, ordered)])

    def _place(self, halves: np.ndarray, slots: np.ndarray) -> tuple[int, np.ndarray]:
        first = 0
        while True:
            tries = np.arange(first, first + TRIES_AT_ONCE, dtype=np.uint64)
            places = halves[:, 1:] + tries * np.uint64(STEP)
            places = (places ^ (places >> np.uint64(32))) * (halves[:, :1] | np.uint64(1))
            places = (places ^ (places >> np.uint64(29))) % np.uint64(self.size)
            good = (slots[places.astype(np.int64)] < 0).all(axis=0)
            for k in np.flatnonzero(good).tolist():
                found = places[:, k].astype(np.int64)
                if len(set(found.tolist())) == len(found):
                    return first + k, found
            first += TRIES_AT_ONCE

    def reader(self):
        """A function from a byte string to its position among the keys, None for a stranger."""
        size, buckets, blob = self.size, self.buckets, self.blob
        displacements, positions, ends = (
            part.tolist() for part in (self.displacements, self.positions, self.ends)
        )
        if not size:
            return lambda key: None

        def position(key: bytes) -> int | None:
            whole = xxh3_128_intdigest(key)
            low = whole & MASK
            displacement = displacements[low % buckets]
            if displacement < 0:
                slot = -displacement - 1
            else:
                place = ((whole >> 64) + displacement * STEP) & MASK
                place = ((place ^ (place >> 32)) * (low | 1)) & MASK
                slot = (place ^ (place >> 29)) % size
            return positions[slot] if blob[ends[slot] : ends[slot + 1]] == key else None

        return position
