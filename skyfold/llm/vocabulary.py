"""A byte-level BPE vocabulary behind a minimal perfect hash, and its encoder."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import xxhash

# Fixed value: the splitting pattern that belongs to the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MOST_CACHED = 200_000
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _slot(h: int, displacement: int, n: int) -> int:
    x = (h ^ displacement * _ODD) & _MASK
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & _MASK
    return (x ^ x >> 29) % n


class PerfectHash:
    """Maps n byte strings to the slots 0..n-1 without a gap; other strings meet a slot whose key differs.

    Keys are grouped by a first hash; each group gets the first displacement that sends its keys to free slots,
    large groups first, and groups of one key take the slots left over, kept as negative numbers.
    """

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        n = self.n = len(keys)
        self.groups = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.groups)]
        for i, h in enumerate(hashes):
            groups[h % self.groups].append(i)
        taken: list[int | None] = [None] * n
        self.displacements = [0] * self.groups
        order = sorted(range(self.groups), key=lambda g: -len(groups[g]))
        free = 0
        for g in order:
            members = groups[g]
            if len(members) > 1:
                d = 1
                while True:
                    slots = [_slot(hashes[i], d, n) for i in members]
                    if len(set(slots)) == len(slots) and all(taken[s] is None for s in slots):
                        break
                    d += 1
                self.displacements[g] = d
                for i, s in zip(members, slots):
                    taken[s] = i
            elif members:
                while taken[free] is not None:
                    free += 1
                taken[free] = members[0]
                self.displacements[g] = -free - 1
        self.keys = [keys[i] for i in taken]
        self.values = [values[i] for i in taken]

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacements[h % self.groups]
        slot = -d - 1 if d < 0 else _slot(h, d, self.n)
        return self.values[slot] if self.keys[slot] == key else None


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(4)
def load(path: str) -> PerfectHash:
    """The vocabulary of a ``.tiktoken`` file: tokens by rank, which is their id."""
    ranks = read_ranks(path)
    return PerfectHash(list(ranks), list(ranks.values()))


def merged(piece: bytes, table: PerfectHash) -> list[int]:
    """Ids of a piece that is no token: the pair of least rank merges first, the leftmost of equal ones.

    Symbols are linked spans over the bytes: ``end[i]`` is where the symbol that starts at i ends (0: none starts
    there), ``back[i]`` where the one before it starts. The heap keeps outdated pairs, which are skipped.
    """
    n = len(piece)
    end = list(range(1, n + 1))
    back = list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def push(start: int) -> None:
        middle = end[start]
        if middle < n:
            rank = table.get(piece[start : end[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, middle, end[middle]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, start, middle, stop = heapq.heappop(heap)
        if end[start] != middle or end[middle] != stop:
            continue
        end[start], end[middle] = stop, 0
        if stop < n:
            back[stop] = start
            push(start)
        if start:
            push(back[start])
    ids, at = [], 0
    while at < n:
        ids.append(table.get(piece[at : end[at]]))
        at = end[at]
    return ids


class Encoder:
    """Encodes texts; pre-tokens met before come from a bounded memory."""

    def __init__(self, table: PerfectHash, pattern: str = PATTERN) -> None:
        import regex

        self.table, self.split, self.known = table, regex.compile(pattern).findall, {}

    def ids(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known = self.known
            for piece in self.split(text):
                found = known.get(piece)
                if found is None:
                    raw = piece.encode()
                    whole = self.table.get(raw)
                    found = (whole,) if whole is not None else tuple(merged(raw, self.table))
                    if len(known) >= _MOST_CACHED:
                        known.clear()
                    if len(piece) <= 64:
                        known[piece] = found
                out += found
        return out
