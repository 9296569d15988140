"""Repeated substrings of many short strings, by merging the Burrows-Wheeler transforms of shards.

Each shard's rotations are sorted on their own. The shards are then merged as by Holt and McMillan ("Merging of
multi-string BWTs with applications", 2014): an interleave says, row by row, from which shard the next row
comes. It begins in order of the first eight characters, and each refinement takes the characters that precede
the rows, eight or sixteen at a time, and deals the rows out stably by them; the interleave is then right for that many
characters more. No suffix is sorted or compared again. Where neighbours are told apart first gives their common
prefix (as by Egidi and Manzini), and rows never told apart within `length` characters are one repeated interval.
"""

from __future__ import annotations

import numpy as np

#: Characters taken at a time.
STEP = 8
#: Rotations of a shard, roughly.
SHARD = 1 << 16

def ordered(high: np.ndarray) -> np.ndarray:
    """The stable order of non-negative numbers: one sort of number and position together, if both fit in 63 bits."""
    bits = len(high).bit_length()
    if int(high.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(high, kind="stable")
    keys = high.astype(np.int64) << bits
    keys |= np.arange(len(high))
    keys.sort()
    return keys & ((1 << bits) - 1)


def dense(values: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    order = np.argsort(values)
    held = values[order]
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.cumsum(np.concatenate(([False], held[1:] != held[:-1])))
    return ranks


class Rotations:
    """The rotations of strings, each led by a zero character; row r is rotation `place[r]` of string `owner[r]`."""

    def __init__(self, strings: list[bytes]):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.size, self.start = sizes, np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(strings)), sizes)
        self.place = np.arange(len(self.owner)) - self.start[self.owner]
        text = b"".join([b"\0" + s + b"\0" + s[: STEP - 1] for s in strings])
        at = (self.start + STEP * np.arange(len(strings)))[self.owner] + self.place
        words = np.ndarray((len(text) - STEP + 1,), ">u8", text, strides=(1,))
        self.word = words[at].astype(np.uint64)

    def shifted(self, by: int) -> np.ndarray:
        """The row of the rotation so many characters on."""
        return self.start[self.owner] + (self.place + by) % self.size[self.owner]

    def leading(self, n: int) -> np.ndarray:
        """The first n characters of each rotation, n < STEP, as small numbers in order."""
        return dense(self.word >> np.uint64(64 - 8 * n))

    def sorted_shard(self, rows: slice, ranks: np.ndarray, length: int) -> np.ndarray:
        """The rows of a shard of whole strings in the order of their rotations' first `length` characters; ranks: of
        the first STEP. What is equal so far may come in any order: a refinement only counts what precedes it."""
        start, size, place = self.start[self.owner[rows]] - rows.start, self.size[self.owner[rows]], self.place[rows]
        known = STEP
        while True:
            bits = int(ranks.max()).bit_length()
            thrice = 3 * bits <= 63
            joined = ranks << bits | ranks[start + (place + known) % size]
            if thrice:
                joined = joined << bits | ranks[start + (place + 2 * known) % size]
            known *= 3 if thrice else 2
            if known >= length:
                return np.argsort(joined) + rows.start
            ranks = dense(joined)


def merged(rotations: Rotations, length: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows in the order of their first `length` characters, and where a row differs from the one before."""
    cuts = [0]
    for end in (rotations.start + rotations.size).tolist():
        if end - cuts[-1] >= SHARD:
            cuts.append(end)
    if cuts[-1] < len(rotations.owner):
        cuts.append(len(rotations.owner))
    letters = dense(rotations.word)
    shards = [rotations.sorted_shard(slice(a, b), letters[a:b], length) for a, b in zip(cuts, cuts[1:])]
    rows = np.concatenate(shards)
    source = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint32), [len(x) for x in shards])

    bits = int(letters.max()).bit_length()
    twice = 2 * bits + len(rows).bit_length() <= 63
    first = letters[rows]
    order = ordered(first)
    interleave = source[order]
    held = first[order]
    apart = np.concatenate(([True], held[1:] != held[:-1]))
    known = min(STEP, length)
    near, far = (letters[rotations.shifted(-k * STEP)] for k in (1, 2))
    while known < length:
        step = min(2 * STEP if twice else STEP, length - known)
        before = near
        if step > STEP:  # the characters before the nearest eight come first
            before = (far if step == 2 * STEP else rotations.leading(step - STEP)[rotations.shifted(-step)]) << bits | near
        elif step < STEP:
            before = rotations.leading(step)[rotations.shifted(-step)]
        taken = np.empty_like(before)
        taken[np.argsort(interleave, kind="stable")] = before[rows]
        block = np.cumsum(apart)
        order = ordered(taken)
        interleave, taken, block = interleave[order], taken[order], block[order]
        apart = np.concatenate(([True], (taken[1:] != taken[:-1]) | (block[1:] != block[:-1])))
        known += step
    found = np.empty_like(rows)
    found[np.argsort(interleave, kind="stable")] = rows
    return found, apart


def least_owner(strings: list[bytes], owners: np.ndarray, length: int) -> np.ndarray:
    """For each string and each of its windows of `length` characters, one after the other: the least owner of a
    string that holds it."""
    if not strings:
        return np.zeros(0, np.int64)
    rotations = Rotations(strings)
    rows, apart = merged(rotations, length)
    string, start = rotations.owner[rows], rotations.place[rows] - 1
    whole = (start >= 0) & (start + length < rotations.size[string])
    owner = np.where(whole, owners[string], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(owner, np.flatnonzero(apart))[np.cumsum(apart) - 1]
    windows = np.maximum(rotations.size - length, 0)
    first = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    out[(first[string] + start)[whole]] = least[whole]
    return out
