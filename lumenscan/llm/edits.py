"""Edit distances of one line to others, exact, by bit-parallel columns: one step for each character of the other.

Lines of up to ``BATCHED`` characters are compared with many others at once, longer ones one by one with integers of any width.
"""

from __future__ import annotations

import numpy as np

BATCHED = 256
_ONE, _TOP = np.uint64(1), np.uint64(63)


def distance(a: str, b: str, most: int) -> int:
    """The edit distance, or any number over ``most`` if it is over that."""
    if not a or not b:
        return len(a) + len(b)
    full, top = (1 << len(a)) - 1, len(a) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        eq = where.get(c, 0)
        v = eq | minus
        h = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(h | plus)), plus & h
        score += (up >> top & 1) - (down >> top & 1)
        if score - left > most:
            return most + 1
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(v | up)), up & v
    return score


def codes(lines: list[str]) -> tuple[np.ndarray, int]:
    """A row for each line, its characters as small numbers from 1 up and 0 after its end, and the number of numbers."""
    width = max(map(len, lines), default=0)
    table = np.zeros((len(lines), width), np.uint32)
    for i, line in enumerate(lines):
        table[i, : len(line)] = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    known, table = np.unique(np.append(table.ravel(), np.uint32(0)), return_inverse=True)
    return table[:-1].reshape(len(lines), width), len(known)


def distances(a: np.ndarray, others: np.ndarray, lengths: np.ndarray, symbols: int, most: np.ndarray) -> np.ndarray:
    """The distances of a (its codes, one at least) to rows of codes of these lengths; where one is over its ``most``, any number over that."""
    words = (len(a) + 63) // 64
    where = np.zeros((words, symbols), np.uint64)
    at = np.arange(len(a))
    np.bitwise_or.at(where, (at // 64, a), _ONE << (at % 64).astype(np.uint64))
    last = np.uint64((len(a) - 1) % 64)
    plus, minus = np.full((words, len(others)), ~np.uint64(0)), np.zeros((words, len(others)), np.uint64)
    found = np.where(lengths == 0, len(a), most + 1)
    row = np.arange(len(others))
    score = np.full(len(others), len(a), np.int64)
    for j in range(int(lengths.max(initial=0))):
        if j % 16 == 0:
            # each character left lowers the distance by one at the most
            alive = (score - (lengths - j) <= most) & (lengths > j)
            if 4 * alive.sum() < 3 * len(row):
                row, score, lengths, most, others, plus, minus = row[alive], score[alive], lengths[alive], most[alive], others[alive], plus[:, alive], minus[:, alive]
                if not len(row):
                    break
        column = others[:, j]
        up_in, down_in = np.ones(len(row), np.uint64), np.zeros(len(row), np.uint64)
        for w in range(words):
            eq = where[w][column]
            v = eq | minus[w]
            eq |= down_in
            h = (((eq & plus[w]) + plus[w]) ^ plus[w]) | eq
            up, down = minus[w] | ~(h | plus[w]), plus[w] & h
            if w == words - 1:
                score = score + ((up >> last) & _ONE).astype(np.int64) - ((down >> last) & _ONE).astype(np.int64)
            up_out, down_out = up >> _TOP, down >> _TOP
            up, down = (up << _ONE) | up_in, (down << _ONE) | down_in
            plus[w], minus[w] = down | ~(v | up), up & v
            up_in, down_in = up_out, down_out
        ended = lengths == j + 1
        found[row[ended]] = score[ended]
    return found
