"""Edit distances up to a small bound, by banded bit-parallel steps over many pairs at once."""

from __future__ import annotations

import numpy as np

#: Pairs that take their steps together.
PAIRS = 2048


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b without what they begin and end with alike, which takes no edit."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    k = int(differ.argmax()) if n else 0
    if not n or not differ[k]:
        return a[n:], b[n:]
    a, b, n = a[k:], b[k:], n - k
    differ = a[::-1][:n] != b[::-1][:n]
    k = int(differ.argmax())
    if not differ[k]:
        k = n
    return a[: len(a) - k], b[: len(b) - k]


def distances(pairs: list[tuple[str, str]], bound: int) -> np.ndarray:
    """The Levenshtein distance (code points) of each pair, bound + 1 where it is above bound."""
    if not 0 <= bound <= 30:
        raise ValueError("the bound must be from 0 to 30")
    out = np.full(len(pairs), bound + 1, np.int64)
    todo = []
    for k, (x, y) in enumerate(pairs):
        if abs(len(x) - len(y)) > bound:
            continue
        a, b = trim(code_points(x), code_points(y))
        if len(a) < len(b):
            a, b = b, a
        if not len(b):
            out[k] = len(a)
        else:
            todo.append((k, a, b))
    todo.sort(key=lambda t: len(t[2]))
    for i in range(0, len(todo), PAIRS):
        part = todo[i : i + PAIRS]
        out[[k for k, _, _ in part]] = _banded([a for _, a, _ in part], [b for _, _, b in part], bound)
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], bound: int) -> np.ndarray:
    """Distances of a (the longer, or as long) to b. Bit k of a word is the cell k - bound off the diagonal.

    Each step takes a character of a. The words hold where the distance rises or falls from a row of the band to the
    next, as in Myers' algorithm; the band slides by one with each step, so five shifts and an addition move it whole.
    """
    pairs = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = 2 * bound + 1
    steps = int(la.max())
    # characters that stand before and after the texts equal none
    text = np.full((pairs, steps), 0xFFFFFFFE, np.uint32)
    pattern = np.full((pairs, int(lb.max()) + steps + 2 * width + 2), 0xFFFFFFFF, np.uint32)
    for k in range(pairs):
        text[k, : la[k]] = a[k]
        pattern[k, bound : bound + lb[k]] = b[k]
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    # before the first step, rows below the diagonal rise by one each; those above don't exist yet
    rise = np.full(pairs, ((1 << bound) - 1) << bound, np.uint64)
    fall = np.zeros(pairs, np.uint64)
    score = np.full(pairs, 0, np.int64)  # at the cell on the diagonal
    result = np.full(pairs, bound + 1, np.int64)
    bits = (one << np.arange(width, dtype=np.uint64)).astype(np.uint64)
    middle = np.uint64(1 << bound)
    live = np.arange(pairs)
    for i in range(steps):
        # the band of this step: rows i - bound .. i + bound, the diagonal in the middle
        match = ((pattern[live, i : i + width] == text[live, i, None]) * bits).sum(1, dtype=np.uint64)
        p, n = rise[live], fall[live]
        zero = ((((match & p) + p) ^ p) | match | n) & full
        up = n | (~(zero | p) & full)
        down = zero & p
        score[live] += (zero & middle) == 0
        shifted = zero >> one
        rise[live] = (down | ~(shifted | up)) & full
        fall[live] = shifted & up
        ended = la[live] == i + 1
        if ended.any():
            done = live[ended]
            result[done] = _below(score[done], la[done] - lb[done], rise[done], fall[done], bound)
        if ended.any() or i % 16 == 15:
            live = live[~ended & (score[live] <= 2 * bound)]
            if not len(live):
                break
    return np.minimum(result, bound + 1)


def _below(score: np.ndarray, gap: np.ndarray, rise: np.ndarray, fall: np.ndarray, bound: int) -> np.ndarray:
    """The distance in the cell gap rows above the diagonal's, after the last step."""
    score = score.copy()
    # after a step the band has slid: bit k - 1 is the step from row k - 1 to row k of the band
    for g in range(int(gap.max(initial=0))):
        bit = np.uint64(1 << max(bound - 1 - g, 0))
        use = gap > g
        score -= use & ((rise & bit) != 0)
        score += use & ((fall & bit) != 0)
    return score
