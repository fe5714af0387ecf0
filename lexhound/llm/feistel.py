"""A keyed permutation of any range of integers: a Feistel network over two parts, with cycle walking."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b
from math import isqrt

ROUNDS = 10


class Feistel:
    """permute() maps each of 0..size-1 to another one to one, by the key and a tweak; restore() is its inverse."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        if not key:
            raise ValueError("the key is empty")
        self.key, self.rounds = blake2b(key, digest_size=32).digest(), rounds

    def _round(self, k: int, tweak: bytes, half: int) -> int:
        data = b"%d|%s|%d" % (k, tweak, half)
        return int.from_bytes(blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def permute(self, value: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return value
        low = isqrt(size - 1) + 1  # low * high >= size, and less than size + low
        high = -(-size // low)
        while True:
            a, b = divmod(value, low)
            for k in range(self.rounds):
                if k % 2:
                    b = (b + self._round(k, tweak, a)) % low
                else:
                    a = (a + self._round(k, tweak, b)) % high
            value = a * low + b
            if value < size:
                return value

    def restore(self, value: int, size: int, tweak: bytes) -> int:
        if size < 2:
            return value
        low = isqrt(size - 1) + 1
        high = -(-size // low)
        while True:
            a, b = divmod(value, low)
            for k in reversed(range(self.rounds)):
                if k % 2:
                    b = (b - self._round(k, tweak, a)) % low
                else:
                    a = (a - self._round(k, tweak, b)) % high
            value = a * low + b
            if value < size:
                return value


def walk(step: Callable[[int], int], value: int, allowed: Callable[[int], bool]) -> int:
    """A permutation restricted to the allowed values: step until one is met."""
    value = step(value)
    while not allowed(value):
        value = step(value)
    return value
