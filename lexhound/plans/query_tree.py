"""Boolean queries as trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass


class Part:
    """A node: Word, Not, And or Or. And and Or are equal whichever side comes first; see equal_in_order()."""

    def __and__(self, other: Part | str) -> Part:
        return And(self, part(other))

    def __or__(self, other: Part | str) -> Part:
        return Or(self, part(other))

    def __invert__(self) -> Part:
        return Not(self)

    def children(self) -> tuple[Part, ...]:
        return ()

    def walk(self) -> Iterator[Part]:
        """This node and all below, in order."""
        todo: list[Part] = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children())

    def for_each(self, visit: Callable[[Part], None]) -> None:
        for p in self.walk():
            visit(p)

    def for_each_word(self, visit: Callable[[str], None]) -> None:
        for w in self.words():
            visit(w)

    def words(self) -> list[str]:
        """The words of all leaves from left to right, negated ones included."""
        return [p.text for p in self.walk() if isinstance(p, Word)]

    def equal_in_order(self, other: Part) -> bool:
        return repr(self) == repr(other)

    def __repr__(self) -> str:
        out: list[str] = []
        todo: list[Part | str] = [self]  # trees may be deep: no recursion
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif isinstance(x, Word):
                out.append(x.text)
            elif isinstance(x, Not):
                todo += [")", x.part, "(NOT "]
            else:
                todo += [")", x.right, f" {type(x).__name__.upper()} ", x.left, "("]
        return "".join(out)

    def __str__(self) -> str:
        return repr(self)


@dataclass(frozen=True, repr=False)
class Word(Part):
    text: str


@dataclass(frozen=True, repr=False)
class Not(Part):
    part: Part

    def children(self):
        return (self.part,)


@dataclass(frozen=True, repr=False, eq=False)
class _Pair(Part):
    left: Part
    right: Part

    def children(self):
        return self.left, self.right

    def swapped(self) -> Part:
        return type(self)(self.right, self.left)

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and ((self.left, self.right) == (other.left, other.right) or (self.left, self.right) == (other.right, other.left))

    def __hash__(self) -> int:
        return hash((type(self).__name__, frozenset((self.left, self.right))))


class And(_Pair):
    pass


class Or(_Pair):
    pass


def part(x: Part | str) -> Part:
    return x if isinstance(x, Part) else Word(x)
