"""Queries over an index: the documents they match, and rated hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Algorithm
from ..operators.hits import HITS, and_hits, and_not_hits, leaf_hits, or_hits, rate, top_hits
from ..operators.index import Index
from .parser import ParseOptions, parse
from .query_tree import And, Not, Or, Part, Word, part

#: Leaves whose marks fit into one number.
_BITS = 62
#: Words and operators of queries for hits.
MOST_PARTS = 400


class StrayNotError(ValueError):
    """A NOT that isn't one side of an AND: what it leaves can't be found by an index."""

    def __init__(self, at: Part):
        super().__init__(f"{at} must be combined with something by AND")


class TooManyParts(ValueError):
    """A query whose hits would take too many joins, one for each operator."""

    def __init__(self):
        super().__init__(f"hits are of queries of at most {MOST_PARTS} words and operators")


def _sides(node: And) -> tuple[Part, Part | None]:
    """What an AND keeps, and what it negates, if it does."""
    if isinstance(node.right, Not):
        return node.left, node.right.part
    if isinstance(node.left, Not):
        return node.right, node.left.part
    return node, None


@dataclass(frozen=True)
class Documents:
    """The documents that a query matches. proximates, the expansion of its words, can be given to Query.hits()."""

    query: Query
    index: Index
    proximates: DataFrame | None

    def table(self, strict_not: bool = False) -> DataFrame:
        """(doc_id), distinct and in no order.

        A negated word doesn't exclude documents, it only lowers hits' ratings, unless strict_not. All leaves are looked
        up in one pass: each document gathers a mark of every leaf that it has, in one aggregate, by which the tree is
        decided; so any query takes one shuffle of what its words find.
        """
        leaves: list[str] = []
        holds = _condition(self.query.root, leaves, strict_not)
        marks = list(dict.fromkeys(leaves))
        postings = self.index.document_rows()
        if not any(marks):
            return postings.sparkSession.createDataFrame([], "doc_id long")
        chunks = [marks[i : i + _BITS] for i in range(0, len(marks), _BITS)]
        source = self.proximates
        if source is None:
            found, key = postings.where(F.col("word").isin([m for m in marks if m])), F.col("word")
        else:
            found = postings.join(source.where(F.col("query_word").isin([m for m in marks if m])).select("word", "query_word"), "word")
            key = F.col("query_word")
        bits = {w: (c, b) for c, chunk in enumerate(chunks) for b, w in enumerate(chunk)}
        masks = [F.bit_or(_case(key, {w: 1 << b for w, (k, b) in bits.items() if k == c and w})).alias(f"m{c}") for c in range(len(chunks))]
        got = found.groupBy("doc_id").agg(*masks)
        return got.where(holds(lambda w: F.col(f"m{bits[w][0]}").bitwiseAND(F.lit(1 << bits[w][1])) != 0)).select("doc_id")


def _case(key: Column, values: dict[str, int]) -> Column:
    return reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1]).cast("long")), values.items(), F.when(F.lit(False), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def _condition(node: Part, leaves: list[str], strict_not: bool) -> Callable[[Callable[[str], Column]], Column]:
    """The tree as a condition over marks of leaves; leaves gets those that it needs."""
    if isinstance(node, Word):
        leaves.append(node.text)
        return lambda mark: mark(node.text)
    if isinstance(node, Or):
        any_of = [_condition(x, leaves, strict_not) for x in _chain(node, Or)]
        return lambda mark: _balanced(or_, [a(mark) for a in any_of])
    if isinstance(node, And):
        every, none = [], []
        for x in _chain(node, And):
            if isinstance(x, Not):  # read in any case: what is wrong in it counts
                none.append(_condition(x.part, leaves if strict_not else [], strict_not))
            else:
                every.append(_condition(x, leaves, strict_not))
        none = none if strict_not else []
        return lambda mark: _balanced(and_, [a(mark) for a in every] + [~a(mark) for a in none])
    raise StrayNotError(node)


def _chain(node: Part, kind: type) -> list[Part]:
    """What one operator joins, from left to right, however many. Of an AND of two NOTs, none is one side of it."""
    out: list[Part] = []
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, kind):
            if kind is And and isinstance(x.left, Not) and isinstance(x.right, Not):
                raise StrayNotError(x.left)
            todo += [x.right, x.left]
        else:
            out.append(x)
    return out


def _balanced(join: Callable[[Column, Column], Column], parts: list[Column]) -> Column:
    """All parts joined in a tree of little depth, as expressions are read by recursion."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@dataclass(frozen=True)
class Query:
    """A boolean query."""

    root: Part

    @classmethod
    def parse(cls, text: str, options: ParseOptions | None = None) -> Query:
        return cls(parse(text, options))

    @classmethod
    def of(cls, root: Part | str) -> Query:
        return cls(part(root))

    def __str__(self) -> str:
        return str(self.root)

    def proximates(self, index: Index) -> DataFrame | None:
        """The expansion of all its words, negated ones too; None where only exact words count."""
        if index.config.algorithm is Algorithm.EXACT:
            return None
        return index.proximates(self.root.words())

    def documents(self, index: Index) -> Documents:
        return Documents(self, index, self.proximates(index))

    def hits(
        self, index: Index, distance_threshold: int | None = 100, proximates: DataFrame | None = None, occurrences: Callable[[DataFrame | None, str], DataFrame] | None = None
    ) -> DataFrame:
        """Rated hits, in no order. distance_threshold: bytes within which places of one word count as one.

        Negated words lower the rating of hits near them, and never remove one. occurrences: another source of places than
        the index; it takes the expansion (or None) and a word, and gives (doc_id, word, start, rating).
        """
        exact = index.config.algorithm is Algorithm.EXACT
        places_of = occurrences or index.occurrences
        expansion = None if exact else proximates if proximates is not None else self.proximates(index)
        number = 0
        # where an AND leaves few documents, places elsewhere needn't be sorted
        matched = Documents(self, index, expansion).table() if occurrences is None and any(isinstance(p, And) and _sides(p)[1] is None for p in self.root.walk()) else None
        if sum(1 for _ in self.root.walk()) > MOST_PARTS:
            raise TooManyParts

        def plan(node: Part) -> DataFrame:
            nonlocal number
            if isinstance(node, Word):
                number += 1
                if not node.text:
                    return index.document_postings().sparkSession.createDataFrame([], HITS)
                # by document once, for all windows above; so many parts aren't joined to fewer, whose sorts would spill
                found = places_of(expansion, node.text)
                found = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
                found = found if matched is None else found.join(matched, "doc_id", "left_semi")
                return leaf_hits(found, number, distance_threshold)
            if isinstance(node, Or):
                left = plan(node.left)
                return or_hits(left, plan(node.right))
            if isinstance(node, And):
                kept, negated = _sides(node)
                if negated is not None:  # the positive side's words are numbered first
                    left = plan(kept)
                    return and_not_hits(left, plan(negated))
                left = plan(node.left)
                return and_hits(left, plan(node.right))
            raise StrayNotError(node)

        return rate(plan(self.root))

    def search(self, index: Index, k: int = 10, distance_threshold: int | None = 100) -> DataFrame:
        """The k best hits, best first."""
        return top_hits(self.hits(index, distance_threshold), k)
