"""Constraints on itemsets, compiled to column predicates.

A constraint type holds item names and wildcard patterns.  Every wildcard is a
category of its own; all plain names of a type share one.  A set passes if every
category of every type lets it pass:

* ALL: it has every item of the category (a wildcard: every known item that matches);
* ANY: it has at least one;
* NONE (negative all): it has none;
* NOT_ALL (negative any): it lacks at least one.

An ALL or ANY category without a known item lets nothing pass, NONE everything and
NOT_ALL nothing; with ``compat`` a category without a known item is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmine.functions.patterns import glob_to_regex, has_wildcard


class Kind(Enum):
    ALL = "positive, all"
    ANY = "positive, any"
    NONE = "negative, all"
    NOT_ALL = "negative, any"


@dataclass
class Constraints:
    of: dict[Kind, set[str]] = field(default_factory=dict)
    compat: bool = False

    def add(self, kind: Kind, *names: str) -> Constraints:
        self.of.setdefault(kind, set()).update(names)
        return self

    def set(self, kind: Kind, names: Iterable[str]) -> Constraints:
        self.of[kind] = set(names)
        return self

    def __bool__(self) -> bool:
        return any(self.of.values())

    def categories(self, vocabulary: DataFrame, column: str = "item") -> list[tuple[Kind, str | None, list[str], int]]:
        """(kind, wildcard or None, known plain names, number of known items): an exact name counts as itself, even with a ``*`` in it.

        One aggregation over the vocabulary: a flag a name, a count a wildcard; items themselves are not collected.
        """
        names = sorted({n for names in self.of.values() for n in names})
        if not names:
            return []
        item = F.col(column)
        flags = [F.coalesce(F.bool_or(item == n), F.lit(False)).alias(f"is{i}") for i, n in enumerate(names)]
        counts = [F.count_if(item.rlike(glob_to_regex(n))).alias(f"n{i}") for i, n in enumerate(names) if has_wildcard(n)]
        row = vocabulary.select(column).distinct().agg(*flags, *counts).first()
        exact = {n for i, n in enumerate(names) if row[f"is{i}"]}
        out = []
        for kind, own in self.of.items():
            plain = sorted(n for n in own if not has_wildcard(n) or n in exact)
            if plain:
                known = [n for n in plain if n in exact]
                out.append((kind, None, known, len(known)))
            out += [(kind, w, [], row[f"n{names.index(w)}"]) for w in sorted(own - set(plain))]
        return out

    def items_of(self, kind: Kind, vocabulary: DataFrame, column: str = "item") -> DataFrame:
        """(item): all known items that the categories of a kind hold."""
        test = F.lit(False)
        for n in sorted(self.of.get(kind, ())):
            test = test | ((F.col(column) == n) | F.col(column).rlike(glob_to_regex(n)) if has_wildcard(n) else F.col(column) == n)
        return vocabulary.where(test).select(F.col(column).alias("item")).distinct()

    def predicate(self, items: Column, vocabulary: DataFrame, column: str = "item") -> Column:
        """Whether ``items``, all of them known, pass; the vocabulary(item) says which names are known."""
        return self.compiled(vocabulary, column)(items)

    def compiled(self, vocabulary: DataFrame, column: str = "item") -> Callable[[Column], Column]:
        """The same for any number of columns, with one look at the vocabulary."""
        found = [x for x in self.categories(vocabulary, column) if x[3] or not self.compat]
        asked = {kind: len([n for n in own if not has_wildcard(n)]) for kind, own in self.of.items()}

        def test(items: Column) -> Column:
            out = F.lit(True)
            for kind, wildcard, known, number in found:
                out = out & _test(kind, wildcard, known, number, items, asked[kind])
            return out

        return test

    def filter(self, sets: DataFrame, vocabulary: DataFrame, items: str = "items") -> DataFrame:
        return sets.where(self.predicate(F.col(items), vocabulary))


def _test(kind: Kind, wildcard: str | None, known: list[str], number: int, items: Column, asked: int) -> Column:
    """One category: of a wildcard, as many items of the set match as are known if it has all of them."""
    if wildcard is not None:
        rx = glob_to_regex(wildcard)
        has_any = F.exists(items, lambda x: x.rlike(rx))
        has_all = F.size(F.filter(items, lambda x: x.rlike(rx))) == number
        reachable = number > 0
    else:
        literal = F.array(*[F.lit(n) for n in known]).cast("array<string>")
        has_any = F.arrays_overlap(items, literal) if known else F.lit(False)
        has_all = F.size(F.array_except(literal, items)) == 0
        reachable = 0 < number and (kind is not Kind.ALL or number >= asked)  # an unknown name can never be met
    if kind is Kind.ANY:
        return has_any & F.lit(reachable)
    if kind is Kind.NONE:
        return ~has_any
    return (has_all if kind is Kind.ALL else ~has_all) & F.lit(reachable)


def defaults() -> tuple[Constraints, Constraints]:
    """(for itemsets, for consequents): some episode, and that it is slow."""
    return Constraints().add(Kind.ANY, "episode:*"), Constraints().add(Kind.ANY, "duration:slow")


def with_consequent(itemsets: Constraints, consequent: Constraints) -> Constraints:
    """What rules ask of their consequent, they ask of the whole itemset too."""
    out = Constraints({k: set(v) for k, v in itemsets.of.items()}, itemsets.compat)
    for kind, names in consequent.of.items():
        out.add(kind, *names)
    return out
