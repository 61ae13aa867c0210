"""Ordered rules read from a table: all their keywords in one automaton, so that a text is read once for any number of rules."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "kind string, place int, pattern string, fold boolean, value string"
_PLAIN = re.compile(r"(?:[^\\^$.*+?{}\[\]()|]|\\[^\w])+")


def keywords(pattern: str) -> list[str] | None:
    """The literal alternatives that a pattern consists of; None if it is of another form."""
    parts = pattern.split("|")
    if not all(_PLAIN.fullmatch(p) for p in parts):
        return None
    return [re.sub(r"\\(.)", r"\1", p) for p in parts]


@dataclass
class Rulebook:
    """Rules by kind. The first rule of a kind, by place, that a text matches decides; with ``fold``, text and keywords are
    lower-cased. Patterns of literal alternatives go into an automaton; others are tried one by one, those alone that
    stand before the best keyword found."""

    rules: dict[str, list[tuple[int, str, bool, str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: Iterable[tuple]) -> Rulebook:
        """``rows``: kind, place, pattern, fold, value."""
        book = cls()
        for kind, place, pattern, fold, value in rows:
            book.rules.setdefault(kind, []).append((place, pattern, bool(fold), value))
        for of_kind in book.rules.values():
            of_kind.sort(key=lambda r: r[0])
        return book

    @classmethod
    def read(cls, table: DataFrame, most: int = 1_000_000) -> Rulebook:
        """The rules of a table (``RULES``). They are a program, which every task holds; more than ``most`` raise."""
        rows = table.select("kind", "place", "pattern", "fold", "value").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rules")
        return cls.of(map(tuple, rows))

    @cached_property
    def compiled(self) -> dict[str, tuple]:
        """For each kind: automata (plain, folded) of keyword -> place among the kind's rules, and the patterns left over."""
        out = {}
        for kind, of_kind in self.rules.items():
            first: tuple[dict, dict] = ({}, {})
            patterns = []
            for at, (_, pattern, fold, _) in enumerate(of_kind):
                held = keywords(pattern)
                if held is None:
                    patterns.append((at, re.compile(pattern, re.IGNORECASE if fold else 0)))
                for word in held or ():
                    first[fold].setdefault(word.lower() if fold else word, at)
            automata = []
            for words in first:
                automaton = ahocorasick.Automaton()
                for word, at in words.items():
                    automaton.add_word(word, at)
                automaton.make_automaton()
                automata.append(automaton if words else None)
            out[kind] = (*automata, patterns)
        return out

    def match(self, kind: str, text: str | None) -> str | None:
        """Value of the first rule of a kind that occurs in a text."""
        if text is None or kind not in self.rules:
            return None
        plain, folded, patterns = self.compiled[kind]
        best = len(self.rules[kind])
        for automaton, held in ((plain, text), (folded, text.lower() if folded else "")):
            if automaton:
                best = min(best, min((at for _, at in automaton.iter(held)), default=best))
        for at, pattern in patterns:
            if at > best:
                break
            if pattern.search(text):
                best = at
        return self.rules[kind][best][3] if best < len(self.rules[kind]) else None

    def __getstate__(self):
        return {"rules": self.rules}  # automata are made again, once a worker

    def column(self, spark, kind: str, text: Column) -> Column:
        """``match`` as a Column: only the text goes through Arrow, and the rules are broadcast."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("string")
        def matched(texts: pa.Array) -> pa.Array:
            book = shared.value
            return pa.array([book.match(kind, t) for t in texts.to_pylist()], pa.string())

        return matched(text)


__all__ = ["RULES", "Rulebook", "keywords"]
