"""Thousands of signatures over texts: one automaton of literals, then the few patterns it points at."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import required_literal

#: Bytes of all patterns of a registry, which every worker holds.
MOST_BYTES = 16 << 20


#: A pattern that is nothing but a word: case flag, word edge, literal, word edge.
_WORD = re.compile(r"(\(\?i\))?(\\b)?((?:[^\\.^$*+?{}\[\]|()]|\\[^0-9A-Za-z])+)(\\b)?")
_WORD_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
#: What `.` does not match in Java: Python's own leaves out the line feed only.
_ANY = r"[^\n\r\u0085\u2028\u2029]"


def _folded(text: str) -> str:
    """ASCII letters in lower case, all else as it is, so that places stay the same."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _compiled(pattern: str):
    if re.match(r"\(\?[a-z]*s", pattern):
        return re.compile(pattern, re.ASCII).search
    body = re.sub(r"(\\.|\[\^?\]?(?:\\.|[^\]])*\])|\.", lambda m: m[1] or _ANY, pattern, flags=re.DOTALL)
    return re.compile(body, re.ASCII).search


class Signatures:
    """Ids and patterns of a registry, as `matching_ids` takes them, sent to the workers as they are.

    Every pattern has a literal that its matches must hold. An Aho–Corasick automaton of all
    literals reads a lower-case text once. Patterns that are plain words are settled where the automaton
    finds them, by the characters beside the place; other patterns whose literal occurred, and those
    without one, are searched for, one after the other until the first of an id matches. The work for
    a text follows its length and what it holds, not the size of the registry.
    """

    def __init__(self, signatures):
        self.signatures = tuple((i, tuple(patterns)) for i, patterns in signatures)
        size = sum(len(p.encode()) for _, patterns in self.signatures for p in patterns)
        if size > MOST_BYTES:
            raise ValueError(f"{size} bytes of patterns are more than a worker should hold; split the registry")

    def __getstate__(self):
        return {"signatures": self.signatures}

    @cached_property
    def _plan(self):
        """(automaton or None, entries without a literal, compiled patterns).

        A literal holds (its number, its length, words, other patterns); a word is (signature, exact text or
        None for any case, whether a word character must stand before and after it, or None for no matter).
        """
        by_literal: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
        always: list[tuple[int, str]] = []
        for k, (_, patterns) in enumerate(self.signatures):
            for p in patterns:
                if word := _WORD.fullmatch(p):
                    exact = re.sub(r"\\(.)", r"\1", word[3], flags=re.DOTALL)
                    before = (exact[0] not in _WORD_CHARS) if word[2] else None
                    after = (exact[-1] not in _WORD_CHARS) if word[4] else None
                    by_literal[_folded(exact)][0].append((k, None if word[1] else exact, before, after))
                elif p.isascii() and (literal := required_literal(p)):
                    by_literal[literal][1].append((k, p))
                else:
                    always.append((k, p))
        automaton = None
        if by_literal:
            automaton = ahocorasick.Automaton()
            for i, (literal, (words, others)) in enumerate(by_literal.items()):
                automaton.add_word(literal, (i, len(literal), tuple(words), tuple(others)))
            automaton.make_automaton()
        return automaton, always, {}

    def found_in(self, text: str) -> set[int]:
        """Places in the registry of the signatures that occur."""
        automaton, always, compiled = self._plan
        wanted = list(always)
        found: set[int] = set()
        if automaton is not None:
            called: set[int] = set()  # literals whose other patterns are wanted
            settled: set[int] = set()  # literals with nothing left to learn
            for end, (i, size, words, others) in automaton.iter(_folded(text)):
                if i in settled:
                    continue
                start, stop = end + 1 - size, end + 1
                left = 0
                for k, exact, before, after in words:
                    if k in found:
                        continue
                    if (
                        (before is None or (start > 0 and text[start - 1] in _WORD_CHARS) == before)
                        and (after is None or (stop < len(text) and text[stop] in _WORD_CHARS) == after)
                        and (exact is None or text.startswith(exact, start))
                    ):
                        found.add(k)
                    else:
                        left += 1
                if others and i not in called:
                    called.add(i)
                    wanted += others
                if not left:
                    settled.add(i)
        for k, pattern in wanted:
            if k in found:
                continue
            if pattern not in compiled:
                compiled[pattern] = _compiled(pattern)
            if compiled[pattern](text):
                found.add(k)
        return found

    def ids_in(self, text: str) -> list[str]:
        return sorted({self.signatures[k][0] for k in self.found_in(text)})


def matching_ids(text: Column, signatures) -> Column:
    """Like `functions.text.matching_ids`, for registries of any number of signatures; a NULL text has NULL."""
    registry = Signatures(signatures)

    @F.arrow_udf("array<string>")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else registry.ids_in(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return ids(text)


def matching_by(text: Column, categories: dict) -> Column:
    """A struct of `functions.text.matching_ids` for each category; the text is read once for all of them."""
    entries = [(category, i, patterns) for category, signatures in categories.items() for i, patterns in signatures]
    registry = Signatures((i, patterns) for _, i, patterns in entries)
    owner, names = [category for category, _, _ in entries], list(categories)

    @F.arrow_udf("struct<" + ",".join(f"`{c}`:array<string>" for c in names) + ">")
    def ids(texts: pa.Array) -> pa.Array:
        found: dict[str, list] = {c: [] for c in names}
        for t in texts.to_pylist():
            here: dict[str, set] = {c: set() for c in names}
            for k in registry.found_in(t) if t else ():
                here[owner[k]].add(registry.signatures[k][0])
            for c in names:
                found[c].append(sorted(here[c]))
        return pa.StructArray.from_arrays([pa.array(found[c], pa.list_(pa.string())) for c in names], names)

    return ids(text)
