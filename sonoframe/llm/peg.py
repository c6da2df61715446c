"""A small parsing-expression-grammar engine.

An expression is a function from (text, position) to (end, tree) or None. Choice is ordered and greedy repetition
never gives back, as usual for such grammars. A tree is (name, start, end, children); expressions that are not
named give the trees of their parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Tree = tuple
Parser = Callable[[str, int], "tuple[int, tuple] | None"]


def term(pattern: str, flags: int = 0) -> Parser:
    """A terminal: what the regular expression matches here."""
    match = re.compile(pattern, flags).match

    def parse(text: str, at: int):
        found = match(text, at)
        return None if found is None else (found.end(), ())

    return parse


def seq(*parts: Parser) -> Parser:
    def parse(text: str, at: int):
        trees: tuple = ()
        for part in parts:
            got = part(text, at)
            if got is None:
                return None
            at, more = got
            trees += more
        return at, trees

    return parse


def choice(*parts: Parser) -> Parser:
    def parse(text: str, at: int):
        for part in parts:
            got = part(text, at)
            if got is not None:
                return got
        return None

    return parse


def many(part: Parser) -> Parser:
    """Zero or more; stops where nothing is consumed."""

    def parse(text: str, at: int):
        trees: list = []
        while True:
            got = part(text, at)
            if got is None or got[0] == at:
                return at, tuple(trees)
            at = got[0]
            trees.extend(got[1])

    return parse


def maybe(part: Parser) -> Parser:
    def parse(text: str, at: int):
        return part(text, at) or (at, ())

    return parse


def but(part: Parser) -> Parser:
    """A predicate: succeeds, consuming nothing, where ``part`` fails."""

    def parse(text: str, at: int):
        return (at, ()) if part(text, at) is None else None

    return parse


def node(name: str, part: Parser, where: Callable[[str], bool] | None = None) -> Parser:
    """A named tree around ``part``; ``where`` may refuse the text that it spans."""

    def parse(text: str, at: int):
        got = part(text, at)
        if got is None or (where is not None and not where(text[at : got[0]])):
            return None
        return got[0], ((name, at, got[0], got[1]),)

    return parse


def nested(pairs: dict[str, str], leaf: Parser) -> Parser:
    """Text in brackets (``pairs``: opening to closing) that may hold brackets, of any depth, and ``leaf`` between them.
    Open brackets are kept on a stack. Those still open where matching fails would fail there too, so they are not tried again."""
    seen: list = [None, set()]

    def parse(text: str, at: int):
        if at >= len(text) or text[at] not in pairs:
            return None
        if seen[0] is not text:
            seen[:] = [text, set()]
        if at in seen[1]:
            return None
        open_at = [at]
        at += 1
        while open_at:
            if at < len(text) and text[at] in pairs:
                open_at.append(at)
                at += 1
            elif at < len(text) and (got := leaf(text, at)) is not None and got[0] > at:
                at = got[0]
            elif at < len(text) and text[at] == pairs[text[open_at[-1]]]:
                open_at.pop()
                at += 1
            else:
                seen[1].update(open_at)
                return None
        return at, ()

    return parse
