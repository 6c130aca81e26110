"""Boolean trigram queries that a regular expression implies.

A text that matches the expression contains the trigrams the query asks for, so texts
that fail the query need no matching. The query is over lower-case text, which covers
expressions in either case. `ANY` means that nothing can be required.
"""

from __future__ import annotations

from itertools import product
from re import _parser as parser

ANY = ()
MOST_STRINGS = 64
MOST_CHARACTERS = 4

#: A query is ANY, a trigram, ("and", queries) or ("or", queries).
Query = tuple | str


def both(kind: str, parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "or" and ANY in parts:
        return ANY
    parts = [p for p in parts if p != ANY]
    if len(parts) < 2:
        return parts[0] if parts else ANY
    return (kind, tuple(parts))


def of_strings(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return ANY
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [own for own in sets if not any(other < own for other in sets)]
    return both("or", [both("and", sorted(own)) for own in sorted(least, key=sorted)])


def strings_of(kind, value) -> set[str] | None:
    """All lower-case strings that a node stands for, if they are few."""
    name = str(kind)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return {""}
    if name == "IN":
        found = set()
        for sort, what in value:
            if str(sort) == "LITERAL":
                found.add(chr(what).lower())
            elif str(sort) == "RANGE" and what[1] - what[0] <= 2 * MOST_CHARACTERS:
                found |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST_CHARACTERS else None
    if name == "SUBPATTERN":
        return sequence_strings(value[-1])
    if name == "BRANCH":
        parts = [sequence_strings(s) for s in value[1]]
        return None if None in parts or sum(map(len, parts)) > MOST_STRINGS else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        own = sequence_strings(inner)
        if own is None or int(most) > 3 or sum(len(own) ** n for n in range(least, int(most) + 1)) > MOST_STRINGS:
            return None
        return {"".join(p) for n in range(least, int(most) + 1) for p in product(own, repeat=n)}
    return None


def sequence_strings(nodes) -> set[str] | None:
    found = {""}
    for kind, value in nodes:
        own = strings_of(kind, value)
        if own is None or len(found) * len(own) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def node_query(kind, value) -> Query:
    name = str(kind)
    if name == "SUBPATTERN":
        return sequence_query(value[-1])
    if name == "BRANCH":
        return both("or", [sequence_query(s) for s in value[1]])
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] >= 1:
        return sequence_query(value[2])
    return ANY


def sequence_query(nodes) -> Query:
    parts: list[Query] = []
    run = {""}
    for kind, value in nodes:
        own = strings_of(kind, value)
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        parts.append(of_strings(run))
        run = own if own is not None else {""}
        if own is None:
            parts.append(node_query(kind, value))
    return both("and", [*parts, of_strings(run)])


def query_of(pattern: str) -> Query:
    return sequence_query(parser.parse(pattern))


def grams_in(query: Query) -> list[str]:
    if isinstance(query, str):
        return [query]
    return list(dict.fromkeys(g for part in query[1:] for q in part for g in grams_in(q)))
