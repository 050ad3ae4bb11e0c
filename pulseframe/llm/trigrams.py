"""Boolean trigram queries from regular expressions.

``clauses(pattern)`` lists alternatives; a text that matches the pattern contains every
trigram of at least one of them.  Trigrams are lower case, so the index they are looked up
in must be too; that only adds candidates.  An empty result means that nothing is mandatory.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

#: A class or a repeat with more strings than this is taken as unknown.
MAX_STRINGS = 16


def _strings(node) -> list[str] | None:
    """All strings a node matches, or None when they are many or unknown."""
    kind, value = node
    if kind is op.LITERAL:
        return [chr(value)]
    if kind is op.IN:
        found: list[str] = []
        for what, item in value:
            if what is op.LITERAL:
                found.append(chr(item))
            elif what is op.RANGE and item[1] - item[0] < MAX_STRINGS:
                found += map(chr, range(item[0], item[1] + 1))
            else:
                return None
        return found if len(found) <= MAX_STRINGS else None
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        parts = [_sequence(branch) for branch in value[1]]
        return None if None in parts else [s for part in parts for s in part]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        own = _sequence(inner)
        if own is None or high is op.MAXREPEAT or len(own) ** high > MAX_STRINGS:
            return None
        return [s for n in range(low, high + 1) for s in map("".join, product(own, repeat=n))]
    return None


def _sequence(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        own = _strings(node)
        if own is None or len(out) * len(own) > MAX_STRINGS:
            return None
        out = [a + b for a in out for b in own]
    return out


def _runs(nodes) -> list[list[str]]:
    """Stretches of the pattern whose strings are known, as lists of alternatives."""
    runs: list[list[str]] = [[""]]
    for node in nodes:
        own = _strings(node)
        if own is not None and len(runs[-1]) * len(own) <= 4 * MAX_STRINGS:
            runs[-1] = [a + b for a in runs[-1] for b in own]
            continue
        kind, value = node
        if own is not None:
            runs.append(own)
        elif kind is op.SUBPATTERN:
            runs += _runs(value[-1])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            # What must occur at least once, with unknown text on both sides.
            runs += _runs(value[2])
        runs.append([""])
    return runs


def trigrams(text: str) -> set[str]:
    text = text.lower()
    return {text[k : k + 3] for k in range(len(text) - 2)}


def clauses(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams; empty if the pattern has none."""
    out = [frozenset()]
    for run in _runs(_parser.parse(pattern)):
        own = {frozenset(trigrams(s)) for s in run}
        if frozenset() not in own:
            out = [a | b for a in out for b in own]
    # An alternative that asks for more than another one adds no candidates.
    out = [a for a in set(out) if not any(b < a for b in set(out))]
    return [] if frozenset() in out else sorted(out, key=sorted)
