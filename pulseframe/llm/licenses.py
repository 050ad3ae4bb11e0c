"""License scans: exact phrases and fuzzy short notices.

A notice of a few words is searched with up to k edits.  Cut into k + 1 pieces, at
least one piece of any such match stands in the text unchanged (pigeonhole).  The
pieces of all notices form one Aho-Corasick automaton; a hit names a notice and the
only window it can lie in; the regex library then looks for the notice with at most
k edits in that window and gives its span and its edits.  The words that tell licenses
apart take at most one edit, the shortest none.  Windows are searched one by
one, the match with the fewest edits is taken first, and what a taken match leaves of
a window is searched again, so a better match never hides another beside it.  A match
that lies inside one of a longer notice is part of that, and one that a word before it
denies is none.

Defined results: a null or empty text has no words, no labels and score 0; equal
rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm.common import id_type, mapped, table, texts

# Phrases that are found word by word, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Short notices of common licenses, as normalised words, and the label of each.
NOTICES = {
    "permission is hereby granted free of charge to any person": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "distributed under the mit license": "mit",
    "licensed under the apache license": "apache-2.0",
    "released under the apache license": "apache-2.0",
    "distributed under the apache license": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "released under the bsd license": "bsd",
    "licensed under the bsd license": "bsd",
    "distributed under the bsd license": "bsd",
    "permission to use copy modify and distribute this software": "isc",
    "released under the isc license": "isc",
    "licensed under the isc license": "isc",
    "gnu general public license": "gpl",
    "released under the gpl": "gpl",
    "licensed under the gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "released under the lgpl": "lgpl",
    "licensed under the lgpl": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the agpl": "agpl",
    "licensed under the agpl": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common public license": "cpl",
    "microsoft public license": "ms-pl",
    "european union public licence": "eupl",
    "server side public license": "sspl",
    "common development and distribution license": "cddl",
    "business source license": "busl",
    "boost software license": "bsl",
    "academic free license": "afl",
    "licensed under the artistic license": "artistic",
    "released under the artistic license": "artistic",
    "altered source versions must be plainly marked as such": "zlib",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons zero": "cc0",
    "licensed under cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noderivs": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noncommercial noderivs": "cc-by-nc-nd",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by nc sa": "cc-by-nc-sa",
    "licensed under cc by nc nd": "cc-by-nc-nd",
    "all rights reserved": "reserved",
    "no part of this publication may be reproduced": "reserved",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "placed in the public domain": "public-domain",
}
# Words that tell one license from another, and the edits each may have where it stands in a notice.
KEY_WORDS = {
    "mit": 0, "bsd": 0, "isc": 0, "gpl": 0, "lgpl": 0, "agpl": 0, "cc": 0, "cc0": 0, "nc": 0, "sa": 0, "nd": 0, "sil": 0,
    "side": 0, "font": 0, "gnu": 1, "apache": 1, "lesser": 1, "library": 1, "affero": 1, "documentation": 1, "mozilla": 1,
    "eclipse": 1, "common": 1, "microsoft": 1, "european": 1, "server": 1, "development": 1, "business": 1, "boost": 1,
    "academic": 1, "artistic": 1, "python": 1, "database": 1, "zero": 1, "unencumbered": 1, "attribution": 1,
    "sharealike": 1, "noderivatives": 1, "noderivs": 1, "noncommercial": 1, "public": 1, "domain": 1, "rights": 1,
    "publication": 1,
}
# A notice is not meant where one of the first stands within two words before it, or one of the others inside it.
NEGATIONS = {"not", "never", "nor", "neither", "cannot", "without", "no"}
OTHER_WORDS = {"preserved", "deserved", "observed", "reversed"}
#: One edit is allowed for this many characters of a notice.
CHARS_PER_EDIT = 10

# Fixed value: a word is made of [0-9a-z] after lower-casing A-Z, or of non-ASCII characters.
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


@dataclass(frozen=True)
class Span:
    """A place of a label: words ``first_word`` (from 0) to ``last_word`` inclusive."""

    label: str
    first_word: int
    last_word: int
    edits: int
    length: int


def normalised(text: str | None) -> bytes:
    """Words joined by one space, with a space at both ends."""
    return b" " + b" ".join((text or "").encode().translate(_TO_WORDS).split()) + b" "


def places(norm: bytes, phrase: str) -> list[int]:
    """Word numbers at which the words of ``phrase`` stand one after the other."""
    wanted, found, word, last = b" " + phrase.encode() + b" ", [], 0, 0
    at = norm.find(wanted)
    while at >= 0:
        word += norm.count(b" ", last, at)
        last = at
        found.append(word)
        at = norm.find(wanted, at + 1)
    return found


def _pattern(notice: str, edits: int) -> str:
    """The notice with up to ``edits`` edits in each run between its key words."""
    parts, run = [], ""
    for piece in re.findall(r" *[^ ]+", notice):
        word = piece.lstrip(" ")
        if word not in KEY_WORDS:
            run += piece
            continue
        run += piece[: -len(word)]
        if run:
            parts.append(f"(?:{regex.escape(run)}){{e<={edits}}}")
        allowed = min(KEY_WORDS[word], edits)
        parts.append(f"(?:{word}){{e<={allowed}}}" if allowed else rf"(?<![^ ]){word}(?![^ ])")
        run = ""
    return "".join(parts) + (f"(?:{regex.escape(run)}){{e<={edits}}}" if run else "")


class Finder:
    """The compiled notices: seeds of all of them in one automaton, and a pattern each."""

    def __init__(self, notices: dict[str, str], chars_per_edit: int):
        self.notices, self.whole, seeds = [], [], {}
        for notice, label in notices.items():
            edits = len(notice) // chars_per_edit
            pattern = regex.compile(_pattern(notice, edits), regex.BESTMATCH)
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for start, end in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[start:end], []).append((len(self.notices), start))
            self.notices.append((notice, label, edits, pattern))
            # Words that stand in every match as they are.
            self.whole.append([f" {w} " for w in dict.fromkeys(notice.split()) if min(KEY_WORDS.get(w, 1), edits) == 0])
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def spans(self, norm: str) -> list[Span]:
        """Non-overlapping matches of every notice, those with fewer edits first."""
        windows: dict[int, set[tuple[int, int]]] = {}
        for end, (size, uses) in self.automaton.iter(norm):
            start = end - size + 1
            for k, offset in uses:
                notice, _, edits, _ = self.notices[k]
                low = max(0, start - offset - edits)
                high = min(len(norm), start - offset + len(notice) + edits)
                around = norm[max(0, low - 1) : high] + " "
                if all(w in around for w in self.whole[k]):
                    windows.setdefault(k, set()).add((low, high))
        found = []
        for k, own in windows.items():
            notice, label, most, pattern = self.notices[k]
            word = last = 0
            for at, end, edits in _taken(pattern, norm, own, most):
                # A best match can begin or end with the space beside a word.
                start = at + (norm[at] == " ")
                word += norm.count(" ", last, start)
                last = start
                inside = norm[start:end].rstrip(" ").count(" ")
                if not _denied(norm, start, end):
                    found.append(Span(label, word - 1, word - 1 + inside, edits, len(notice)))
        return _outermost(found)


def _denied(norm: str, start: int, end: int) -> bool:
    """Whether the words at ``start`` to ``end`` are denied or hold a word of another meaning."""
    first = norm.rfind(" ", 0, start)
    before = norm.rfind(" ", 0, max(norm.rfind(" ", 0, max(first, 0)), 0))
    close = norm.find(" ", end - 1)
    inside = norm[first + 1 : len(norm) if close < 0 else close]
    return not (NEGATIONS.isdisjoint(norm[before + 1 : first].split()) and OTHER_WORDS.isdisjoint(inside.split()))


def _outermost(spans: list[Span]) -> list[Span]:
    """Spans that lie in no span of a longer notice.

    Spans of one notice do not overlap, so no more are open at a time than there are notices.
    """
    kept: list[Span] = []
    reach: list[Span] = []
    for span in sorted(spans, key=lambda s: (s.first_word, -s.last_word, -s.length, s.edits)):
        reach = [s for s in reach if s.last_word >= span.first_word]
        if not any(s.last_word >= span.last_word and s.length > span.length for s in reach):
            kept.append(span)
            reach.append(span)
    return kept


def _taken(
    pattern: regex.Pattern, norm: str, windows: set[tuple[int, int]], most: int
) -> list[tuple[int, int, int]]:
    """Start, end and edits of the matches in ``windows``, best first without overlaps, in order of place.

    The pattern bounds the edits of each of its runs; ``most`` bounds their sum.
    """
    heap: list[tuple[int, int, int, int, int]] = []

    def search(low: int, high: int) -> None:
        match = pattern.search(norm, low, high)
        if match and sum(match.fuzzy_counts) <= most:
            heapq.heappush(heap, (sum(match.fuzzy_counts), match.start(), match.end(), low, high))

    for low, high in windows:
        search(low, high)
    taken: list[tuple[int, int, int]] = []
    while heap:
        edits, start, end, low, high = heapq.heappop(heap)
        # The first taken match that ends after this one's start.
        at = bisect.bisect_right(taken, start, key=lambda t: t[1])
        if at == len(taken) or taken[at][0] >= end:
            taken.insert(at, (start, end, edits))
        else:
            search(low, min(high, taken[at][0]))
            search(max(low, taken[at][1]), high)
    return taken


@cache
def _finder(notices: tuple[tuple[str, str], ...], chars_per_edit: int) -> Finder:
    return Finder(dict(notices), chars_per_edit)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    chars_per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """Per document: number of words, exact places, fuzzy spans, labels and a score.

    ``spans`` lists label, first and last word and edits of every fuzzy match;
    ``score`` is 1 for an exact phrase, else the best ``1 - edits / length`` of a
    match, else 0.  ``labels`` holds the labels of both, sorted and distinct.
    """
    exact = PHRASES if phrases is None else phrases
    fuzzy = tuple((NOTICES if notices is None else notices).items())

    def scan(batch: dict[str, list]) -> dict[str, list]:
        finder = _finder(fuzzy, chars_per_edit)
        out: dict[str, list] = {n: [] for n in names}
        out["doc_id"] = batch["doc_id"]
        for text in batch["text"]:
            norm = normalised(text)
            found = {label: places(norm, phrase) for phrase, label in exact.items()}
            at = [p for one in found.values() for p in one]
            base = sorted({label for label, one in found.items() if one})
            spans = sorted(finder.spans(norm.decode()), key=lambda s: (s.first_word, s.label, s.last_word))
            out["n_words"].append(max(norm.count(b" ") - 1, 0) if norm != b"  " else 0)
            out["n_base"].append(len(at))
            out["first_word"].append(min(at, default=None))
            out["last_word"].append(max(at, default=None))
            out["base_labels"].append(",".join(base))
            out["labels"].append(",".join(sorted({*base, *(s.label for s in spans)})))
            out["score"].append(1.0 if at else max((1 - s.edits / s.length for s in spans), default=0.0))
            out["spans"].append([(s.label, s.first_word, s.last_word, s.edits) for s in spans])
        return out

    picked = texts(docs, id_col, text_col)
    names = "doc_id n_words n_base first_word last_word base_labels labels score spans".split()
    kinds = [
        id_type(picked), "long", "long", "long", "long", "string", "string", "double",
        "array<struct<label: string, first_word: int, last_word: int, edits: int>>",
    ]
    return mapped(picked, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)), lambda b: _tuples(scan(b)))


def _tuples(out: dict[str, list]) -> dict[str, list]:
    keys: Sequence[str] = ("label", "first_word", "last_word", "edits")
    out["spans"] = [[dict(zip(keys, s)) for s in one] for one in out["spans"]]
    return out


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
