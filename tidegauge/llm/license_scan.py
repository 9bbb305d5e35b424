"""License notices in texts: exact phrases, and fuzzy short notices.

A text is reduced to its words, lower-cased in A-Z only and joined by single
spaces, with a space at both ends.  Phrases are found where their words stand
consecutively.  Notices may be misspelt: each allows some edits of characters,
in proportion to its length.  With ``k`` edits allowed a notice is cut into
``k + 1`` pieces, and any place with at most ``k`` edits holds one of the pieces
as it is (pigeonhole).  One automaton over the pieces of all notices passes over
the text; each piece it finds marks a window where the notice can lie, as wide
as the notice and its edits allow.  There the regex library matches the notice
with bounded errors, with ever more of them until it fits, which tells span and
edits.  So no place within the bound is missed, and only windows are matched
fuzzily, each at bounded cost.  A window gives the places with the fewest edits.

Spans of one notice that overlap count once, as the one with the fewest edits
(ties: the first).  A notice inside a longer one's span doesn't count.

Defined cases: null and empty texts have no words and no notice; very long texts
are scanned whole; rows that repeat, or lack an id, have a row each; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, functions as F

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices by label, as they are commonly worded.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("artistic", "under the terms of the artistic license"),
    ("bsd", "licensed under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsl", "boost software license version 1 0"),
    ("cc0", "creative commons zero"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("cc-by", "licensed under cc by"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("epl", "eclipse public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "either version 2 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: One edit is allowed for so many characters of a notice.
PER_EDIT = 12

#: Bytes of words stay, A-Z in lower case; all others part words.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

HIT = "label string, first_word int, n_words int, edits int, similarity double"


def folded(text: str | None) -> tuple[str, int]:
    """Words joined and framed by single spaces, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else " ", len(words)


@dataclass(frozen=True)
class Notice:
    """A notice with the edits it allows, cut into pieces that cover it."""

    label: str
    text: str  # framed by spaces
    edits: int
    pieces: tuple[tuple[int, str], ...]
    patterns: tuple[regex.Pattern, ...]  # by the edits they allow

    @property
    def reach(self) -> int:
        return len(self.text) + self.edits


def notice(label: str, text: str, per_edit: int = PER_EDIT) -> Notice:
    framed = f" {' '.join(text.split())} "
    k = len(text) // per_edit
    cuts = [round(i * len(framed) / (k + 1)) for i in range(k + 2)]
    pieces = tuple((a, framed[a:b]) for a, b in pairwise(cuts))
    # the spaces around a notice are not for editing, so that it begins and ends with words
    exact = regex.escape(framed[1:-1], special_only=True, literal_spaces=True)
    return Notice(label, framed, k, pieces, tuple(regex.compile(f"(?<= )(?:{exact}){{e<={j}}}(?= )") for j in range(k + 1)))


class Scanner:
    """Finds notices in folded texts."""

    def __init__(self, notices: Iterable[tuple[str, str]] = NOTICES, per_edit: int = PER_EDIT):
        self.notices = [notice(label, text, per_edit) for label, text in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for at, piece in n.pieces:
                seeds.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if seeds:
            self.automaton.make_automaton()
        self._place = lru_cache(1 << 14)(self._search)  # notices repeat, and so do their windows

    def windows(self, text: str) -> Iterable[tuple[int, int, int]]:
        """(notice, start, end) around every seed, wide enough for any match that holds it."""
        if not self.notices:
            return
        for end, (size, owners) in self.automaton.iter(text):
            for i, at in owners:
                n = self.notices[i]
                start = end + 1 - size - at - n.edits
                yield i, max(0, start), min(len(text), start + n.reach + n.edits + 1)

    def _search(self, i: int, window: str) -> tuple[tuple[int, int, int], ...]:
        """(start, end, edits) of the notice's places in a window that take the fewest edits."""
        patterns = self.notices[i].patterns
        if not patterns[-1].search(window):
            return ()
        for edits, pattern in enumerate(patterns):
            if found := [(m.start(), m.end(), edits) for m in pattern.finditer(window, overlapped=True)]:
                return tuple(found)
        return ()

    def places(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in a folded text; those of one notice don't overlap."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for i, start, end in set(self.windows(text)):
            for a, b, edits in self._place(i, text[start:end]):
                found.setdefault(i, set()).add((edits, start + a, start + b))
        best = [(i, *span) for i, spans in found.items() for span in _apart(spans)]
        return sorted(best, key=lambda p: (p[1], -p[2], p[0]))

    def hits(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, words, edits, similarity) in a folded text."""
        found, at, before, reach = [], 0, 0, 0
        for i, a, b, edits in self.places(text):
            if b <= reach:  # inside a longer notice
                continue
            reach = b
            before += text.count(" ", at, a)
            at = a
            n = self.notices[i]
            found.append((n.label, before - 1, text.count(" ", a, b) + 1, edits, 1 - edits / (len(n.text) - 2)))
        return found


def _apart(spans: Iterable[tuple[int, int, int]]) -> Iterable[tuple[int, int, int]]:
    """Of spans (edits, start, end) those with the fewest edits that don't overlap better ones, as (start, end, edits)."""
    taken: list[tuple[int, int]] = []
    for edits, a, b in sorted(spans):
        i = bisect(taken, (a, b))
        if (not i or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b))
            yield a, b, edits


def phrase_places(text: str, phrase: str) -> list[int]:
    """Words at which the words of ``phrase`` stand in a folded text, overlapping ones too."""
    framed, out, at, before, counted = f" {phrase} ", [], text.find(f" {phrase} "), 0, 0
    while at >= 0:
        before += text.count(" ", counted, at)
        counted = at
        out.append(before)
        at = text.find(framed, at + 1)
    return out


def scan(text: Column, phrases: dict[str, str] = PHRASES, notices: Iterable[tuple[str, str]] = NOTICES, per_edit: int = PER_EDIT) -> Column:
    """Struct of a text's n_words, n_base, first_word, last_word, base_labels, labels, score and hits.

    ``hits`` lists the notices with their spans in words; ``score`` is the best similarity, 1 for a phrase.
    """
    notices = tuple(notices)

    @F.pandas_udf(f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, hits array<struct<{HIT.replace(' ', ':').replace(',:', ',')}>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices, per_edit)
        for texts in batches:
            rows = []
            for text in texts:
                words, n = folded(text)
                base = {p: phrase_places(words, p) for p in phrases}
                starts = [at for places in base.values() for at in places]
                labels = {phrases[p] for p, places in base.items() if places}
                hits = scanner.hits(words)
                score = 1.0 if starts else max((h[4] for h in hits), default=0.0)
                every = labels | {h[0] for h in hits}
                rows.append((n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, hits))
            out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "hits"])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return find(text)
