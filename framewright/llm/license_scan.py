"""Operator 13: licence notices in texts, also with errors.

A text's words (runs of ASCII letters and digits and characters beyond ASCII, only A-Z lower-cased) are joined by blanks. A notice with k errors allowed is split into k + 1 pieces: of any text within k edits, one piece is left
whole. Notices whose name alone tells them apart (``mit``) keep the name exact, and that is their seed. One automaton finds all pieces, names and base phrases in a single pass; the windows around pieces, ends moved to
blanks and overlapping ones joined, are the only places where the regex library's bounded-error matching looks. Any place that matches lies in such a window, so nothing is missed.

``scan`` reports every found notice with its words, its characters in the text and its edits; ``summarize`` one row for each text: base phrases counted exactly, labels of both, and as score 1 for a base phrase, else the
largest share of a notice's characters that needed no edit (0 without one).

Null and empty texts have no words and no labels. Null ids and repeated rows stay as rows of their own. Texts are scanned whole, long ones too; matches don't overlap within a window. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import documents, map_text

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: One edit for so many characters of a notice's part with errors, one at least.
CHARACTERS_AN_EDIT = 10
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    """A notice in words; ``exact`` characters at its start take no errors."""

    label: str
    words: str
    exact: int = 0

    @property
    def edits(self) -> int:
        return max(1, (len(self.words) - self.exact) // CHARACTERS_AN_EDIT)

    def seeds(self) -> list[tuple[str, int]]:
        """Pieces and where they begin in the notice."""
        if self.exact:
            return [(" " + self.words[: self.exact], -1)]
        n, k = len(self.words), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(self.words[s:e], s) for s, e in zip(cuts, cuts[1:])]

    @property
    def pattern(self) -> regex.Pattern:
        fixed, rest = self.words[: self.exact], self.words[self.exact :]
        return _pattern(fixed, rest, self.edits)


@cache
def _pattern(fixed: str, rest: str, edits: int) -> regex.Pattern:
    return regex.compile(f"(?e)(?<![^ ]){regex.escape(fixed)}(?:{regex.escape(rest)}){{e<={edits}}}(?![^ ])")


# Wordings of public licences, without punctuation.
NOTICES = (
    Notice("mit", "mit license", 4),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Notice("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    Notice("apache", "apache license"),
    Notice("apache", "licensed under the apache license version 2 0"),
    Notice("apache", "you may not use this file except in compliance with the license"),
    Notice("gpl", "general public license"),
    Notice("gpl", "you can redistribute it and or modify it under the terms of the gnu"),
    Notice("lgpl", "lesser general public license"),
    Notice("agpl", "affero general public license"),
    Notice("bsd", "bsd license", 4),
    Notice("bsd", "bsd 2 clause license", 13),
    Notice("bsd", "bsd 3 clause license", 13),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("isc", "isc license", 4),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("mpl", "mozilla public license"),
    Notice("epl", "eclipse public license"),
    Notice("cc", "licensed under cc by"),
    Notice("cc", "creative commons attribution"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
)


def fold(text: str | None) -> tuple[str, int]:
    """The words with a blank before, between and after them, and their number."""
    words = text.encode().translate(_FOLD).split() if text else []
    return b" ".join([b"", *words, b""]).decode(), len(words)


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        values: dict[str, list] = {}
        for phrase, label in BASE.items():
            values.setdefault(f" {phrase} ", []).append((label, None))
        for i, notice in enumerate(notices):
            for piece, at in notice.seeds():
                values.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in values.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def places(self, folded: str) -> tuple[list[tuple[int, str]], dict[int, list[tuple[int, int]]]]:
        """Base phrases (place of their first letter, label) and, for each notice with a seed, its joined windows."""
        base, windows = [], {}
        for end, (size, values) in self.automaton.iter(folded):
            start = end + 1 - size
            for of, at in values:
                if at is None:
                    base.append((start + 1, of))
                    continue
                notice = self.notices[of]
                lo = max(0, folded.rfind(" ", 0, max(1, start - at - notice.edits + 1)))
                hi = folded.find(" ", min(len(folded) - 1, max(end, start - at + len(notice.words) + notice.edits)))
                hi = len(folded) if hi < 0 else hi
                of_notice = windows.setdefault(of, [])
                # seeds of one notice come in the order of their ends, windows may begin earlier than the last one
                while of_notice and of_notice[-1][1] >= lo:
                    before = of_notice.pop()
                    lo, hi = min(lo, before[0]), max(hi, before[1])
                of_notice.append((lo, hi))
        return base, windows

    def matches(self, folded: str, windows: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
        """Notice, first and last place, edits of every place that matches."""
        out = []
        for of, parts in windows.items():
            for lo, hi in parts:
                for m in self.notices[of].pattern.finditer(folded, lo, hi):
                    out.append((of, *_trimmed(folded, m.start(), m.end()), sum(m.fuzzy_counts)))
        return sorted(out, key=lambda x: x[1:3])


def _trimmed(folded: str, start: int, end: int) -> tuple[int, int]:
    """Without the blanks that an edit may take in."""
    while start < end and folded[start] == " ":
        start += 1
    while start < end and folded[end - 1] == " ":
        end -= 1
    return start, end


@cache
def scanner(notices: tuple[Notice, ...] = NOTICES) -> Scanner:
    return Scanner(notices)


def _word_at(folded: str, place: int) -> int:
    return folded.count(" ", 0, place) - 1


FOUND = ("doc_id", "notice", "label", "first_word", "last_word", "start", "end", "edits", "found")


def scan(df: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """FOUND: every place that a notice matches; start and end count characters of the text, ``found`` is what stands there."""

    def run(ids, texts):
        rows = []
        for doc_id, text in zip(ids, texts):
            own = scanner(notices)
            folded, _ = fold(text)
            found = own.matches(folded, own.places(folded)[1])
            words = [m.span() for m in _WORD.finditer(text)] if found else []
            for of, s, e, edits in found:
                first, last = _word_at(folded, s), _word_at(folded, e - 1)
                at, to = words[first][0], words[last][1]
                rows.append((doc_id, notices[of].words, notices[of].label, first, last, at, to, edits, text[at:to]))
        return dict(zip(FOUND, map(list, zip(*rows)))) if rows else {c: [] for c in FOUND}

    return map_text(df, run, "doc_id long, notice string, label string, first_word long, last_word long, start long, end long, edits long, found string")


SUMMARY = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_found")


def summarize(df: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """SUMMARY: one row for each text; n_found counts the places that notices match."""

    def one(doc_id, text):
        own = scanner(notices)
        folded, n_words = fold(text)
        base, windows = own.places(folded)
        found = own.matches(folded, windows)
        ends = [_word_at(folded, place(base)[0]) for place in (min, max)] if base else [None, None]
        base_labels = {label for _, label in base}
        labels = base_labels | {notices[of].label for of, *_ in found}
        score = 1.0 if base else max((1 - edits / len(notices[of].words) for of, *_, edits in found), default=0.0)
        return doc_id, n_words, len(base), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, len(found)

    def run(ids, texts):
        return dict(zip(SUMMARY, map(list, zip(*map(one, ids, texts))))) if ids else {c: [] for c in SUMMARY}

    return map_text(df, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_found long")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(documents(spark, sf_dir))
