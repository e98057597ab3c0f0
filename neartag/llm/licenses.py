"""Fuzzy search for short licence notices (operator 11).

A text is cut into words: runs of ASCII letters, digits and all characters beyond ASCII, with
A-Z in lower case.  Words joined by single spaces are the string that is searched, so comment
marks, line ends and punctuation inside a notice do not matter.

Notices are found with up to ``errors`` inserted, deleted or replaced characters.  A notice is
split into ``errors + 1`` pieces; a place with that few errors holds at least one piece
unchanged (pigeonhole), so all pieces of all notices are looked for at once, as exact seeds.
Around each seed lies the stretch that could hold the notice.  The regex library matches the
notice there with bounded errors, and reports span and edits.  Overlapping places of one notice
count once: the one with the fewest edits, then the longest, then the first.

Base phrases are found exactly, at every place where their words stand in a row.

Rows are independent, so there is no shuffle and no group.  Null and empty texts have no words
and no places.  Whole texts are searched, however long; the work per seed is bounded by the
length of its notice, and equal stretches are matched once while remembered.  Null ids and
repeated rows are kept as they are, ties between notices go to the one listed first, an empty
table gives an empty result, and columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from neartag.llm.common import id_and_text, slices

# Exact phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Notice:
    """A notice in the words that are searched, and the errors allowed in it."""

    label: str
    text: str
    errors: int

    def pieces(self) -> list[tuple[int, str]]:
        """``errors + 1`` nearly equal pieces with their offsets."""
        n, cuts = self.errors + 1, len(self.text)
        return [(cuts * i // n, self.text[cuts * i // n:cuts * (i + 1) // n]) for i in range(n)]


# About one error in ten characters; every piece has at least eight.
NOTICES = (
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("mit", "released under the mit license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "terms of the gnu general public license", 3),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 6),
    Notice("mpl", "subject to the terms of the mozilla public license", 4),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6),
    Notice("unlicense", "free and unencumbered software released into the public domain", 5),
    Notice("cc-by", "licensed under cc by 4 0", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by", "creative commons attribution", 2),
    Notice("proprietary", "all rights reserved", 1),
)

# A-Z to lower case; ASCII characters that are no letters or digits to a space.
PLAIN = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def places(plain: bytes, phrase: bytes) -> tuple[int, int, int]:
    """How often the phrase's words stand in a row in `` word word ... ``, with its first and last position."""
    wanted, n, first, last = b" " + phrase + b" ", 0, -1, -1
    at = plain.find(wanted)
    while at >= 0:
        n, first, last = n + 1, at if n == 0 else first, at
        at = plain.find(wanted, at + 1)
    return n, first, last


@dataclass(frozen=True)
class Place:
    """Where a notice was found: characters in the searched string, and its edits."""

    notice: int
    start: int
    end: int
    edits: int


class Search:
    """All notices over one string."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            for offset, piece in notice.pieces():
                seeds.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()
        # The best match of a stretch: fewest errors first, not the first that fits.
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.errors}}}") for n in notices]
        self.match = lru_cache(20_000)(self.best)

    def best(self, number: int, stretch: str) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match of a notice in a stretch."""
        found = self.patterns[number].search(stretch)
        return (*found.span(), sum(found.fuzzy_counts)) if found else None

    def find(self, plain: str) -> list[Place]:
        """The places of all notices, in order; places of one notice do not overlap."""
        stretches: dict[int, set[int]] = {}
        for end, (length, owners) in self.automaton.iter(plain):
            for number, offset in owners:
                stretches.setdefault(number, set()).add(end + 1 - length - offset)
        found = []
        for number, starts in stretches.items():
            notice = self.notices[number]
            size, spare = len(notice.text), notice.errors
            candidates = set()
            for start in starts:
                low, high = max(0, start - spare), min(len(plain), start + size + spare)
                match = self.match(number, plain[low:high])
                if match is not None:
                    candidates.add((match[2], match[0] - match[1], low + match[0], low + match[1]))
            taken: list[tuple[int, int]] = []
            for edits, _, start, end in sorted(candidates):
                at = bisect_right(taken, (start, end))
                if (at and taken[at - 1][1] > start) or (at < len(taken) and taken[at][0] < end):
                    continue
                taken.insert(at, (start, end))
                found.append(Place(number, start, end, edits))
        return sorted(found, key=lambda p: (p.start, p.end, p.notice))


@lru_cache(maxsize=4)
def search_of(notices: tuple[Notice, ...]) -> Search:
    return Search(notices)


def scan_text(text: str | None, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> dict:
    """Everything the operator reports about one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(PLAIN).split()
    plain = b" " + b" ".join(words) + b" "
    n_base, firsts, lasts, base_labels = 0, [], [], set()
    for phrase, label in base:
        n, first, last = places(plain, phrase.encode())
        if n:
            n_base += n
            firsts.append(plain.count(b" ", 0, first))
            lasts.append(plain.count(b" ", 0, last))
            base_labels.add(label)
    string = plain.decode("utf-8", "surrogatepass")
    found = search_of(notices).find(string)
    spans = []
    if found:
        # Words of the text and where they begin in the searched string.
        bounds = [m.span() for m in WORD.finditer(data)]
        begins, at = [], 1
        for word in words:
            begins.append(at)
            at += len(word.decode("utf-8", "surrogatepass")) + 1
        for place in found:
            inside = string[place.start:place.end]  # without the spaces that a match may begin or end with
            low, high = place.start + len(inside) - len(inside.lstrip(" ")), place.start + len(inside.rstrip(" "))
            one, other = bisect_right(begins, low) - 1, bisect_right(begins, high - 1) - 1
            notice = notices[place.notice]
            spans.append({"label": notice.label, "notice": notice.text, "edits": place.edits, "first_word": one, "last_word": other,
                          "start": len(data[:bounds[one][0]].decode("utf-8", "surrogatepass")),
                          "end": len(data[:bounds[other][1]].decode("utf-8", "surrogatepass")),
                          "score": 1.0 - place.edits / (notice.errors + 1)})
    score = max([1.0 if n_base else 0.0, *(s["score"] for s in spans)])
    return {"n_words": len(words), "n_base": n_base, "first_word": min(firsts, default=None), "last_word": max(lasts, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {s["label"] for s in spans})),
            "score": score, "spans": spans}


SPAN = "struct<label:string,notice:string,edits:int,first_word:bigint,last_word:bigint,start:bigint,end:bigint,score:double>"


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase,
    ``labels`` those of base phrases and notices.  ``score`` is 1 with a base phrase, else the
    best of the notices: 1 without edits, less in proportion to the errors allowed.  ``spans``
    has a row per notice found, with its place in characters of the text.
    """
    span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("edits", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                      ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
             "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [scan_text(t.as_py(), notices, base) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array([m[name] for m in made], kind) for name, kind in kinds.items())], ["doc_id", *kinds])

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             f"score double, spans array<{SPAN}>")
