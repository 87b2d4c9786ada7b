"""License scans: phrases, and fuzzy search for short notices.

Texts are compared as normalised words: A-Z in lower case, other ASCII punctuation as spaces. Each known
notice may be found with up to k edits (k grows with its length). It is split into k + 1 pieces, so
that any place within k edits holds at least one piece unchanged; an automaton finds all pieces in one
pass over a text, and around each the regex library's bounded-error matching decides and reports the
best span and its edits. Edits must not turn one license into another: a match begins and ends at words, short words
that tell notices apart (mit, bsd, clause counts, by, sa, nc, nd) stand as they are, and longer names have one edit at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.session import read_table, ship

# Base phrases with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Short notices of well-known licenses, in normalised words, with their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd 3 clause license", "bsd"),
    ("licensed under the bsd 2 clause license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("common development and distribution license", "cddl"),
    ("distributed under the boost software license", "boost"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib"),
    ("licensed under the european union public licence", "eupl"),
    ("this font software is licensed under the sil open font license", "ofl"),
    ("you may distribute under the terms of either the gnu general public license or the artistic license", "artistic"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("licensed under the microsoft public license", "ms-pl"),
    ("licensed under the academic free license", "afl"),
    ("licensed under the open software license", "osl"),
    ("server side public license", "sspl"),
    ("business source license", "bsl"),
    ("open database license", "odbl"),
    ("python software foundation license", "psf"),
    ("universal permissive license", "upl"),
    ("licensed under the creative commons attribution", "cc-by"),
    ("licensed under cc by", "cc-by"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("licensed under cc by nc sa", "cc-by-nc-sa"),
    ("licensed under cc by nc nd", "cc-by-nc-nd"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
    ("proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited", "proprietary"),
)
# Short words that tell notices apart, which no edit may touch, and names, which one may.
TELLING = frozenset("gnu mit bsd sil cc cc0 by sa nc nd 2 3".split())
NAMES = frozenset(
    "apache lesser library affero documentation mozilla eclipse boost european artistic microsoft academic server side business source database "
    "python universal permissive creative commons attribution sharealike noncommercial noderivatives unencumbered".split()
)
#: One edit is allowed for so many characters of a notice,
EDIT_EVERY = 12
#: but no more than this.
MAX_EDITS = 6
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def normalise(text: str | None) -> list[bytes]:
    """The words of a text: runs of characters that are not ASCII punctuation, space or control."""
    return (text or "").encode().translate(_TABLE).split()


def edits(notice: str) -> int:
    return min(MAX_EDITS, len(notice) // EDIT_EVERY)


def pattern(notice: str) -> regex.Pattern:
    """A bounded-error pattern of whole words: telling words stand as they are, a run of names may have one edit,
    what lies between up to edits() of them. Their sum is for whoever matches to bound, as is what ends a match."""
    parts, k = [], edits(notice)
    for w in notice.split():
        kind = 0 if w in TELLING else min(1, k) if w in NAMES else k
        if parts and parts[-1][0] == (kind, w in TELLING):
            parts[-1][1].append(w)
        else:
            parts.append(((kind, w in TELLING), [w]))
    out = []
    for n, ((most, sure), run) in enumerate(parts):
        text = regex.escape(" ".join(run), literal_spaces=True)
        space = "" if n == 0 else " " if parts[n - 1][0][1] or sure else "(?: ){e<=1}" if k else " "
        out.append(space + (rf"(?<![^ ]){text}(?![^ ])" if sure else rf"(?:{text}){{e<={most}}}"))
    return regex.compile(rf"(?b)(?<![^ ]){''.join(out)}(?![^ ])")


def is_notice(line: str, m: regex.Match, notice: str) -> bool:
    """Whether a match of pattern() is the notice: with few enough edits in all, and not in the plural, which
    speaks of such licenses rather than being one."""
    plural = line[m.start() : m.end()].rsplit(" ", 1)[-1] == notice.rsplit(" ", 1)[-1] + "s"
    return sum(m.fuzzy_counts) <= edits(notice) and not plural


@lru_cache(maxsize=1)
def matcher(notices: tuple[tuple[str, str], ...]):
    """The automaton of pieces, and a bounded-error pattern for each notice."""
    automaton, patterns, seeds = ahocorasick.Automaton(), [], {}
    for n, (notice, _) in enumerate(notices):
        k = edits(notice)
        bounds = [len(notice) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(bounds, bounds[1:]):
            seeds.setdefault(notice[a:b], []).append((n, a))
        patterns.append(pattern(notice))
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), tuple(uses)))
    automaton.make_automaton()
    return automaton, patterns


def find_notices(line: str, notices: tuple[tuple[str, str], ...] = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the best matches in normalised text, by notice and start."""
    automaton, patterns = matcher(notices)
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, (size, uses) in automaton.iter(line):
        start = end - size + 1
        for n, offset in uses:
            k, whole = edits(notices[n][0]), len(notices[n][0])
            windows.setdefault(n, []).append((max(0, start - offset - k), start - offset + whole + k + 1))  # and what ends it
    found = []
    for n in sorted(windows):
        merged: list[list[int]] = []
        for lo, hi in sorted(windows[n]):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        spans, todo = [], [(lo, hi) for lo, hi in merged]
        # The best match of a part need not be its first: both sides of it are searched, too.
        while todo:
            lo, hi = todo.pop()
            m = patterns[n].search(line, lo, hi) if lo < hi else None
            if m and m.end() > m.start() and line[m.end() : m.end() + 1] in ("", " "):
                if is_notice(line, m, notices[n][0]):
                    spans.append((n, m.start(), m.end(), sum(m.fuzzy_counts)))
                todo += [(lo, m.start()), (m.end(), hi)]
        found += sorted(spans)
    return found


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of matches that overlap only the one with the fewest edits, the longest of these, the first: variants of a
    license differ in a few letters, and a fuzzy match of one is no sign of it where another stands unedited."""
    kept: list[tuple[int, int, int, int]] = []
    for n, s, e, d in sorted(found, key=lambda x: (x[3], x[1] - x[2], x[1], x[0])):
        if all(e <= a or b <= s for _, a, b, _ in kept):
            kept.append((n, s, e, d))
    return sorted(kept)


def scan(text: str | None, notices: tuple[tuple[str, str], ...] = NOTICES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, notices found."""
    words = normalise(text)
    joined = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for phrase, label in PHRASES:
        needle, at, counted, word = b" " + phrase.encode() + b" ", -1, 0, 0
        while (at := joined.find(needle, at + 1)) >= 0:
            word, counted = word + joined.count(b" ", counted, at), at
            places.append(word)
            labels.add(label)
    line = joined[1:-1].decode()
    found = resolve(find_notices(line, notices))
    best = 1.0 if places else 0.0
    for n, _, _, e in found:
        best = max(best, 1.0 - e / len(notices[n][0]))
    spans = [f"{notices[n][1]}:{s}:{e}:{d}" for n, s, e, d in found]
    more = labels | {notices[n][1] for n, *_ in found}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), best, ",".join(spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    for b in batches:
        rows = [scan(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, notices (label:start:end:edits in the normalised text).

    Of notices that overlap, the closest match counts, of equally close ones the longest, then the first. The score is 1 with a base phrase, else the best share of a notice that was found unedited, else 0.
    A null text is empty; long texts are read whole. Rows that repeat are returned as often as they come; other columns are
    ignored. No rows give no rows.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, schema)


def op4_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
