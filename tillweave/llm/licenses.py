"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text is reduced to its words, lower-cased and joined by single blanks. A rule is a regular expression over that
form; it is tried only where its keyword occurs. Of the detections, one that lies within another of higher priority,
or of equal priority and greater length, is suppressed. Base phrases always count.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillweave.llm.common import slices_of

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: (keyword that every name holds, names as patterns over words, identifiers).
LICENSES: dict[str, tuple[str, list[str], list[str]]] = {
    "mit": ("mit", [r"mit licen[cs]e", r"mit x11 licen[cs]e", r"expat licen[cs]e mit"], ["mit"]),
    "apache-1.1": ("apache", [r"apache (?:software )?licen[cs]e (?:version )?1 1"], ["apache 1 1"]),
    "apache-2": ("apache", [r"apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?", r"apache 2(?: 0)? licen[cs]e"], ["apache 2 0"]),
    "bsd-2-clause": ("bsd", [r"bsd 2 clause", r"2 clause bsd", r"simplified bsd", r"freebsd licen[cs]e"], ["bsd 2 clause"]),
    "bsd-3-clause": ("bsd", [r"bsd 3 clause", r"3 clause bsd", r"(?:new|modified|revised) bsd"], ["bsd 3 clause"]),
    "bsd-4-clause": ("bsd", [r"bsd 4 clause", r"4 clause bsd", r"original bsd"], ["bsd 4 clause"]),
    "0bsd": ("bsd", [r"zero clause bsd", r"bsd zero clause", r"0bsd"], ["0bsd"]),
    "gpl-1": ("g", [r"gnu general public licen[cs]e (?:version |v)1", r"gpl ?v ?1"], ["gpl 1 0 only", "gpl 1 0 or later"]),
    "gpl-2": ("g", [r"gnu general public licen[cs]e (?:version |v)2", r"gnu gpl (?:version |v)2", r"gpl ?v ?2"], ["gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"]),
    "gpl-3": ("g", [r"gnu general public licen[cs]e (?:version |v)3", r"gnu gpl (?:version |v)3", r"gpl ?v ?3"], ["gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"]),
    "lgpl-2.1": ("l", [r"gnu (?:lesser|library) general public licen[cs]e (?:version |v)2(?: 1)?", r"lgpl ?v ?2(?: 1)?"], ["lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"]),
    "lgpl-3": ("l", [r"gnu lesser general public licen[cs]e (?:version |v)3", r"lgpl ?v ?3"], ["lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"]),
    "agpl-3": ("a", [r"gnu affero general public licen[cs]e", r"affero gpl", r"agpl ?v ?3"], ["agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"]),
    "gfdl-1.3": ("documentation", [r"gnu free documentation licen[cs]e"], ["gfdl 1 3", "gfdl 1 3 or later"]),
    "mpl-1.1": ("mozilla", [r"mozilla public licen[cs]e (?:version |v)?1 1"], ["mpl 1 1"]),
    "mpl-2": ("mozilla", [r"mozilla public licen[cs]e (?:version |v)?2(?: 0)?"], ["mpl 2 0"]),
    "epl-1": ("eclipse", [r"eclipse public licen[cs]e (?:version |v)?1(?: 0)?"], ["epl 1 0"]),
    "epl-2": ("eclipse", [r"eclipse public licen[cs]e (?:version |v)?2(?: 0)?"], ["epl 2 0"]),
    "edl-1": ("eclipse", [r"eclipse distribution licen[cs]e"], []),
    "cddl-1": ("distribution", [r"common development and distribution licen[cs]e"], ["cddl 1 0", "cddl 1 1"]),
    "cpl-1": ("common", [r"common public licen[cs]e"], ["cpl 1 0"]),
    "isc": ("isc", [r"isc licen[cs]e"], ["isc"]),
    "zlib": ("zlib", [r"zlib licen[cs]e", r"zlib libpng licen[cs]e"], ["zlib"]),
    "libpng": ("libpng", [r"libpng licen[cs]e"], ["libpng 2 0"]),
    "boost-1": ("boost", [r"boost software licen[cs]e"], ["bsl 1 0"]),
    "unlicense": ("unlicense", [r"the unlicense", r"unlicense org"], ["unlicense"]),
    "wtfpl": ("do what the", [r"do what the \w+ you want to public licen[cs]e"], ["wtfpl"]),
    "artistic-1": ("artistic", [r"artistic licen[cs]e (?:version )?1(?: 0)?"], ["artistic 1 0"]),
    "artistic-2": ("artistic", [r"artistic licen[cs]e (?:version )?2(?: 0)?"], ["artistic 2 0"]),
    "python-2": ("python", [r"python software foundation licen[cs]e", r"psf licen[cs]e python", r"python licen[cs]e"], ["python 2 0", "psf 2 0"]),
    "ruby": ("ruby", [r"ruby licen[cs]e"], ["ruby"]),
    "php-3": ("php", [r"php licen[cs]e"], ["php 3 0", "php 3 01"]),
    "postgresql": ("postgresql", [r"postgresql licen[cs]e"], ["postgresql"]),
    "openssl": ("openssl", [r"openssl licen[cs]e"], ["openssl"]),
    "vim": ("vim", [r"vim licen[cs]e"], ["vim"]),
    "tcl": ("tcl", [r"tcl tk licen[cs]e", r"tcl licen[cs]e"], ["tcl"]),
    "w3c": ("w3c", [r"w3c software (?:notice and )?licen[cs]e"], ["w3c"]),
    "unicode": ("unicode", [r"unicode licen[cs]e"], ["unicode 3 0", "unicode dfs 2016"]),
    "ms-pl": ("microsoft", [r"microsoft public licen[cs]e"], ["ms pl"]),
    "ms-rl": ("microsoft", [r"microsoft reciprocal licen[cs]e"], ["ms rl"]),
    "osl-3": ("open software", [r"open software licen[cs]e"], ["osl 3 0"]),
    "afl-3": ("academic", [r"academic free licen[cs]e"], ["afl 3 0"]),
    "eupl-1.2": ("european", [r"european union public licen[cs]e"], ["eupl 1 1", "eupl 1 2"]),
    "cecill": ("cecill", [r"cecill(?: [bc])? (?:free software )?licen[cs]e"], ["cecill 2 1", "cecill b", "cecill c"]),
    "mulan-2": ("mulan", [r"mulan (?:permissive software licen[cs]e|psl)"], ["mulanpsl 2 0"]),
    "ofl-1.1": ("open font", [r"sil open font licen[cs]e"], ["ofl 1 1"]),
    "ncsa": ("ncsa", [r"university of illinois ncsa open source licen[cs]e", r"ncsa open source licen[cs]e"], ["ncsa"]),
    "upl-1": ("universal", [r"universal permissive licen[cs]e"], ["upl 1 0"]),
    "ecl-2": ("educational", [r"educational community licen[cs]e"], ["ecl 2 0"]),
    "sspl-1": ("server side", [r"server side public licen[cs]e"], ["sspl 1 0"]),
    "busl-1.1": ("business source", [r"business source licen[cs]e"], ["busl 1 1"]),
    "elastic-2": ("elastic", [r"elastic licen[cs]e (?:version )?2(?: 0)?"], ["elastic 2 0"]),
    "odbl-1": ("database", [r"open (?:data commons open )?database licen[cs]e"], ["odbl 1 0"]),
    "odc-by-1": ("data commons", [r"open data commons attribution licen[cs]e"], ["odc by 1 0"]),
    "pddl-1": ("public domain", [r"public domain dedication and licen[cs]e"], ["pddl 1 0"]),
    "cc0-1": ("c", [r"cc0(?: 1 0)?", r"creative commons zero"], ["cc0 1 0"]),
    "cc-by": ("c", [r"cc by(?: [1-4] [05])?(?! (?:nc|nd|sa)\b)", r"creative commons attribution(?: [1-4] [05])?(?! (?:non|share|no)\w*)"], ["cc by 3 0", "cc by 4 0"]),
    "cc-by-sa": ("c", [r"cc by sa(?: [1-4] [05])?", r"creative commons attribution share ?alike"], ["cc by sa 3 0", "cc by sa 4 0"]),
    "cc-by-nd": ("c", [r"cc by nd(?: [1-4] [05])?", r"creative commons attribution no ?derivat\w+"], ["cc by nd 3 0", "cc by nd 4 0"]),
    "cc-by-nc": ("c", [r"cc by nc(?: [1-4] [05])?(?! (?:nd|sa)\b)", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?! (?:share|no)\w*)"], ["cc by nc 3 0", "cc by nc 4 0"]),
    "cc-by-nc-sa": ("c", [r"cc by nc sa(?: [1-4] [05])?", r"creative commons attribution non ?commercial share ?alike"], ["cc by nc sa 3 0", "cc by nc sa 4 0"]),
    "cc-by-nc-nd": ("c", [r"cc by nc nd(?: [1-4] [05])?", r"creative commons attribution non ?commercial no ?derivat\w+"], ["cc by nc nd 3 0", "cc by nc nd 4 0"]),
    "public-domain": ("public domain", [r"(?:released|placed|dedicated) (?:in)?to the public domain", r"in the public domain"], []),
    "bsd": ("bsd", [], []),
    "proprietary": ("all rights reserved", [r"all rights reserved"], []),
}

_OPENING = r"permission is hereby granted free of charge to any person"
_REDISTRIBUTION = r"redistribution and use in source and binary forms"
_FSF = r"general public licen[cs]e as published by the free software foundation (?:either )?version"
#: License texts and standard notices: (label, keyword, pattern).
BODIES: list[tuple[str, str, str]] = [
    ("mit", "hereby granted", rf"{_OPENING} obtaining a copy(?! of (?:the unicode|(?:[^ ]+ )?data))(?: of this software and associated documentation files)?"),
    ("ncsa", "hereby granted", rf"{_OPENING} obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("boost-1", "hereby granted", rf"{_OPENING} or organization obtaining a copy"),
    ("unicode", "hereby granted", rf"{_OPENING} obtaining a copy of (?:the unicode |(?:[^ ]+ )?data)(?:[^ ]+ )?files"),
    ("isc", "hereby granted", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above"),
    ("0bsd", "hereby granted", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd-4-clause", "source and binary", rf"{_REDISTRIBUTION}(?=(?: [^ ]+){{0,250}}? all advertising materials mentioning )"),
    ("bsd-3-clause", "source and binary", rf"{_REDISTRIBUTION}(?=(?: [^ ]+){{0,250}}? neither the names? of )(?!(?: [^ ]+){{0,250}}? all advertising materials mentioning )"),
    ("bsd-2-clause", "source and binary", rf"{_REDISTRIBUTION}(?!(?: [^ ]+){{0,250}}? (?:neither the names? of|all advertising materials mentioning) )"),
    ("gpl-1", "free software foundation", rf"gnu {_FSF} 1"),
    ("gpl-2", "free software foundation", rf"gnu {_FSF} 2"),
    ("gpl-3", "free software foundation", rf"gnu {_FSF} 3"),
    ("lgpl-2.1", "free software foundation", rf"gnu (?:lesser|library) {_FSF} 2(?: 1)?"),
    ("lgpl-3", "free software foundation", rf"gnu lesser {_FSF} 3"),
    ("gpl-1", "gpl version", r"gpl version 1"),
    ("gpl-2", "gpl version", r"gpl version 2"),
    ("gpl-3", "gpl version", r"gpl version 3"),
    ("lgpl-2.1", "lgpl version", r"lgpl version 2(?: 1)?"),
    ("lgpl-3", "lgpl version", r"lgpl version 3"),
    ("bsd", "bsd licen", r"bsd licen[cs]e"),
]
#: Identifiers that other things than a license bear too, versions of programs for example.
NOT_BARE = frozenset("python psf php unicode libpng cc cc0".split())

#: Forms of a rule: (priority, weight, pattern around a name or an identifier).
NOTICE = (3, 0.95, r"(?:licen[cs]ed|released|distributed|published|provided|covered|(?:made )?available) (?:\w+ ){{0,3}}under (?:the )?(?:terms of )?(?:the )?(?:{0})(?: licen[cs]e)?")
NAMED = (2, 0.8, r"(?:{0})(?: licen[cs]e)?")
TAGGED = (4, 1.0, r"spdx licen[cs]e identifier (?:{0})")
BARE = (2, 0.8, r"(?:{0})(?! [0-9])")
BODY = (3, 0.95, "{0}")
LINKED = (1, 0.7, r"opensource org licenses (?:{0})")
BASE_PRIORITY, BASE_WEIGHT = 5, 0.9


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    keyword: bytes
    pattern: re.Pattern


@functools.cache
def rules() -> list[Rule]:
    """All rules, the highest priority first; within one, in the order of the table."""
    out = []
    for label, (keyword, names, tags) in LICENSES.items():
        forms = [(NOTICE, n, keyword) for n in names] + [(NAMED, n, keyword) for n in names]
        forms += [(form, t, word) for t in tags for form, word in ((TAGGED, "spdx"), (LINKED, "opensource org"))]
        forms += [(BARE, t, t.split(" ")[0]) for t in tags if re.search(r"\d", t) and t.split(" ")[0] not in NOT_BARE]
        forms += [(BODY, body, word) for of, word, body in BODIES if of == label]
        for (priority, weight, form), name, word in forms:
            out.append(Rule(label, priority, weight, word.encode(), re.compile(rf"(?<= ){form.format(name)}(?= )".encode())))
    return sorted(out, key=lambda r: -r.priority)


@functools.cache
def gates() -> list[tuple[bytes, list[Rule]]]:
    """Rules by the keyword that a text must hold for any of them to match."""
    by: dict[bytes, list[Rule]] = {}
    for rule in rules():
        by.setdefault(rule.keyword, []).append(rule)
    return list(by.items())


_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Every name, tag and phrase of the table holds one of these.
_ANY = [b"licen", b" gpl", b" lgpl", b" agpl", b"affero gpl", b"gnu gpl", b" cc", b"creative commons", b"bsd", b"mulan", b"public domain", b"all rights reserved"]
_ANY += sorted({word.encode() for _, word, _ in BODIES} | {b" " + t.split(" ")[0].encode() + b" " for _, _, tags in LICENSES.values() for t in tags if re.search(r"\d", t)})
_IDS = {t.encode(): label for label, (_, _, tags) in LICENSES.items() for t in tags}
_ID = b"(?:" + b"|".join(sorted(_IDS, key=len, reverse=True)) + b")(?= )"
_OPERAND = _ID + rb"(?: with (?:[^ ]+ ){1,5}?exception(?: [0-9]+){0,2}(?= ))?"
_EXPRESSION = re.compile(rb"(?<= )spdx licen[cs]e identifier " + _OPERAND + rb"(?: (?:and|or) " + _OPERAND + rb")+")
_OPERANDS = re.compile(rb"(?<= )" + _ID)


class Found(NamedTuple):
    label: str
    priority: int
    weight: float
    start: int
    end: int


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Words:
    """Numbers of words in ``" w w ... "``, from the places of its blanks, which are looked up once a text."""

    def __init__(self, norm: bytes):
        self.norm, self.blanks = norm, None

    def before(self, at: int) -> int:
        """Blanks before a place."""
        if self.blanks is None:
            self.blanks = np.flatnonzero(np.frombuffer(self.norm, np.uint8) == 32)
        return int(np.searchsorted(self.blanks, at))


def base_places(norm: bytes, words: Words | None = None) -> list[tuple[int, int, str]]:
    """(first word, end, label) of every place of a base phrase in ``" w w ... "``."""
    out, words = [], words or Words(norm)
    for phrase, label in BASE.items():
        needle = b" " + phrase.encode() + b" "
        at = norm.find(needle)
        while at >= 0:
            start = words.before(at)
            out.append((start, start + phrase.count(" ") + 1, label))
            at = norm.find(needle, at + 1)
    return sorted(out)


def detections(norm: bytes, words: Words | None = None) -> list[Found]:
    """What the rules find, in word positions."""
    words = words or Words(norm)
    if not any(x in norm for x in _ANY):
        return []
    out = []
    for keyword, group in gates():
        if keyword in norm:
            for rule in group:
                for m in rule.pattern.finditer(norm):
                    start = words.before(m.start()) - 1
                    out.append(Found(rule.label, rule.priority, rule.weight, start, start + m.group().count(b" ") + 1))
    if b" spdx " in norm:
        for whole in _EXPRESSION.finditer(norm):
            for m in _OPERANDS.finditer(norm, whole.start(), whole.end() + 1):
                start = words.before(m.start()) - 1
                out.append(Found(_IDS[m.group()], *TAGGED[:2], start, start + m.group().count(b" ") + 1))
    return out


def resolve(found: list[Found]) -> list[Found]:
    """Without detections that lie within a stronger one: of higher priority, or as high and longer, or an earlier rule's twin.

    Of what is kept, the starts of growing ends are remembered: among intervals that start no later, the last end is
    the largest, so one look tells whether any of them holds the next.
    """
    kept: list[Found] = []
    starts: list[int] = []
    ends: list[int] = []
    for f in sorted(found, key=lambda f: (-f.priority, f.start - f.end, f.start, f.label)):
        at = bisect_right(starts, f.start)
        if at and ends[at - 1] >= f.end:
            continue
        kept.append(f)
        at -= at > 0 and starts[at - 1] == f.start  # a longer one takes the place of one with the same start
        stop = bisect_right(ends, f.end, at)
        starts[at:stop], ends[at:stop] = [f.start], [f.end]
    return kept


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of the kept detections."""
    words = words_of(text or "")
    norm = b" " + b" ".join(words) + b" "
    place = Words(norm)
    base = base_places(norm, place)
    kept = resolve([Found(label, BASE_PRIORITY, BASE_WEIGHT, a, b) for a, b, label in base] + detections(norm, place))
    own = {label for _, _, label in base}
    weights: dict[str, float] = {}
    for f in kept:
        weights[f.label] = max(f.weight, weights.get(f.label, 0.0))
    labels = own | weights.keys()
    miss = 1.0
    for label in sorted(labels):
        miss *= 1 - weights.get(label, BASE_WEIGHT)
    return (
        len(words), len(base), base[0][0] if base else None, max(b[0] for b in base) if base else None,
        ",".join(sorted(own)), ",".join(sorted(labels)), 1 - miss,
        [{"label": f.label, "start": f.start, "end": f.end} for f in sorted(kept, key=lambda f: (f.start, f.end, f.label))],
    )


SCANNED = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: int, end: int>>"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and what ``scan`` says of the whole text, in one pass without a shuffle.

    Needs doc_id and text; other columns play no part. Null and empty texts have no words, empty label strings and
    score 0. Equal rows give equal rows; an empty table gives none.
    """
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [
        pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    ]
    names = "n_words n_base first_word last_word base_labels labels score spans".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in slices_of(batch.column(1)):
                part = batch.slice(begin, stop - begin)
                columns = zip(*map(scan, part.column(1).to_pylist()))
                yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + SCANNED)
