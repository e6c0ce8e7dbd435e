"""License scans by ordered signature rules (operator 5).

Base: places where the words of a fixed phrase stand consecutively. The method adds an ordered
list of regexes, each with a label, a priority and a keyword; one Aho-Corasick pass finds the
keywords of a text and only their rules run. Runs of white space with the comment marks among
them become one space first, with a map of places, so notices broken over lines match rules
that know single spaces only, and no rule can try the ways to share a long run out; a version
is read as it is written ("v3", "-2.0", "version 2 or later") and normalised. The list is the product of license names
and of the ways they are used, which carry the priorities, and of notices written one by one.
Detections are taken in order of priority, then length, then place; one that lies inside a
detection already taken is suppressed, so "bsd 3-clause license" does not also report "bsd".
Containment is asked of a prefix-maximum tree over starts: n detections cost n log n.

Defined cases: null text is empty: no words, no labels, score 0; first and last word are
null without a base place; overlapping base places all count; repeated rows are scanned
alike; other columns are ignored; doc_id is cast to long.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, keyword, how the name is written (a regex), whether it comes in versions.
FAMILIES = [
    ("agpl", "affero", r"(?:gnu )?affero (?:general public|gpl) licen[cs]e", True),
    ("agpl", "agpl", r"\b(?:gnu )?agpl(?:\b|(?=v ?[0-9]))", True),
    ("lgpl", "lesser", r"(?:gnu )?(?:lesser|library) (?:general public|gpl) licen[cs]e", True),
    ("lgpl", "lgpl", r"\b(?:gnu )?lgpl(?:\b|(?=v ?[0-9]))", True),
    ("gpl", "gpl", r"\b(?:gnu )?gpl(?:\b|(?=v ?[0-9]))", True),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", True),
    ("apache", "apache", r"apache(?: software)?(?: licen[cs]e)?", True),
    ("mozilla", "mozilla", r"mozilla public licen[cs]e", True),
    ("mozilla", "mpl", r"\bmpl\b", True),
    ("eclipse", "eclipse", r"eclipse (?:public|distribution) licen[cs]e", True),
    ("cddl", "cddl", r"\bcddl\b", True),
    ("cddl", "common development", r"common development and distribution licen[cs]e", True),
    ("artistic", "artistic", r"artistic licen[cs]e", True),
    ("boost", "boost", r"boost software licen[cs]e", True),
    ("bsd-2", "bsd", r"(?:2|two)[ -]clause bsd|bsd[ -](?:2|two)[ -]clause|simplified bsd", False),
    ("bsd-3", "bsd", r"(?:3|three)[ -]clause bsd|bsd[ -](?:3|three)[ -]clause|(?:new|modified|revised) bsd", False),
    ("bsd", "bsd", r"\bbsd\b", False),
    ("mit", "mit", r"\bmit\b", False),
    ("isc", "isc", r"\bisc\b", False),
    ("zlib", "zlib", r"\bzlib(?:/libpng)?\b", False),
    ("unlicense", "unlicense", r"\bunlicense\b", False),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", True),
    ("python", "python", r"python (?:software foundation|psf)", True),
    ("openssl", "openssl", r"openssl", False),
    ("postgresql", "postgresql", r"postgresql", False),
    ("php", "php", r"\bphp\b", True),
    ("ruby", "ruby", r"\bruby\b", False),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", True),
    ("eupl", "european union public", r"european union public licen[cs]e", True),
    ("epl", "epl", r"\bepl\b", True),
    ("odbl", "open database", r"open database licen[cs]e", True),
    ("odbl", "odbl", r"\bodbl\b", True),
    ("cc-by-nc-nd", "cc", r"\bcc[ -]by[ -]nc[ -]nd", True),
    ("cc-by-nc-sa", "cc", r"\bcc[ -]by[ -]nc[ -]sa", True),
    ("cc-by-nc", "cc", r"\bcc[ -]by[ -]nc", True),
    ("cc-by-nd", "cc", r"\bcc[ -]by[ -]nd", True),
    ("cc-by-sa", "cc", r"\bcc[ -]by[ -]sa", True),
    ("cc-by", "cc", r"\bcc[ -]by\b", True),
    ("cc0", "cc0", r"\bcc0\b", True),
]
# How a name is used, and the priority that use gives.
USES = [
    (60, r"spdx-license-identifier: ?{n}{v}"),
    (50, r"(?:licen[cs]ed|released|distributed|available|published|provided|offered|redistributable)(?: to you)? under (?:the )?(?:(?:terms|conditions) of (?:the )?)?{n}{v}(?: licen[cs]e)?"),
    (45, r"(?:terms|conditions) of (?:the )?{n}{v}(?: licen[cs]e)?"),
    (40, r"(?:this (?:work|program|file|software|text|library|project|code|module|document)|it) is (?:licen[cs]ed )?(?:under|covered by|subject to) (?:the )?{n}{v}(?: licen[cs]e)?"),
    (30, r"(?:see|under) the {n}{v}(?: licen[cs]e)? for"),
    (28, r"licen[cs]e: ?{n}{v}"),
    (20, r"{n}{v},? licen[cs]e"),
    (10, r"{n}{v}"),
]
# A version as it is written after a name.
VERSION = r"(?:,? ?(?:version |ver\.? ?|v\.? ?)|[- ])(?P<v>[0-9]{1,2}(?:\.[0-9]{1,2}){0,2})(?![0-9])(?:\+|,? or (?:\(at your option\) )?(?:any )?later(?: version)?)?"
#: What a version adds to a use's priority: a versioned name comes before uses of the bare one in it.
VERSIONED = 30
MOST = max(p for p, _ in USES) + VERSIONED
# Names that say nothing when they stand alone.
COMMON = "mit isc php ruby postgresql openssl zlib apache python".split()
# Priority, label, keyword, regex of notices that stand on their own.
NOTICES = [
    (35, "mit", "permission is hereby granted", r"permission is hereby granted,? free of charge"),
    (36, "mit", "the software is provided", r"the software is provided \W?as is\W?,? without warranty of any kind"),
    (36, "mit", "permission notice shall be", r"the above copyright notice and this permission notice shall be included"),
    (35, "isc", "permission to use", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose"),
    (36, "isc", "with or without fee", r"with or without fee is hereby granted"),
    (35, "bsd", "redistribution and use", r"redistribution and use in source and binary forms"),
    (36, "bsd-3", "endorse or promote", r"(?:neither the name|the names?) [^.]{0,200}endorse or promote products derived"),
    (35, "bsd", "binary form must", r"redistributions in binary form must reproduce"),
    (35, "bsd", "source code must retain", r"redistributions of source code must retain"),
    (37, "bsd-4", "advertising materials", r"all advertising materials mentioning features"),
    (35, "apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    (34, "apache", "apache software foundation", r"licen[cs]ed to the apache software foundation"),
    (36, "apache-2.0", "contributor license", r"one or more contributor licen[cs]e agreements"),
    (35, "gpl", "gnu.org/licenses", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl"),
    (35, "lgpl", "gnu.org/licenses", r"gnu\.org/(?:licenses|copyleft)/(?:old-licenses/)?lgpl"),
    (35, "agpl", "gnu.org/licenses", r"gnu\.org/licenses/agpl"),
    (35, "gfdl", "gnu.org/licenses", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    (34, "gpl", "free software; you can", r"this (?:program|library|file) is free software[;:,] you can redistribute it"),
    (33, "gpl", "free software foundation", r"as published by the free software foundation"),
    (33, "gpl", "merchantability or fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    (35, "mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    (36, "mozilla-2.0", "source code form is", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    (35, "eclipse", "eclipse.org/legal", r"eclipse\.org/legal/epl"),
    (35, "boost-1.0", "boost.org/license", r"boost\.org/license_1_0"),
    (35, "unlicense", "unlicense.org", r"unlicense\.org"),
    (34, "unlicense", "unencumbered software", r"free and unencumbered software released into the public domain"),
    (35, "wtfpl", "what the fuck", r"do what the fuck you want to public licen[cs]e"),
    (35, "zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    (35, "zlib", "altered source versions", r"altered source versions must be plainly marked"),
    (35, "cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/[0-9.]+"),
    (35, "cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/[0-9.]+"),
    (35, "cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc/[0-9.]+"),
    (35, "cc-by-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nd/[0-9.]+"),
    (35, "cc-by-nc-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/[0-9.]+"),
    (35, "cc-by-nc-nd", "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/[0-9.]+"),
    (35, "cc0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    (35, "cc-by", "creative commons", r"creative commons attribution(?: [0-9.]+)?(?: international)?(?: licen[cs]e)?"),
    (45, "cc-by-sa", "creative commons", r"creative commons attribution[ -]share ?alike(?: [0-9.]+)?"),
    (45, "cc-by-nc", "creative commons", r"creative commons attribution[ -]non ?commercial(?: [0-9.]+)?"),
    (46, "cc-by-nc-sa", "creative commons", r"creative commons attribution[ -]non ?commercial[ -]share ?alike(?: [0-9.]+)?"),
    (45, "cc-by-nd", "creative commons", r"creative commons attribution[ -]no ?deriv(?:ative)?s?(?: [0-9.]+)?"),
    (25, "public-domain", "public domain", r"(?:released|placed|dedicated)? ?(?:in|into|to)? ?(?:the )?public domain"),
    (25, "reserved", "rights reserved", r"all rights reserved"),
    (15, "reserved", "rights reserved", r"some rights reserved"),
    (15, "copyright", "copyright", r"copyright (?:\(c\)|©)? ?[12][0-9]{3}"),
    (15, "copyright", "©", r"© ?[12][0-9]{3}"),
    (25, "proprietary", "confidential", r"proprietary and confidential|confidential and proprietary"),
    (25, "proprietary", "may not be", r"may not be (?:reproduced|copied|distributed|disclosed|modified) without"),
    (25, "proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution|reproduction) of this (?:file|software|work|document)"),
    (25, "proprietary", "trade secret", r"contains? (?:confidential |proprietary )?trade secrets?"),
    (25, "proprietary", "end user license", r"end user licen[cs]e agreement"),
    (36, "mit", "copyright holders be liable", r"in no event shall the authors or copyright holders be liable"),
    (35, "mit", "expat", r"expat licen[cs]e"),
    (36, "mit-0", "attribution", r"mit[ -]no[ -]attribution"),
    (36, "mit-0", "mit-0", r"\bmit-0\b"),
    (36, "bsd-3", "neither the name", r"neither the name of (?:the )?[^.]{1,120} nor the names of its contributors"),
    (35, "0bsd", "0bsd", r"\b0bsd\b"),
    (35, "apache-2.0", "asl", r"\basl[ -]?2(?:\.0)?\b"),
    (34, "apache", "licensed under the apache", r"licen[cs]ed under the apache licen[cs]e"),
    (35, "gpl", "gnu project", r"part of the gnu project"),
    (33, "gpl", "copy of the gnu general", r"received a copy of the gnu general public licen[cs]e"),
    (34, "lgpl", "copy of the gnu lesser", r"received a copy of the gnu lesser general public licen[cs]e"),
    (35, "agpl", "copy of the gnu affero", r"received a copy of the gnu affero general public licen[cs]e"),
    (36, "gpl-classpath", "classpath", r"classpath exception"),
    (36, "gpl-linking", "special exception", r"as a special exception,? (?:the copyright holders|you may)"),
    (35, "gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e"),
    (35, "mpl-2.0", "incompatible with secondary", r"incompatible with secondary licen[cs]es"),
    (35, "cddl", "sun.com/cddl", r"sun\.com/cddl"),
    (35, "artistic", "perlfoundation", r"perlfoundation\.org/artistic"),
    (35, "python", "psf license", r"psf licen[cs]e"),
    (35, "openssl", "eric young", r"cryptographic software written by eric young"),
    (35, "zlib", "express or implied warranty", r"without any express or implied warranty"),
    (35, "ofl", "scripts.sil.org", r"scripts\.sil\.org/ofl"),
    (35, "odbl", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    (35, "odc-by", "opendatacommons", r"opendatacommons\.org/licenses/by"),
    (35, "pddl", "opendatacommons", r"opendatacommons\.org/licenses/pddl"),
    (35, "open-government", "open government", r"open government licen[cs]e"),
    (35, "beerware", "beer", r"beer-?ware licen[cs]e|buy me a beer in return"),
    (35, "json", "used for good", r"shall be used for good, not evil"),
    (35, "ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    (35, "ms-pl", "ms-pl", r"\bms-pl\b"),
    (35, "ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    (35, "ms-rl", "ms-rl", r"\bms-rl\b"),
    (35, "w3c", "w3c software", r"w3c software (?:notice|licen[cs]e)"),
    (35, "unicode", "unicode", r"unicode(?:,? inc\.?)? licen[cs]e agreement"),
    (35, "ncsa", "illinois", r"university of illinois/ncsa open source licen[cs]e"),
    (35, "sspl", "server side public", r"server side public licen[cs]e"),
    (35, "bsl", "business source", r"business source licen[cs]e"),
    (35, "elastic", "elastic license", r"elastic licen[cs]e"),
    (35, "commons-clause", "commons clause", r"commons clause licen[cs]e condition"),
    (35, "rail", "responsible ai", r"(?:open )?responsible ai licen[cs]e"),
    (35, "rail", "openrail", r"\bopenrail\b"),
    (36, "cc-by-nc", "noncommercial", r"for non-?commercial (?:use|purposes) only"),
    (36, "cc0", "waived all copyright", r"waived all copyright and related or neighbou?ring rights"),
    (25, "public-domain", "no copyright", r"no (?:known )?copyright(?: restrictions)?"),
    (25, "reserved", "reprinted", r"reprinted (?:with|by) permission"),
    (25, "reserved", "no part of this", r"no part of this (?:publication|book|work|document) may be reproduced"),
    (25, "proprietary", "express written", r"without (?:the )?(?:express|prior) written (?:permission|consent)"),
    (25, "proprietary", "internal use", r"for internal use only"),
    (25, "shareware", "shareware", r"this (?:program|software) is shareware"),
    (25, "freeware", "freeware", r"(?:is|as) freeware"),
]


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    regex: re.Pattern


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """Names x uses, with and without a version, and the notices, in order of priority."""
    out = []
    for label, keyword, name, versions in FAMILIES:
        for tail in (VERSION, "") if versions else ("",):
            for priority, use in USES:
                if not tail and label in COMMON and priority == 10:
                    continue
                full = use.replace("{n}", f"(?:{name})").replace("{v}", tail)
                out.append(Rule(priority + (VERSIONED if tail else 0), label, keyword, re.compile(full)))
    out += [Rule(p, label, k, re.compile(x)) for p, label, k, x in NOTICES]
    return sorted(out, key=lambda r: -r.priority)


def versioned(label: str, m: re.Match) -> str:
    v = m.groupdict().get("v")
    return label if not v else f"{label}-{v}" if "." in v else f"{label}-{v}.0"


@lru_cache(maxsize=1)
def _gate() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        by.setdefault(r.keyword, []).append(i)
    found = ahocorasick.Automaton()
    for k in by:
        found.add_word(k, k)
    found.make_automaton()
    return found, by


class Contained:
    """Intervals taken so far; asks whether one lies inside any of them. A tree over the starts
    keeps, for every prefix of them, the largest end."""

    def __init__(self, starts: list[int]):
        self.place = {x: i + 1 for i, x in enumerate(sorted(set(starts)))}
        self.top = [0] * (len(self.place) + 1)

    def take(self, a: int, b: int) -> bool:
        """Take a..b unless an interval taken before contains it."""
        i, end = self.place[a], 0
        while i:
            end = max(end, self.top[i])
            i -= i & -i
        if end >= b:
            return False
        i = self.place[a]
        while i < len(self.top):
            self.top[i] = max(self.top[i], b)
            i += i & -i
        return True


_GAP = re.compile(r"[\s*#/;]+")


class Collapsed:
    """A text whose runs of white space and comment marks, if white space is among them, are
    one space each; ``span`` leads back to places of the text as it was."""

    def __init__(self, text: str):
        parts, size, at = [], 0, 0
        self.here, self.there = [0], [0]
        for m in _GAP.finditer(text):
            run = m[0]
            if run == " " or not any(map(str.isspace, run)):
                continue
            parts += [text[at : m.start()], " "]
            size += m.start() - at + 1
            at = m.end()
            self.here += [size - 1, size]
            self.there += [m.start(), at]
        self.text = "".join([*parts, text[at:]])

    def _of(self, place: int) -> int:
        i = bisect_right(self.here, place) - 1
        return self.there[i] + place - self.here[i]

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self._of(a), self._of(b - 1) + 1


def hits_of(text: str) -> list[tuple[int, int, int, int, str]]:
    """(-priority, -length, start, end, label) of every match in a collapsed text of the rules
    whose keyword it holds, in the order in which they are taken."""
    found, by = _gate()
    out = []
    for i in sorted(i for k in {k for _, k in found.iter(text)} for i in by[k]):
        r = rules()[i]
        out += [(-r.priority, m.start() - m.end(), m.start(), m.end(), versioned(r.label, m)) for m in r.regex.finditer(text)]
    return sorted(out)


def detect(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of the detections that stand, in order of place."""
    flat = Collapsed(text)
    hits = hits_of(flat.text)
    taken = Contained([h[2] for h in hits])
    return sorted((*flat.span(a, b), label, -p) for p, _, a, b, label in hits if taken.take(a, b))


def _scan(batches):
    phrases = []
    for phrase, label in BASE.items():
        w = next(iter(tn.words(pa.array([phrase]), "alnum")))
        phrases.append((phrase.split(), w.hash, label))
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for w in tn.words(batch.column(1), "alnum"):
            places: dict[int, list[tuple[int, str]]] = {}
            for parts, hashes, label in phrases:
                m = len(parts)
                if len(w.hash) < m:
                    continue
                hit = np.ones(len(w.hash) - m + 1, bool)
                for j in range(m):
                    hit &= w.hash[j : len(w.hash) - m + 1 + j] == hashes[j]
                for k in np.flatnonzero(hit).tolist():
                    i = int(np.searchsorted(w.off, k, "right")) - 1
                    if k + m <= w.off[i + 1] and [w.word(k + j) for j in range(m)] == parts:
                        places.setdefault(i, []).append((k - int(w.off[i]), label))
            for i in range(w.n):
                n, own = int(w.off[i + 1] - w.off[i]), places.get(i, [])
                found = detect(w.text(i)) if n else []
                base = sorted({label for _, label in own})
                size = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", w.text(i)[a:b])) for a, b, _, _ in found) if found else 0
                strength = max([p for _, _, _, p in found] + [25 * bool(own)])
                score = 0.0 if not (own or found) else min(1.0, 0.5 * strength / MOST + 0.5 * min(1.0, (size + 2 * len(own)) / 12))
                for column, v in zip(out, (n, len(own), min((k for k, _ in own), default=None), max((k for k, _ in own), default=None), ",".join(base), ",".join(sorted({*base, *(x for _, _, x, _ in found)})), score)):
                    column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
