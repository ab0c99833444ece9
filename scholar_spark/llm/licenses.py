"""Operator 5: ordered licence signatures with keyword gates and containment suppression."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Base phrases and their labels; they are reported wherever their words stand.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licence families: label stem -> (names as they are written, versions). Words are lower case, parted by blanks.
FAMILIES = {
    "gpl": (("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3")),
    "lgpl": (("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"), ("2", "2 1", "3")),
    "agpl": (("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "3")),
    "gfdl": (("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    "apache": (("apache software license", "apache license", "apache"), ("1", "1 1", "2")),
    "mpl": (("mozilla public license", "mpl"), ("1", "1 1", "2")),
    "epl": (("eclipse public license", "epl"), ("1", "2")),
    "cddl": (("common development and distribution license", "cddl"), ("1", "1 1")),
    "cpl": (("common public license", "cpl"), ("1",)),
    "eupl": (("european union public licence", "european union public license", "eupl"), ("1 1", "1 2")),
    "osl": (("open software license", "osl"), ("1", "2 1", "3")),
    "afl": (("academic free license", "afl"), ("2 1", "3")),
    "artistic": (("artistic license", "perl artistic license"), ("1", "2")),
    "bsl": (("boost software license", "boost license"), ("1",)),
    "busl": (("business source license", "busl"), ("1 1",)),
    "sspl": (("server side public license", "sspl"), ("1",)),
    "python": (("python software foundation license", "psf license"), ("2",)),
    "zpl": (("zope public license", "zpl"), ("2", "2 1")),
    "lppl": (("latex project public license", "lppl"), ("1", "1 3")),
    "ofl": (("sil open font license", "open font license", "ofl"), ("1", "1 1")),
    "odbl": (("open database license", "odbl"), ("1",)),
    "ms-pl": (("microsoft public license", "ms pl"), ()),
    "ms-rl": (("microsoft reciprocal license", "ms rl"), ()),
    "mit": (("mit license", "expat license", "mit x11 license"), ()),
    "isc": (("isc license", "internet systems consortium license"), ()),
    "zlib": (("zlib license", "zlib libpng license"), ()),
    "bsd-2": (("bsd 2 clause license", "two clause bsd license", "simplified bsd license", "freebsd license"), ()),
    "bsd-3": (("bsd 3 clause license", "three clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"), ()),
    "bsd-4": (("bsd 4 clause license", "four clause bsd license", "original bsd license"), ()),
    "bsd": (("bsd license", "berkeley software distribution license"), ()),
    "wtfpl": (("do what the fuck you want to public license", "wtfpl"), ()),
    "unlicense": (("the unlicense", "unlicense org"), ()),
    "postgresql": (("postgresql license",), ()),
    "openssl": (("openssl license",), ()),
    "vim": (("vim license",), ()),
    "ncsa": (("university of illinois ncsa open source license", "ncsa open source license"), ()),
    "upl": (("universal permissive license",), ("1",)),
    "eulas": (("end user license agreement", "eula"), ()),
    "cc0": (("cc0", "creative commons zero", "cc zero"), ("1",)),
    "cc-by": (("cc by", "creative commons attribution"), ("1", "2", "2 5", "3", "4")),
    "cc-by-sa": (("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("1", "2", "2 5", "3", "4")),
    "cc-by-nd": (("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"), ("1", "2", "2 5", "3", "4")),
    "cc-by-nc": (("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("1", "2", "2 5", "3", "4")),
    "cc-by-nc-sa": (("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("1", "2", "2 5", "3", "4")),
    "cc-by-nc-nd": (("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("1", "2", "2 5", "3", "4")),
}
#: Names that are ordinary words in some language or too short to stand alone: only with a version or in a grant.
WEAK = {"apache", "gpl", "mpl", "epl", "cpl", "osl", "afl", "ofl", "ms pl", "ms rl", "cc by", "vim license", "cddl", "zpl"}
#: Wordings that name no licence of their own: label, pattern, keyword.
PLAIN = (
    ("public-domain", r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", " public domain "),
    ("all-rights-reserved", r"all rights reserved", " all rights reserved "),
    ("copyright", r"copyright (?:c )?\d{4}(?: \d{4})?", " copyright "),
    ("permissive-grant", r"permission is hereby granted free of charge to any person obtaining a copy", " permission is hereby granted "),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification", " redistribution and use "),
    ("proprietary", r"proprietary and confidential", " proprietary and confidential "),
    ("no-redistribution", r"(?:may|must) not be (?:copied|redistributed|reproduced)", " not be "),
    ("as-is", r"provided as is without warranty", " as is without "),
)
GRANT = r"(?:licensed|released|distributed|available|published|provided|covered|made available) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"


@dataclass(frozen=True)
class Signature:
    name: str
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern
    base: bool = False


def _signature(name: str, label: str, priority: int, keyword: str, body: str, base: bool = False) -> Signature:
    return Signature(name, label, priority, keyword.encode(), re.compile(f" (?:{body})(?= )".encode()), base)


def signatures() -> list[Signature]:
    """All rules in order: base phrases, then each family's grant, versioned, tagged and bare wordings."""
    out = [_signature(f"base:{label}", label, 0, f" {phrase} ", phrase, True) for phrase, label in BASE.items()]
    for stem, (names, versions) in FAMILIES.items():
        for name in names:
            key, end = f" {name}", "" if "licen" in name else "(?: licen[sc]e)?"
            for v in versions:
                label = f"{stem}-{v.replace(' ', '.')}"
                said = rf"{name}{end}(?: (?:version|v|ver))? v?{v}(?: 0)?"
                out.append(_signature(f"grant:{label}:{name}", label, 90, key, f"{GRANT}{said}(?: or (?:any )?later(?: version)?)?"))
                out.append(_signature(f"version:{label}:{name}", label, 70, key, f"{said}(?: or (?:any )?later(?: version)?| only)?"))
            out.append(_signature(f"grant:{stem}:{name}", stem, 60, key, f"{GRANT}{name}{end}"))
            out.append(_signature(f"spdx:{stem}:{name}", stem, 80, " spdx ", rf"spdx license identifier {name.removesuffix(' license')}(?: \d)*(?: only| or later)?"))
            if name not in WEAK:
                out.append(_signature(f"name:{stem}:{name}", stem, 40, key, name + end))
    out += [_signature(f"plain:{label}", label, 30, key, body) for label, body, key in PLAIN]
    return out


#: Word bytes: what is left of the text, lower-cased, without [\x00-\x2F\x3A-\x60\x7B-\x7F].
_BLANKED = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_BLANKED).split()


class Scanner:
    """The rules by keyword; a rule's pattern is tried only where its keyword stands in the text."""

    def __init__(self) -> None:
        self.by_key: dict[bytes, list[Signature]] = {}
        for rule in signatures():
            self.by_key.setdefault(rule.keyword, []).append(rule)

    def scan(self, line: bytes) -> list[tuple[Signature, int, int]]:
        """(rule, first byte, end byte) in the blank-joined words, before suppression."""
        found = []
        for key, rules in self.by_key.items():
            if key in line:
                for rule in rules:
                    found += [(rule, m.start(), m.end()) for m in rule.pattern.finditer(line)]
        return found


def suppress(found: list[tuple[Signature, int, int]]) -> list[tuple[Signature, int, int]]:
    """Take detections by priority, then length, then place; drop those inside one already taken.

    ``starts`` and ``ends`` are the taken intervals that lie in no other one, so both ascend and the last
    that starts no later reaches furthest: a binary search for each detection.
    """
    taken: list[tuple[Signature, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []
    for rule, a, b in sorted(found, key=lambda f: (-f[0].priority, f[1] - f[2], f[1], f[0].name)):
        i = bisect_right(starts, a) - 1
        if i >= 0 and ends[i] >= b:
            continue
        taken.append((rule, a, b))
        first = bisect_left(starts, a)
        last = max(first, bisect_right(ends, b))
        starts[first:last], ends[first:last] = [a], [b]
    return sorted(taken, key=lambda f: (f[1], f[2], f[0].name))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the detections of every whole text of ``docs``.

    ``found`` holds structs of rule, label, priority, base, start and end (word numbers from 0, end
    exclusive) in text order. Base phrases are never suppressed and suppress nothing. A null or empty text
    has no words and no detections; a text of any length is read whole. Repeated rows and null keys give a
    row each; other columns are not read; an empty table gives an empty result.
    """

    def make():
        scanner = Scanner()

        def each(row):
            words = words_of(row["text"])
            line = b" " + b" ".join(words) + b" "
            hits = scanner.scan(line)
            if hits:
                base = [h for h in hits if h[0].base]
                kept = base + suppress([h for h in hits if not h[0].base])
                blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                at = np.searchsorted(blanks, [(a, b) for _, a, b in kept]).tolist()
                places = [(a, b, r) for (a, b), (r, _, _) in zip(at, kept)]
                hits = [
                    {"rule": r.name, "label": r.label, "priority": r.priority, "base": r.base, "start": a, "end": b}
                    for a, b, r in sorted(places, key=lambda p: (p[0], p[1], p[2].name))
                ]
            yield row["doc_id"], len(words), hits

        return each

    schema = "doc_id bigint, n_words bigint, found array<struct<rule:string,label:string,priority:int,base:boolean,start:bigint,end:bigint>>"
    return arrow_map(docs.select("doc_id", "text"), make, schema)


def license_query(docs: DataFrame) -> DataFrame:
    """What the query of operator 5 returns; score: the surest detection's, 1 for a base phrase."""
    joined = lambda hits: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))))
    base = F.filter("found", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])
    sure = F.transform("found", lambda h: F.when(h["base"], 1.0).otherwise(h["priority"] / 100.0))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )
