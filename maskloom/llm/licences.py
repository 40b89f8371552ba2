"""Ordered signature rules that find licence statements in the texts of captured documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskloom.llm.records import REGION_ID, TEXT, slices, texts_of

#: Phrases whose every place counts, with the label each gives.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: label: how the licence is named in running text (words of the folded text, as a regex).
NAMES = {
    "mit": r"mit", "mit-0": r"mit (?:0|no attribution)", "x11": r"x11", "isc": r"isc",
    "apache-1": r"apache (?:software )?(?:license )?(?:version )?1 [01]",
    "apache-2": r"apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?",
    "bsd-2": r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)",
    "bsd-3": r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)",
    "bsd-4": r"(?:bsd 4 clause|4 clause bsd|original bsd)", "0bsd": r"(?:0bsd|zero clause bsd|bsd zero clause)",
    "gpl-1": r"(?:gnu general public license|gpl) (?:version |v )?v?1(?: 0)?",
    "gpl-2": r"(?:gnu general public license|gnu gpl|gpl) (?:version |v )?v?2(?: 0)?",
    "gpl-3": r"(?:gnu general public license|gnu gpl|gpl) (?:version |v )?v?3(?: 0)?",
    "lgpl-2": r"(?:gnu (?:lesser|library) general public license|lgpl) (?:version |v )?v?2(?: [01])?",
    "lgpl-3": r"(?:gnu lesser general public license|lgpl) (?:version |v )?v?3(?: 0)?",
    "agpl-3": r"(?:gnu affero general public license|agpl) (?:version |v )?v?3(?: 0)?",
    "mpl-1": r"(?:mozilla public license|mpl) (?:version |v )?1 [01]",
    "mpl-2": r"(?:mozilla public license|mpl) (?:version |v )?2(?: 0)?",
    "epl-1": r"(?:eclipse public license|epl) (?:version |v )?1(?: 0)?",
    "epl-2": r"(?:eclipse public license|epl) (?:version |v )?2(?: 0)?",
    "eupl": r"(?:european union public license|european union public licence|eupl)(?: (?:version |v )?1 [12])?",
    "cddl": r"(?:common development and distribution license|cddl)(?: (?:version )?1 [01])?",
    "cpl": r"common public license(?: version 1 0)?", "osl": r"open software license(?: version 3 0)?",
    "afl": r"academic free license(?: version 3 0)?", "artistic-1": r"artistic license 1 0",
    "artistic-2": r"artistic license (?:version )?2(?: 0)?", "zlib": r"zlib(?: libpng)?", "bsl-1": r"boost software license(?: (?:version )?1 0)?",
    "unlicense": r"unlicense", "wtfpl": r"(?:wtfpl|do what the fuck you want to public license)",
    "ofl": r"(?:sil )?open font license(?: (?:version )?1 1)?", "ncsa": r"(?:university of illinois )?ncsa(?: open source)?",
    "postgresql": r"postgresql", "python-2": r"python software foundation(?: license version 2)?",
    "php-3": r"php license (?:version )?3 01", "ruby": r"ruby", "ms-pl": r"microsoft public", "ms-rl": r"microsoft reciprocal",
    "upl": r"universal permissive(?: license version 1 0)?", "cecill": r"cecill(?: [abc2])?", "odbl": r"open database(?: license)?",
    "pddl": r"public domain dedication and license", "odc-by": r"open data commons attribution", "gfdl": r"gnu free documentation",
    "cc0": r"(?:cc0(?: 1 0)?|creative commons zero)",
    "cc-by": r"(?:cc by|creative commons attribution)(?! (?:sa|nc|nd|share|non|no))(?: [1234] \d)?",
    "cc-by-sa": r"(?:cc by sa|creative commons attribution share ?alike)(?: [1234] \d)?",
    "cc-by-nd": r"(?:cc by nd|creative commons attribution no ?deriv\w*)(?: [1234] \d)?",
    "cc-by-nc": r"(?:cc by nc|creative commons attribution non ?commercial)(?! (?:sa|nd|share|no))(?: [1234] \d)?",
    "cc-by-nc-sa": r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234] \d)?",
    "cc-by-nc-nd": r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)(?: [1234] \d)?",
}

#: form, where {n} stands for a name: priority, words of which the text must hold all, confidence.
#: ``licen`` stands for any word that holds it.
FORMS = {
    r"spdx license identifier {n}(?: only| or later)?": (90, ("spdx", "identifier"), 1.0),
    r"licen[sc]ed under (?:the |a )?(?:terms of the )?{n}(?: licen[sc]e)?": (80, ("under",), 0.98),
    r"(?:released|distributed|available|published|dual licen[sc]ed) under (?:the |a )?(?:terms of the )?{n}(?: licen[sc]e)?":
        (80, ("under",), 0.95),
    r"(?:subject to|governed by|according to) (?:the )?(?:terms of the )?{n} licen[sc]e": (70, ("licen",), 0.9),
    r"licen[sc]e (?:is |type )?(?:the )?{n}(?: licen[sc]e)?": (60, ("licen",), 0.85),
    r"(?:the )?{n} licen[sc]e": (50, ("licen",), 0.8),
    r"under {n}": (40, ("under",), 0.7),
}

#: Sentences that only one licence has: label, pattern, required words.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("hereby", "granted")),
    ("mit", r"the above copyright notice and this permission notice shall be included", ("copyright", "notice")),
    ("mit", r"opensource org licenses mit", ("opensource",)),
    ("apache-2", r"you may not use this file except in compliance with the license", ("compliance",)),
    ("apache-2", r"apache org licenses license 2 0", ("apache",)),
    ("apache-2", r"unless required by applicable law or agreed to in writing software", ("applicable",)),
    ("bsd-2", r"redistribution and use in source and binary forms with or without modification are permitted", ("redistribution",)),
    ("bsd-3", r"neither the name of [^ ]+(?: [^ ]+){0,12} nor the names of its contributors", ("neither", "contributors")),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display", ("advertising",)),
    ("gpl-2", r"either version 2 of the license or (?:at your option )?any later version", ("version", "later")),
    ("gpl-3", r"either version 3 of the license or (?:at your option )?any later version", ("version", "later")),
    ("gpl", r"this program is free software you can redistribute it and or modify", ("redistribute",)),
    ("gpl", r"gnu org licenses gpl", ("gnu",)),
    ("lgpl", r"this library is free software you can redistribute it and or modify", ("redistribute",)),
    ("agpl-3", r"users interacting with it remotely through a computer network", ("remotely",)),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license", ("mozilla",)),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", ("fee",)),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", ("warranty",)),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization", ("hereby", "organization")),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified", ("verbatim",)),
    ("epl-2", r"eclipse org legal epl (?:v20|2 0)", ("eclipse",)),
    ("cc0", r"creativecommons org publicdomain zero 1 0", ("creativecommons",)),
    ("cc-by", r"creativecommons org licenses by [1234] \d", ("creativecommons",)),
    ("cc-by-sa", r"creativecommons org licenses by sa [1234] \d", ("creativecommons",)),
    ("cc-by-nd", r"creativecommons org licenses by nd [1234] \d", ("creativecommons",)),
    ("cc-by-nc", r"creativecommons org licenses by nc [1234] \d", ("creativecommons",)),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [1234] \d", ("creativecommons",)),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [1234] \d", ("creativecommons",)),
    ("ofl", r"this font software is licensed under the sil open font license", ("font",)),
    ("public-domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", ("public", "domain")),
    ("proprietary", r"all rights reserved", ("rights", "reserved")),
    ("proprietary", r"unauthorized (?:copying|reproduction|use|distribution)", ("unauthorized",)),
    ("proprietary", r"proprietary and confidential", ("proprietary", "confidential")),
]


@dataclass(frozen=True)
class Rule:
    rule: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float
    base: bool = False


@lru_cache(maxsize=1)
def signature_rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, sentences, then every form of every name."""
    rules = [Rule(f"base-{label}", label, re.escape(phrase).replace("\\ ", " "), tuple(phrase.split()), 100, 1.0, True)
             for phrase, label in BASE_PHRASES.items()]
    rules += [Rule(f"sentence-{i}", label, pattern, words, 95, 1.0) for i, (label, pattern, words) in enumerate(SENTENCES)]
    for k, (form, (priority, words, confidence)) in enumerate(FORMS.items()):
        for label, name in NAMES.items():
            gate = (*words, *_required_word(name))
            rules.append(Rule(f"form-{k}-{label}", label, form.format(n=name), gate, priority, confidence))
    # These short names are unlike any other words, so that they count without the word licence too.
    rules += [Rule(f"name-{label}", label, label.replace("-", " ") + r"(?: [1234] \d)?", ("cc", "by"), 30, 0.6)
              for label in NAMES if label.startswith("cc-by")]
    return tuple(rules)


def _required_word(name: str) -> tuple[str, ...]:
    """A word that every match of a name holds, where its pattern begins with one."""
    word = re.match(r"[a-z0-9]+(?=$| |\()", name)
    return (word[0],) if word and not name[word.end():].startswith("?") else ()


_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

DETECTION = pa.struct([("rule", pa.string()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64()),
                       ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())])


def settled(found: list[tuple]) -> list[tuple]:
    """Drop detections ``(priority, start, end, order)`` whose interval lies in one that outranks them.

    A higher priority outranks; on equal priority the longer interval, then the earlier rule.
    """
    kept: list[tuple] = []
    for level in sorted({f[0] for f in found}, reverse=True):
        above = sorted((f[1], f[2]) for f in kept)
        starts = [s for s, _ in above]
        reach = np.maximum.accumulate([e for _, e in above]) if above else []
        far = -1
        for f in sorted((f for f in found if f[0] == level), key=lambda f: (f[1], -f[2], f[3])):
            k = np.searchsorted(starts, f[1], side="right")
            if f[2] <= far or (k and reach[k - 1] >= f[2]):
                continue
            far = max(far, f[2])
            kept.append(f)
    return sorted(kept, key=lambda f: (f[1], f[2], f[3]))


def _compiled() -> list[tuple]:
    return [(r, re.compile(b"(?<= )(?:" + r.pattern.encode() + b")(?= )"), [k.encode() for k in r.keywords])
            for r in signature_rules()]


def _detect(text: bytes, rules: list[tuple]) -> list[dict]:
    words = text.split()
    folded = b" " + b" ".join(words) + b" "
    present = set(words)
    if b"licen" in text:
        present.add(b"licen")
    found = []
    for order, (rule, pattern, gate) in enumerate(rules):
        if all(k in present for k in gate):
            found += [(rule.priority, m.start(), m.end(), order) for m in pattern.finditer(folded)]
    if not found:
        return []
    blanks = np.flatnonzero(np.frombuffer(folded, np.uint8) == 0x20)
    out = []
    for _, start, end, order in settled(found):
        r = rules[order][0]
        out.append({"rule": r.rule, "label": r.label, "priority": r.priority, "confidence": r.confidence, "base": r.base,
                    "first": int(np.searchsorted(blanks, start)) - 1, "last": int(np.searchsorted(blanks, end)) - 1})
    return out


def scan_licences(regions: DataFrame) -> DataFrame:
    """``region_id``, ``n_words`` long and ``detections`` array of
    ``(rule, label, priority, confidence, base, first, last)``, one row per row.

    The whole ``original_text`` is folded (A-Z lower-cased, ASCII letters, digits and all non-ASCII characters
    kept, the rest separates words); rules run on the folded words. A rule is tried only if the text holds all
    its keywords. ``first`` and ``last`` are the numbers, from 0, of a detection's first and last word.
    Detections inside one that outranks them are dropped; base phrases outrank all others, so each of their
    places is reported.

    A null or empty text has no words and no detections. Rows do not influence each other, so repeated ids
    are fine. Memory is bounded by the longest text.
    """
    from pyspark.sql.types import LongType, StructField, StructType
    from pyspark.sql.pandas.types import from_arrow_type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _compiled()
        gates = sorted({min(gate, key=lambda k: (k != b"licen", k != b"under", k != b"cc", k)) for _, _, gate in rules})
        for rows, data, bounds in slices(batches, TEXT):
            data = _FOLD[data]
            here = data.tobytes()
            near = [k for k in gates if k in here]
            found = [
                _detect(t, rules) if any(k in t for k in near) else []
                for t in texts_of(data, bounds)
            ]
            inside = data != 0x20
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = bounds[:-1][bounds[:-1] < bounds[1:]]
            begins[edges] = inside[edges]
            words = np.diff(np.searchsorted(np.flatnonzero(begins), bounds))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(words, pa.int64()), pa.array(found, pa.list_(DETECTION))],
                names=[REGION_ID, "n_words", "detections"])

    schema = StructType([regions.select(REGION_ID).schema[0], StructField("n_words", LongType(), False),
                         StructField("detections", from_arrow_type(pa.list_(DETECTION)), False)])
    return regions.select(REGION_ID, TEXT).mapInArrow(scan, schema)
