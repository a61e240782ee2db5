"""License detection: ordered signature rules behind a keyword prefilter.

Rules come from a table of licenses, each with the ways its name is written, put into several forms (a tag, a notice, a
grant, a bare mention). One expression over a column of lower-cased texts finds those with any keyword; most have none. In these,
a pass of one keyword automaton, and the literals that all matches of a rule hold, decide which rules run at all.
Overlapping detections are resolved by priority: a detection contained in one of higher rank is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cohort.llm.batches import over_batches, texts_of

# Label, keywords of which any mention of the license holds one, pattern of its name, address of its text.
NAMES = [
    ("mit", "mit|expat", r"(?:mit|expat)", r"opensource\.org/licenses/mit"),
    ("mit-0", "mit0|mit-0|mit 0|mitno attribution|mit-no attribution|mit no attribution", r"mit[- ]?(?:0|no attribution)", r"opensource\.org/licenses/mit-0"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)?[,]?[- ](?:version |v)?1\.0", r"apache\.org/licenses/license-1\.0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?[,]?[- ](?:version |v)?1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?[,]?[- ](?:version |v)?2(?:\.0)?", r"apache\.org/licenses/license-2\.0"),
    ("gpl-1.0", "general public|gpl", r"(?:gnu )?(?:general public license|gpl)[,]?[- ]?(?:version |v)?1(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", "general public|gpl", r"(?:gnu )?(?:general public license|gpl)[,]?[- ]?(?:version |v)?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "general public|gpl", r"(?:gnu )?(?:general public license|gpl)[,]?[- ]?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.0", "lesser|library general|lgpl", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)[,]?[- ]?(?:version |v)?2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", "lesser|library general|lgpl", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)[,]?[- ]?(?:version |v)?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lesser|library general|lgpl", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)[,]?[- ]?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "affero|agpl", r"(?:gnu )?(?:affero general public license|agpl)[,]?[- ]?(?:version |v)?3(?:\.0)?", r"gnu\.org/licenses/agpl-3\.0"),
    ("fdl-1.3", "free documentation|fdl", r"(?:gnu )?(?:free documentation license|g?fdl)[,]?[- ]?(?:version |v)?(?:1\.[0-3])?", r"gnu\.org/licenses/fdl"),
    ("bsd-0", "bsd", r"(?:0bsd|zero[- ]clause bsd)", r"opensource\.org/licenses/0bsd"),
    ("bsd-2-clause", "bsd", r"(?:(?:2|two)[- ]clause bsd|(?:simplified|freebsd) bsd|bsd[- ](?:2|two)[- ]clause)", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:3|three)[- ]clause bsd|(?:new|modified|revised) bsd|bsd[- ](?:3|three)[- ]clause)", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:(?:4|four)[- ]clause bsd|original bsd|bsd[- ](?:4|four)[- ]clause)", r"spdx\.org/licenses/bsd-4-clause"),
    ("mpl-1.1", "mozilla|mpl", r"(?:mozilla public license|mpl)[,]?[- ]?(?:version |v)?1\.[01]", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mozilla|mpl", r"(?:mozilla public license|mpl)[,]?[- ]?(?:version |v)?2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "eclipse|epl", r"(?:eclipse public license|epl)[,]?[- ]?(?:version |v)?1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "eclipse|epl", r"(?:eclipse public license|epl)[,]?[- ]?(?:version |v)?2(?:\.0)?", r"eclipse\.org/legal/epl-2\.0"),
    ("eupl-1.2", "european union|eupl", r"(?:european union public licen[cs]e|eupl)[,]?[- ]?(?:version |v)?1\.[012]", r"joinup\.ec\.europa\.eu/.{0,40}eupl"),
    ("cddl-1.0", "common development|cddl", r"(?:common development and distribution license|cddl)[,]?[- ]?(?:version |v)?1\.[01]", r"opensource\.org/licenses/cddl"),
    ("artistic-1.0", "artistic", r"artistic(?: license)?[,]?[- ]?(?:version |v)?1(?:\.0)?", r"perlfoundation\.org/artistic_license_1"),
    ("artistic-2.0", "artistic", r"artistic(?: license)?[,]?[- ]?(?:version |v)?2(?:\.0)?", r"perlfoundation\.org/artistic_license_2"),
    ("bsl-1.0", "boost|bsl", r"boost(?: software)?(?: license)?[,]?[- ]?(?:version |v)?1(?:\.0)?", r"boost\.org/license_1_0"),
    ("busl-1.1", "business source|busl", r"(?:business source license|busl)[,]?[- ]?(?:version |v)?1\.1", r"mariadb\.com/bsl11"),
    ("sspl-1.0", "server side|sspl", r"(?:server side public license|sspl)[,]?[- ]?(?:version |v)?1?(?:\.0)?", r"mongodb\.com/licensing/server-side-public-license"),
    ("isc", "isc", r"isc", r"opensource\.org/licenses/isc"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"opensource\.org/licenses/zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("python-2.0", "python|psf", r"(?:python software foundation|psf)[,]?[- ]?(?:license )?(?:version |v)?2?(?:\.0)?", r"python\.org/.{0,20}license"),
    ("php-3.01", "php", r"php(?: license)?[,]?[- ]?(?:version |v)?3\.0?1?", r"php\.net/license"),
    ("postgresql", "postgresql", r"postgresql", r"postgresql\.org/about/licen[cs]e"),
    ("openssl", "openssl", r"openssl", r"openssl\.org/source/license"),
    ("ofl-1.1", "open font|ofl", r"(?:sil )?(?:open font license|ofl)[,]?[- ]?(?:version |v)?1\.1", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", "open database|odbl", r"(?:open database license|odbl)[,]?[- ]?(?:version |v)?1?(?:\.0)?", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", "open data commons|odc", r"(?:open data commons attribution(?: license)?|odc-by)[,]?[- ]?(?:version |v)?1?(?:\.0)?", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", "public domain dedication|pddl", r"(?:public domain dedication and license|pddl)[,]?[- ]?(?:version |v)?1?(?:\.0)?", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", "cc0|cc-0|cc 0|creative commons zero", r"(?:cc[- ]?0|creative commons zero)[,]?[- ]?(?:version |v)?1?(?:\.0)?", r"creativecommons\.org/publicdomain/zero"),
    ("ms-pl", "microsoft|ms-pl", r"(?:microsoft public license|ms-pl)", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft|ms-rl", r"(?:microsoft reciprocal license|ms-rl)", r"opensource\.org/licenses/ms-rl"),
    ("ecl-2.0", "educational community|ecl", r"(?:educational community license|ecl)[,]?[- ]?(?:version |v)?2(?:\.0)?", r"opensource\.org/licenses/ecl-2\.0"),
    ("afl-3.0", "academic free|afl", r"(?:academic free license|afl)[,]?[- ]?(?:version |v)?3(?:\.0)?", r"opensource\.org/licenses/afl-3\.0"),
    ("ncsa", "ncsa|illinois", r"(?:university of illinois/ncsa|ncsa)(?: open source)?", r"opensource\.org/licenses/ncsa"),
    ("upl-1.0", "universal permissive|upl", r"(?:universal permissive license|upl)[,]?[- ]?(?:version |v)?1(?:\.0)?", r"opensource\.org/licenses/upl"),
    ("vim", "vim", r"vim", r"vimhelp\.org"),
    ("ruby", "ruby", r"ruby", r"ruby-lang\.org/.{0,20}license"),
    ("x11", "x11", r"x11", r"spdx\.org/licenses/x11"),
    ("openrail", "openrail|open rail", r"(?:creativeml |bigscience )?open ?rail(?:-?[+]?[ms]{1,2})?", r"huggingface\.co/spaces/.{0,40}license"),
]

# The Creative Commons families, the words their long names use, and their versions.
CC_PARTS = {"by": "attribution", "by-sa": "attribution[- ]share-?alike", "by-nd": "attribution[- ]no-?deriv(?:ative)?s?", "by-nc": "attribution[- ]non-?commercial", "by-nc-sa": "attribution[- ]non-?commercial[- ]share-?alike", "by-nc-nd": "attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Sentences of license texts: label, keyword, pattern, score.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy", 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted", 0.95),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose", 1.0),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing, software distributed under the license", 1.0),
    ("gpl", "this program is free software", r"this program is free software[;:] you can redistribute it and/or modify", 0.9),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("zlib", "as-is", r"this software is provided 'as-is', without any express or implied warranty", 0.9),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|in) (?:in)?(?:to )?the public domain", 0.7),
    ("proprietary", "all rights reserved", r"all rights reserved", 0.6),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("warranty-disclaimer", "without warrant", r"without warrant(?:y|ies) (?:or conditions )?of any kind", 0.5),
]

# The phrases of the plain count, as words, and their labels.
PHRASES = [((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl")]
_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_IN_WORD = np.array([_WORDS.fullmatch(bytes([b])) is not None for b in range(256)])


@dataclass(frozen=True)
class Rule:
    """A signature; smaller ranks win. ``keywords``: one of them must occur, and all ``needs``, or the rule is not tried."""

    rank: int
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    score: float
    needs: tuple[str, ...]


def _table() -> list[tuple[str, str, str, str]]:
    table = list(NAMES)
    for part, words in CC_PARTS.items():
        for version in CC_VERSIONS:
            v = version.replace(".", r"\.")
            name = rf"(?:cc[- ]{part}|creative commons {words})(?: (?:international|unported|generic))?(?: public)?(?: license)?[,]?[- ](?:version |v)?{v}"
            table.append((f"cc-{part}-{version}", "cc by|cc-by|creative commons", name, rf"creativecommons\.org/licenses/{part}/{v}"))
    return table


def _version(name: str) -> tuple[str, ...]:
    """The digits of a version that no way to write a name leaves out."""
    digits = re.search(r"\(\?:version \|v\)\?(\d(?:\\\.\d)?)(?!\?)", name)
    return (digits[1].replace("\\", ""),) if digits else ()


@cache
def rules() -> list[Rule]:
    """The ordered rules: identifier tags, addresses, sentences of the texts, notices that grant, then bare names."""
    found = []
    edge, close = r"(?<![\w.])", r"(?![\w])"
    for label, keywords, name, address in _table():
        keys = tuple(keywords.split("|"))
        tag, version = re.escape(label), _version(name)
        found += [
            (0, label, ("spdx-license-identifier",), rf"spdx-license-identifier:\s{{0,4}}{tag}(?:-only|-or-later)?{close}", 1.0, ()),
            (1, label, ("http",), rf"https?://(?:www\.)?{address}", 0.95, ()),
            (3, label, keys, rf"{edge}(?:licen[cs]ed|released|distributed|available|provided|published) (?:\w+ ){{0,2}}under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?{close}", 0.9, ("under ", *version)),
            (4, label, keys, rf"licen(?<![\w.]licen)[cs]e\s?[:=]\s{{0,2}}[\"']?(?:the )?{name}{close}", 0.85, ("licen", *version)),
            (5, label, keys, rf"{edge}(?:the )?{name}[,]? (?:public |software )?licen[cs]e{close}", 0.8, ("licen", *version)),
        ]
        if re.search(r"\d$", label):
            found.append((6, label, keys, rf"{edge}{name}{close}", 0.5, version))
    found += [(2, label, (key,), pattern, score, ()) for label, key, pattern, score in SENTENCES]
    for label, words in (("mit", "mit"), ("apache", "apache"), ("gpl", "general public"), ("lgpl", "lesser general public"), ("agpl", "affero general public")):
        found.append((7, label, (words,), rf"{edge}{words}\s+licen[cs]e{close}", 0.5, ("licen",)))
    found.sort(key=lambda r: r[0])
    return [Rule(n, label, keys, re.compile(pattern), score, needs) for n, (_, label, keys, pattern, score, needs) in enumerate(found)]


@cache
def _gate() -> tuple[ahocorasick.Automaton, dict[str, list[Rule]]]:
    by_key: dict[str, list[Rule]] = {}
    for rule in rules():
        for key in rule.keywords:
            by_key.setdefault(key, []).append(rule)
    automaton = ahocorasick.Automaton()
    for key in by_key:
        automaton.add_word(key, key)
    automaton.make_automaton()
    return automaton, by_key


@cache
def any_keyword() -> str:
    """An expression that matches the lower-cased texts in which the automaton finds a keyword."""
    return "|".join(re.escape(key) for key in _gate()[1])


def detections(text: str) -> list[tuple[int, int, str, float]]:
    """``(start, end, label, score)`` of every signature that stands, by start; offsets in the lower-cased text."""
    low = text.lower()
    automaton, by_key = _gate()
    chosen = {rule.rank: rule for key in {key for _, key in automaton.iter(low)} for rule in by_key[key] if all(word in low for word in rule.needs)}
    kept: list[tuple[int, int, str, float]] = []
    for rank in sorted(chosen):
        rule = chosen[rank]
        for m in rule.pattern.finditer(low):
            if not any(s <= m.start() and m.end() <= e for s, e, _, _ in kept):
                kept.append((m.start(), m.end(), rule.label, rule.score))
    return sorted(kept)


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
])


def _places(words: list[bytes], phrase: tuple[bytes, ...]) -> Iterator[int]:
    at = -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return
        if tuple(words[at : at + len(phrase)]) == phrase:
            yield at


def _word_counts(raw: list[bytes]) -> list[int]:
    """The number of words of each text."""
    inside = _IN_WORD[np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)]
    sizes = np.array([len(r) + 1 for r in raw])
    return np.add.reduceat(inside[1:] & ~inside[:-1], np.cumsum(sizes) - sizes, dtype=np.int64).tolist()


def _scan(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in SCHEMA}
        texts = [text or "" for text in batch["text"]]
        lower = [text.encode().lower() for text in texts]  # bytes: A to Z only
        named = pc.match_substring_regex(pa.array([text.lower() for text in texts], type=pa.large_string()), any_keyword()).to_pylist()
        for doc_id, text, raw, n_words, has_name in zip(batch["doc_id"], texts, lower, _word_counts(lower), named, strict=True):
            words = _WORDS.findall(raw) if b"license" in raw else []
            places = [(at, label) for phrase, label in PHRASES for at in _places(words, phrase)]
            found = detections(text) if has_name else []
            base = {label for _, label in places}
            starts = [at for at, _ in places]
            values = (
                doc_id, n_words, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                ",".join(sorted(base | {d[2] for d in found})), max([d[3] for d in found] + [0.8] * bool(places), default=0.0),
            )
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        yield out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: words, places of the plain phrases, labels of the plain phrases and of all rules, score.

    A null or empty text has no words, no labels and score 0. Rows are independent and need no shuffle.
    """
    return over_batches(texts_of(docs), _scan, SCHEMA)
