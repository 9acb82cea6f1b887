"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its lower-case words joined by blanks. A text without any keyword of the
rules is done. Else the rules whose keywords it has run in their order: tags, quoted
notices, grants, links, then bare names, of more particular licenses first. A detection
that a kept one contains is suppressed, and so is one that overlaps a kept one of a rule
before it. What the base phrases find is always kept.

Defined cases: a null text is empty. A text without words has no detection, null places,
empty labels and score 0. Repeated rows are scanned each. Further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.spans import Taken

#: Phrases whose every place counts, with their labels.
BASE = {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}

#: Licenses, the more particular first: label, names (of words, as regular expressions), and the words of the short id.
FAMILIES = (
    ("agpl-3", "gnu affero general public license(?: version| v)? ?3|agpl ?v? ?3", "agpl 3 0"),
    ("agpl", "gnu affero general public license|affero general public license|agpl license", "agpl"),
    ("lgpl-2.1", "gnu (?:lesser|library) general public license(?: version| v)? ?2 1|lgpl ?v? ?2 1", "lgpl 2 1"),
    ("lgpl-3", "gnu lesser general public license(?: version| v)? ?3|lgpl ?v? ?3", "lgpl 3 0"),
    ("lgpl-2", "gnu (?:lesser|library) general public license(?: version| v)? ?2|lgpl ?v? ?2", "lgpl 2 0"),
    ("lgpl", "gnu lesser general public license|gnu library general public license|lgpl license", "lgpl"),
    ("gpl-3", "gnu general public license(?: version| v)? ?3|gnu gpl(?: version| v)? ?3|gpl ?v? ?3", "gpl 3 0"),
    ("gpl-2", "gnu general public license(?: version| v)? ?2|gnu gpl(?: version| v)? ?2|gpl ?v? ?2", "gpl 2 0"),
    ("gpl-1", "gnu general public license(?: version| v)? ?1|gpl ?v? ?1", "gpl 1 0"),
    ("gpl", "gnu general public license|gnu gpl|gpl license", "gpl"),
    ("gfdl-1.3", "gnu free documentation license version 1 3", "gfdl 1 3"),
    ("gfdl", "gnu free documentation license|gfdl", "gfdl"),
    ("apache-2", "apache(?: software)? license(?: version| v)? ?2|apache 2 0 license|apache ?v?2 license", "apache 2 0"),
    ("apache-1.1", "apache software license version 1 1", "apache 1 1"),
    ("apache-1", "apache license version 1 0", "apache 1 0"),
    ("apache", "apache software license|apache license", "apache"),
    ("bsd-4", "(?:original|4 clause|four clause) bsd license|bsd 4 clause", "bsd 4 clause"),
    ("bsd-3", "(?:new|revised|modified|3 clause|three clause) bsd license|bsd 3 clause", "bsd 3 clause"),
    ("bsd-2", "(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause", "bsd 2 clause"),
    ("bsd-0", "zero clause bsd license|bsd zero clause", "0bsd"),
    ("bsd", "bsd style license|bsd license|berkeley software distribution license", "bsd"),
    ("mit-0", "mit no attribution license", "mit 0"),
    ("mit", "mit license|mit x11 license|expat license|mit style license", "mit"),
    ("x11", "x11 license", "x11"),
    ("isc", "isc license|internet software consortium license", "isc"),
    ("mpl-2", "mozilla public license(?: version| v)? ?2|mpl ?v? ?2", "mpl 2 0"),
    ("mpl-1.1", "mozilla public license(?: version| v)? ?1 1|mpl 1 1", "mpl 1 1"),
    ("mpl", "mozilla public license", "mpl"),
    ("epl-2", "eclipse public license(?: version| v)? ?2|epl ?v? ?2", "epl 2 0"),
    ("epl-1", "eclipse public license(?: version| v)? ?1|epl ?v? ?1", "epl 1 0"),
    ("epl", "eclipse public license", "epl"),
    ("cddl-1.1", "common development and distribution license version 1 1", "cddl 1 1"),
    ("cddl", "common development and distribution license|cddl", "cddl 1 0"),
    ("cpl", "common public license", "cpl 1 0"),
    ("eupl", "european union public licen[cs]e", "eupl 1 2"),
    ("cecill", "cecill(?: free software)? license|cecill", "cecill 2 1"),
    ("bsl", "boost software license", "bsl 1 0"),
    ("busl", "business source license", "busl 1 1"),
    ("zlib", "zlib(?: libpng)? license", "zlib"),
    ("libpng", "libpng license", "libpng 2 0"),
    ("artistic-2", "artistic license(?: version| v)? ?2", "artistic 2 0"),
    ("artistic", "artistic license", "artistic 1 0"),
    ("psf", "python software foundation license|psf license", "psf 2 0"),
    ("php", "php license", "php 3 01"),
    ("ruby", "ruby license", "ruby"),
    ("w3c", "w3c software(?: notice and)? license", "w3c"),
    ("ofl", "sil open font license|open font license", "ofl 1 1"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("upl", "universal permissive license", "upl 1 0"),
    ("ms-pl", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft reciprocal license", "ms rl"),
    ("osl", "open software license", "osl 3 0"),
    ("afl", "academic free license", "afl 3 0"),
    ("ncsa", "university of illinois ncsa open source license|ncsa open source license", "ncsa"),
    ("openssl", "openssl license", "openssl"),
    ("elastic", "elastic license", "elastic 2 0"),
    ("sspl", "server side public license", "sspl 1 0"),
    ("blueoak", "blue oak model license", "blueoak 1 0 0"),
    ("mulan", "mulan psl|mulan permissive software license", "mulanpsl 2 0"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)|cc by nc nd", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike|cc by nc sa", "cc by nc sa 4 0"),
    ("cc-by-nc", "creative commons attribution non ?commercial|cc by nc", "cc by nc 4 0"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)|cc by nd", "cc by nd 4 0"),
    ("cc-by-sa", "creative commons attribution share ?alike|cc by sa", "cc by sa 4 0"),
    ("cc-by", "creative commons attribution|cc by [1234] [05]", "cc by 4 0"),
    ("cc0", "creative commons zero|cc0", "cc0 1 0"),
    ("odbl", "open database license|odbl", "odbl 1 0"),
    ("pddl", "public domain dedication and license|pddl", "pddl 1 0"),
    ("cdla", "community data license agreement", "cdla permissive 2 0"),
)
#: Notices that licenses ask to be kept, the longer first.
NOTICES = (
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so(?= the software is provided)"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted (?:[^ ]+ ){1,120}?neither the name"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "copyright (?:[^ ]+ ){1,12}?all rights reserved"),
)
GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|covered|redistributed|shared) (?:[^ ]+ ){0,3}?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
#: How far a kind of rule is to be believed.
TRUST = {"tag": 1.0, "notice": 0.95, "grant": 0.95, "link": 0.9, "name": 0.7}


class Rule(NamedTuple):
    label: str
    kind: str
    any_of: tuple[bytes, ...]  # keywords of which a text must have one
    pattern: re.Pattern


def keywords(names: str) -> tuple[bytes, ...]:
    """For each alternative, its longest word of three letters or more that isn't optional, else what it begins with."""

    def one(name: str) -> str:
        sure = re.findall("[a-z]{3,}", re.sub(r"\(\?[:=].*?\)[?]?|\[.*?\]|.\?", " ", name))
        return max(sure, key=len) if sure else re.match("[a-z0-9 ]+", name)[0].strip()

    return tuple(sorted({one(n).encode() for n in re.split(r"\|(?![^(]*\))", names)}))


@lru_cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order."""

    def rule(label: str, kind: str, any_of: tuple[bytes, ...], body: str) -> Rule:
        return Rule(label, kind, any_of, re.compile(f"(?<= )(?:{body})(?= )".encode()))

    whole = lambda x: f"(?:{x})"
    out = [rule(label, "tag", (b"spdx",), f"spdx license identifier {short}") for label, _, short in FAMILIES]
    out += [rule(label, "notice", keywords(body), body) for label, body in NOTICES]
    out += [rule(label, "grant", keywords(names), GRANT + whole(names)) for label, names, _ in FAMILIES]
    out += [rule(label, "link", (b"org licenses",), f"(?:opensource|spdx|gnu|apache|creativecommons) org licenses {whole(names_of_link(short))}") for label, _, short in FAMILIES]
    out += [rule(label, "name", keywords(names), f"(?:the )?{whole(names)}(?: licen[sc]e)?") for label, names, _ in FAMILIES]
    return tuple(out)


def names_of_link(short: str) -> str:
    """A short id as links have it: with its version, or with - that is, here, a blank - in it; those of creative commons go without their first word."""
    return f"{short}|{short.removeprefix('cc ')}" if short.startswith("cc ") else f"license {short}|{short}"


#: What separates words becomes a blank, and A-Z lower case.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))


@lru_cache
def gate() -> tuple[bytes, ...]:
    """Every text that a rule could match has one of these: all keywords, but for those that another one is part of."""
    words = {w for r in rules() for w in r.any_of}
    return tuple(sorted(w for w in words if not any(x != w and x in w for x in words)))


def detections(text: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in bytes of a text of words between blanks, in order of place; overlaps are resolved."""
    if not any(w in text for w in gate()):
        return []
    taken, kept, has = Taken(), [], {}
    for r in rules():
        for w in r.any_of:
            if w not in has:
                has[w] = w in text
        if any(has[w] for w in r.any_of):
            for m in r.pattern.finditer(text):
                if not taken.overlaps(*m.span()):
                    taken.add(*m.span())
                    kept.append((*m.span(), r))
    return sorted(kept, key=lambda d: d[:2])


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label:first word:end)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, ""
    flat = b" %s " % b" ".join(words)
    places = []
    for phrase, label in BASE.items():
        if phrase in flat:
            places += [(m.start() + 1, label) for m in re.finditer(b" %s(?= )" % phrase, flat)]
    found = detections(flat)
    at, before = 0, 0
    number = {}
    for place in sorted({p for p, _ in places} | {p for s, e, _ in found for p in (s, e + 1)}):
        before += flat.count(b" ", at, place)
        at, number[place] = place, before - 1
    first, last = (number[f(places)[0]] if places else None for f in (min, max))
    own = {label for _, label in places}
    labels = own | {r.label for *_, r in found}
    score = max([1.0 if places else 0.0, *(TRUST[r.kind] for *_, r in found)])
    return len(words), len(places), first, last, ",".join(sorted(own)), ",".join(sorted(labels)), score, ",".join(f"{r.label}:{number[s]}:{number[e + 1]}" for s, e, r in found)


RESULT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string"


def find_licenses(docs: DataFrame) -> DataFrame:
    """RESULT for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([scan(t) for t in pdf["text"]], columns=[c.split()[0] for c in RESULT.split(", ")[1:]])
            yield out.assign(doc_id=pdf["doc_id"].astype("Int64"), first_word=out["first_word"].astype("Int64"), last_word=out["last_word"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, RESULT)
