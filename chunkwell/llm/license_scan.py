"""Operator 3: licence scans by sentence rules.

A text is cut into sentences twice, line by line and over whole paragraphs (so that a wrapped
sentence and a lone line without a full stop are both found).  A normalised sentence is mapped to
the identifier of a known licence sentence; the identifiers, in text order, are then matched
against ordered licence rules, the most specific first.  An identifier that no rule uses at its
place stays in ``unmatched``.

A sentence that puts something under a licence by name (``UNDER``) is known wherever the phrase
stands in it, with any words before and behind; one that denies it ("not licensed under", "no longer
released under") is none.  Licences are named by their SPDX identifiers; an SPDX
expression keeps its operators.

A text without any of the ``KEYWORDS`` can hold no known sentence (a test asserts this of the
table), so only the others are cut.

Cases: a null or empty text has no licence (empty lists).  Repeated sentences repeat their
identifier; a licence is named once.  Texts and sentences of any length are read whole.  Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from chunkwell.llm.common import map_texts

KEYWORDS = ("licen", "copyright", "permission", "warrant", "redistribut", "liab", "spdx", "public domain", "free software", "endorse", "cc0", "misrepresent", "altered source", "gpl", "apache-2", "cc by", "creative commons", "source distribution", "advertis", "gnu ", "mpl ")

#: SPDX identifiers and the names by which sentences call the licences (normalised as
#: sentences are).  Of a name that begins like another one the longer stands first.
NAMES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", r"apache(?: software)?(?: licen[sc]e)?,? (?:version |v\.? ?|- ?)?2(?:\.0)?(?: licen[sc]e)?|apache-2\.0"),
    ("Apache-1.1", r"apache(?: software)? licen[sc]e,? (?:version |v\.? ?)?1\.1"),
    ("MIT-0", r"mit no attribution(?: licen[sc]e)?|mit-0"),
    ("MIT", r"(?:mit|expat|mit x11|x11 mit)(?: style)?(?: open source)?(?: licen[sc]e)?"),
    ("X11", r"x11 licen[sc]e"),
    ("0BSD", r"(?:zero|0)[- ]clause bsd(?: licen[sc]e)?|0bsd(?: licen[sc]e)?"),
    ("BSD-4-Clause", r"(?:original bsd|4[- ]clause bsd|four[- ]clause bsd|bsd 4[- ]clause)(?: licen[sc]e)?"),
    ("BSD-3-Clause", r"(?:new bsd|revised bsd|modified bsd|3[- ]clause bsd|three[- ]clause bsd|bsd[- ]3[- ]clause)(?: licen[sc]e)?"),
    ("BSD-2-Clause", r"(?:simplified bsd|freebsd|2[- ]clause bsd|two[- ]clause bsd|bsd[- ]2[- ]clause)(?: licen[sc]e)?"),
    ("ISC", r"isc(?: licen[sc]e)?"),
    ("Zlib", r"zlib(?: libpng)?(?: licen[sc]e)?"),
    ("BSL-1.0", r"boost software licen[sc]e(?:,? (?:- )?(?:version |v\.? ?)?1\.0)?"),
    ("Artistic-2.0", r"artistic licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("Artistic-1.0", r"artistic licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("EPL-2.0", r"eclipse public licen[sc]e,? (?:- ?)?(?:version |v\.? ?)?2(?:\.0)?|epl[- ]2\.0"),
    ("EPL-1.0", r"eclipse public licen[sc]e,? (?:- ?)?(?:version |v\.? ?)?1(?:\.0)?|epl[- ]1\.0"),
    ("MPL-2.0", r"mozilla public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?|mpl[- ]2\.0"),
    ("MPL-1.1", r"mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.1|mpl[- ]1\.1"),
    ("CDDL-1.1", r"common development and distribution licen[sc]e(?: cddl)?,? (?:version |v\.? ?)?1\.1"),
    ("CDDL-1.0", r"common development and distribution licen[sc]e(?: cddl)?(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("CPL-1.0", r"common public licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("EUPL-1.2", r"european union public licen[sc]e,? (?:version |v\.? ?)?1\.2|eupl[- ]1\.2"),
    ("EUPL-1.1", r"european union public licen[sc]e,? (?:version |v\.? ?)?1\.1|eupl[- ]1\.1"),
    ("Unlicense", r"unlicense"),
    ("WTFPL", r"wtfpl|do what the fuck you want to public licen[sc]e"),
    ("MS-PL", r"microsoft public licen[sc]e(?: ms-pl)?"),
    ("MS-RL", r"microsoft reciprocal licen[sc]e(?: ms-rl)?"),
    ("Python-2.0", r"(?:python software foundation|psf) licen[sc]e(?:,? (?:version |v\.? ?)?2)?"),
    ("PostgreSQL", r"postgresql licen[sc]e"),
    ("OFL-1.1", r"sil open font licen[sc]e,? (?:version |v\.? ?)?1\.1"),
    ("OpenSSL", r"openssl licen[sc]e"),
    ("AFL-3.0", r"academic free licen[sc]e,? (?:version |v\.? ?)?3\.0"),
    ("OSL-3.0", r"open software licen[sc]e,? (?:version |v\.? ?)?3\.0"),
    ("ECL-2.0", r"educational community licen[sc]e,? (?:version |v\.? ?)?2\.0"),
    ("NCSA", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("PHP-3.01", r"php licen[sc]e,? (?:version |v\.? ?)?3\.01"),
    ("UPL-1.0", r"universal permissive licen[sc]e(?: upl)?,? (?:version |v\.? ?)?1\.0"),
    ("Ruby", r"ruby licen[sc]e"),
    ("Vim", r"vim licen[sc]e"),
    ("Sleepycat", r"sleepycat licen[sc]e"),
    ("Beerware", r"beer-?ware licen[sc]e"),
    ("LPPL-1.3c", r"latex project public licen[sc]e(?:,? (?:version |v\.? ?)?1\.3c?)?"),
    ("ODbL-1.0", r"(?:open data commons )?open database licen[sc]e(?: odbl)?(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("CC0-1.0", r"(?:creative commons )?cc0(?:[- ]1\.0)?(?: universal)?"),
)
#: The GNU licences, by the words between "gnu" and "license".
GNU: dict[str, str] = {"affero general public": "AGPL", "lesser general public": "LGPL", "library general public": "LGPL", "general public": "GPL", "free documentation": "GFDL", "agpl": "AGPL", "lgpl": "LGPL", "gpl": "GPL"}

_LATER = r"(?P<later>,? (?:or|and) (?:at your option,? )?(?:any )?later(?: version)?|,? or newer)"
_GNU_NAME = r"(?:gnu )?(?P<gnu>affero general public|lesser general public|library general public|general public|free documentation)(?: licen[sc]e)?(?: [al]?gpl)?,? ?(?:- ?)?(?:version |v\.? ?)?(?P<gnu_version>[123](?:\.\d)?)?" + _LATER + "?|(?:gnu )?(?P<abbreviated>[al]?gpl)[- ]?(?:version |v\\.? ?)?(?P<short_version>[123](?:\\.\\d)?)(?P<short_later>\\+|" + _LATER.replace("later>", "later_words>") + ")?"
_CC_NAME = r"(?:a |the )?(?:cc|creative commons)(?: licen[sc]e)?[- ](?P<cc>by(?:-nc)?(?:-(?:sa|nd))?|attribution(?:[- ]non-?commercial)?(?:[- ](?:share-?alike|no-?deriv(?:ative)?s?(?: works)?))?)[- ,]*(?:version |v\.? ?)?(?P<cc_version>[1-4]\.\d)"
_NAME = "(?:" + "|".join([*(f"(?P<n{i}>{p})" for i, (_, p) in enumerate(NAMES)), _CC_NAME, _GNU_NAME]) + r")(?![\w.]*\w)"
_VERB = r"(?:licen[sc]ed|re-?licen[sc]ed|released|distributed|available|published|provided|offered|governed|covered|shared|redistribute it(?: and or modify it)?|used)(?: \w+){0,4}? (?:under|by|with)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?(?: version (?P<before>[123](?:\.\d)?) of the)?"
_UNDER = re.compile(rf"(?<![\w-]){_VERB} {_NAME}")
_DENIED = re.compile(r"(?:\bnot|\bnever|\bno longer|\bcannot|\bt|\bneither|\bnor|\bwithout being)(?: \w+){0,2} $")

#: Identifier and pattern of a normalised sentence (lower case, single spaces, no final stop).
SENTENCES: tuple[tuple[str, str], ...] = (
    ("SPDX", r"(?:.* )?spdx-license-identifier .*"),
    ("APACHE2_HEAD", r"(?:.* )?licensed under the apache license,? version 2\.0 the license, you may not use this (?:file|work|software) except in compliance with the license"),
    ("APACHE2_NOT_EXCEPT", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("APACHE2_OBTAIN", r"you may obtain a copy of the license at(?: https? ?www\.apache\.org licenses license-2\.0)?"),
    ("APACHE2_ASIS", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis,? without warranties or conditions of any kind,? either express or implied"),
    ("APACHE2_SEE", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MIT_TITLE", r"(?:the )?mit license(?: mit)?"),
    ("MIT_GRANT", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files .*subject to the following conditions"),
    ("MIT_NOTICE", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("BOOST_TITLE", r"boost software license - version 1\.0(?: - august 17th,? 2003)?"),
    ("BOOST_GRANT", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*"),
    ("BOOST_NOTICE", r"the copyright notices in the software and this entire statement,? .* must be included in all copies of the software.*"),
    ("ASIS", r"(?:the|this) software is provided .*as is,? (?:and the authors? disclaims? all warranties|without warranty|and any express or implied warranties).*"),
    ("LIABLE", r"in no event (?:shall|will) .* be (?:held )?liable for any .*"),
    ("ISC_GRANT", r"permission to use,? copy,? modify,? and(?: or)? distribute this software for any purpose with or without fee is hereby granted.*"),
    ("ZLIB_ASIS", r"this software is provided as-is,? without any express or implied warranty"),
    ("ZLIB_GRANT", r"permission is granted to anyone to use this software for any purpose,? including commercial applications,? and to alter it and redistribute it freely,? subject to the following restrictions"),
    ("ZLIB_ORIGIN", r"(?:\d\.? )?the origin of this software must not be misrepresented.*"),
    ("ZLIB_ALTERED", r"(?:\d\.? )?altered source versions must be plainly marked as such.*"),
    ("ZLIB_NOTICE", r"(?:\d\.? )?this notice may not be removed or altered from any source distribution"),
    ("BSD_REDIST", r"redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", r"(?:\d\.? |\* |- )?redistributions of source code must retain the above copyright notice,? this list of conditions and the following disclaimer"),
    ("BSD_BINARY", r"(?:\d\.? |\* |- )?redistributions in binary form must reproduce the above copyright notice,? this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD_ADVERTISE", r"(?:\d\.? |\* |- )?all advertising materials mentioning features or use of this software must display the following acknowledge?ment.*"),
    ("BSD_ENDORSE", r"(?:\d\.? |\* |- )?neither the name .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GNU_FREE", r".* is free software,? you can redistribute it and or modify it under the terms of the gnu (?P<gnu>affero general public|lesser general public|library general public|general public) license as published by the free software foundation,? (?:either version (?P<version>[123](?:\.\d)?) of the license,? or (?:at your option )?any later version|version (?P<only>[123](?:\.\d)?)(?: of the license| only)?)"),
    ("GNU_HOPE", r".* is distributed in the hope that it will be useful,? but without any warranty,? without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GNU_SEE", r"see the gnu (?:affero |lesser |library )?general public license for more details"),
    ("GNU_COPY", r"you should have received a copy of the gnu (?:affero |lesser |library )?general public license along with .*"),
    ("MPL2_SUBJECT", r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0"),
    ("MPL2_COPY", r"if a copy of the mpl was not distributed with this file,? you can obtain one at .*"),
    ("EPL_HEAD", r"(?:.* )?this program and the accompanying materials are made available under the terms of the eclipse public license,? (?:- ?)?v(?:ersion)?\.? ?(?P<version>[12]\.0).*"),
    ("CC0_WAIVED", r".*(?:to the extent possible under law|has waived all copyright).*(?:waived all copyright and related|cc0).*"),
    ("PUBLIC_DOMAIN", r"(?:.* )?(?:is|are|been|hereby) (?:hereby )?(?:dedicated|released|placed|put)(?: \w+)? (?:in)?to the public domain(?: .*)?"),
    ("UNLICENSE", r"this is free and unencumbered software released into the public domain"),
    ("WTFPL", r"(?:.* )?do what the fuck you want to public license.*"),
    ("UNDER", r"(?:.* )?(?:licen[sc]ed|released|distributed|available) under .*licen[sc]e.*"),
    ("COPYRIGHT", r"(?:portions )?copyright .*"),
    ("ALL_RIGHTS", r"(?:.* )?all rights reserved under copyright"),
)

#: Licence rules in order; the first whose identifiers stand at a place wins there.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-4-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERTISE", "BSD_ENDORSE", "ASIS", "LIABLE")),
    ("BSD-3-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "ASIS", "LIABLE")),
    ("BSD-2-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "ASIS", "LIABLE")),
    ("Apache-2.0", ("APACHE2_HEAD", "APACHE2_OBTAIN", "APACHE2_ASIS", "APACHE2_SEE")),
    ("Apache-2.0", ("UNDER", "APACHE2_NOT_EXCEPT", "APACHE2_OBTAIN", "APACHE2_ASIS", "APACHE2_SEE")),
    ("BSL-1.0", ("BOOST_TITLE", "BOOST_GRANT", "BOOST_NOTICE")),
    ("BSL-1.0", ("BOOST_GRANT", "BOOST_NOTICE")),
    ("MIT", ("MIT_TITLE", "MIT_GRANT", "MIT_NOTICE", "ASIS", "LIABLE")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "ASIS", "LIABLE")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("ISC", ("ISC_GRANT", "ASIS", "LIABLE")),
    ("Zlib", ("ZLIB_ASIS", "LIABLE", "ZLIB_GRANT", "ZLIB_ORIGIN", "ZLIB_ALTERED", "ZLIB_NOTICE")),
    ("Zlib", ("ZLIB_GRANT", "ZLIB_ORIGIN", "ZLIB_ALTERED", "ZLIB_NOTICE")),
    ("{gnu}-{version}", ("GNU_FREE", "GNU_HOPE", "GNU_SEE", "GNU_COPY")),
    ("{gnu}-{version}", ("GNU_FREE", "GNU_HOPE", "GNU_SEE")),
    ("{gnu}-{version}", ("GNU_FREE",)),
    ("MPL-2.0", ("MPL2_SUBJECT", "MPL2_COPY")),
    ("MPL-2.0", ("MPL2_SUBJECT",)),
    ("EPL-{version}", ("EPL_HEAD",)),
    ("Apache-2.0", ("APACHE2_HEAD",)),
    ("CC0-1.0", ("CC0_WAIVED",)),
    ("CC0-1.0", ("PUBLIC_DOMAIN",)),
    ("Unlicense", ("UNLICENSE",)),
    ("WTFPL", ("WTFPL",)),
    ("{spdx}", ("SPDX",)),
    ("{spdx}", ("UNDER",)),
)
#: Identifiers that stand between the sentences of a licence without belonging to it.
NEUTRAL = frozenset({"COPYRIGHT"})

_COMPILED = tuple((k, re.compile(p, re.S)) for k, p in SENTENCES)
_KEY = re.compile("|".join(KEYWORDS), re.I)
_CUT = re.compile(r"(?<=[.!?])(?<! v\.)\s+|(?<=:)\s*\n\s*")
_MARKS = re.compile(r"^[\s/#*;!>-]+|[\s*/]+$")
_DROP = re.compile(r"[\"'`“”‘’«»/:=()]+|--+")
_SPACE = re.compile(r"\s+")
_EXPRESSION = re.compile(r"SPDX-License-Identifier:?\s*(\(*[A-Za-z0-9.+\-]+\)*(?:\s+(?:AND|OR|WITH)\s+\(*[A-Za-z0-9.+\-]+\)*)*)", re.I)
_KNOWN = {n.lower(): n for n in [*(n for n, _ in NAMES), *(f"{g}-{v}-{w}" for g in ("GPL", "LGPL", "AGPL", "GFDL") for v in ("1.0", "2.0", "2.1", "3.0", "1.1", "1.2", "1.3") for w in ("only", "or-later"))]}


def normalise(sentence: str) -> str:
    """Lower case, without comment marks, quotes and final punctuation, single spaces."""
    s = _MARKS.sub("", sentence).lower()
    s = _SPACE.sub(" ", _DROP.sub(" ", s).replace(";", ",")).strip()
    return re.sub(r" ?,", ",", s).rstrip(".,!? ")


def _gnu(name: str, version: str, later: bool) -> str:
    version = version if "." in version else f"{version}.0"
    return f"{GNU[name]}-{version}-{'or-later' if later else 'only'}"


def _cc(name: str, version: str) -> str:
    name = re.sub(r"[- ]works$", "", name).replace(" ", "-")
    for long, short in (("attribution", "by"), ("non-commercial", "nc"), ("noncommercial", "nc"), ("share-alike", "sa"), ("sharealike", "sa")):
        name = name.replace(long, short)
    return f"CC-{re.sub(r'no-?deriv(?:ative)?s?', 'nd', name).upper()}-{version}"


def named_licence(sentence: str) -> str | None:
    """The licence that a normalised sentence puts something under; none if it denies that."""
    for m in _UNDER.finditer(sentence):
        if _DENIED.search(sentence[: m.start()]):
            continue
        g = m.groupdict()
        if g["cc"]:
            return _cc(g["cc"], g["cc_version"])
        if g["gnu"] or g["abbreviated"]:
            version = g["gnu_version"] or g["short_version"] or g["before"]
            if version is None:
                found = re.search(r"(?:version |v\.? ?)([123](?:\.\d)?)\b", sentence[m.end() :])
                version = found[1] if found else None
            if version is None:
                continue
            later = bool(g["later"] or g["short_later"]) or bool(re.search(r"\bor (?:at your option,? )?(?:any )?later\b", sentence[m.end() :]))
            return _gnu(g["gnu"] or g["abbreviated"], version, later)
        return next(n for i, (n, _) in enumerate(NAMES) if g[f"n{i}"])
    return None


def _expression(sentence: str) -> str | None:
    """The SPDX expression of a sentence, its identifiers as they are registered."""
    m = _EXPRESSION.search(sentence)
    if not m:
        return None
    words = re.sub(r"([()])", r" \1 ", m[1].rstrip(".")).split()
    out = " ".join(w.upper() if w.lower() in ("and", "or", "with") else _KNOWN.get(w.lower(), w) for w in words)
    return out.replace("( ", "(").replace(" )", ")")


def identify(sentence: str) -> tuple[str, dict] | None:
    """The known licence sentence that this one is."""
    if not _KEY.search(sentence):
        return None
    s = normalise(sentence)
    for k, p in _COMPILED:
        if k == "UNDER":  # by the phrase, wherever it stands
            if (name := named_licence(s)) is not None:
                return k, {"spdx": name}
            continue
        if m := p.fullmatch(s):
            if k == "SPDX":
                name = _expression(sentence)
                if name is None:
                    continue
                return k, {"spdx": name}
            if k == "PUBLIC_DOMAIN" and re.search(r"\b(?:not|never|no longer|t) (?:\w+ ){0,2}(?:dedicated|released|placed|put)\b", s):
                continue
            names = {n: v for n, v in m.groupdict().items() if v}
            if k == "GNU_FREE":
                whole = _gnu(names["gnu"], names.get("version") or names["only"], "version" in names)
                names = dict(zip(("gnu", "version"), whole.split("-", 1), strict=True))
            return k, names
    return None


def _sentences(text: str):
    """(offset, sentence) of each line's sentences, and of each paragraph's with its lines joined."""
    at, paragraph = 0, []
    for line in [*text.split("\n"), ""]:
        bare = _MARKS.sub("", line)
        if bare:
            paragraph.append((at, line))
            for s in _cut(line):
                yield at + s[0], s[1]
        elif paragraph:
            if len(paragraph) > 1:
                joined = "\n".join(x for _, x in paragraph)
                cleaned = "\n".join(_MARKS.sub(lambda m: " " * len(m[0]), x) for x in joined.split("\n"))
                for s in _cut(cleaned):
                    if "\n" in s[1].strip():
                        yield paragraph[0][0] + s[0], s[1]
            paragraph = []
        at += len(line) + 1


def _cut(s: str):
    at = 0
    for m in _CUT.finditer(s):
        yield at, s[at : m.start()]
        at = m.end()
    if at < len(s):
        yield at, s[at:]


def scan(text: str | None) -> tuple[list[str], list[str], list[str]]:
    """(licences, sentence identifiers, identifiers that no rule used), each in text order."""
    if not text or not _KEY.search(text):
        return [], [], []
    hits = {(at, -at - len(s), hit[0], tuple(sorted(hit[1].items()))) for at, s in _sentences(text) if (hit := identify(s))}
    found, end = [], 0
    for at, neg_end, k, names in sorted(hits):  # a line's sentence inside a known longer one is part of that
        if -neg_end > end:
            found.append((k, dict(names)))
            end = -neg_end
    every = [k for k, _ in found]
    ids = [x for x in found if x[0] not in NEUTRAL]
    licences, unmatched, i = [], [], 0
    while i < len(ids):
        for name, rule in RULES:
            part = ids[i : i + len(rule)]
            if tuple(k for k, _ in part) == rule:
                names = {n: v for _, d in part for n, v in d.items()}
                named = name.format(**names) if "{" in name else name
                if named not in licences:
                    licences.append(named)
                i += len(rule)
                break
        else:
            unmatched.append(ids[i][0])
            i += 1
    return licences, every, unmatched


def license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, licenses, sentence_ids, unmatched`` for every row of ``docs``."""

    def run(ids, texts):
        out = [scan(t) for t in texts]
        return ids, [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]

    return map_texts(docs, ["doc_id", "text"], run, "doc_id long, licenses array<string>, sentence_ids array<string>, unmatched array<string>")
