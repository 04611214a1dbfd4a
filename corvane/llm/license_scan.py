"""Licence scan: normalised sentences are mapped to identifiers, then identifier sequences to licences.

A sentence is lower-cased and reduced to words of letters, digits, plus signs
and full stops inside words; it ends with .!?;: before white space, before a
URL, or with a line, and one that a line cuts off may go on in the next.  Known
sentences have an identifier; a rule is an ordered sequence of identifiers that
must follow each other among a document's known sentences with few other words
between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.textkit import batches_of

#: Words of no known sentence that may stand between two sentences of a rule: a copyright line, an address, a comment.
GAP = 40


def _named(name: str, short: str = "") -> tuple[str, ...]:
    """The usual ways to name a licence in a sentence of its own."""
    names = [name, *([short] if short else [])]
    subjects = ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ", "This document is ", "The code is ", "The content is ")
    verbs = ("licensed under", "released under", "distributed under", "available under", "made available under")
    return tuple(f"{subject}{verb} {the}{n}" for n in names for the in ("", "the ", "the terms of the ", "a ") for subject in subjects for verb in verbs)


# Known sentences of licences and notices, by identifier.
SENTENCES = {
    "mit-title": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "mit-by-name": _named("MIT License", "MIT"),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-warranty": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',),
    "apache-title": ("Apache License Version 2.0, January 2004", "Apache License, Version 2.0"),
    "apache-by-name": (*_named("Apache License, Version 2.0", "Apache 2.0 License"), *_named("Apache License 2.0", "Apache-2.0 License"), *_named("Apache-2.0"), 'Licensed under the Apache License, Version 2.0 (the "License");'),
    "apache-compliance": ("you may not use this file except in compliance with the License.",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "apache-url": ("http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"),
    "apache-warranty": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',),
    "free-program": ("This program is free software:", "This library is free software;", "This file is free software;", "This is free software:"),
    "gpl3-by-name": (*_named("GNU General Public License, version 3", "GPL, version 3"), *_named("GNU General Public License v3.0", "GPLv3"), *_named("GPL-3.0")),
    "gpl2-by-name": (*_named("GNU General Public License, version 2", "GPL, version 2"), *_named("GNU General Public License v2.0", "GPLv2"), *_named("GPL-2.0")),
    "gpl3-later": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl3-only": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    "gpl2-terms": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",),
    "version2-later": ("either version 2 of the License, or (at your option) any later version.",),
    "gpl2-later": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",),
    "gpl2-only": ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",),
    "agpl3-by-name": (*_named("GNU Affero General Public License, version 3", "AGPLv3"), *_named("GNU Affero General Public License v3.0", "AGPL-3.0")),
    "agpl3-later": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "lgpl3-by-name": (*_named("GNU Lesser General Public License, version 3", "LGPLv3"), *_named("GNU Lesser General Public License v3.0", "LGPL-3.0")),
    "lgpl21-by-name": (*_named("GNU Lesser General Public License, version 2.1", "LGPLv2.1"), *_named("GNU Lesser General Public License v2.1", "LGPL-2.1")),
    "lgpl3-later": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "lgpl-terms": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",),
    "version21-later": ("either version 2.1 of the License, or (at your option) any later version.",),
    "fsf-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    "fsf-implied": ("without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "mpl2-by-name": (*_named("Mozilla Public License, version 2.0", "MPL 2.0"), *_named("Mozilla Public License 2.0", "MPL-2.0")),
    "mpl2-terms": ("This Source Code Form is subject to the terms of the Mozilla Public License, v.", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    "mpl2-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at", "If a copy of the MPL was not distributed with this file, you can obtain one at"),
    "isc-title": ("ISC License", "The ISC License"),
    "isc-by-name": _named("ISC License", "ISC"),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "unlicense-release": ("This is free and unencumbered software released into the public domain.",),
    "unlicense-free": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "bsl-title": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0"),
    "bsl-by-name": (*_named("Boost Software License, Version 1.0", "BSL-1.0"), "Distributed under the Boost Software License, Version 1.0."),
    "artistic2-by-name": _named("Artistic License 2.0", "Artistic-2.0"),
    "artistic2-title": ("The Artistic License 2.0",),
    "epl2-by-name": (*_named("Eclipse Public License 2.0", "EPL-2.0"), "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "zlib-warranty": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "wtfpl": ("Do What The Fuck You Want To Public License",),
    "cc0": (*_named("CC0 1.0", "Creative Commons Zero"), "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    "cc-by": (*_named("CC BY 4.0", "Creative Commons Attribution 4.0 International License"), *_named("CC-BY-4.0")),
    "cc-by-sa": (*_named("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"), *_named("CC-BY-SA-4.0")),
    "cc-by-nc": (*_named("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"), *_named("CC-BY-NC-4.0")),
    "cc-by-nd": (*_named("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"), *_named("CC-BY-ND-4.0")),
    "cc-by-nc-sa": (*_named("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), *_named("CC-BY-NC-SA-4.0")),
    "bsd3-by-name": _named("BSD 3-Clause License", "BSD-3-Clause License"),
    "bsd2-by-name": _named("BSD 2-Clause License", "BSD-2-Clause License"),
    "bsd-redistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-endorsement": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-warranty": ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',),
    "reserved": ("All rights reserved.",),
}
# A licence's rules, each an ordered sequence of identifiers.
RULES = {
    "MIT": (("mit-title", "mit-grant", "mit-notice", "mit-warranty"), ("mit-grant", "mit-notice", "mit-warranty"), ("mit-title", "mit-grant", "mit-notice"), ("mit-grant", "mit-notice"), ("mit-title", "mit-grant"), ("mit-by-name",)),
    "Apache-2.0": (("apache-by-name", "apache-compliance", "apache-copy", "apache-url", "apache-warranty"), ("apache-by-name", "apache-compliance", "apache-copy", "apache-warranty"), ("apache-by-name", "apache-compliance"), ("apache-by-name",), ("apache-compliance", "apache-copy", "apache-url")),
    "GPL-3.0-or-later": (("free-program", "gpl3-later", "fsf-hope", "fsf-implied"), ("free-program", "gpl3-later"), ("gpl3-later",)),
    "GPL-3.0-only": (("free-program", "gpl3-only"), ("gpl3-by-name",)),
    "GPL-2.0-or-later": (("free-program", "gpl2-terms", "version2-later", "fsf-hope", "fsf-implied"), ("free-program", "gpl2-terms", "version2-later"), ("gpl2-terms", "version2-later"), ("gpl2-later",)),
    "GPL-2.0-only": (("free-program", "gpl2-only"), ("gpl2-by-name",)),
    "AGPL-3.0-or-later": (("free-program", "agpl3-later"), ("agpl3-later",)),
    "AGPL-3.0-only": (("agpl3-by-name",),),
    "LGPL-3.0-or-later": (("free-program", "lgpl3-later"), ("lgpl3-later",)),
    "LGPL-3.0-only": (("lgpl3-by-name",),),
    "LGPL-2.1-or-later": (("free-program", "lgpl-terms", "version21-later"), ("lgpl-terms", "version21-later")),
    "LGPL-2.1-only": (("lgpl21-by-name",),),
    "MPL-2.0": (("mpl2-terms", "mpl2-copy"), ("mpl2-terms",), ("mpl2-by-name",)),
    "ISC": (("isc-title", "isc-grant"), ("isc-grant",), ("isc-by-name",)),
    "0BSD": (("0bsd-grant",),),
    "Unlicense": (("unlicense-release", "unlicense-free"), ("unlicense-release",)),
    "BSL-1.0": (("bsl-by-name",), ("bsl-title",)),
    "Artistic-2.0": (("artistic2-by-name",), ("artistic2-title",)),
    "EPL-2.0": (("epl2-by-name",),),
    "Zlib": (("zlib-warranty", "zlib-grant"), ("zlib-grant",)),
    "WTFPL": (("wtfpl",),),
    "CC0-1.0": (("cc0",),),
    "CC-BY-4.0": (("cc-by",),),
    "CC-BY-SA-4.0": (("cc-by-sa",),),
    "CC-BY-NC-4.0": (("cc-by-nc",),),
    "CC-BY-ND-4.0": (("cc-by-nd",),),
    "CC-BY-NC-SA-4.0": (("cc-by-nc-sa",),),
    "BSD-3-Clause": (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement", "bsd-warranty"), ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement"), ("bsd-redistribution", "bsd-endorsement"), ("bsd3-by-name",)),
    "BSD-2-Clause": (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty"), ("bsd-redistribution", "bsd-source", "bsd-binary"), ("bsd-redistribution",), ("bsd2-by-name",)),
    "proprietary": (("reserved",),),
}

_END = re.compile(r"(?<=[.!?;:])[ \t\r]+|[ \t\r]+(?=https?://)")
_WORD = re.compile(r"[a-z0-9+]+(?:\.[a-z0-9]+)*")


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def pieces(text: str) -> Iterator[tuple[str, bool, int]]:
    """The normalised parts of a text that no sentence end or line end cuts: (part, whether a sentence ends with it, words before it).

    Blank lines end what stands before them, and give an empty part.
    """
    words = 0
    for line in text.split("\n"):
        parts = [(p, n) for p in _END.split(line) if (n := normalised(p))]
        if not parts:
            yield "", True, words
        for at, (part, norm) in enumerate(parts):
            yield norm, at + 1 < len(parts) or part.rstrip()[-1:] in (".", "!", "?", ";", ":"), words
            words += norm.count(" ") + 1


def sentence_ids(text: str, known: dict[str, str], longest: int, firsts: frozenset[str]) -> list[tuple[str, int, int]]:
    """(identifier, first word, word after) of the known sentences of a text, in order."""
    out: list[tuple[str, int, int]] = []
    open_: list[tuple[str, int]] = []  # unfinished sentences, from the longest, and their first words
    for norm, ended, at in pieces(text):
        if not norm:
            open_ = []
            continue
        here = [(f"{start} {norm}", first) for start, first in open_] + [(norm, at)]
        found = next(((known[x], first) for x, first in here if x in known), None)
        if found:
            out.append((*found, at + norm.count(" ") + 1))
        open_ = [] if ended or found else [(x, first) for x, first in here if len(x) < longest and x.split(" ", 1)[0] in firsts]
    return out


def matched_rules(ids: list[tuple[str, int, int]], rules: dict[str, tuple[tuple[str, ...], ...]], gap: int = GAP) -> list[tuple[str, int]]:
    """(licence, length of its rule) for each run of identifiers that a rule names; longer rules take theirs first.

    Neighbours in a run have at most `gap` words of no known sentence between them.
    """
    names = [x[0] for x in ids]
    near = [b[1] - a[2] <= gap for a, b in zip(ids, ids[1:], strict=False)]
    taken, found = [False] * len(ids), []
    for licence, rule in sorted(((name, rule) for name, own in rules.items() for rule in own if rule[0] in names), key=lambda x: -len(x[1])):
        for at in range(len(ids) - len(rule) + 1):
            if tuple(names[at : at + len(rule)]) == rule and all(near[at : at + len(rule) - 1]) and not any(taken[at : at + len(rule)]):
                taken[at : at + len(rule)] = [True] * len(rule)
                found.append((at, licence, len(rule)))
    return [(licence, n) for _, licence, n in sorted(found)]


def _scan(sentences: dict[str, tuple[str, ...]], rules: dict, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {normalised(s): name for name, own in sentences.items() for s in own}
        longest, firsts = max(map(len, known), default=0), frozenset(s.split(" ", 1)[0] for s in known)
        for batch in batches:
            ids = [sentence_ids(text or "", known, longest, firsts) for text in batch.column(1).to_pylist()]
            hits = [matched_rules(own, rules, gap) for own in ids]
            names = [sorted({licence for licence, _ in own}) for own in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[x[0] for x in own] for own in ids], pa.list_(pa.string())), pa.array([len(h) for h in hits], pa.int64()), pa.array(names, pa.list_(pa.string()))], names=["id", "sentence_ids", "n_rules", "licences"])

    return run


def license_scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sentences: dict = SENTENCES, rules: dict = RULES, gap: int = GAP) -> DataFrame:
    """One row for each document: key, sentence_ids (in order), n_rules (matches) and licences (distinct, sorted).

    A null or empty text has none; repeated rows and null keys get a row each; an
    empty table gives none; other columns are not read, so that their names can't
    clash.  Texts are read whole, whatever their length.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    return batches_of(rows, _scan(sentences, rules, gap), f"id {kind}, sentence_ids array<string>, n_rules bigint, licences array<string>").withColumnRenamed("id", key)
