"""Licence scan: sparse TF-IDF cosine of passages to licence templates, then inheritance along paths.

Passages are lines, paragraphs, comment blocks, and the whole text of a file with the name of a
licence file. A licence has templates for notices, SPDX lines, headers and its text (of long
licences the title with what follows it), and rules on the words that tell it from its neighbours, such as
version, NC, SA, Affero or the number of clauses. A file's own licence is that of its best passage. A file without one inherits from the nearest ancestor directory that holds a
licence file, found by joins on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.session import materialise

_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} "
    "along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_END = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_END = (
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
    "under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
#: Notices, headers and texts of common licences, as their authors ask to write them.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License, Version 2.0", _APACHE, _APACHE + _APACHE_END,
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", _MIT, _MIT + _MIT_END],
    "ISC": ["Released under the ISC License.", "ISC License", _ISC, _ISC + _ISC_END],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD, _BSD + _BSD_END, "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the conditions of the BSD 2-Clause License are met."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", _BSD + _BSD_THIRD, _BSD + _BSD_THIRD + _BSD_END, "Redistribution and use in source and "
                     "binary forms, with or without modification, are permitted provided that the conditions of the BSD 3-Clause License are met."],
    "MPL-2.0": [_MPL, "Mozilla Public License Version 2.0", _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright to this work under CC0 1.0.", "CC0 1.0 Universal",
                "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: Patterns, over the terms of a passage joined by blanks, that a licence asks for and those that rule it out.
RULES: dict[str, tuple[list[str], str | None]] = {
    "Apache-2.0": ([r"\bapache\b", r"\b(v?2\.0|v?2)\b"], None),
    "MIT": ([r"\bmit licen[cs]e\b|licen[cs]ed? (under )?(the )?mit\b|identifier mit\b|\bdeal in the software\b"], None),
    "ISC": ([r"\bisc licen[cs]e\b|licen[cs]ed? (under )?(the )?isc\b|identifier isc\b|\bpermission notice appear in all copies\b"], r"\bdeal in the software\b"),
    "BSD-2-Clause": ([r"\bbsd (2|two)\b|\bredistributions in binary form\b"], r"\bendorse\b|\bbsd (3|4|three|four)\b|\badvertising materials\b"),
    "BSD-3-Clause": ([r"\bbsd (3|three)\b|\bendorse\b"], r"\bbsd (2|4|two|four)\b|\badvertising materials\b"),
    "MPL-2.0": ([r"\b(mozilla|mpl)\b", r"\bv?2(\.0)?\b"], None),
    "CC0-1.0": ([r"\bcc0\b|\bwaived all copyright\b"], None),
}


def _families() -> None:
    """Licences that differ in version or in a condition only."""
    gnu = (
        ("GPL", "GNU General Public License", ("2.0", "3.0"), r"\baffero\b|\blesser\b|\blibrary general\b|\b[al]gpl"),
        ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0"), r"\baffero\b|\bagpl"),
        ("AGPL", "GNU Affero General Public License", ("3.0",), r"\blesser\b|\blgpl"),
    )
    dates = {"GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}
    for short, full, versions, other in gnu:
        for version in versions:
            name, v = f"{short}-{version}", version.removesuffix(".0")
            first = "This {1} is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, "
            first += "either version {2} of the License, or (at your option) any later version. "
            first = first.format(full, "library" if short == "LGPL" else "program", v)
            TEMPLATES[name] = [
                f"This work is licensed under the {full}, version {v}.", f"{full} Version {v}", f"Licensed under the {short}v{v}.", f"Licensed under the {short} {version}.",
                f"This {'library' if short == 'LGPL' else 'program'} is free software under the terms of the {full}, version {v}.", first,
                first + _WARRANTY.format(full), f"{full} Version {v} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
                "verbatim copies of this license document, but changing it is not allowed.",
                f"SPDX-License-Identifier: {name}-only", f"SPDX-License-Identifier: {name}-or-later",
            ]
            TEMPLATES[name].append(f"{full} Version {v}, {dates[name]}")
            family = {"GPL": r"\bgeneral public\b|\bgpl", "LGPL": r"\blesser general\b|\blgpl", "AGPL": r"\baffero\b|\bagpl"}[short]
            number = re.escape(v) + (r"(\.0)?" if v != version else "")
            RULES[name] = ([family, rf"\bversion {number}(?![.\w])|\b{short.lower()} ?v? ?{number}(?![.\w])|\blicense (v ?)?{number}(?![.\w])"], other)
    kinds = {
        "BY": ("Attribution", set()), "BY-SA": ("Attribution-ShareAlike", {"sa"}), "BY-NC": ("Attribution-NonCommercial", {"nc"}), "BY-ND": ("Attribution-NoDerivatives", {"nd"}),
        "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike", {"nc", "sa"}), "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", {"nc", "nd"}),
    }
    words = {"nc": r"\bnc\b|\bnon ?commercial\b", "sa": r"\bsa\b|\bshare ?alike\b", "nd": r"\bnd\b|\bno ?deriv(ative)?s?\b"}
    for kind, (full, has) in kinds.items():
        for version in ("3.0", "4.0"):
            name = f"CC-{kind}-{version}"
            TEMPLATES[name] = [
                f"Licensed under CC {kind} {version}.", f"Creative Commons {full} {version} International", f"{full} {version} International",
                f"This work is licensed under a Creative Commons {full} {version} International License.",
            ]
            asked = [r"\bcc by\b|\battribution\b", rf"\b{re.escape(version)}(?![.\w])", *(words[w] for w in sorted(has))]
            RULES[name] = (asked, "|".join(words[w] for w in sorted(words.keys() - has)) or None)
    for name, texts in TEMPLATES.items():
        texts.append(f"SPDX-License-Identifier: {name}")


_families()
_TERM = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


_COMMENT = re.compile(r"\s*(?:#|//|/?\*|--|;|%|<!--)")


class Scanner:
    """Templates as sparse unit vectors, and the terms without which no passage can match."""

    def __init__(self, templates: dict[str, str | list[str]], least: float, rules: dict[str, tuple[list[str], str | None]] | None = None):
        texts = [(name, t) for name, given in sorted(templates.items()) for t in ([given] if isinstance(given, str) else given)]
        terms = [Counter(_TERM.findall(text.lower())) for _, text in texts]
        self._names = [name for name, _ in texts]
        self._rules = {n: ([re.compile(x) for x in asked], re.compile(never) if never else None) for n, (asked, never) in (rules or {}).items()}
        used = Counter(t for c in terms for t in c)
        self._rare = math.log(1 + len(terms)) + 1
        self._idf = {t: math.log((1 + len(terms)) / (1 + n)) + 1 for t, n in used.items()}
        self._least = least
        self._vectors: dict[str, list[tuple[int, float]]] = {}
        keys: set[str] = set()
        for at, counts in enumerate(terms):
            weights = {t: n * self._idf[t] for t, n in counts.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            # Shared terms of less than the asked share of a template's length cannot reach the asked cosine.
            spare = (least * norm) ** 2
            for t, w in sorted(weights.items(), key=lambda x: (-used[x[0]], x[1], x[0])):
                self._vectors.setdefault(t, []).append((at, w / norm))
                spare -= w * w
                if spare <= 0:
                    keys.add(t)
        self._keys = keys

    def _fits(self, name: str, joined: str) -> bool:
        if name not in self._rules:
            return True
        asked, never = self._rules[name]
        return all(x.search(joined) for x in asked) and not (never and never.search(joined))

    def match(self, passage: str) -> tuple[str, float] | None:
        """Best template whose licence fits, and cosine of one passage; ties go to the first name."""
        return self._match(_TERM.findall(passage.lower()))

    def _match(self, terms: list[str]) -> tuple[str, float] | None:
        if self._keys.isdisjoint(terms):
            return None
        dots: Counter = Counter()
        norm = 0.0
        for t, n in Counter(terms).items():
            w = n * self._idf.get(t, self._rare)
            norm += w * w
            for at, v in self._vectors.get(t, ()):
                dots[at] += w * v
        floor, joined, fits = (self._least - 1e-6) * math.sqrt(norm), " ".join(terms), {}
        for at, dot in sorted(dots.items(), key=lambda x: (-round(x[1], 9), self._names[x[0]])):
            if dot < floor:
                return None
            name = self._names[at]
            if name not in fits:
                fits[name] = self._fits(name, joined)
            if fits[name]:
                value = round(dot / math.sqrt(norm), 6)
                return (name, value) if value >= self._least else None
        return None

    def _passages(self, lines: list[list[str]], commented: list[bool]) -> Iterator[list[str]]:
        """Terms of lines, paragraphs and comment blocks that hold any of the needed terms."""
        keyed = [not self._keys.isdisjoint(x) for x in lines]
        if not any(keyed):
            return
        yield from (x for x, k in zip(lines, keyed) if k)
        for paragraphs in (True, False):
            # A paragraph ends at a line without words and where comment begins or ends, a comment block only at the latter.
            start = 0
            for i in range(len(lines) + 1):
                if i == len(lines) or i and commented[i] != commented[i - 1] or paragraphs and not lines[i]:
                    if i - start > 1 and (paragraphs or commented[start]) and any(keyed[start:i]):
                        yield [t for x in lines[start:i] for t in x]
                    start = i

    def scan(self, text: str | None, whole: bool) -> tuple[str | None, float]:
        """Best match among all passages, and the whole text where asked."""
        best: tuple[str | None, float] = (None, 0.0)
        if not text:
            return best
        raw = text.split("\n")
        lines = [_TERM.findall(x.lower()) for x in raw]
        passages = self._passages(lines, [bool(_COMMENT.match(x)) for x in raw])
        for terms in [*passages, *([[t for x in lines for t in x]] if whole else [])]:
            found = self._match(terms)
            if found and (found[1] > best[1] or found[1] == best[1] and found[0] < best[0]):
                best = found
        return best


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, str | list[str]] | None = None, least: float = 0.6, licence_names: str = r"(?i)^(licen[cs]e|copying)(\..*)?$") -> DataFrame:
    """path, own, similarity, licence, origin ('own', 'inherited' or null), inherited_from of every row of ``files`` (path, text).

    ``templates`` are texts by licence, without the rules that the fixed ones have.
    Null and empty texts have no own licence. A null path inherits nothing. Repeated
    paths are scanned row by row; if several licence files lie in one directory, the
    best match counts, then the first name. The root is the empty directory. Extra columns are ignored.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    rules = RULES if templates is None else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(chosen, least, rules)
        for batch in batches:
            found = [scanner.scan(t, bool(w)) for t, w in zip(batch["text"], batch["whole"])]
            yield pd.DataFrame({"path": batch["path"], "whole": batch["whole"], "own": [f[0] for f in found], "similarity": [f[1] for f in found]})

    named = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(licence_names), F.lit(False))
    scanned = files.select("path", "text", named.alias("whole")).mapInPandas(read, "path string, whole boolean, own string, similarity double")
    scanned = materialise(scanned)
    licensed = scanned.where("whole and own is not null and path is not null").groupBy(_folder(F.col("path")).alias("folder")).agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "own", "path")).alias("m")
    ).select("folder", F.col("m.own").alias("licence"), F.col("m.path").alias("source"))
    folders = scanned.where("own is null and path is not null").select(_folder(F.col("path")).alias("of")).distinct()
    depth = F.size(F.split("of", "/"))
    ancestors = folders.select("of", F.posexplode(F.concat(
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(F.split("of", "/"), 1, i), "/"))
    )).alias("depth", "folder"))
    nearest = ancestors.join(licensed, "folder").groupBy("of").agg(F.max(F.struct("depth", "licence", "source")).alias("m"))
    lent = nearest.select("of", F.col("m.licence").alias("lent"), F.col("m.source").alias("source"))
    rows = scanned.withColumn("of", F.when(F.col("own").isNull(), _folder(F.col("path")))).join(lent, "of", "left")
    own = F.col("own").isNotNull()
    return rows.select(
        "path", "own", "similarity", F.coalesce("own", "lent").alias("licence"),
        F.when(own, "own").when(F.col("lent").isNotNull(), "inherited").alias("origin"), F.when(~own, F.col("source")).alias("inherited_from"),
    )
