"""License scans by conditional compression.

The surroundings of every place that names a licence are the candidate blocks. Each is compressed alone and with each template
as a raw zstandard dictionary. A template that the block repeats makes it much smaller: templates are ranked by that
reduction, measured against what the template would save on itself. Every one above ``REDUCTION`` is confirmed by wording in the
wider surroundings: a word alignment of the template counts inserted, missing and changed words, template
fields such as a year or a holder match any words, and the words that tell a licence from its relatives must be there exactly.
Confirmed notices are blanked and the places left are ranked again, until nothing more is confirmed.

A text is cut at the gaps between naming places that are wider than a notice may reach, so each part is judged as it would be in
the whole text, and the work grows with the text's length. Cases: a null or blank text has no blocks; repeated rows repeat their findings; of notices that overlap, the one stays that has the
most words, each difference taken off three times, then the earlier one; texts of any length are scanned whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import table

#: Characters before and after a naming place that its candidate block holds.
BEFORE, AFTER = 300, 600
#: Characters on either side of a naming place in which a notice may lie, above the longest template's.
REACH = 2000
#: Share of a template's own saving that a block must show; share of its words that may differ.
REDUCTION, DIFFERENCES = 0.25, 0.1
KEY = r"(?i)licen[cs]|copyright|copyleft|spdx|permission is (?:hereby|granted)|permission to use, copy|redistribution and use|all rights reserved|public domain|creative commons|\bcc[ -]by|\bcc0\b|subject to the terms|unencumbered"

#: Public licence texts and notices; {} stands for up to eight words of any kind.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "Copyright {} All rights reserved."),
    ("Proprietary", "All rights reserved."),
)
FIELD, FIELD_WORDS = "{}", 8


def words_at(text: str) -> tuple[list[str], list[int]]:
    """Words in lower case without marks at their ends, and where each starts."""
    out, at = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        w = m[0].lower().strip("()[]\"'.,;:*#/")
        if w:
            out.append(w)
            at.append(m.start())
    return out, at


@dataclass
class Template:
    name: str
    text: str
    words: list[str]
    telling: frozenset[str]
    dictionary: zstandard.ZstdCompressor
    saving: int


def prepare(templates=TEMPLATES) -> tuple[list[Template], zstandard.ZstdCompressor]:
    """Compressors by template. A template's telling words are those that the nearest of other names lack."""
    bare, out = zstandard.ZstdCompressor(level=6, write_content_size=False), []
    split = [[FIELD if w == FIELD else w for w in (words_at(t)[0] if FIELD not in t else sum(([*words_at(p)[0], FIELD] for p in t.split(FIELD)), [])[:-1])] for _, t in templates]
    for i, (name, text) in enumerate(templates):
        mine = set(split[i]) - {FIELD}
        near = [mine - set(split[j]) for j, (other, _) in enumerate(templates) if other != name and len(mine & set(split[j])) * 2 >= len(mine)]
        plain = text.replace(FIELD, "")
        with_it = zstandard.ZstdCompressor(level=6, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(plain.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        saving = len(bare.compress(plain.encode())) - len(with_it.compress(plain.encode()))
        out.append(Template(name, text, split[i], frozenset().union(*near), with_it, max(1, saving)))
    return out, bare


def align(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """Fewest word differences of the template to any run of the block's words: (differences, first word, words)."""
    n = len(block)
    ids: dict[str, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in block], np.int64)
    cost, start, place = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for w in template:
        if w == FIELD:
            best, from_ = cost.copy(), start.copy()
            for k in range(1, FIELD_WORDS + 1):
                if k > n:
                    break
                better = cost[:-k] < best[k:]
                best[k:], from_[k:] = np.where(better, cost[:-k], best[k:]), np.where(better, start[:-k], from_[k:])
            cost, start = best, from_
            continue
        new, from_ = cost + 1, start.copy()
        swap = cost[:-1] + (code != ids.get(w, -1))
        better = swap <= new[1:]
        new[1:], from_[1:] = np.where(better, swap, new[1:]), np.where(better, start[:-1], from_[1:])
        low = np.minimum.accumulate(new - place)
        source = np.maximum.accumulate(np.where(new - place == low, place, 0))
        cost, start = low + place, from_[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end - int(start[end])


def notices(template: Template, words: list[str], low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(first word, words, differences) of each place between ``low`` and ``high`` where the template stands: the best
    one, then those before and after it."""
    if high <= low:
        return
    d, s, n = align(template.words, words[low:high])
    if d > DIFFERENCES * len(template.words) or not n:
        return
    if template.telling <= set(words[low + s : low + s + n]):
        yield low + s, n, d
    yield from notices(template, words, low, low + s)
    yield from notices(template, words, low + s + n, high)


def findings(text: str, ready: tuple[list[Template], zstandard.ZstdCompressor]) -> list[tuple[str, int, int, int, float]]:
    """(licence, first character, characters, differing words, reduction) of each notice in a text."""
    templates, bare = ready
    places, out = [m.span() for m in re.finditer(KEY, text)], []
    while places:
        regions: list = []  # first and last character of surroundings that touch, best reduction by template
        for a, b in places:
            low, high = max(0, a - REACH), b + REACH
            raw = text[max(0, a - BEFORE) : b + AFTER].encode()
            alone = len(bare.compress(raw))
            gain = {i: (alone - len(t.dictionary.compress(raw))) / t.saving for i, t in enumerate(templates)}
            if not regions or low > regions[-1][1]:
                regions.append([low, high, {}])
            regions[-1][1] = high
            for i, g in gain.items():
                if g >= REDUCTION:
                    regions[-1][2][i] = max(g, regions[-1][2].get(i, g))
        new: list = []
        for low, high, ranked in regions:
            words, at = words_at(text[low:high])
            found = []
            for i in sorted(ranked, key=lambda i: (-ranked[i], i)):
                t = templates[i]
                for s, n, d in notices(t, words, 0, len(words)):
                    end = at[s + n - 1] + len(words[s + n - 1])
                    found.append((3 * d - len(t.words), d, low + at[s], t.name, end - at[s], round(ranked[i], 4)))
            for _, d, first, name, chars, gain in sorted(found):
                if all(first >= f + c or first + chars <= f for _, f, c, _, _ in new):
                    new.append((name, first, chars, d, gain))
        if not new:
            break
        out += new
        left, at = [], 0
        for first, chars in sorted((first, chars) for _, first, chars, _, _ in new):
            left += [text[at:first], " " * chars]
            at = first + chars
        text = "".join([*left, text[at:]])
        places = [m.span() for m in re.finditer(KEY, text)]
    return out


def parts(text: str) -> Iterator[tuple[int, str]]:
    """(first character, part) of a text's parts around its naming places; no notice reaches from one into another."""
    low = high = None
    for m in re.finditer(KEY, text):
        a, b = max(0, m.start() - REACH), m.end() + REACH
        if low is None:
            low, high = a, b
        elif a > high:
            yield low, text[low:high]
            low, high = a, b
        else:
            high = b
    if low is not None:
        yield low, text[low:high]


def scan_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas over (doc_id, text): every notice."""
    ready = prepare()
    for batch in batches:
        rows = [(d, low + x[1], *x[:1], *x[2:]) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for low, part in parts(text) for x in findings(part, ready)]
        yield pd.DataFrame(rows, columns=["doc_id", "at", "license", "chars", "differences", "reduction"]).astype({"doc_id": "Int64"})


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, at, chars, differences, reduction): every notice, ``at`` its first character from 0."""
    named = docs.select("doc_id", "text").filter(F.col("text").rlike(KEY))
    found = named.mapInPandas(scan_texts, "doc_id long, at long, license string, chars long, differences long, reduction double")
    return found.select("doc_id", "license", "at", "chars", "differences", "reduction")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
