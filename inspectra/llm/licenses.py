"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams. DataFrame functions only.

1. Anchors: a text that reaches the threshold t against a template holds at least t / (2 - t) of the template's distinct
   bigrams, so it holds one of any |T| - ceil(t |T| / (2 - t)) + 1 of them; the longest ones are chosen. One pattern of all
   anchors tells texts without any from the rest, and no match is lost.
2. Texts with anchors are lower-cased, all but letters and digits become single spaces, and their segments - the whole
   text, paragraphs (blank lines between) and lines - are compared with the templates whose size is within the bounds
   t / (2 - t) <= |segment| / |template| <= (2 - t) / t. A segment counts for its most similar template.
3. Windows: each anchor found in the text tells where its template would begin; the window as long as the template from
   there is compared with it. So licences of several paragraphs and notices within a sentence are found in any document.
   The best window of a template counts unless it overlaps a better one of another template.

Everything happens within a row: nothing is shuffled and a hot source costs nothing extra.

Defined cases: null, empty or one-word texts match nothing; ties go to the smaller name; repeated rows are scanned row by
row; an empty table gives an empty table; without templates nothing matches; all columns of the input stay, result
columns replace those of the same name, and no other name is taken.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

THRESHOLD = 0.8
# Names and texts of licence notices and short licences.
TEMPLATES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
Templates = tuple[tuple[str, str], ...]
#: What parts two words, in lower-cased and in normalised text.
BETWEEN = r"[^\p{L}\p{N}]"


def template_words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return re.findall(r"[^\W_]+", text.lower())


class Known:
    """What is known of the templates before any text is read: bigrams in order, distinct ones, anchors."""

    def __init__(self, templates: Templates, threshold: float):
        self.rows: list[tuple[str, int, list[str]]] = []  # name, bigrams of the whole text, distinct ones
        self.anchors: dict[str, list[tuple[int, int]]] = defaultdict(list)  # bigram: (template, place in it)
        for name, text in templates:
            w = template_words(text)
            every = [f"{a} {b}" for a, b in zip(w, w[1:])]
            pairs = list(dict.fromkeys(every))
            if not pairs:
                continue
            least = math.ceil(threshold * len(pairs) / (2 - threshold) - 1e-9)
            for p in sorted(pairs, key=lambda p: (-len(p), p))[: len(pairs) - least + 1]:
                self.anchors[p].append((len(self.rows), every.index(p)))
            self.rows.append((name, len(every), pairs))

    def pattern(self) -> str:
        """Finds an anchor in lower-cased text; branches by first letter, then first word."""
        tree: dict[str, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
        for p in self.anchors:
            a, b = p.split(" ")
            tree[a[0]][a[1:]].add(b)
        words = lambda of: "|".join(f"{a}{BETWEEN}++(?:{'|'.join(sorted(b))})" for a, b in sorted(of.items()))
        starts = "".join(sorted(tree))
        letters = "|".join(f"{c}(?:{words(of)})" for c, of in sorted(tree.items()))
        return rf"(?=[{starts}])(?<![\p{{L}}\p{{N}}])(?:{letters})(?![\p{{L}}\p{{N}}])"

    def column(self) -> Column:
        """array of (name, n, pairs), one constant."""
        literal = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        quoted = lambda values: ", ".join(map(literal, values))
        return F.expr("array(" + ", ".join(f"named_struct('name', {quoted([name])}, 'n', {n}, 'pairs', array({quoted(pairs)}))" for name, n, pairs in self.rows) + ")")

    def index(self) -> Column:
        """map of anchor to an array of (t, place), one constant."""
        places = lambda at: ", ".join(f"named_struct('t', {t}, 'place', {k})" for t, k in at)
        return F.expr("map(" + ", ".join(f"'{p}', array({places(at)})" for p, at in self.anchors.items()) + ")")


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalized(lowered: Column) -> Column:
    """Runs of anything but letters, digits and line ends become one space."""
    return F.regexp_replace(lowered, r"[^\p{L}\p{N}\n]+", " ")


def segments(text: Column) -> Column:
    """The distinct whole text, paragraphs and lines of a normalised text."""
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n(?: *\n)+"), F.split(text, r"\n")))


def bigrams(segment: Column) -> Column:
    """The pairs of neighbouring words in order, with one space between."""

    def paired(w: Column) -> Column:
        many = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, many), F.slice(w, 2, many), lambda a, b: F.concat(a, F.lit(" "), b))

    return bound(F.array_remove(F.split(segment, r"[ \n]+"), ""), paired)


def dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def of_segments(norm: Column, known: Column, pattern: str, t: float) -> Column:
    """(minus dice, name) of the best template of each segment that has one."""

    def best(pairs: Column) -> Column:
        n = F.size(pairs)
        fit = F.filter(known, lambda x: (n >= t / (2 - t) * F.size(x["pairs"])) & (n <= (2 - t) / t * F.size(x["pairs"])))
        rated = F.transform(fit, lambda x: F.struct((-dice(pairs, x["pairs"])).alias("minus"), x["name"].alias("name")))
        return F.array_min(F.filter(rated, lambda x: x["minus"] <= -t))

    some = F.filter(segments(norm), lambda s: s.rlike(pattern))
    distinct = F.transform(some, lambda s: F.array_distinct(bigrams(s)))
    return F.filter(F.transform(distinct, best), lambda x: x.isNotNull())


def of_windows(norm: Column, known: Column, index: Column, anchors: list[str], t: float) -> Column:
    """(minus dice, name) of each template's best window that no better one of another template overlaps."""

    def over(every: Column) -> Column:
        hits = F.filter(F.transform(every, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda h: h["p"].isin(anchors))
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["p"]), lambda a: F.struct(a["t"].alias("t"), F.greatest(h["i"] - a["place"], F.lit(0)).alias("at"))))))

        def rated(s: Column) -> Column:
            x = F.element_at(known, s["t"] + 1)
            minus = bound(F.array_distinct(F.slice(every, s["at"] + 1, x["n"])), lambda window: -dice(window, x["pairs"]))
            return F.struct(minus.alias("minus"), x["name"].alias("name"), s["t"].alias("t"), s["at"].alias("at"), (s["at"] + x["n"]).alias("end"))

        good = F.filter(F.transform(starts, rated), lambda x: x["minus"] <= -t)
        none = F.lit(None).cast("struct<minus: double, name: string, t: int, at: int, end: int>")
        firsts = lambda all_: F.filter(F.transform(F.array_distinct(F.transform(all_, lambda x: x["t"])), lambda k: F.coalesce(F.array_min(F.filter(all_, lambda y: y["t"] == k)), none)), lambda x: x.isNotNull())
        clear = lambda each: F.filter(each, lambda x: ~F.exists(each, lambda y: (y["at"] < x["end"]) & (x["at"] < y["end"]) & (y < x)))
        return bound(good, lambda g: bound(firsts(g), clear))

    found = bound(bigrams(norm), over)
    return F.transform(found, lambda x: F.struct(x["minus"].alias("minus"), x["name"].alias("name")))


def scan(docs: DataFrame, text: str = "text", templates: Templates = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with license and dice (of the most similar match), n_matches (segments and windows) and licenses (names, sorted, distinct)."""
    known = Known(templates, threshold)
    lowered, found = F.lower(F.coalesce(F.col(text), F.lit(""))), unused(docs, "found")
    nothing = F.array().cast("array<struct<minus: double, name: string>>")
    if known.rows:
        pattern, rows = known.pattern(), known.column()
        matched = lambda norm: F.concat(of_segments(norm, rows, pattern, threshold), of_windows(norm, rows, known.index(), list(known.anchors), threshold))
        matches = F.when(lowered.rlike(pattern), bound(normalized(lowered), matched)).otherwise(nothing)
    else:
        matches = nothing
    top = F.array_min(found)
    added = {
        "license": top["name"], "dice": F.round(-top["minus"], 6), "n_matches": F.size(found).cast("long"),
        "licenses": F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["name"]))), ","),
    }
    ready = docs.withColumn(found, matches)
    return ready.select(*[c for c in docs.columns if c.lower() not in added], *[c.alias(k) for k, c in added.items()])
