"""Licence notices in text, by the Dice coefficient of word bigrams against templates.

Every line and every paragraph of a text is normalised to words of a-z and 0-9 and becomes a set of word
bigrams. A set of n bigrams can only reach a coefficient t against a template of m bigrams if
``m t / (2 - t) <= n <= m (2 - t) / t``: the bounds pick the templates that are compared at all, after words that any match must hold have
picked the lines. Everything runs in DataFrame functions.

Nulls and odd rows: a null or empty text has no notice; rows that share an id (null too) are one document;
equal lines count each; an empty table gives an empty result; other columns are not read.
"""

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

LEAST = 0.7
#: Words taken last as marks of a template; this list changes the work, never the result.
COMMON = frozenset("a and any as at be by for from if in is it of on or that the this to was with you".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions:"
)
_MIT_TEXT = (
    f"{_MIT_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_3 = (
    f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Short forms, openings, whole paragraphs and notices, and whole texts of short public licences.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-conditions": _BSD_2,
    "bsd-2-text": f"{_BSD_2} {_BSD_DISCLAIMER}",
    "bsd-3-conditions": _BSD_3,
    "bsd-3-text": f"{_BSD_3} {_BSD_DISCLAIMER}",
    "bsd-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-long-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-long-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc-header": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": "Released under the MIT License.",
    "mit-grant": _MIT_GRANT,
    "mit-header": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-text": _MIT_TEXT,
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def bigrams_of(text: str) -> list[str]:
    """Sorted distinct word bigrams of a template."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def marker_words(known: list[tuple[str, list[str]]], least: float = LEAST) -> list[str]:
    """Words of which every text that reaches some template holds at least one.

    Such a text has at least c of a template's m bigrams, so it has one of any m - c + 1 of them, and so one of
    the words that cover these. Long words come first, as they are rare; words that hold another are left out.
    """
    chosen: list[str] = []
    for _, pairs in known:
        m = len(pairs)
        c = math.ceil(least * (m + math.ceil(m * least / (2 - least))) / 2 - 1e-9)
        left = {tuple(p.split(" ")) for p in pairs}
        words = sorted({w for p in left for w in p}, key=lambda w: (w in COMMON, not any(x in w for x in chosen), -len(w), w))
        for word in words:
            if len(left) < c:
                break
            if any(word in p for p in left):
                left = {p for p in left if word not in p}
                chosen.append(word)
    return sorted({w for w in chosen if not any(x != w and x in w for x in chosen)}, key=lambda w: (-len(w), w))


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))
    return F.split(plain, " ")


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, license, n_places, best_dice``: the templates that some line or paragraph reaches."""
    known = [(name, bigrams_of(text)) for name, text in sorted(templates.items())]
    known = [(name, pairs) for name, pairs in known if pairs]
    low = {name: len(pairs) * least / (2 - least) for name, pairs in known}
    high = {name: len(pairs) * (2 - least) / least for name, pairs in known}
    text = F.col("text").cast("string")
    # Texts without a marker word can't reach any template; the same holds for each line.
    markers = F.array(*[F.lit(w) for w in marker_words(known, least)])
    marked = lambda c: F.exists(F.array(F.lower(c)), lambda low: F.exists(markers, lambda w: F.contains(low, w)))
    docs = docs.where(marked(text))
    lines = F.split(text, "\n")
    # A paragraph of one line is that line; only longer ones are units of their own.
    paragraphs = F.filter(F.split(text, "\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.filter(F.concat(lines, paragraphs), marked)).alias("unit"))
    words = units.select("doc_id", words_of(F.col("unit")).alias("words"))
    # Not distinct yet, so only the lower bound holds here.
    words = words.where(F.size("words") - 1 >= min(low.values()))
    pairs = words.select("doc_id", F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("pairs"))
    pairs = pairs.where(F.size("pairs") <= max(high.values()))
    scored = []
    for name, own in known:
        common = F.size(F.array_intersect("pairs", F.array(*[F.lit(p) for p in own])))
        dice = 2.0 * common / (F.size("pairs") + len(own))
        scored.append(F.when(F.size("pairs").between(low[name], high[name]), F.struct(F.lit(name).alias("license"), dice.alias("dice"))))
    hits = pairs.select("doc_id", F.explode(F.array(*scored)).alias("hit")).select("doc_id", "hit.*").where(F.col("dice") >= least)
    return hits.groupBy("doc_id", "license").agg(F.count("*").alias("n_places"), F.max("dice").alias("best_dice"))


def licenses_sql(templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same in SQL over ``documents``; the templates are cut by SQL as the texts are."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in sorted(templates.items()))
    words = lambda c: f"string_split(trim(regexp_replace(translate({c}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ')"
    pairs = lambda w: f"list_distinct([{w}[i] || ' ' || {w}[i + 1] for i in generate_series(1, len({w}) - 1)])"
    return f"""
WITH t0(license, body) AS (VALUES {rows}), t1 AS (SELECT license, {words('body')} AS w FROM t0), t AS (SELECT license, {pairs('w')} AS tp FROM t1),
u AS (SELECT doc_id, unnest(string_split(text, chr(10)) || [x for x in regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') if contains(x, chr(10))]) AS unit FROM documents),
w AS (SELECT doc_id, {words('unit')} AS w FROM u), b AS (SELECT doc_id, {pairs('w')} AS p FROM w WHERE len(w) > 2),
d AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(p, tp)) / (len(p) + len(tp)) AS dice FROM b, t
      WHERE len(p) BETWEEN len(tp) * {least}::DOUBLE / (2 - {least}::DOUBLE) AND len(tp) * (2 - {least}::DOUBLE) / {least}::DOUBLE)
SELECT doc_id, license, count(*) AS n_places, max(dice) AS best_dice FROM d WHERE dice >= {least} GROUP BY doc_id, license"""
