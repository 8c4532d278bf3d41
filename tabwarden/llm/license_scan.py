"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Only DataFrame functions, and no shuffle: a document is judged where it lies. Its units are the whole text, its paragraphs,
runs of as many paragraphs as a template has, and its lines. A unit of m bigrams can reach a Dice coefficient t with a template of n only if m t <= (2 - t) n and
n t <= (2 - t) m, so units outside every template's bounds are dropped by their word count alone, before any bigram is
made, and the others meet just the templates whose bounds they keep. A text without any of a few anchor words that each
match must hold is not cut into units at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
SIMILARITY = 0.8
#: Room for rounding where a size lies just on its bound.
SLACK = 1e-6

# --- licence templates: fixed values, public texts ---
TEMPLATES = {
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT grant": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0 header": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/.""",
    "MPL-2.0 header": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}


def normalised(text: str) -> list[str]:
    """Words of a template, cut as `words_of` cuts a text."""
    return "".join(ch if ch.isalnum() else " " for ch in text.lower()).split()


def numbered(words: list[str]) -> list[str]:
    """Bigrams; a bigram that comes again has its number behind it, so that sets of these are multisets of bigrams."""
    seen: dict[str, int] = {}
    out = []
    for a, b in zip(words, words[1:]):
        key = f"{a} {b}"
        seen[key] = n = seen.get(key, 0) + 1
        out.append(f"{key} {n}")
    return out


def templates(texts: dict[str, str]) -> list[tuple[str, list[str]]]:
    """(name, numbered bigrams) in order of name."""
    return sorted((name, numbered(normalised(text))) for name, text in texts.items())


def anchors(known: list[tuple[str, list[str]]], similarity: float) -> list[str]:
    """Few words of which every text that can match some template holds at least one.

    A match shares at least n t / (2 - t) of a template's n bigrams, so it has one of any `need` of them. Words are chosen
    greedily until those `need` bigrams of each template hold a chosen word.
    """
    left = {name: len(b) - math.ceil(len(b) * similarity / (2 - similarity) - 1e-9) + 1 for name, b in known}
    open_pairs = {name: [x.split()[:2] for x in b] for name, b in known}
    out: list[str] = []
    while any(n > 0 for n in left.values()):
        worth: dict[str, int] = {}
        for name, pairs in open_pairs.items():
            if left[name] > 0:
                for word in {w for p in pairs for w in p}:
                    worth[word] = worth.get(word, 0) + min(left[name], sum(word in p for p in pairs))
        word = max(worth, key=lambda w: (len(w) > 4, worth[w] * len(w) ** 2, w))  # long words are rare ones
        out.append(word)
        for name, pairs in open_pairs.items():
            left[name] -= sum(word in p for p in pairs)
            open_pairs[name] = [p for p in pairs if word not in p]
    return out


def most_paragraphs(texts: dict[str, str]) -> int:
    """Paragraphs of the template that has the most; two at least."""
    return max([2, *(len(re.split(r"\n *\n\s*", t.strip())) for t in texts.values())])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once although `use` names it within inner functions."""
    return F.transform(F.array(value), use)[0]


def numbered_bigrams(words: Column) -> Column:
    """`numbered` over an array of words."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    earlier = lambda p, x, i: F.size(F.filter(F.slice(p, 1, i + 1), lambda y: y == x))
    return bound(pairs, lambda p: F.when(F.size(F.array_distinct(p)) == F.size(p), F.transform(p, lambda x: F.concat(x, F.lit(" 1")))).otherwise(
        F.transform(p, lambda x, i: F.concat_ws(" ", x, earlier(p, x, i)))
    ))


def license_scan(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, texts: dict[str, str] | None = None
) -> DataFrame:
    """doc_id, matches (array of unit, license, dice), license, dice; one row per input row.

    Words are runs of letters and digits of the lower-cased text; units are the whole text (`text`), its paragraphs, where
    blank lines part them (`paragraph`), its lines (`line`), and two or more paragraphs that follow each other, up to as many as
    the template with the most has (`run`). matches: for each unit the template of the greatest Dice coefficient of at least
    `similarity`, ties to the name that sorts first, in the order whole, paragraphs, lines; of the runs, which overlap, the best
    one only, at last.
    license and dice: the best of them, ties to the name that sorts first; null where there is none. A null or empty text
    has no units. Repeated rows and null ids are rows like others, other columns are ignored, an empty table gives an empty
    result.
    """
    given = TEMPLATES if texts is None else texts
    known, most = [x for x in templates(given) if x[1]], most_paragraphs(given)
    telling = anchors(known, similarity)
    tells = lambda c: reduce(or_, [c.contains(w) for w in telling])
    ratio = (2 - similarity) / similarity
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("b")) for name, b in known
    ])
    low, high = min(len(b) for _, b in known) / ratio - SLACK, max(len(b) for _, b in known) * ratio + SLACK

    low_case = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    plain = F.when(tells(low_case), F.regexp_replace(low_case, r"[^\p{L}\p{N}\n]+", " "))
    flat = lambda c: F.trim(F.translate(c, "\n", " "))
    unit = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), flat(t).alias("said"))
    count = F.size("_paras")
    run = lambda i: lambda n: F.struct(F.lit("run").alias("kind"), flat(F.array_join(F.slice("_paras", i, n), " ")).alias("said"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), count), lambda i: F.transform(F.filter(F.sequence(F.lit(2), F.lit(most)), lambda n: i + n - 1 <= count), run(i))))
    units = F.filter(
        F.concat(
            F.array(unit("text")("_plain")), F.transform("_paras", unit("paragraph")), F.transform(F.split("_plain", "\n"), unit("line")), runs,
        ),
        lambda u: tells(u["said"]),
    )
    words = lambda u: F.split(u["said"], " +")
    cut = F.filter(
        F.transform("_units", lambda u: F.struct(u["kind"].alias("kind"), words(u).alias("w"))),
        lambda u: (F.size(u["w"]) - 1 >= low) & (F.size(u["w"]) - 1 <= high),
    )
    pairs = F.transform("_cut", lambda u: F.struct(u["kind"].alias("kind"), (F.size(u["w"]) - 1).alias("n"), numbered_bigrams(u["w"]).alias("b")))

    def best(u: Column) -> Column:
        near = F.filter(table, lambda t: (u["n"] * F.lit(similarity) <= (2 - similarity) * t["n"] + SLACK) & (t["n"] * F.lit(similarity) <= (2 - similarity) * u["n"] + SLACK))
        scored = F.transform(near, lambda t: F.struct(
            (F.lit(-2.0) * F.size(F.array_intersect(t["b"], u["b"])) / (t["n"] + u["n"])).alias("low"), t["name"].alias("name")
        ))
        return F.array_min(scored)

    found = F.transform("_pairs", lambda u: F.struct(u["kind"].alias("unit"), best(u).alias("top")))
    good = F.filter(found, lambda m: m["top"]["low"] <= -similarity)
    of_runs = F.filter("_good", lambda m: m["unit"] == "run")
    kept = F.concat(
        F.filter("_good", lambda m: m["unit"] != "run"), F.when(F.size(of_runs) > 0, F.array(F.array_min(of_runs))).otherwise(F.filter("_good", lambda m: F.lit(False))),
    )
    out = (
        df.select(F.col(id_col).cast("long").alias("doc_id"), plain.alias("_plain"))
        .select("doc_id", "_plain", F.split("_plain", r"\n *\n[ \n]*").alias("_paras"))
        .select("doc_id", F.when(F.col("_plain").isNotNull(), units).alias("_units")).select("doc_id", cut.alias("_cut"))
        .select("doc_id", pairs.alias("_pairs")).select("doc_id", F.coalesce(good, F.array()).alias("_good")).select("doc_id", kept.alias("_kept"))
    )
    first = F.array_min("_kept.top")
    return out.select(
        "doc_id", F.transform("_kept", lambda m: F.struct(m["unit"].alias("unit"), m["top"]["name"].alias("license"), (-m["top"]["low"]).alias("dice"))).alias("matches"),
        first["name"].alias("license"), (-first["low"]).alias("dice"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = license_scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct("matches.license"))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"), "license", F.round("dice", 6).alias("dice"),
    )


def oracle(similarity: float = SIMILARITY) -> str:
    """DuckDB SQL that says the same from the definition: every unit against every template, no bounds used for the scores."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quote(name)}, {quote(' '.join(normalised(text)))})" for name, text in sorted(TEMPLATES.items()))
    sizes, most = [len(b) for _, b in templates(TEMPLATES)], most_paragraphs(TEMPLATES)
    low, high = min(sizes) * similarity / (2 - similarity) - SLACK, max(sizes) * (2 - similarity) / similarity + SLACK
    return rf"""
WITH plain AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS p FROM documents
), raw AS (
  SELECT r, 'text' AS kind, p AS u FROM plain
  UNION ALL SELECT r, 'paragraph', unnest(regexp_split_to_array(p, '\n *\n[ \n]*')) FROM plain
  UNION ALL SELECT r, 'line', unnest(string_split(p, chr(10))) FROM plain
  UNION ALL SELECT r, 'run', array_to_string(list_slice(ps, k, k + n - 1), ' ')
  FROM (SELECT r, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT r, regexp_split_to_array(p, '\n *\n[ \n]*') AS ps FROM plain)), (SELECT unnest(range(2, {most} + 1)) AS n)
  WHERE k + n - 1 <= len(ps)
), units AS (
  SELECT row_number() OVER () AS i, r, kind, regexp_split_to_array(trim(translate(u, chr(10), ' ')), ' +') AS w
  FROM raw WHERE trim(translate(u, chr(10), ' ')) <> ''
), cand AS (SELECT * FROM units WHERE len(w) - 1 BETWEEN {low} AND {high}),
pairs AS (SELECT i, w[k] || ' ' || w[k + 1] AS b FROM (SELECT i, w, unnest(range(1, len(w))) AS k FROM cand)),
bags AS (SELECT i, b, count(*) AS n FROM pairs GROUP BY i, b),
sizes AS (SELECT i, sum(n) AS n FROM bags GROUP BY i),
tw AS (SELECT name, string_split(t, ' ') AS w FROM (VALUES
{rows}
) v(name, t)),
tbags AS (SELECT name, w[k] || ' ' || w[k + 1] AS b, count(*) AS n FROM (SELECT name, w, unnest(range(1, len(w))) AS k FROM tw) GROUP BY ALL),
tsizes AS (SELECT name, sum(n) AS n FROM tbags GROUP BY name),
met AS (SELECT i, name, sum(least(x.n, y.n)) AS m FROM bags x JOIN tbags y USING (b) GROUP BY i, name),
dice AS (SELECT i, name, 2.0::DOUBLE * m / (s.n + t.n) AS d FROM met JOIN sizes s USING (i) JOIN tsizes t USING (name)),
found AS (SELECT i, r, kind, name, d FROM dice JOIN cand USING (i) WHERE d >= {similarity} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d DESC, name) = 1),
top AS (SELECT * FROM found QUALIFY kind <> 'run' OR row_number() OVER (PARTITION BY r, kind ORDER BY d DESC, name) = 1),
docs AS (
  SELECT r, count(*) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, arg_min(name, (-d, name)) AS license, max(d) AS dice FROM top GROUP BY r
)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, license, round(dice, 6) AS dice
FROM plain p LEFT JOIN docs USING (r)
"""


OP4_SQL = oracle()
