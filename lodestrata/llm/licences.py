"""Licence scan by sentence rules (operator 9), DataFrame functions only.

Texts are split into sentences, which are normalised (lower case; what is not a letter or digit becomes one blank) and
mapped to identifiers of known licence sentences by an equi-join. A document's identifiers in order are its sequence;
a rule is an ordered sequence of identifiers and matches where all of them follow one another in the document's
sequence, unknown sentences between them set aside.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Licence sentences, by identifier.
SENTENCES = {
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-header-1": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-header-2": "you may not use this file except in compliance with the License",
    "apache-header-3": "You may obtain a copy of the License at",
    "apache-header-4": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-header-5": "See the License for the specific language governing permissions and limitations under the License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense-1": "This is free and unencumbered software released into the public domain",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "ccby4": "Licensed under CC BY 4.0",
    "ccbysa4": "Licensed under CC BY-SA 4.0",
    "ccbync4": "Licensed under CC BY-NC 4.0",
    "ccbynd4": "Licensed under CC BY-ND 4.0",
    "ccbyncsa4": "Licensed under CC BY-NC-SA 4.0",
    "ccby4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbysa4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ccbync4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "rights": "All rights reserved",
}

# Rules (identifier, licence, ordered sentence identifiers).
RULES = [
    ("apache-short", "Apache-2.0", ["apache-licensed"]),
    ("apache-header", "Apache-2.0", ["apache-header-1", "apache-header-2", "apache-header-3", "apache-header-4", "apache-header-5"]),
    ("apache-spdx", "Apache-2.0", ["spdx-apache"]),
    ("mit-short", "MIT", ["mit-released"]),
    ("mit-short-2", "MIT", ["mit-licensed"]),
    ("mit-title", "MIT", ["mit-title"]),
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("mit-spdx", "MIT", ["spdx-mit"]),
    ("bsd-2", "BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("bsd-3", "BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-3-spdx", "BSD-3-Clause", ["spdx-bsd3"]),
    ("isc", "ISC", ["isc-grant"]),
    ("gpl3-short", "GPL-3.0-only", ["gpl3-licensed"]),
    ("gpl3-header", "GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("gpl2-header", "GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("gpl3-spdx", "GPL-3.0-only", ["spdx-gpl3"]),
    ("mpl2", "MPL-2.0", ["mpl-subject", "mpl-copy"]),
    ("unlicense", "Unlicense", ["unlicense-1", "unlicense-2"]),
    ("cc-by", "CC-BY-4.0", ["ccby4"]),
    ("cc-by-long", "CC-BY-4.0", ["ccby4-long"]),
    ("cc-by-sa", "CC-BY-SA-4.0", ["ccbysa4"]),
    ("cc-by-sa-long", "CC-BY-SA-4.0", ["ccbysa4-long"]),
    ("cc-by-nc", "CC-BY-NC-4.0", ["ccbync4"]),
    ("cc-by-nc-long", "CC-BY-NC-4.0", ["ccbync4-long"]),
    ("cc-by-nd", "CC-BY-ND-4.0", ["ccbynd4"]),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", ["ccbyncsa4"]),
    ("all-rights", "LicenseRef-proprietary", ["rights"]),
]

# Licences by SPDX identifier with the names that statements give them.
NAMES = {
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT license (MIT)"],
    "MIT-0": ["MIT No Attribution License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "0BSD": ["BSD Zero Clause License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License Version 2"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License - v 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "CC0-1.0": ["CC0 1.0 Universal license", "Creative Commons Zero v1.0 Universal license"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
}

# Statements that a work is under a licence.
STATEMENTS = [
    "Licensed under the {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}",
    "This software is licensed under the {}", "This software is released under the {}", "This program is licensed under the {}", "This code is licensed under the {}", "This file is licensed under the {}",
]

# Whole licence texts, without titles and copyright lines, by SPDX identifier.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "WTFPL": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "PostgreSQL": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.""",
}


def public_rules() -> tuple[dict[str, str], list[tuple[str, str, list[str]]]]:
    """(sentences by identifier, rules): SENTENCES and RULES, an SPDX tag and every statement for each licence of NAMES, and the sentences of TEXTS in order."""
    sentences, rules, known = dict(SENTENCES), list(RULES), {normal(x) for x in SENTENCES.values()}

    def add(rule: str, licence: str, parts: list[str]) -> None:
        names = [f"{rule}#{i}" for i in range(len(parts))]
        sentences.update(zip(names, parts, strict=True))
        rules.append((rule, licence, names))

    for licence, names in NAMES.items():
        own = [(f"spdx:{licence}", f"SPDX-License-Identifier: {licence}")]
        own += [(f"says:{licence}:{i}:{k}", s.format(name)) for i, name in enumerate(names) for k, s in enumerate(STATEMENTS)]
        for rule, sentence in own:
            if normal(sentence) not in known:
                known.add(normal(sentence))
                add(rule, licence, [sentence])
    for licence, text in TEXTS.items():
        # a number that begins a line is cut off as a sentence of its own, which a rule sets aside like any that it does not know
        add(f"text:{licence}", licence, [p for p in re.split(f"\n(?:[0-9]+[.] )?|{CUT}", text) if normal(p) and not normal(p).isdigit()])
    return sentences, rules


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Sentences as the splitter cuts them: a known text with inner full stops or semicolons is several pieces in a row.
CUT = r"[.!?;:]+(?:\s+|$)"
#: Notices stand apart from what is around them by lines without letters or digits (a comment's marks aside), and by URLs.
BLANK = r"\n[^A-Za-z0-9]*\n|\r[^A-Za-z0-9\n]*\r"
URL = r"[Hh][Tt][Tt][Pp][Ss]?://\S+"
#: A line that states a copyright, not one of a wrapped sentence that speaks of "the above copyright notice".
HOLDER = r"(?:^|[\r\n])[^A-Za-z0-9\r\n]*(?:[Cc]opyright|COPYRIGHT)[ \t]*(?:\([Cc]\)|©|[0-9])[^\r\n]*"
PARAGRAPH = f"{BLANK}|{HOLDER}|{URL}|{CUT}"


def _pieces(sentence: str) -> list[str]:
    return [p for p in (normal(x) for x in re.split(CUT, sentence)) if p]


Rules = tuple[dict[str, str], list[tuple[str, str, list[str]]]]


def dictionary(rules: Rules | None = None) -> Rules:
    """(identifier of each normalised sentence piece, rules over identifiers of pieces)."""
    sentences, ordered = rules or public_rules()
    known, parts = {}, {}
    for name, text in sentences.items():
        pieces = _pieces(text)
        parts[name] = []
        for i, p in enumerate(pieces):
            ident = known.setdefault(p, name if len(pieces) == 1 else f"{name}/{i + 1}")
            parts[name].append(ident)
    return known, [(rule, licence, [p for s in names for p in parts[s]]) for rule, licence, names in ordered]


def anchors(known: dict[str, str], rules: list[tuple[str, str, list[str]]], least: int = 6) -> list[str]:
    """Words of which each rule's sentences hold one, those in most rules first. A word has letters and digits only, so a text holds
    it unbroken wherever a sentence of the text's normal form does: no match is lost by asking for them."""
    texts = {i: s for s, i in known.items()}
    words = {rule: {w for i in ids for w in texts[i].split()} for rule, _, ids in rules}
    rest = {rule: {w for w in own if len(w) >= least} or {max(own, key=len)} for rule, own in words.items()}
    out = []
    while rest:
        count = Counter(w for own in rest.values() for w in own)
        best = max(count, key=lambda w: (count[w], len(w), w))
        out.append(best)
        rest = {rule: own for rule, own in rest.items() if best not in own}
    # a word within which another stands adds nothing
    return [w for w in out if not any(x != w and x in w for x in out)]


def _without_urls(sentences: dict[str, str], known: dict[str, str]) -> dict[str, str]:
    """A known sentence that holds a URL is found without it in the view that cuts there."""
    return {p: known[normal(x)] for x in sentences.values() if re.search(URL, x) and normal(x) in known for p in [normal(re.sub(URL, " ", x))]}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Rows (key, rule_id, licence, n_sentences, n_matches, first_sentence), one per row of docs and matching rule.

    Whole texts are scanned three times: as a flow, where sentences run over line ends, line by line, and by paragraphs,
    where they run over line ends but not over blank lines, copyright lines and URLs. n_matches counts
    the matches in the view that has more; first_sentence is the lowest number of a match's first sentence there,
    from 0. A text that is null, empty or has no known sentence gives no row. Rows with equal keys give rows each.
    rules: (sentences by identifier, [(rule, licence, identifiers in order)]), public_rules() by default; the tables made of it are sent
    to all tasks, so it should be a rule base (megabytes), not data.
    """
    given = rules or public_rules()
    known, rules = dictionary(given)
    spark = docs.sparkSession
    bare = _without_urls(given[0], known)
    named = [(view, s, i) for view in ("flow", "lines", "paragraphs") for s, i in ({**known, **bare} if view == "paragraphs" else known).items()]
    sentences = F.broadcast(spark.createDataFrame(named, "view string, sentence string, sid string"))  # a fixed table
    steps = F.broadcast(spark.createDataFrame([(r, x, len(ids), i, s) for r, x, ids in rules for i, s in enumerate(ids)], "rule_id string, licence string, n_sentences int, step int, sid string"))

    def cleaned(c):
        return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))

    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.lower("text").rlike("|".join(anchors(known, rules))))
    kept = kept.withColumn("row", F.monotonically_increasing_id())  # before the rows are split
    flow = F.split("text", CUT)
    lines = F.split("text", rf"[\r\n]+|{CUT}")
    paragraphs = F.split("text", PARAGRAPH)
    views = [F.struct(F.lit(name).alias("view"), s.alias("s")) for name, s in (("flow", flow), ("lines", lines), ("paragraphs", paragraphs))]
    every = kept.select("row", "key", F.explode(F.array(*views)).alias("v"))
    found = (
        every.select("row", "key", "v.view", F.posexplode("v.s").alias("pos", "raw"))
        .withColumn("sentence", cleaned("raw"))
        .join(sentences, ["view", "sentence"])
        .select("row", "key", "view", "pos", "sid")
    )
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "view").orderBy("pos")))
    hits = (
        ranked.join(steps, "sid")
        .groupBy("row", "view", "rule_id", "licence", "n_sentences", (F.col("rank") - F.col("step")).alias("start"))
        .agg(F.count(F.lit(1)).alias("steps"), F.min("pos").alias("pos"), F.first("key").alias("key"))
        .filter(F.col("steps") == F.col("n_sentences"))
    )
    by_view = hits.groupBy("row", "view", "rule_id", "licence", "n_sentences").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.first("key").alias("key"))
    best = by_view.groupBy("row", "rule_id", "licence", "n_sentences").agg(F.max("n").alias("n_matches"), F.min_by("pos", F.struct(-F.col("n"), "view")).alias("first_sentence"), F.first("key").alias(key))
    return best.select(key, "rule_id", "licence", "n_sentences", "n_matches", "first_sentence")


def scan_sql(table: str = "documents", key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> str:
    """The same in DuckDB, without the filter that scan() begins with."""
    given = rules or public_rules()
    known, rules = dictionary(given)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    views = {"flow": CUT, "lines": rf"[\r\n]+|{CUT}", "paragraphs": PARAGRAPH}
    bare = _without_urls(given[0], known)
    sentences = ", ".join(f"({quote(view)}, {quote(s)}, {quote(i)})" for view in views for s, i in ({**known, **bare} if view == "paragraphs" else known).items())
    steps = ", ".join(f"({quote(r)}, {quote(x)}, {len(ids)}, {i}, {quote(s)})" for r, x, ids in rules for i, s in enumerate(ids))
    cuts = " UNION ALL ".join(f"SELECT row_id, k, {quote(view)} AS view, string_split_regex(t, {quote(cut)}) AS s FROM docs" for view, cut in views.items())
    return f"""
WITH known(view, sentence, sid) AS (VALUES {sentences}),
steps(rule_id, licence, n_sentences, step, sid) AS (VALUES {steps}),
docs AS (SELECT row_number() OVER () AS row_id, {key} AS k, {text} AS t FROM {table} WHERE {text} IS NOT NULL),
views AS ({cuts}),
parts AS (SELECT row_id, k, view, unnest(range(len(s))) AS pos, unnest(s) AS raw FROM views),
found AS (SELECT row_id, k, view, pos, sid, row_number() OVER (PARTITION BY row_id, view ORDER BY pos) AS rk
  FROM (SELECT *, trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM parts) JOIN known USING (view, sentence)),
hits AS (SELECT row_id, k, view, rule_id, licence, n_sentences, rk - step AS start, min(pos) AS pos FROM found JOIN steps USING (sid)
  GROUP BY row_id, k, view, rule_id, licence, n_sentences, rk - step HAVING count(*) = n_sentences),
by_view AS (SELECT row_id, k, view, rule_id, licence, n_sentences, count(*) AS n, min(pos) AS pos FROM hits GROUP BY ALL)
SELECT k AS {key}, rule_id, licence, n_sentences::INT AS n_sentences, n AS n_matches, pos::INT AS first_sentence FROM by_view
QUALIFY row_number() OVER (PARTITION BY row_id, rule_id ORDER BY n DESC, view) = 1"""
