"""License scans: canonical digests of entire texts, looked up by a hash join.

Normalising lower-cases a text, gives equivalent spellings one form (whole words only), takes out copyright
lines, and leaves words (letters and digits) with one space between. The units are a document's
whole text, each of its paragraphs (runs of two or more worded lines between blank lines) and each of its lines; a unit is a licence
if the digest of all of its normal form is that of a known licence text or notice. Known are the notices and texts in
``KNOWN``, and the long texts whose digests are in ``DIGESTS``; ``known`` takes others. DataFrame functions only.

A copyright line begins with "copyright" or "(c)" and goes on with a year or a placeholder, or is "copyright" and up
to six words that do not go on as licence texts do ("copyright notice", "copyright holders", ...), or is "all rights reserved".

Defined cases: null or empty texts, and units without a word, match nothing; a text of one line is
one ``text`` unit and one ``line`` unit; repeated rows are scanned each but give one row per
doc_id; equal known texts of two licences give a row for each; very long texts are read whole;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, after lower-casing and removal of punctuation.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("per cent", "percent"), ("whilst", "while"), ("judgement", "judgment"),
    ("favour", "favor"), ("organisation", "organization"), ("fulfil", "fulfill"), ("wilful", "willful"), ("merchantibility", "merchantability"),
]

# Licence notices and short licence texts.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Copyright (c) <year>, <copyright holder>
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Copyright (c) <year>, <copyright holder>
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
]

# Digests of the normal forms of entire licence texts, without their copyright lines.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "77e1a2c8e9671a8095fa8108104daeae"),
    ("Artistic-1.0-Perl", "2fe792d1191a708e71b9beca097682bd"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "510ee6eaa4a085a82cc0dd37876e716f"),
    ("GFDL-1.3", "bb177c2ca80d2d202dd84be197519ac3"),
    ("GPL-1.0", "637c8dd9413df12dd04f01dcc685bc4f"),
    ("GPL-2.0", "5c18a626dd71c1589021930898879283"),
    ("GPL-3.0", "f8de4ee042e7af7040c9c77af4e24d6f"),
    ("LGPL-2.0", "ebf358251bfe9161668a8c8251261977"),
    ("LGPL-2.1", "1ff066c677365f47fea81c911a7c822e"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "252dfbcf46f9012c7c356a9252f1c30c"),
    ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec"),
]

# Copyright lines of normal forms; the second pattern lists how licence texts go on.
COPYRIGHT_LINE = r"^(copyright |copr )?(c )?(c )?((19|20)[0-9][0-9]( |$)|year|yyyy)|^copyright( c)?( by)?( [^ ]+){1,6}$|^all rights reserved$"
NOT_COPYRIGHT_LINE = r"^copyright (notice|law|license|owner|statement|interest|act|treaty|permission|disclaimer)|^copyright (and|or|in|of|to|on|is|for|the|this|that|as|are|was|has) |^(19|20)[0-9][0-9]"
MOST_KNOWN = 100_000
BLANK = r"\n( *\n)+"


def normal_paragraphs(text: Column) -> Column:
    """The normal forms of the lines of a text, an array for each paragraph; copyright lines and lines without a word are left out."""
    flat = F.regexp_replace(F.lower(F.replace(text, F.lit("©"), F.lit(" c "))), r"[^\p{L}\p{N}\n]+", " ")

    def line(x: Column) -> Column:
        x = F.concat(F.lit(" "), F.replace(x, F.lit(" "), F.lit("  ")), F.lit(" "))  # a space on both sides of every word
        for other, one in EQUIVALENT:
            x = F.replace(x, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
        return F.replace(F.trim(x), F.lit("  "), F.lit(" "))

    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), line), lambda x: (x != "") & ~(x.rlike(COPYRIGHT_LINE) & ~x.rlike(NOT_COPYRIGHT_LINE)))
    return F.filter(F.transform(F.split(flat, BLANK), lines), lambda p: F.size(p) > 0)


def digest(normal: Column) -> Column:
    return F.md5(normal.cast("binary"))


def known_digests(known: DataFrame) -> DataFrame:
    """``license_id, digest`` of known texts (``license_id, text``)."""
    return known.select("license_id", digest(F.array_join(F.flatten(normal_paragraphs(F.col("text"))), " ")).alias("digest")).distinct()


def license_scan(documents: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license_id, unit, n_units``: how many units of a document are texts of a licence."""
    spark: SparkSession = documents.sparkSession
    if known is None:
        digests = known_digests(spark.createDataFrame(KNOWN, "license_id string, text string"))
        digests = digests.union(spark.createDataFrame(DIGESTS, "license_id string, digest string")).distinct()
    else:
        digests = known_digests(known)
    if digests.count() <= MOST_KNOWN:  # beyond it the join is left to the planner
        digests = F.broadcast(digests)
    rows = documents.select(F.col(key).alias("doc_id"), normal_paragraphs(F.col(text).cast("string")).alias("paragraphs"))
    unit = lambda name, normal: F.struct(F.lit(name).alias("unit"), digest(normal).alias("digest"))
    whole = F.array(unit("text", F.array_join(F.flatten("paragraphs"), " ")))
    parts = F.transform(F.filter("paragraphs", lambda p: F.size(p) > 1), lambda p: unit("paragraph", F.array_join(p, " ")))
    single = F.transform(F.flatten("paragraphs"), lambda x: unit("line", x))
    # no filter on the lines: it would move below them and normalise every text twice
    found = F.when(F.size("paragraphs") > 0, F.concat(whole, parts, single))
    units = rows.select("doc_id", F.explode(found).alias("u")).select("doc_id", "u.unit", "u.digest")
    return units.join(digests, "digest").groupBy("doc_id", "license_id", "unit").agg(F.count("*").alias("n_units"))


def oracle() -> str:
    """The same over DuckDB views."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    flat = "regexp_replace(lower(replace(text, '©', ' c ')), '[^\\p{L}\\p{N}\\n]+', ' ', 'g')"
    line = "' ' || replace(x, ' ', '  ') || ' '"
    for other, one in EQUIVALENT:
        line = f"replace({line}, {quote(' ' + other.replace(' ', '  ') + ' ')}, {quote(' ' + one.replace(' ', '  ') + ' ')})"
    line = f"replace(trim({line}), '  ', ' ')"
    keep = f"x <> '' AND NOT (regexp_matches(x, {quote(COPYRIGHT_LINE)}) AND NOT regexp_matches(x, {quote(NOT_COPYRIGHT_LINE)}))"
    lines = f"list_filter(list_transform(string_split(p, chr(10)), lambda x: {line}), lambda x: {keep})"
    paragraphs = f"list_filter(list_transform(string_split_regex({flat}, {quote(BLANK)}), lambda p: {lines}), lambda p: len(p) > 0)"
    values = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    more = "".join(f" UNION SELECT {quote(i)}, {quote(d)}" for i, d in DIGESTS)
    return f"""
WITH known AS (SELECT * FROM (VALUES {values}) AS k(license_id, text)),
digests AS (SELECT license_id, md5(array_to_string(flatten(ps), ' ')) AS digest FROM (SELECT license_id, {paragraphs} AS ps FROM known){more}),
docs AS (SELECT doc_id, {paragraphs} AS ps FROM documents),
units AS (
  SELECT doc_id, 'text' AS unit, md5(array_to_string(flatten(ps), ' ')) AS digest FROM docs WHERE len(ps) > 0
  UNION ALL SELECT doc_id, 'paragraph', md5(array_to_string(p, ' ')) FROM (SELECT doc_id, unnest(ps) AS p FROM docs) WHERE len(p) > 1
  UNION ALL SELECT doc_id, 'line', md5(x) FROM (SELECT doc_id, unnest(flatten(ps)) AS x FROM docs))
SELECT doc_id, license_id, unit, count(*) AS n_units FROM units JOIN digests USING (digest) GROUP BY ALL"""
