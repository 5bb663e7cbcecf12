"""License scans by canonical digest: normalise a whole text, then hash-join it to known licence digests.

DataFrame functions only. A text is looked up as a whole, and so is each of its paragraphs and lines, since a grant notice
("Licensed under ...") is a complete licence statement that stands on a line or in a paragraph of its own, however wrapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts without their copyright lines, and grant notices.
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
LICENSES = (
    ("MIT", _MIT + _WARRANTY_MIT),
    ("MIT", "MIT License\n" + _MIT + _WARRANTY_MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT + _WARRANTY_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("ISC", "ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _WARRANTY_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _WARRANTY_ISC),
    ("BSD-2-Clause", _BSD_TERMS + "\n" + _WARRANTY_BSD),
    ("BSD-3-Clause", _BSD_TERMS + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _WARRANTY_BSD),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
# Spellings that count as one; applied in this order to lower-cased text.
SPELLINGS = (
    ("licence", "license"), ("licencing", "licensing"), ("organis", "organiz"), ("authoris", "authoriz"), ("recognis", "recogniz"),
    ("merchantib", "merchantab"), ("favour", "favor"), ("programme", "program"), ("whilst", "while"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("non-commercial", "noncommercial"),
    ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("https://", "http://"),
)
#: A line that names the holder: "Copyright (c) 2020 ...", "(c) 2020 ...", "All rights reserved."
COPYRIGHT_LINE = r"(?m)^[^\n0-9a-z(©]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
#: What stands between the letters and digits of a line.
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


#: What parts paragraphs, and lines of one, once punctuation is spaces.
PARAGRAPHS, BREAKS = r"\n *(?:\n *)+", r" *\n *"
#: Rows that a table of known licences may have; it is broadcast, at about 100 bytes a row.
MOST_KNOWN = 10_000


def canonical(text: Column) -> Column:
    """A text in canonical form, lines kept: lower case, one spelling, no copyright lines, single spaces for punctuation."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, PUNCTUATION, " ")


def _lines(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _whole(t: Column) -> Column:
    return F.concat_ws(" ", _lines(t))


def _paragraphs(t: Column) -> Column:
    return F.transform(F.split(t, PARAGRAPHS), lambda x: F.trim(F.regexp_replace(x, BREAKS, " ")))


def _digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def known(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """digest, license of every known text, one row a digest (of two licences the first by name).

    more: license, text of further known texts; with LICENSES they may be MOST_KNOWN, or it is refused.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("license"), F.lit(t).alias("text")) for i, t in LICENSES])
    k = spark.range(1).select(F.explode(rows).alias("x")).select("x.license", "x.text")
    if more is not None:
        k = k.unionByName(more.select("license", "text").where("license IS NOT NULL AND text IS NOT NULL").limit(MOST_KNOWN + 1))
        if k.count() > MOST_KNOWN:
            raise ValueError(f"more than {MOST_KNOWN} known licence texts")
    whole = k.select("license", _whole(canonical(F.col("text"))).alias("t")).where("t <> ''")
    return whole.groupBy(_digest(F.col("t")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Per row of docs (doc_id, text; others are left out): the licence that the whole text is, and all that it states.

    text_license: the licence whose canonical text is the whole text, else null. licenses: ids of the whole text
    and of single paragraphs and lines, distinct, in order, comma-joined, '' for none; n_licenses counts them. Null and empty
    texts and texts of copyright lines only match nothing. Repeated rows each get a row; no rows give none. more: further known texts.

    Whole texts are hash-joined with the known digests. Parts of a text are looked up in the same digests as a
    constant of the plan, so no row is expanded or shuffled, and copies of one text meet nowhere.
    """
    lookup = known(docs.sparkSession, more)
    licenses = {r["digest"]: r["license"] for r in lookup.collect()}  # MOST_KNOWN rows at most
    of_digest = F.create_map(*[F.lit(x) for kv in licenses.items() for x in kv])
    d = docs.select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.select("doc_id", _digest(_whole(F.col("t"))).alias("whole"), F.array_distinct(F.concat(_lines(F.col("t")), _paragraphs(F.col("t")))).alias("parts"))
    hits = F.filter(F.transform("parts", _digest), lambda x: x.isin(list(licenses)))
    d = d.select("doc_id", "whole", F.transform(hits, lambda x: F.element_at(of_digest, x)).alias("stated"))
    whole = F.broadcast(lookup.select(F.col("digest").alias("whole"), F.col("license").alias("text_license")))
    found = F.array_sort(F.array_distinct(F.concat("stated", F.filter(F.array("text_license"), lambda x: x.isNotNull()))))
    return (
        d.join(whole, "whole", "left")
        .select("doc_id", "text_license", found.alias("found"))
        .select("doc_id", "text_license", F.array_join("found", ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql() -> str:
    t = f"regexp_replace(lower(text), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    for a, b in SPELLINGS:
        t = f"replace({t}, {_quoted(a)}, {_quoted(b)})"
    t = f"regexp_replace({t}, {_quoted(PUNCTUATION)}, ' ', 'g')"
    lines = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')"
    paragraphs = f"list_transform(regexp_split_to_array(t, {_quoted(PARAGRAPHS)}), lambda x: trim(regexp_replace(x, {_quoted(BREAKS)}, ' ', 'g'), ' '))"
    values = ", ".join(f"({_quoted(i)}, {_quoted(x)})" for i, x in LICENSES)
    return f"""
WITH raw(license, text) AS (VALUES {values}),
known AS (SELECT canon, min(license) AS license FROM (SELECT license, array_to_string({lines}, ' ') AS canon FROM (SELECT license, {t} AS t FROM raw)) GROUP BY canon),
d AS (SELECT doc_id, array_to_string({lines}, ' ') AS whole, list_concat({lines}, {paragraphs}) AS parts FROM (SELECT doc_id, {t} AS t FROM (SELECT doc_id, COALESCE(text, '') AS text FROM documents))),
found AS (
  SELECT doc_id, (SELECT min(license) FROM known WHERE canon = whole) AS text_license,
    (SELECT list_sort(list(DISTINCT license)) FROM known WHERE list_contains(parts, canon) OR canon = whole) AS found
  FROM d
)
SELECT doc_id, text_license, COALESCE(array_to_string(found, ','), '') AS licenses, COALESCE(len(found), 0)::BIGINT AS n_licenses FROM found
"""


SQL = _sql()
