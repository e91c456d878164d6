"""Licence scan by canonical digests, in DataFrame expressions only.

A text is brought to one form: lower case, no copyright lines, no title, no marks of list items, no punctuation, one
spelling for equivalent words. Texts of one form have one digest, and entire
texts are found by a hash join with the digests of known licences. Every line of a document
is looked up in the same way among the known one-line notices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licences by identifier, and one-line notices that name one.
LICENCES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
}
# The third clause, which the text with three clauses has between the second one and the disclaimer.
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

"""
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"
LICENCES["BSD-3-Clause"] = LICENCES["BSD-2-Clause"].replace(_DISCLAIMER, _THIRD + _DISCLAIMER)

# Digests of the canonical forms of long texts as they are published, some with and without their appendix.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "cd264b0a4283e71bd0a18e33afd4ad86b5ea9ef0f6e8fac8b03c2d02a026c7c7",
        "2bdf0417af9f118a4d8d7e3666fb8affabdaa1ac1be8f77970fa447146257410",
    ),
    "CC0-1.0": ("888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c",),
    "GPL-2.0": (
        "7184d26d84b872ba4d2f7f785abf2f2e9fa24bb587420a49515d6d61713c52bb",
        "c96bbd300040e473c5c8c1406c85b75af765d5f4035156ef4962ce0c62ac5faa",
    ),
    "GPL-3.0": (
        "bd7328918ecee5d4124586097537cc86fbe5616cd6c36107d0bee228d12898bc",
        "4671d5b2b1066ae8112f48b114054efb01163ffef85367f8994fbc430d73ecd9",
    ),
    "LGPL-2.1": (
        "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98",
        "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3",
    ),
    "LGPL-3.0": ("cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",),
    "MPL-2.0": ("d17fc6111c9b88ed1373bbab79e0de04d2e2439ce8b9852a7d6ff0ba1cc9d389",),
}
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
}
# Lines that name an owner or a year, and equivalent spellings, after punctuation has gone.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|[0-9]{4}|by )|\(c\)|©|all rights reserved)[^\n]*$"
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"),
    ("favour", "favor"), ("https ", "http "),
)


# Marks of list items at the start of lines, and title lines of licences, before the words their texts begin with.
ITEM = r"(?m)^[ \t]*(?:[0-9]{1,2}|[a-z])[.)][ \t]+"
TITLE = (
    r"^(?:the )?(?:mit license(?: mit)?|isc license(?: isc)?|(?:bsd zero clause|zero clause bsd|0bsd) license|zlib(?: libpng)? license"
    r"|(?:(?:simplified|new|modified|revised) bsd|bsd (?:2|3) clause(?: simplified| new or revised)?) license|unlicense)"
    r" (?=permission |redistribution |this software is |this is free )"
)


def canonical(text: Column) -> Column:
    """The form in which texts are compared; empty for NULL and for texts without letters and digits."""
    found = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    found = F.trim(F.regexp_replace(F.regexp_replace(found, ITEM, ""), r"[^\p{L}\p{N}]+", " "))
    for other, usual in SPELLINGS:
        found = F.replace(found, F.lit(other), F.lit(usual))
    return F.regexp_replace(found, TITLE, "")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(docs: DataFrame, texts: Mapping[str, Sequence[str]], digests: Mapping[str, Sequence[str]]) -> DataFrame:
    """``known_digest, licence``, with one row for each text or digest given."""
    rows = [(name, text, None) for name, some in texts.items() for text in some]
    rows += [(name, None, one) for name, some in digests.items() for one in some]
    table = docs.sparkSession.createDataFrame(rows, "licence string, known string, given string")
    return table.select(F.coalesce("given", digest(F.col("known"))).alias("known_digest"), "licence").dropDuplicates(["known_digest"])


def scan(
    docs: DataFrame, licences: Mapping[str, str] = LICENCES, notices: Mapping[str, Sequence[str]] = NOTICES,
    digests: Mapping[str, Sequence[str]] = DIGESTS,
) -> DataFrame:
    """``doc_id, text_digest, licence, notices`` of every row of ``docs``.

    ``licence`` names the known licence, or notice, that the entire text is; NULL if it is none. ``notices`` lists,
    in order and once each, the licences named by lines. A NULL or empty text is none and has the
    digest of the empty text; rows that repeat stay rows, an empty table gives none, and other columns are not read. Texts
    of any length are brought to their form whole, in one row. Known texts
    are given by the caller and few, so they are broadcast.
    """
    spark = docs.sparkSession
    texts = {name: [text] for name, text in licences.items()}
    for name, some in notices.items():
        texts[name] = [*texts.get(name, []), *some]
    whole = known_digests(docs, texts, digests)
    # The notices' canonical forms, few and known beforehand, as a table for look-up inside a row.
    pairs = [(name, text) for name, some in notices.items() for text in some]
    lines = spark.createDataFrame(pairs, "licence string, known string").select(
        digest(F.col("known")).alias("d"), "licence", F.char_length(canonical(F.col("known"))).alias("n")
    ).dropDuplicates(["d"]).collect()
    named = F.create_map(*[F.lit(x) for row in lines for x in (row["d"], row["licence"])]) if lines else None
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if named is None:
        found = F.array().cast("array<string>")
    else:
        sizes = [row["n"] for row in lines]
        forms = F.transform(F.split("text", "\n"), canonical)
        forms = F.filter(forms, lambda form: F.char_length(form).isin(*sizes))
        found = F.transform(forms, lambda form: F.try_element_at(named, F.sha2(form.cast("binary"), 256)))
        found = F.array_sort(F.array_distinct(F.array_compact(found)))
    rows = rows.select("doc_id", digest(F.col("text")).alias("text_digest"), found.alias("notices"))
    joined = rows.join(F.broadcast(whole), F.col("text_digest") == F.col("known_digest"), "left")
    return joined.select("doc_id", "text_digest", "licence", "notices")
