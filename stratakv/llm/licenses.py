"""Operator 1, licence scans: canonical digest lookup.

A text is brought into a canonical form (copyright lines dropped, lower case, one spelling for
equivalent words, punctuation and spacing made alike) and its digest is hash-joined to the digests
of known licence texts. Whole texts are looked up, and each line of a text is looked up as a text
of its own, since notices are usually a line of a longer file. A whole text's form is the words of
its lines' forms, so each line is cut into words once. Whole licence texts lie in ``licence_texts``
(public texts, one file each, named by licence).
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Most rows of a catalogue that is broadcast (about 100 bytes a row); a larger one is joined by sort-merge.
BROADCAST_ROWS = 100_000

# Spellings that count as the same word, the second form being the canonical one.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses", "maximise": "maximize",
    "merchantibility": "merchantability", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "wilfull", "noncommercial": "non commercial",
    "sublicence": "sublicense", "per cent": "percent", "copyright owner": "copyright holder", "https": "http",
}

# Public licence texts and the one-line notices by which files name a licence.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(
    ", provided that the above copyright notice and this permission notice appear in all copies.", "."
)
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
WHOLE_UNLICENSE = UNLICENSE + """

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace(
    "\n\nTHIS SOFTWARE IS",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS",
)
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
FILES = [(f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
CATALOGUE = [
    *FILES,
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_3),
    ("Apache-2.0", APACHE_NOTICE),
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("0BSD", ZERO_BSD),
    ("Unlicense", UNLICENSE),
    ("Unlicense", WHOLE_UNLICENSE),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]

#: A line that only states a copyright: the word or a mark, then a mark, a year or "by". (A line that
#: starts with "copyright holders" or "copyright notice" is a part of the licence.)
COPYRIGHT_LINE = r"(?i)^[ \t#*/;-]*(?:copyright[ \t:]*(?:\(c\)|©|by\b|(?:19|20)[0-9][0-9])|\(c\)[ \t:]*(?:19|20)[0-9][0-9]|©)"
#: All but letters, digits and characters beyond ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Spellings of one word for one word, and all others (of words in their canonical spelling).
WORDS = {a: b for a, b in SPELLINGS.items() if " " not in a + b}
PHRASES = {a: b for a, b in SPELLINGS.items() if " " in a + b}


def _any_of(words: Iterable[str]) -> str:
    """A pattern for a text with any of the words between spaces, grouped by first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(words):
        by.setdefault(w[0], []).append(w[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) + ") "


def line_words(line: Column) -> Column:
    """A line's words in one spelling, each between two spaces of its own; empty for copyright lines."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.concat(F.lit(" "), F.regexp_replace(lower, SEPARATORS, "  "), F.lit(" "))
    table = F.create_map(*(F.lit(x) for pair in WORDS.items() for x in pair))
    each = F.transform(F.split(plain, " +"), lambda w: F.coalesce(F.try_element_at(table, w), w))
    spelt = F.when(plain.rlike(_any_of(WORDS)), F.concat(F.lit(" "), F.array_join(each, "  "), F.lit(" "))).otherwise(plain)
    return F.when(lower.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(spelt)


def finished(words: Column) -> Column:
    """``line_words`` of one or more lines as canonical form: one spelling of phrases, single spaces."""
    words = F.concat(F.lit(" "), F.regexp_replace(words, " +", "  "), F.lit(" "))
    for other, one in PHRASES.items():
        words = F.replace(words, F.lit(" " + other.replace(" ", "  ") + " "), F.lit(" " + one.replace(" ", "  ") + " "))
    return F.trim(F.regexp_replace(words, " +", " "))


def canonical(text: Column) -> Column:
    """The canonical form of a text: its words in one spelling, separated by single spaces."""
    return finished(F.array_join(F.transform(F.split(text, "\n"), line_words), " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def catalogue_digests(spark, catalogue: Iterable[tuple[str, str]]) -> DataFrame:
    """(digest, license) of the known texts: of texts with one canonical form the first licence counts."""
    known = list(catalogue)
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(known)], "i int, license string, text string")
    digests = rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min_by("license", "i").alias("license"))
    return F.broadcast(digests) if len(known) <= BROADCAST_ROWS else digests


def scan(
    docs: DataFrame, catalogue: Iterable[tuple[str, str]] = CATALOGUE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Licences of every row: id_col, canonical_sha256, license_id, notices, n_notices.

    license_id is the licence whose canonical text is the row's whole canonical text (null: none);
    notices are the distinct licences, sorted, of which a single line is the whole canonical text,
    n_notices the number of such lines. Null texts count as empty. Texts without words have the
    digest of the empty string and match nothing. Repeated rows are rows of their own; an empty
    table gives an empty result; columns of ``docs`` other than the two are not looked at.
    """
    known = catalogue_digests(docs.sparkSession, catalogue)
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")
    )
    none = F.sha2(F.lit("").cast("binary"), 256)
    sha = lambda x: F.sha2(finished(x).cast("binary"), 256)
    cut = rows.select("uid", "id", F.transform(F.split("text", "\n"), line_words).alias("words"))
    units = cut.select("uid", "id", sha(F.array_join("words", " ")).alias("whole"), F.transform("words", sha).alias("lines"))
    every = units.select(
        "uid", "id", "whole", F.posexplode(F.concat(F.array("whole"), "lines")).alias("at", "digest")
    )
    looked_up = every.join(known, "digest", "left").withColumn(
        "license", F.when(F.col("digest") != none, F.col("license"))
    )
    line = F.col("at") > 0
    return (
        looked_up.groupBy("uid", "id", "whole")
        .agg(
            F.max(F.when(~line, F.col("license"))).alias("license_id"),
            F.array_sort(F.collect_set(F.when(line, F.col("license")))).alias("notices"),
            F.count(F.when(line, F.col("license"))).alias("n_notices"),
        )
        .select(F.col("id").alias(id_col), F.col("whole").alias("canonical_sha256"), "license_id", "notices", "n_notices")
    )


def contract(found: DataFrame) -> DataFrame:
    """``scan``'s result with the notices comma-joined."""
    return found.withColumn("notices", F.array_join("notices", ","))
