"""Licence scan by canonical digest: whole texts that are a known licence, whatever their typography.

The canonical form is lower case, without copyright notices, with punctuation and white space as single spaces and with
equivalent spellings made one. Its SHA-256 is joined to the digests of the known texts, a fixed list.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keyed

# What the canonical form drops: notices with a sign or a year, and undated ones that begin a paragraph. A line of body text wrapped before the word,
# or a list item (c), stays.
START = r"[^\p{L}\p{N}\n©]*"
MARK = r"(?:\(c\)|©|[<\[{(]?(?:\d{4}|yyyy|year)\b)"
DATED = rf"(?:©|copyright[ \t:,]*{MARK}|\(c\)[ \t:,]*(?:copyright\b|{MARK})|all rights reserved)[^\n]*$"
BODY = r"(?:also|and|as|disclaimer|holders?|in|interests?|is|laws?|licen[cs]es?|notices?|of|or|owners?|protection|rights?|statements?|to|treat(?:y|ies))\b"
UNDATED = rf"(?:copyright[ \t:]+(?!{BODY})[^\n]*|\(c\)[^\n]{{1,60}}(?=\n\n|\n?(?![\s\S])))(?:\n|$)"
OTHER = r"[^\p{L}\p{N}]+"

# Spellings that count as equal (left becomes right).
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments",
    "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "favour": "favor", "favourable": "favorable", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "merchantability": "merchantability",
    "modelled": "modeled", "noncommercial": "non commercial", "optimise": "optimize", "organisation": "organization", "organisations": "organizations",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "http": "https",
}

# The known texts. Each is public; copyright lines are left out, as the canonical form drops them.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_WARRANTY),
    ("ISC", "ISC License\n\n" + ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + ISC_WARRANTY),
    ("0BSD", ISC_GRANT + ".\n\n" + ISC_WARRANTY),
    ("BSD-2-Clause", BSD_START + "\n\n" + BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_START + "\n\n" + BSD_WARRANTY),
    ("BSD-3-Clause", BSD_START + "\n\n" + BSD_NAME + "\n\n" + BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_START + "\n\n" + BSD_NAME + "\n\n" + BSD_WARRANTY),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Unlicense", UNLICENSE),
    ("BSL-1.0", BSL),
]

# Digests of whole texts that are too long to stand here, as in /usr/share/common-licenses; the second of a name ends before the appendix.
FULL = [
    ("ef9aa6097e8b8724e8bedf9a9a264cbc3142b55ef97f3c3f079b7aa1aeac425c", "Apache-2.0"),
    ("ed44d69699f98d45c0c3e52ef4574fb05d6045eb6e2cd0e5e3810f6177e87f84", "Apache-2.0"),
    ("331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6", "GPL-2.0"),
    ("1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca", "GPL-2.0"),
    ("a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68", "GPL-3.0"),
    ("ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "GPL-3.0"),
    ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "LGPL-2.1"),
    ("48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "LGPL-2.1"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3.0"),
    ("26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986", "MPL-1.1"),
    ("9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13", "MPL-2.0"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0"),
]


def canonical_text(text: str) -> str:
    """The canonical form of a known text: the same steps as ``canonical``, for the driver's fixed list."""
    start = r"(?:[^\w\n©]|_)*"
    spaced = re.sub(r"\n(?:[^\w\n]|_)+(?=\n)", "\n", text.lower())
    kept = re.sub(rf"(?m)^{start}{DATED}", "", spaced)
    kept = re.sub(rf"(?:\A|(?<=\n\n))(?:{start}{UNDATED.replace('|$)', '|(?![^\n]))')})+", "", kept)
    words = re.sub(r"[\W_]+", " ", kept).strip().split(" ")
    return " ".join(SPELLINGS.get(w, w) for w in words)


def digest_list(known: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(digest, licence) of each distinct canonical form; the first name of equal forms stays."""
    out: dict[str, str] = {}
    for name, text in known:
        out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return list(out.items())


def canonical(text: Column) -> Column:
    """The canonical form of a text column, in JVM functions."""
    spaced = F.regexp_replace(F.lower(text), r"\n[^\p{L}\p{N}\n]+(?=\n)", "\n")
    kept = F.regexp_replace(spaced, f"(?md)^{START}{DATED}", "")
    kept = F.regexp_replace(kept, rf"(?md)^(?:\A|(?<=\n\n)|\G){START}{UNDATED}", "")
    words = F.split(F.trim(F.regexp_replace(kept, OTHER, " ")), " ")
    pairs = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(pairs, w), w)), " ")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license) of each row: the licence whose canonical text the whole text is, else null.

    A null text has null digest and licence; an empty one has the digest of the empty string. Rows repeat as they do in the input.
    The digests are a fixed list, so broadcasting them is bounded. Other columns are ignored.
    """
    digests = docs.sparkSession.createDataFrame(digest_list(KNOWN) + FULL if known is None else digest_list(known), "canonical_sha256 string, license string")
    rows = keyed(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", F.sha2(F.encode(canonical(F.col("text")), "UTF-8"), 256).alias("canonical_sha256"))
    return rows.join(F.broadcast(digests), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license")
