"""Licence scans by sentences and rules.

A text is cut into sentences; each is normalised to its words and looked up among the sentences that
licences and notices are known to consist of, which gives it an identifier. The sequence of a
document's identifiers is then rewritten by rules in order, the longer and more specific first: a rule
turns a run of identifiers into the name of a licence, and what one rule has used no later one sees.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import sealed

#: End of a sentence: punctuation before white space, a colon that ends a line, or a blank line, which
#: may hold the marks of a comment.
_END = r"([.!?;])[ \t\r\n]+|:[ \t\r]*\n[ \t\r\n]*|\n[ \t\r#*/-]*\n[ \t\r\n]*"
_NO_WORD = r"[^\p{L}\p{N}]+"
_MARK = "\x01"


#: How notices begin that put something under a licence; what follows is the licence's name.
_NOTICE = (
    r"^(?:(?:this|the) (?:work|software|project|program|file|code|library|document|text|package|module) is )?"
    r"(?:licen[cs]ed|released|distributed|made available|available|published) under (?:the terms of )?(?:the )?"
)

#: What the scan uses; the SQL has the narrower patterns above. Version 3 notices go on in the same line
#: after `free software:`, and a name may follow `a` or `an`.
_SCAN_END = r"((?i:free[ \t\r\n#*/-]+software:))[ \t]+|" + _END
_SCAN_NOTICE = _NOTICE.removesuffix("(?:the )?") + "(?:the |an? )?"


def normalised(sentence: str) -> str:
    """The words of a sentence; a notice is cut down to `under` and the name of the licence."""
    return re.sub(_NOTICE, "under ", re.sub(r"[\W_]+", " ", sentence.lower()).strip())


_NAMES = {
    "MIT": ["MIT License", "MIT Licence", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-Clause BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "3-Clause BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD": ["BSD License", "BSD-style license"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-1.0": ["Eclipse Public License, version 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "WTFPL": ["WTFPL"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal license", "CC0 1.0 Universal Public Domain Dedication"],
}
for _short, _long, _versions in (("GPL", "General", "123"), ("LGPL", "Lesser General", ("2.1", "3")), ("LGPL", "Library General", "2"), ("AGPL", "Affero General", "3")):
    for _v in _versions:
        _point = _v if "." in _v else f"{_v}.0"
        for _n in (f"GNU {_long} Public License", _short, f"GNU {_short}"):
            _forms = [f"{_n}, version {x}" for x in {_v, _point}] + [f"{_n} v{x}" for x in {_v, _point}] + [f"{_n} {x}" for x in {_v, _point}]
            _NAMES.setdefault(f"{_short}-{_point}", []).extend(_forms)
            _NAMES.setdefault(f"{_short}-{_point}-or-later", []).extend(f"{x}{tail}" for x in _forms for tail in (" or later", " or any later version", ", or (at your option) any later version"))
for _parts, _long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _NAMES[f"CC-{_parts}-{_v}"] = [f"CC {_parts} {_v}", f"Creative Commons {_long} {_v}", f"Creative Commons {_long} {_v} License", f"Creative Commons {_long} {_v} International License", f"Creative Commons {_long} {_v} Unported License"]

#: Sentences that stand for a part of a licence: identifier, then the sentences.
_PARTS = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mit-liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-warranty": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "bsd-liability": ["IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES", "IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES", "IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES"],
    "bsd-loss": ["LOSS OF USE, DATA, OR PROFITS"],
    "bsd-theory": ["OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"],
    "bsd-ads": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "isc-warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "isc-liability": ["IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "apache-head": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-except": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "gpl-free": ["This program is free software", "This library is free software", "This file is free software"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-see": ["See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"],
    "mpl-head": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib-use": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-origin": ["The origin of this software must not be misrepresented"],
    "zlib-claim": ["you must not claim that you wrote the original software"],
    "zlib-acknowledge": ["If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required"],
    "zlib-altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"],
    "zlib-notice": ["This notice may not be removed or altered from any source distribution"],
    "unlicense-dedicate": ["In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain"],
    "unlicense-benefit": ["We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"],
    "unlicense-intend": ["We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-copyright": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"],
    "gpl-title-2": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-title-3": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl-title-3": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl-title-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "agpl-title-3": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "gpl-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program", "You should have received a copy of the GNU Lesser General Public License along with this library", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "mpl-grants": ["Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license"],
    "rights": ["All rights reserved"],
}


def _sentences() -> dict[str, str]:
    out = {}
    for licence, names in _NAMES.items():
        for name in names:
            out[normalised(f"SPDX-License-Identifier: {licence}")] = f"is:{licence}"
            out.setdefault(normalised(f"under {name}"), f"is:{licence}")
    for ident, texts in _PARTS.items():
        out |= {normalised(t): ident for t in texts}
    for short, long, versions in (("GPL", "General", ("1", "2", "3")), ("LGPL", "Lesser General", ("2.1", "3")), ("AGPL", "Affero General", ("3",))):
        for v in versions:
            base = f"under the terms of the GNU {long} Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"
            only = f"under the terms of the GNU {long} Public License as published by the Free Software Foundation, version {v} of the License"
            for lead in ("you can redistribute it and/or modify it ", "you may redistribute it and/or modify it "):
                point = v if "." in v else f"{v}.0"
                out[normalised(lead + base)] = f"terms:{short}-{point}-or-later"
                out[normalised(lead + only)] = f"terms:{short}-{point}"
                out[normalised(f"{lead}under the terms of the GNU {long} Public License as published by the Free Software Foundation")] = f"published:{short}"
            out[normalised(f"either version {v} of the License, or (at your option) any later version")] = f"either:{v}"
    return out


#: Normalised sentence -> identifier.
SENTENCES = _sentences()


def _rules() -> list[tuple[str, list[str]]]:
    bsd, damage = ["bsd-grant", "bsd-source", "bsd-binary"], ["bsd-liability", "bsd-loss", "bsd-theory"]
    rules = [
        ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
        ("BSD-4-Clause", [*bsd, "bsd-ads", "bsd-endorse", "bsd-warranty", *damage]),
        ("BSD-3-Clause", [*bsd, "bsd-endorse", "bsd-warranty", *damage]),
        ("BSD-2-Clause", [*bsd, "bsd-warranty", *damage]),
        ("BSD-3-Clause", [*bsd, "bsd-endorse", "bsd-warranty"]),
        ("BSD-2-Clause", [*bsd, "bsd-warranty"]),
        ("Apache-2.0", ["apache-head", "apache-except", "apache-copy", "apache-basis", "apache-see"]),
        ("ISC", ["isc-grant", "isc-warranty", "isc-liability"]),
        ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-use", "zlib-origin", "zlib-claim", "zlib-acknowledge", "zlib-altered", "zlib-notice"]),
        ("Unlicense", ["unlicense-domain", "unlicense-anyone", "unlicense-dedicate", "unlicense-benefit", "unlicense-intend"]),
        ("Apache-2.0", ["apache-title", "apache-terms"]), ("LGPL-3.0", ["lgpl-title-3", "gpl-verbatim"]), ("LGPL-2.1", ["lgpl-title-2.1", "gpl-verbatim"]),
        ("AGPL-3.0", ["agpl-title-3", "gpl-verbatim"]), ("GPL-3.0", ["gpl-title-3", "gpl-verbatim"]), ("GPL-2.0", ["gpl-title-2", "gpl-verbatim"]), ("MPL-2.0", ["mpl-title", "mpl-grants"]),
        ("MPL-2.0", ["mpl-head", "mpl-copy"]),
        ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ]
    terms = sorted({v for v in SENTENCES.values() if v.startswith("terms:")})
    for t in terms:
        rules.append((t[6:], ["gpl-free", t, "gpl-hope", "gpl-implied", "gpl-see"]))
    for t in terms:
        rules.append((t[6:], ["gpl-free", t]))
    rules += [
        ("MIT", ["mit-grant", "mit-notice"]), ("BSD-3-Clause", [*bsd, "bsd-endorse"]), ("BSD-2-Clause", bsd),
        ("Apache-2.0", ["apache-head", "apache-except"]), ("Apache-2.0", ["apache-head"]), ("MPL-2.0", ["mpl-head"]),
        ("ISC", ["isc-grant"]), ("Zlib", ["zlib-use"]), ("BSL-1.0", ["boost-grant"]), ("Apache-2.0", ["apache-title"]), ("Unlicense", ["unlicense-domain"]),
    ]
    for t in terms:  # the older wording has a semicolon in this sentence
        short, v = t[6:].split("-")[:2]
        if t.endswith("-or-later"):
            parts = [f"published:{short}", f"either:{v.removesuffix('.0')}"]
            rules += [(t[6:], ["gpl-free", *parts, "gpl-hope", "gpl-implied", "gpl-see"]), (t[6:], ["gpl-free", *parts]), (t[6:], parts)]
    rules += [(t[6:], [t]) for t in terms]
    return rules + [(v[3:], [v]) for v in sorted({v for v in SENTENCES.values() if v.startswith("is:")})]


#: (licence, identifiers), applied in this order.
RULES = _rules()


#: Parts of words of which every known sentence has one, or else it is a notice with a short name.
_GATE = ("licen", "software", "redistribut", "permission", "permitted", "warrant", "liab", "copyright", "reserved", "profits", "altered", "dedication", "reproduction", "acknowledg", "mozilla")
_SHORT = rf"under(?:{_NO_WORD}(?:the|terms|of|an?))*{_NO_WORD}(?:mit|mpl|cc|wtfpl|gnu|a?gpl|lgpl|creative)"


def _unseen() -> list[str]:
    """Known sentences that a text may have without passing the gate: none."""
    return [s for s in SENTENCES if not any(w in s for w in _GATE) and not re.match(r"under (?:mit|mpl|cc|wtfpl|gnu|a?gpl|lgpl|creative)", s)]


if _unseen():
    raise ValueError(f"the gate lets pass without a look: {_unseen()[:3]}")


def _may_have(text: Column) -> Column:
    """Whether a text may have a known sentence, by a few fast searches in it."""

    def search(low: Column) -> Column:
        out = F.contains(low, F.lit(_GATE[0]))
        for w in _GATE[1:]:
            out = out | F.contains(low, F.lit(w))
        return out | (F.contains(low, F.lit("under")) & low.rlike(_SHORT))

    return F.exists(F.array(F.lower(text)), search)  # the lambda's variable is computed once


def _normal(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), _NO_WORD, " ")), _SCAN_NOTICE, "under ")


def licence_sentences(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order. A line break ends a sentence only
    where the sentence with its line breaks is unknown."""
    pieces = F.split(F.regexp_replace(text, _SCAN_END, "$1$2" + _MARK), _MARK)
    known = lambda c: c.isin(list(SENTENCES))  # noqa: E731 - planned as a hash set

    def words(piece: Column) -> Column:
        lines = F.transform(F.split(piece, "\n"), _normal)
        whole = _normal(piece)
        return F.when(F.instr(piece, "\n") == 0, F.array(whole)).when(known(whole), F.array(whole)).otherwise(lines)

    hits = F.filter(F.flatten(F.transform(pieces, words)), known)
    table = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    return F.when(F.size(hits) > 0, F.transform(hits, lambda h: F.element_at(table, h)))


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, licences, unmatched): for each document with known licence sentences their
    identifiers in order, the licences that the rules find in them, in order and each once, and how many
    identifiers no rule has used. Lists are joined by commas; licences may be empty.

    Each row is judged by itself and in no other column than its text, so repeated rows give repeated
    results and null ids stay null. Null, empty and licence-free texts give no row. A text is cut into
    sentences only if it has one of the words of which each known sentence has one. The scan is one
    projection, without a shuffle or Python.
    """
    may = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(_may_have(F.col("text")))
    found = sealed(may.select("doc_id", licence_sentences(F.col("text")).alias("ids"))).where("ids is not null")
    chain = F.concat(F.lit("["), F.array_join("ids", "]["), F.lit("]"))
    for licence, ids in RULES:
        chain = F.replace(chain, F.lit("".join(f"[{i}]" for i in ids)), F.lit("{" + licence + "}"))
    found = found.select("doc_id", F.array_join("ids", ",").alias("sentences"), chain.alias("chain"))
    names = F.array_join(F.array_distinct(F.regexp_extract_all("chain", F.lit(r"\{([^}]*)\}"), 1)), ",")
    return found.select("doc_id", "sentences", names.alias("licences"), (F.length("chain") - F.length(F.replace("chain", F.lit("["), F.lit("")))).cast("long").alias("unmatched"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    norm = lambda c: f"regexp_replace(trim(regexp_replace(lower({c}), '{_NO_WORD}', ' ', 'g')), '{_NOTICE}', 'under ')"
    known = ", ".join(quote(s) for s in SENTENCES)
    chain = "'[' || array_to_string(ids, '][') || ']'"
    for licence, ids in RULES:
        chain = f"replace({chain}, {quote(''.join(f'[{i}]' for i in ids))}, {quote('{' + licence + '}')})"
    end = _END.replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r")
    return f"""
        WITH known(s, id) AS (VALUES {', '.join(f'({quote(s)}, {quote(i)})' for s, i in SENTENCES.items())}),
        p AS (SELECT doc_id, row_number() OVER () AS row, string_split(regexp_replace(text, '{end}', '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, row, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM p),
        n AS (SELECT doc_id, row, i, piece, {norm('piece')} AS whole FROM e),
        l AS (SELECT doc_id, row, i, CASE WHEN NOT contains(piece, chr(10)) OR whole IN ({known}) THEN [whole] ELSE list_transform(string_split(piece, chr(10)), lambda x: {norm('x')}) END AS own FROM n),
        o AS (SELECT doc_id, row, i, unnest(own) AS s, unnest(range(len(own))) AS k FROM l),
        g AS (SELECT doc_id, row, list(id ORDER BY i, k) AS ids FROM o JOIN known USING (s) GROUP BY doc_id, row),
        c AS (SELECT doc_id, array_to_string(ids, ',') AS sentences, {chain} AS chain FROM g)
        SELECT doc_id, sentences,
            coalesce(array_to_string(list_distinct_in_order, ','), '') AS licences, length(chain) - length(replace(chain, '[', '')) AS unmatched
        FROM (SELECT *, list_filter(regexp_extract_all(chain, '\\{{([^}}]*)\\}}', 1), lambda x, j: list_position(regexp_extract_all(chain, '\\{{([^}}]*)\\}}', 1), x) = j) AS list_distinct_in_order FROM c)"""
