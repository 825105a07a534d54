"""Licence recognition by sentence rules, with DataFrame functions only.

Comment signs at the beginnings of lines, list numbers and tags are taken off, then a text is cut into sentences twice: at sentence
ends, blank lines and colons that end a line, with other line breaks read as blanks (wrapped licence texts), and at every
line break as well (one-line notices between other lines). Normalised sentences map to identifiers of known licence
sentences; an ordered rule is a list of identifiers that must follow each other in this order, other known sentences
allowed between them. Identifiers of SPDX expressions count as found licences. Rules are tried from the most specific to the
least; a licence that another found one covers (``IMPLIED``) is not reported beside it, and reserved rights are reported only
where no licence is. Everything is an expression over the row: no shuffle, no Python.

Defined results: a null or empty text has no sentences and no licences. Repeated rows repeat; no rows give none; extra
columns pass through, clashing ones as ``<name>_in``. A text without any of the hints, at least one of which stands within
a word of every known sentence, is not cut at all. Matching reads whole texts of any length. The narrowest use among the
found licences is the text's, also where an expression offers a choice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table

# fixed values: licences by SPDX name, in the order of reports: kind of use and the names they go by
FAMILIES = {
    "BSD-4-Clause": ("permissive", ["BSD 4-Clause License", "Original BSD License"]),
    "BSD-3-Clause": ("permissive", ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"]),
    "BSD-2-Clause": ("permissive", ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"]),
    "MIT": ("permissive", ["MIT License", "MIT License (MIT)", "Expat License"]),
    "Apache-2.0": ("permissive", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License Version 2.0, January 2004"]),
    "AGPL-3.0": ("copyleft", ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU Affero General Public License Version 3, 19 November 2007", "AGPLv3 License"]),
    "LGPL-3.0": ("copyleft", ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License Version 3, 29 June 2007", "LGPLv3 License"]),
    "LGPL-2.1": ("copyleft", ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU Lesser General Public License Version 2.1, February 1999", "LGPLv2.1 License"]),
    "GPL-3.0": ("copyleft", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License Version 3, 29 June 2007", "GPLv3 License"]),
    "GPL-2.0": ("copyleft", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License Version 2, June 1991", "GPLv2 License"]),
    "MPL-2.0": ("copyleft", ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License Version 2.0"]),
    "EPL-2.0": ("copyleft", ["Eclipse Public License - v 2.0", "Eclipse Public License 2.0"]),
    "CC-BY-NC-4.0": ("restricted", ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"]),
    "CC-BY-ND-4.0": ("restricted", ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    "CC-BY-NC-SA-4.0": ("restricted", ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"]),
    "CC-BY-SA-4.0": ("copyleft", ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"]),
    "CC-BY-4.0": ("permissive", ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"]),
    "CC0-1.0": ("permissive", ["CC0 1.0", "CC0 1.0 Universal License"]),
    "ISC": ("permissive", ["ISC License"]),
    "Zlib": ("permissive", ["zlib License"]),
    "BSL-1.0": ("permissive", ["Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"]),
    "Unlicense": ("permissive", ["Unlicense"]),
    "BSD-style": ("permissive", ["BSD-style license", "BSD style license"]),
    "OFL-1.1": ("permissive", ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "SIL Open Font License Version 1.1 - 26 February 2007"]),
    "Artistic-2.0": ("permissive", ["Artistic License 2.0", "Artistic License, version 2.0"]),
    "CDDL-1.0": ("copyleft", ["Common Development and Distribution License (CDDL) Version 1.0", "Common Development and Distribution License, Version 1.0", "CDDL-1.0 License"]),
    "MPL-1.1": ("copyleft", ["Mozilla Public License Version 1.1", "Mozilla Public License, version 1.1", "Mozilla Public License 1.1 (MPL 1.1)"]),
    "EPL-1.0": ("copyleft", ["Eclipse Public License - v 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"]),
    "CC-BY-3.0": ("permissive", ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution 3.0 License"]),
    "CC-BY-SA-3.0": ("copyleft", ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike 3.0 License"]),
    "all-rights-reserved": ("restricted", []),
}
# fixed values: notices; a name is put into each
NOTICES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "License: {}", "The {}", "{}", "This project is licensed under the {}.",
    "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is licensed under the {}.",
)
# fixed values: sentences of licence texts, by identifier
SENTENCES = {
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is-upper": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "apache-comply": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-unless": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-license": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."],
    "gpl3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "lgpl3-grant": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl2-grant": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl3-grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "bsd-style": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file in the root directory of this source tree.", "Use of this source code is governed by a BSD style license that can be found in the LICENSE file."],
    "mit-style": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.", "Use of this source code is governed by a MIT style license that can be found in the LICENSE file."],
    "ofl-notice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "artistic-grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0)."],
    "cddl-notice": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")."],
    "cddl-comply": ["You may not use this file except in compliance with the License."],
    "mpl11-notice": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."],
    "epl10-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "reserved": ["All rights reserved."],
}
# fixed values: ordered rules (licence, identifiers in their order), most specific first
RULES = [
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-keep", "as-is-upper"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("Apache-2.0", ["apache-comply", "apache-copy", "apache-unless"]),
    ("Apache-2.0", ["apache-terms", "apache-license"]),
    ("Apache-2.0", ["apache-comply"]),
    ("AGPL-3.0", ["agpl3-grant"]),
    ("LGPL-3.0", ["lgpl3-grant"]),
    ("LGPL-2.1", ["lgpl2-grant"]),
    ("GPL-3.0", ["gpl3-grant", "gpl-warranty"]),
    ("GPL-2.0", ["gpl2-grant", "gpl-warranty"]),
    ("GPL-3.0", ["gpl3-grant"]),
    ("GPL-2.0", ["gpl2-grant"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Unlicense", ["unlicense"]),
    ("BSD-style", ["bsd-style"]),
    ("MIT", ["mit-style"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("Artistic-2.0", ["artistic-grant"]),
    ("CDDL-1.0", ["cddl-notice", "cddl-comply"]),
    ("CDDL-1.0", ["cddl-notice"]),
    ("MPL-1.1", ["mpl11-notice"]),
    ("EPL-1.0", ["epl10-notice"]),
    *[(name, [f"{name.lower()}-notice", "gpl-verbatim"]) for name in ("AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-3.0", "GPL-2.0")],
    ("all-rights-reserved", ["reserved"]),
]
RULES += [(name, [f"{name.lower()}-notice"]) for name, (_, names) in FAMILIES.items() if names]
# fixed values: a licence on the left covers those on the right
IMPLIED = {"BSD-4-Clause": ["BSD-3-Clause", "BSD-2-Clause"], "BSD-3-Clause": ["BSD-2-Clause"]}
# each within a word, since white space and punctuation between words may be any
HINTS = ("licen", "permission", "warranty", "copy", "redistribut", "reserved", "unencumbered", "endorse", "spdx", "reproduc", "advertis")
#: SPDX identifiers, lower case, and the licence they stand for
SPDX = {f"{name.lower()}{tail}": name for name in FAMILIES for tail in ("", *(("-only", "-or-later", "+") if "GPL" in name else ())) if name != "all-rights-reserved"}


def _normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def _known() -> dict[str, str]:
    """Normalised sentence -> identifier. A name is put into those notices that have a hint with it."""
    out = {_normal(s): name for name, sentences in SENTENCES.items() for s in sentences}
    for name, (_, names) in FAMILIES.items():
        for sentence in (_normal(notice.format(n)) for n in names for notice in NOTICES):
            if any(h in word for h in HINTS for word in sentence.split()):
                out.setdefault(sentence, f"{name.lower()}-notice")
    return out


KNOWN = _known()
# signs that begin comment lines, and numbers of list items; for Java and for RE2
COMMENT = r"^[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--|>+|dnl\b|REM\b)[ \t]?"
# a tag of HTML, and a clause with anybody's name in it, normalised, and the known sentence it stands for
TAG = r"</?[a-zA-Z][^<>]*>"
ENDORSE = r"^neither the names? of .+ nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission$"
ENDORSE_AS = _normal(SENTENCES["bsd-endorse"][0])
ITEM = r"\n[ \t]*\(?(?:[0-9]{1,2}|[a-z])[.)][ \t]+"


def _pattern(ids: list[str]) -> str:
    """Matches the blank-joined identifier sequence (with blanks around) that has ``ids`` in this order."""
    return " " + " (?:[^ ]+ )*".join(map(re.escape, ids)).replace("\\-", "-") + " "


def plain_lines(text: Column) -> Column:
    """Without comment signs at the beginnings of lines and without tags; list items stand behind a blank line, without their
    numbers."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?md)" + COMMENT, ""), TAG, ""), ITEM, "\n\n")


def sentences(text: Column, at_lines: bool) -> Column:
    """Normalised sentences of a text, in order; empty ones stay out."""
    ends = r"(?<=[.!?])[ \t\n\r\f]+(?=[^a-z0-9 \t\n\r\f])|(?<=[.!?])[ \t\r]*\n[ \t]*(?=[a-z])|" + (r"\n+" if at_lines else r"\n[ \t\n\r\f]*\n|(?<=:)[ \t\r]*\n")
    return F.filter(F.transform(F.split(text, ends), lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), ENDORSE, ENDORSE_AS)), lambda s: s != "")


def identifiers(pieces: Column) -> Column:
    """Identifiers of the known sentences among ``pieces``, in order. The table of sentences is a literal."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.filter(F.transform(pieces, lambda s: F.try_element_at(known, s)), lambda s: s.isNotNull())


def spdx_names(text: Column) -> Column:
    """Licences named in SPDX lines, whatever operators stand between them."""
    names = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    lines = F.array_join(F.regexp_extract_all(text, F.lit(r"SPDX(?:-License-Identifier)?:([^\n]*)"), F.lit(1)), " ")
    words = F.regexp_extract_all(lines, F.lit(r"[A-Za-z0-9+-]+(?:\.[A-Za-z0-9+-]+)*"), F.lit(0))
    return F.filter(F.transform(words, lambda w: F.try_element_at(names, F.lower(w))), lambda n: n.isNotNull())


def recognise(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with sentence_ids (the longer of the two readings), licenses (in the order of ``FAMILIES``) and license_use."""
    results = {"sentence_ids", "licenses", "license_use"}
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in results})
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    df = df.withColumn("_plain", plain_lines(F.when(F.lower(text).rlike("|".join(HINTS)), text).otherwise(F.lit(""))))
    whole, lines = (identifiers(sentences(F.col("_plain"), at_lines)) for at_lines in (False, True))
    df = df.withColumn("_whole", whole).withColumn("_lines", lines)
    readings = [F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")) for c in ("_whole", "_lines")]
    match = lambda ids: readings[0].rlike(_pattern(ids)) | readings[1].rlike(_pattern(ids))
    by_rule = F.filter(F.array(*[F.when(match(ids), F.lit(name)) for name, ids in RULES]), lambda x: x.isNotNull())
    by_rule = F.when((F.size("_whole") > 0) | (F.size("_lines") > 0), by_rule).otherwise(F.array().cast("array<string>"))
    found = F.array_intersect(F.array(*map(F.lit, FAMILIES)), F.concat(by_rule, spdx_names(F.col("_plain"))))
    for over, under in IMPLIED.items():
        found = F.when(F.array_contains(found, over), F.array_except(found, F.array(*map(F.lit, under)))).otherwise(found)
    df = df.withColumn("_found", found)
    df = df.withColumn("licenses", F.when(F.size("_found") > 1, F.array_remove("_found", "all-rights-reserved")).otherwise(F.col("_found")))
    order = ("restricted", "copyleft", "permissive")  # the narrowest use decides
    df = df.withColumn("sentence_ids", F.when(F.size("_lines") > F.size("_whole"), F.col("_lines")).otherwise(F.col("_whole")))
    of_use = lambda kind: F.array(*[F.lit(n) for n, (use, _) in FAMILIES.items() if use == kind])
    verdict = F.coalesce(*[F.when(F.arrays_overlap("licenses", of_use(kind)), F.lit(kind)) for kind in order], F.lit("none"))
    return df.withColumn("license_use", verdict).drop("_whole", "_lines", "_plain", "_found")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "license_use")


def _values(rows: list[tuple]) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in rows)


OP6_SQL = rf"""
with known(sentence, id) as (values {_values(list(KNOWN.items()))}),
rules(license, pattern) as (values {_values([(n, _pattern(ids)) for n, ids in RULES])}),
spdx(word, license) as (values {_values(list(SPDX.items()))}),
families(pos, license, use) as (values {_values([(i, n, use) for i, (n, (use, _)) in enumerate(FAMILIES.items())])}),
implied(over, under) as (values {_values([(a, b) for a, bs in IMPLIED.items() for b in bs])}),
plain as (select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m){COMMENT}', '', 'g'), '{TAG}', '', 'g'), '{ITEM}', chr(10) || chr(10), 'g') as t from documents),
ended as (select doc_id, regexp_replace(regexp_replace(t, '([.!?])[ \t\r]*\n[ \t]*([a-z])', '\1' || chr(1) || '\2', 'g'), '([.!?])[ \t\n\r\f]+([^a-z0-9 \t\n\r\f])', '\1' || chr(1) || '\2', 'g') as t from plain),
cut as (
  select doc_id, 0 as reading, string_split(regexp_replace(regexp_replace(t, '\n[ \t\n\r\f]*\n', chr(1), 'g'), ':[ \t\r]*\n', ':' || chr(1), 'g'), chr(1)) as ps from ended
  union all
  select doc_id, 1, string_split(regexp_replace(t, '\n+', chr(1), 'g'), chr(1)) from ended),
pieces as (select doc_id, reading, unnest(ps) as s, generate_subscripts(ps, 1) as i from cut),
hits as (select doc_id, reading, i, id from pieces join known on regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '{ENDORSE}', '{ENDORSE_AS}') = sentence),
seq as (select doc_id, reading, string_agg(id, ' ' order by i) as ids, count(*) as n from hits group by 1, 2),
named as (select doc_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(t, 'SPDX(?:-License-Identifier)?:([^\n]*)', 1), ' '), '[A-Za-z0-9+-]+(?:\.[A-Za-z0-9+-]+)*')) as w from plain),
matched as (select doc_id, license from seq join rules on regexp_matches(' ' || ids || ' ', pattern) union select doc_id, license from named join spdx on word = lower(w)),
kept as (select doc_id, license from matched m where not exists (select 1 from implied join matched o on o.license = over where under = m.license and o.doc_id = m.doc_id)),
alone as (select doc_id, license from kept k where license <> 'all-rights-reserved' or not exists (select 1 from kept o where o.doc_id = k.doc_id and o.license <> k.license)),
lic as (select doc_id, string_agg(license, ',' order by pos) as licenses, min(case use when 'restricted' then 0 when 'copyleft' then 1 else 2 end) as u from alone join families using (license) group by 1),
best as (select doc_id, replace(ids, ' ', ',') as sentence_ids from seq qualify row_number() over (partition by doc_id order by n desc, reading) = 1)
select d.doc_id, coalesce(sentence_ids, '') as sentence_ids, coalesce(licenses, '') as licenses,
       case u when 0 then 'restricted' when 1 then 'copyleft' when 2 then 'permissive' else 'none' end as license_use
from documents d left join best using (doc_id) left join lic using (doc_id)
"""
QUERIES = {"op6_license_scan": op6_license_scan}
SQL = {"op6_license_scan": OP6_SQL}
