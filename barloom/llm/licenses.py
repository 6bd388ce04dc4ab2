"""License recognition by sentences.

A text is cut into sentences, each is normalised and looked up among the known
licence sentences, and the identifiers found, in text order, are matched against
ordered rules: the first rule whose sequence occurs names a licence and uses its
sentences up, then the next rule is tried on what is left. A licence tag line
names its licence directly. All is built-in expressions; only texts with one of
the trigger words, of which every known sentence has one, are cut at all.

Defined cases: null, empty and unlicensed texts have no sentences and empty
lists; repeated rows are scanned each; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: normalised sentences of public licences and of the notices that name them
SENTENCES = {
    "mit_name": ["mit license", "the mit license", "the mit license mit"],
    "mit_ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache_ref": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "this project is licensed under the apache license version 2.0", "released under the apache license version 2.0"],
    "apache_limit": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at http www.apache.org licenses license-2.0", "you may obtain a copy of the license at"],
    "apache_as_is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd2_ref": ["licensed under the bsd 2-clause license", "released under the bsd 2-clause license"],
    "bsd3_ref": ["licensed under the bsd 3-clause license", "released under the bsd 3-clause license"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "gpl3_ref": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2_ref": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"],
    # a stop within a public wording cuts it, so its parts are the known ones; "this program is free software" goes before these
    "gpl3_later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2_later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl3_version": ["either version 3 of the license or at your option any later version"],
    "gpl2_version": ["either version 2 of the license or at your option any later version"],
    "gpl_warranty": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl_implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_copy": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl_terms": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "lgpl21_version": ["either version 2.1 of the license or at your option any later version"],
    "lgpl21_later": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"],
    "lgpl3_later": ["you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl_warranty": ["this library is distributed in the hope that it will be useful but without any warranty"],
    "lgpl_copy": ["you should have received a copy of the gnu lesser general public license along with this library", "you should have received a copy of the gnu lesser general public license along with this program"],
    "agpl_terms": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "agpl3_later": ["you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl_copy": ["you should have received a copy of the gnu affero general public license along with this program"],
    "zlib_as_is": ["this software is provided as-is without any express or implied warranty"],
    "zlib_liable": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "epl2_ref": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0",
                 "this program and the accompanying materials are made available under the terms of the eclipse public license v2.0 which accompanies this distribution and is available at https www.eclipse.org legal epl-v20.html"],
    "bsd_as_is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd_liable": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
                   "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"],
    "isc_as_is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "lgpl_ref": ["licensed under the gnu lesser general public license version 2.1", "licensed under the gnu lesser general public license version 3"],
    "mpl_ref": ["this source code form is subject to the terms of the mozilla public license v", "this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "cc0_ref": ["this work is dedicated to the public domain under cc0 1.0", "this work is licensed under cc0 1.0 universal public domain dedication"],
    "ccby_ref": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "ccbysa_ref": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "ccbync_ref": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
#: Ordered rules: a licence and the sentences that must follow one another (among the known ones).
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_as_is", "liability"]), ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache_ref", "apache_limit", "apache_copy", "apache_as_is", "apache_see"]), ("Apache-2.0", ["apache_ref", "apache_limit", "apache_copy"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_name"]), ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl3_later", "gpl_warranty", "gpl_implied", "gpl_copy"]), ("GPL-2.0-or-later", ["gpl2_later", "gpl_warranty", "gpl_implied", "gpl_copy"]),
    ("GPL-3.0-or-later", ["gpl_terms", "gpl3_version", "gpl_warranty", "gpl_implied", "gpl_copy"]), ("GPL-2.0-or-later", ["gpl_terms", "gpl2_version", "gpl_warranty", "gpl_implied", "gpl_copy"]),
    ("GPL-3.0-or-later", ["gpl3_later"]), ("GPL-2.0-or-later", ["gpl2_later"]), ("GPL-3.0-or-later", ["gpl_terms", "gpl3_version"]), ("GPL-2.0-or-later", ["gpl_terms", "gpl2_version"]),
    ("LGPL-2.1-or-later", ["lgpl_terms", "lgpl21_version"]), ("LGPL-3.0-or-later", ["lgpl_terms", "gpl3_version"]), ("LGPL-2.1-or-later", ["lgpl21_later"]), ("LGPL-3.0-or-later", ["lgpl3_later"]),
    ("AGPL-3.0-or-later", ["agpl_terms", "gpl3_version"]), ("AGPL-3.0-or-later", ["agpl3_later"]),
    ("Zlib", ["zlib_as_is", "zlib_liable", "zlib_grant"]), ("EPL-2.0", ["epl2_ref"]), ("ISC", ["isc_grant"]),
    ("MIT", ["mit_name"]), ("MIT", ["mit_ref"]), ("Apache-2.0", ["apache_ref"]), ("BSD-2-Clause", ["bsd2_ref"]), ("BSD-3-Clause", ["bsd3_ref"]),
    ("GPL-3.0-only", ["gpl3_ref"]), ("GPL-2.0-only", ["gpl2_ref"]), ("LGPL", ["lgpl_ref"]), ("MPL-2.0", ["mpl_ref"]),
    ("CC0-1.0", ["cc0_ref"]), ("CC-BY-4.0", ["ccby_ref"]), ("CC-BY-SA-4.0", ["ccbysa_ref"]), ("CC-BY-NC-4.0", ["ccbync_ref"]), ("Unlicense", ["unlicense"]),
]
TRIGGER = "[Ll][Ii][Cc][Ee][Nn][SsCc][Ee]|[Cc][Oo][Pp][Yy]|[Ww][Aa][Rr][Rr][Aa][Nn][Tt]|[Pp][Uu][Bb][Ll][Ii][Cc]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr][Ii][Bb]|[Pp][Ee][Rr][Mm][Ii][Ss][Ss][Ii][Oo][Nn]|[Dd][Aa][Mm][Aa][Gg][Ee]"
TAG = "SPDX-License-Identifier:[\\x20\\x09]*([A-Za-z0-9.+-]+)"
#: A line break with the comment mark that may open the next line.
BREAK = "\\n[\\x20\\x09]*(?:#|//|[*]|--)?[\\x20\\x09]*"
#: Sentences end at a stop before a blank, at an empty line, and after a copyright line.
STOP = "[.;:!?][\\x20\\x09-\\x0D]+"
COPYRIGHT = "(?m)^([^\\n]*[Cc]opyright (?:[(][Cc][)]|\u00a9|[0-9])[^\\n]*)\\n"


def normal(sentence: Column) -> Column:
    """Lower case, runs of other characters than a-z 0-9 . - as one blank, no stop or blank at either end."""
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9.-]+", " "), F.lit(" .-"))


def sentences(text: Column) -> Column:
    """A text's sentences; they may run over lines, with comment marks taken out."""
    plain = F.regexp_replace(text, BREAK, "\n")
    return F.split(F.regexp_replace(F.regexp_replace(plain, "\\n\\n+", ".\n"), COPYRIGHT, "$1.\n"), STOP)


def recognise(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, known sentences in order, licences in order of their place, tags, and how many other sentences speak of a licence."""
    known = {s: name for name, all_ in SENTENCES.items() for s in all_}
    lookup = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has = docs.select("doc_id", t.alias("t")).select("doc_id", F.when(F.rlike("t", F.lit(TRIGGER)), F.col("t")).alias("t"))
    none = F.array().cast("array<string>")
    cut = has.select("doc_id", F.coalesce(sentences(F.col("t")), none).alias("raw"), F.coalesce(F.regexp_extract_all("t", F.lit(TAG), F.lit(1)), none).alias("tags"))
    # a sentence that isn't known as a whole is looked up line by line
    parts = F.transform("raw", lambda x: F.when(F.element_at(lookup, normal(x)).isNotNull(), F.array(normal(x))).otherwise(F.transform(F.split(x, "\n"), normal)))
    cut = cut.select("doc_id", "tags", F.flatten(parts).alias("all"))
    named = cut.select("doc_id", "tags", F.filter(F.transform("all", lambda x: F.element_at(lookup, x)), lambda x: x.isNotNull()).alias("ids"),
                       F.size(F.filter("all", lambda x: F.rlike(x, F.lit("licen[sc]e")) & F.element_at(lookup, x).isNull())).cast("long").alias("n_unknown"))
    # identifiers as ;a;;b;;c; so that a rule's sequence is a plain substring
    chain = F.concat_ws("", F.transform("ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))))
    chain = reduce(lambda c, rule: F.replace(c, F.lit("".join(f";{x};" for x in rule[1])), F.lit(f"<{rule[0]}>")), RULES, chain)
    found = F.array_distinct(F.regexp_extract_all("chain", F.lit("<([^>]+)>"), F.lit(1)))
    return named.select("doc_id", "ids", "tags", "n_unknown", chain.alias("chain")).select(
        "doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_union(found, F.col("tags")), ",").alias("licenses"), "n_unknown")
