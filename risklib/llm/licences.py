"""Operator 6: licence scans by sentence rules.

A text is cut into sentences in two views: every line on its own, and lines
joined (for sentences that wrap; end marks and blank lines bound them). Each sentence is normalised (lower case, one
space between words, punctuation other than inner dots removed; marks that
known sentences hold end none) and mapped to the identifier of a known licence sentence. The sequence of identifiers is then
matched against ordered rules, most specific first; a matched part is consumed,
so that a general rule does not also fire on it. Licence-like sentences that
are unknown (in a line, or broken over two), or identifiers that no rule takes, make the scan ``unknown``.

All of it is one projection: known sentences are a fixed set tested by hash,
nothing is exploded, joined or shuffled.

Cases: null and empty texts have no sentences and status ``none``; repeated
sentences are matched each but a licence is named once; ties between rules go
to the earlier rule; very long texts are processed whole; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklib.llm.common import let

#: Known licence sentences, normalised: sentence -> identifier. Fixed values.
SENTENCES = {
    "licensed under the apache license version 2.0": "ApacheRef",
    "licensed under the apache license version 2.0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed"
    " on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "spdx license identifier apache 2.0": "SpdxApache",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "the mit license mit": "MitTitle",
    "mit license": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "spdx license identifier mit": "SpdxMit",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 3 of the license or at your option any"
    " later version": "Gpl3Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 2 of the license or at your option any"
    " later version": "Gpl2Grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu general public license for more details": "GplSee",
    "spdx license identifier gpl 3.0 or later": "SpdxGpl3Later",
    "spdx license identifier gpl 3.0 only": "SpdxGpl3",
    "licensed under cc by nc 4.0": "CcByNc4",
    "licensed under cc by 4.0": "CcBy4",
    "licensed under cc by sa 4.0": "CcBySa4",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CcByNc4",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CcBySa4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
    " following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission": "BsdNames",
    "all rights reserved": "AllRights",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "Mpl2Ref",
}

#: Ordered rules: licence, identifier sequence (each item one identifier; '?' after it: may be absent). Fixed values.
RULES = (
    ("Apache-2.0", "ApacheRef ApacheUse ApacheCopy? ApacheWarranty? ApacheSee?"),
    ("MIT", "MitTitle? AllRights? MitGrant MitNotice MitWarranty?"),
    ("GPL-3.0-or-later", "Gpl3Grant GplWarranty? GplSee?"),
    ("GPL-2.0-or-later", "Gpl2Grant GplWarranty? GplSee?"),
    ("BSD-3-Clause", "AllRights? BsdGrant BsdSource BsdBinary BsdNames"),
    ("BSD-2-Clause", "AllRights? BsdGrant BsdSource BsdBinary"),
    ("Apache-2.0", "SpdxApache"), ("MIT", "SpdxMit"), ("GPL-3.0-only", "SpdxGpl3"), ("GPL-3.0-or-later", "SpdxGpl3Later"),
    ("Apache-2.0", "ApacheRef"), ("MIT", "MitRef"), ("MIT", "MitTitle"),
    ("GPL-3.0-only", "Gpl3Ref"), ("GPL-2.0-only", "Gpl2Ref"),
    ("CC-BY-NC-4.0", "CcByNc4"), ("CC-BY-SA-4.0", "CcBySa4"), ("CC-BY-4.0", "CcBy4"),
    ("Unlicense", "Unlicense"), ("MPL-2.0", "Mpl2Ref"), ("Proprietary", "AllRights"),
)
#: A sentence with one of these, and not known, is licence-like. Fixed values.
HINTS = r"\b(licensed under|license version|license identifier|hereby granted|redistribution and use)\b"


#: Marks after these words are inside known sentences and end none.
INNER_MARKS = r"\b(license identifier|is free software|software foundation|any warranty|license v) ?[.;:](?=[ \n\u0002])"
#: A hint whose words are on two lines, joined by JOIN.
JOIN = "\u0002"
BROKEN_HINTS = (r"\b(licensed\u0002under|license\u0002version|license\u0002identifier|hereby\u0002granted"
                r"|redistribution\u0002and[ \u0002]use|redistribution and\u0002use)\b")


def sentences(text: Column, wrapped: bool) -> Column:
    """Normalised sentences; ``wrapped`` joins lines by JOIN (blank lines still cut)."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), JOIN, " ")
    if wrapped:
        t = F.regexp_replace(F.regexp_replace(t, r"\n[ \t\r]*(?=\n)", "\u0001"), r"\n", JOIN)
        t = F.translate(t, "\u0001", "\n")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n\u0002.!?;:]+", " ")
    if wrapped:
        t = F.regexp_replace(t, r" ?\u0002[ \u0002]*", JOIN)
    t = F.regexp_replace(t, INNER_MARKS, "$1")
    return F.filter(F.split(t, r"[ \u0002]?(?:[.!?;:]+(?=[ \n\u0002]|$)|\n)[ \u0002.!?;:\n]*"), lambda s: s != "")


def known_ids(sents: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    table = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    clean = F.transform(F.filter(sents, lambda s: F.trim(s).isin(*SENTENCES)), lambda s: F.trim(s))
    return F.transform(clean, lambda s: F.element_at(table, s))


def rule_pattern(rule: str) -> str:
    """The rule as a pattern over ',Id,Id,' (each identifier followed by a comma)."""
    return "(?<=,)" + "".join(f"(?:{x[:-1]},)?" if x.endswith("?") else f"{x}," for x in rule.split())


def match_rules(ids: Column) -> Column:
    """Licences of an identifier sequence: struct(licenses in rule order, left: identifiers no rule took)."""
    seq = F.concat(F.lit(","), F.concat_ws(",", ids), F.lit(","))
    found = []
    state = seq
    for licence, rule in RULES:
        p = rule_pattern(rule)
        found.append((licence, p))
        state = F.regexp_replace(state, p, f"<{licence}>,")
    return let(state, lambda s: F.struct(
        F.array_distinct(F.regexp_extract_all(s, F.lit("<([^>]+)>"), F.lit(1))).alias("licenses"),
        F.filter(F.split(s, ","), lambda x: (x != "") & ~x.startswith("<")).alias("left")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, n_unknown, status for every row of ``docs`` (doc_id, text)."""
    s = docs.select("doc_id", sentences(F.col("text"), False).alias("lines"), sentences(F.col("text"), True).alias("broken"))
    s = s.select("*", F.transform("broken", lambda x: F.translate(x, JOIN, " ")).alias("joined"))
    ids = s.select("doc_id", F.size("lines").cast("long").alias("n_sentences"), known_ids(F.col("lines")).alias("line_ids"),
                   known_ids(F.col("joined")).alias("joined_ids"),
                   (F.size(F.filter("lines", lambda x: x.rlike(HINTS) & ~F.trim(x).isin(*SENTENCES)))
                    + F.size(F.filter("broken", lambda x: x.rlike(BROKEN_HINTS) & ~F.trim(F.translate(x, JOIN, " ")).isin(*SENTENCES)))
                    ).cast("long").alias("n_like"))
    empty = F.size("line_ids") + F.size("joined_ids") == 0
    none = F.array().cast("array<string>")
    got = ids.select("*", F.when(empty, F.lit(None)).otherwise(match_rules(F.col("line_ids"))).alias("a"),
                     F.when(empty, F.lit(None)).otherwise(match_rules(F.col("joined_ids"))).alias("b"))
    lic = F.when(empty, none).otherwise(F.array_sort(F.array_union("a.licenses", "b.licenses")))
    unknown = F.col("n_like") + F.when(empty, 0).otherwise(F.size("a.left"))
    out = got.select("doc_id", "n_sentences", F.when(F.size("line_ids") >= F.size("joined_ids"), F.col("line_ids"))
                     .otherwise(F.col("joined_ids")).alias("sentence_ids"), lic.alias("licenses"),
                     unknown.cast("long").alias("n_unknown"))
    return out.withColumn("status", F.when(F.size("licenses") > 0, "known").when(F.col("n_unknown") > 0, "unknown")
                          .otherwise("none"))
