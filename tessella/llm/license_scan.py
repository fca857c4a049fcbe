"""License scans by sentence rules.

Texts are normalised: A-Z in lower case, runs of other characters than a-z and 0-9 as one blank, and between the
words a mark where a sentence ends (full stops, exclamation and question marks before white space or the text's end,
and lines without words) and another where a line ends. Known licence sentences become identifiers where they are

- all that stands between two ends of either kind (one-line notices),
- all that stands between two ends of sentences, lines within joined (wrapped notices), or
- for the long ones of ``WITHIN``, anywhere, whatever ends lie within and whatever stands before and behind: in
  licence files they are wrapped, numbered, and joined by semicolons and colons.

The identifiers of a text, in order, are matched against rules, in the rules' order: a rule holds where its identifiers
stand next to one another in what earlier rules left of that sequence, and takes them out of it; unknown sentences may
stand between them. So a rule that says more stands before those that it holds (BSD-3-Clause before BSD-2-Clause), and
each sentence serves one rule. The SQL knows the first kind of sentence only, so it says the same where no known
sentence is wrapped or part of another. Texts without any of ``STEMS``, one of which each sentence has, aren't looked at.

DataFrame functions only; no shuffle. Defined results: null and empty texts have no sentence and no licence; a row
gives a row, repeated rows too; doc_id is passed on as it is; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import narrow

#: Known licence sentences, normalised, by identifier.
SENTENCES = {
    "mit.ref": "released under the mit license",
    "mit.ref2": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "apache.ref": "licensed under the apache license version 2 0",
    "apache.head": "licensed under the apache license version 2 0 the license",
    "apache.use": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at",
    "apache.asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3.ref": "this work is licensed under the gnu general public license version 3",
    "gpl2.ref": "this work is licensed under the gnu general public license version 2",
    "gpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21.free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl3.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl.details": "see the gnu lesser general public license for more details",
    "agpl.details": "see the gnu affero general public license for more details",
    "gpl3.title": "gnu general public license version 3 29 june 2007",
    "gpl2.title": "gnu general public license version 2 june 1991",
    "lgpl3.title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21.title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3.title": "gnu affero general public license version 3 19 november 2007",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl.details": "see the gnu general public license for more details",
    "lgpl.ref": "this work is licensed under the gnu lesser general public license version 3",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.ref": "released under the bsd license",
    "mpl.ref": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc0.ref": "licensed under cc0 1 0",
    "ccby.ref": "licensed under cc by 4 0",
    "ccbysa.ref": "licensed under cc by sa 4 0",
    "ccbync.ref": "licensed under cc by nc 4 0",
    "ccbynd.ref": "licensed under cc by nd 4 0",
    "unlicense.ref": "this is free and unencumbered software released into the public domain",
    "unlicense.free": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "apache.ref2": "licensed under the apache license 2 0",
    "apache.name": "apache license 2 0",
    "apache.title": "apache license version 2 0 january 2004",
    "mpl.title": "mozilla public license version 2 0",
    "epl2.terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl1.terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "bsd.endorse": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib.use": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost.grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "reserved": "all rights reserved",
}
#: Licences whose SPDX tag is known, each as one more sentence and rule.
TAGGED = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
SENTENCES |= {f"spdx.{x}": "spdx license identifier " + x.lower().replace("-", " ").replace(".", " ") for x in TAGGED}
#: One word's part, at least, of each sentence.
STEMS = ("licens", "permission", "permit", "distribut", "reserved", "unencumbered", "cc0", "anyone", "materials")
#: Rules in their order: licence, form, and the identifiers in theirs.
RULES = [
    ("BSD-3-Clause", "text", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("Apache-2.0", "header", ["apache.head", "apache.use", "apache.copy"]),
    ("BSD-2-Clause", "text", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("AGPL-3.0", "header", ["agpl3.free", "gpl.hope", "agpl.details"]),
    ("GPL-2.0", "header", ["gpl2.free", "gpl.hope", "gpl.details"]),
    ("GPL-3.0", "header", ["gpl3.free", "gpl.hope", "gpl.details"]),
    ("LGPL-2.1", "header", ["lgpl21.free", "lgpl.hope", "lgpl.details"]),
    ("LGPL-3.0", "header", ["lgpl3.free", "lgpl.hope", "lgpl.details"]),
    ("MIT", "text", ["mit.grant", "mit.notice"]),
    ("Unlicense", "text", ["unlicense.ref", "unlicense.free"]),
    ("0BSD", "text", ["0bsd.grant"]),
    ("AGPL-3.0", "title", ["agpl3.title"]),
    ("Apache-2.0", "notice", ["apache.name"]),
    ("Apache-2.0", "notice", ["apache.ref"]),
    ("Apache-2.0", "notice", ["apache.ref2"]),
    ("Apache-2.0", "title", ["apache.title"]),
    ("BSD", "notice", ["bsd.ref"]),
    ("BSL-1.0", "text", ["boost.grant"]),
    ("CC-BY-4.0", "notice", ["ccby.ref"]),
    ("CC-BY-NC-4.0", "notice", ["ccbync.ref"]),
    ("CC-BY-ND-4.0", "notice", ["ccbynd.ref"]),
    ("CC-BY-SA-4.0", "notice", ["ccbysa.ref"]),
    ("CC0-1.0", "notice", ["cc0.ref"]),
    ("EPL-1.0", "header", ["epl1.terms"]),
    ("EPL-2.0", "header", ["epl2.terms"]),
    ("GPL-2.0", "notice", ["gpl2.ref"]),
    ("GPL-2.0", "title", ["gpl2.title"]),
    ("GPL-3.0", "notice", ["gpl3.ref"]),
    ("GPL-3.0", "title", ["gpl3.title"]),
    ("ISC", "text", ["isc.grant"]),
    ("LGPL-2.1", "title", ["lgpl21.title"]),
    ("LGPL-3.0", "notice", ["lgpl.ref"]),
    ("LGPL-3.0", "title", ["lgpl3.title"]),
    ("MIT", "notice", ["mit.ref"]),
    ("MIT", "notice", ["mit.ref2"]),
    ("MPL-2.0", "notice", ["mpl.ref"]),
    ("MPL-2.0", "title", ["mpl.title"]),
    ("Proprietary", "notice", ["reserved"]),
    ("Unlicense", "notice", ["unlicense.ref"]),
    ("Zlib", "text", ["zlib.use"]),
    *((x, "tag", [f"spdx.{x}"]) for x in TAGGED),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences that no other text holds by chance, longer ones first: all but one-line notices.
NOTICES = ("mit.ref", "mit.ref2", "apache.ref", "apache.ref2", "apache.name", "gpl3.ref", "gpl2.ref", "gpl.details", "lgpl.ref", "lgpl.details", "agpl.details", "bsd.ref", "cc0.ref", "ccby.ref", "ccbysa.ref", "ccbync.ref", "ccbynd.ref", "unlicense.ref", "mpl.title", "reserved")
WITHIN = tuple(sorted((i for i in SENTENCES if i not in NOTICES), key=lambda i: (-len(SENTENCES[i]), i)))
#: Where a sentence ends: after a mark, and at lines without words (line ends are line feeds, letters in lower case).
ENDS = r"[.!?]+[ \t\n]+|\n[^a-z0-9]*\n"
#: Marks between words: the end of a sentence, the end of a line.
END, LINE = "E", "L"


def _pattern() -> str:
    """Matches known sentences in a normalised text; of those that begin at one place, the longest first."""
    words = {i: x.split() for i, x in sorted(SENTENCES.items(), key=lambda x: -len(x[1]))}
    within = "|".join(f"(?: [{END}{LINE}])* ".join(words[i]) for i in WITHIN)
    one_line = "|".join(" ".join(w) for i, w in words.items() if i not in WITHIN)
    wrapped = "|".join(f"(?: {LINE})* ".join(w) for i, w in words.items() if i not in WITHIN)
    return f"(?<= )(?:{within})(?= )|(?<=[{END}{LINE}] )(?:{one_line})(?= [{END}{LINE}])|(?<={END} |{END} {LINE} )(?:{wrapped})(?= (?:{LINE} )*{END})"


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known licence sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    lines = F.regexp_replace(low, r"\r\n?", "\n")
    marked = F.replace(F.regexp_replace(lines, ENDS, f" {END} "), F.lit("\n"), F.lit(f" {LINE} "))
    norm = F.concat(F.lit(f"{END} "), F.trim(F.regexp_replace(marked, f"[^a-z0-9{END}{LINE}]+", " ")), F.lit(f" {END}"))
    found = F.regexp_extract_all(norm, F.lit(_pattern()), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, f" [{END}{LINE}](?= )", "")))
    return F.when(low.rlike("|".join(STEMS)), ids).otherwise(F.array().cast("array<string>"))


def _labels(ids: Column) -> Column:
    """``licence:form`` of each rule that holds, in the rules' order. ids: identifiers joined by blanks."""
    rules = F.array(*[F.struct(F.lit(f"{name}:{form}").alias("label"), F.lit("".join(f" {i} " for i in seq)).alias("seq")) for name, form, seq in RULES])
    start = F.struct(F.concat(F.lit(" "), F.replace(ids, F.lit(" "), F.lit("  ")), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("hits"))
    step = lambda a, r: F.struct(F.replace(a["rest"], r["seq"], F.lit(" | ")).alias("rest"), F.when(F.contains(a["rest"], r["seq"]), F.array_append(a["hits"], r["label"])).otherwise(a["hits"]).alias("hits"))
    return F.when(ids == "", F.array().cast("array<string>")).otherwise(F.aggregate(rules, start, step, lambda a: F.array_distinct(a["hits"])))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (joined by blanks), n_sentences, licenses (``licence:form`` of each rule that holds, joined by commas)."""
    rows = narrow(docs, doc_id="long", text="string").select("doc_id", F.array_join(sentence_ids(F.col("text")), " ").alias("sentence_ids"))
    n = F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", " ")))
    return rows.select("doc_id", "sentence_ids", n.cast("int").alias("n_sentences"), F.array_join(_labels(F.col("sentence_ids")), ",").alias("licenses"))


def oracle() -> str:
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for i, s in SENTENCES.items()) + "}"
    seqs = ["".join(f" {i} " for i in seq) for _, _, seq in RULES]
    rests = ", ".join(f"replace(r{k}, '{seq}', ' | ') AS r{k + 1}" for k, seq in enumerate(seqs))
    labels = list(dict.fromkeys(f"{name}:{form}" for name, form, _ in RULES))
    holds = {n: " OR ".join(f"r{k} <> r{k + 1}" for k, (a, b, _) in enumerate(RULES) if f"{a}:{b}" == n) for n in labels}
    rules = ", ".join(f"CASE WHEN {holds[n]} THEN '{n}' END" for n in labels)
    return f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \\t\\r]+|[.!?]*[\\r\\n]+'),
    lambda x: map_extract({known}, trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')))[1]), lambda y: y IS NOT NULL) AS ids FROM documents),
j AS (SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS sentence_ids, len(ids)::INT AS n_sentences FROM s),
r AS (SELECT *, ' ' || replace(sentence_ids, ' ', '  ') || ' ' AS r0, {rests} FROM j)
SELECT doc_id, sentence_ids, n_sentences, array_to_string(list_filter([{rules}], lambda z: z IS NOT NULL), ',') AS licenses FROM r
"""
