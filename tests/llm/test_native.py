"""Chat formatting, line deduplication and licence scans, against plain Python."""

import random

import pyarrow as pa
import pytest

from tessella.llm import chat_format, common, license_scan, line_dedup

DOCS = "doc_id long, text string, lang string, TEXT2 string"


def chats(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    seqs = {c: tuple((r, t) for _, r, t in sorted(ts)) for c, ts in convs.items()}
    out = {}
    for c, s in seqs.items():
        same = [d for d, z in seqs.items() if z == s]
        if c == min(same) and not any(len(z) > len(s) and z[: len(s)] == s for z in seqs.values()):
            out[c] = (len(s), len(same), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in s))
    return out


def test_chats_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        base = [("user" if i % 2 == 0 else "assistant", f"t{c % 4}.{i}") for i in range(8)]
        n = rng.randint(1, 8)
        rows += [(c, i + (5 if c % 3 == 0 else 0), r, t) for i, (r, t) in enumerate(base[:n])]
    rows += [(70, 1, "user", "x"), (70, 1, "user", "x"), (70, None, None, None), (71, 1, "a", "b"), (71, 1, "a", "a"), (None, 0, "user", "lost")]
    rows += [(80, i, "user", f"long {i}") for i in range(0, 3000, 7)]  # over several blocks
    rows += [(81, i, "user", f"long {i}") for i in range(0, 2000, 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat_format.format_chats(df).collect()}
    assert got == chats(rows)
    assert chat_format.format_chats(df.limit(0)).collect() == []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # conversations over several tasks, one turn number or none throughout
        hot = [(1, None, "user", f"same {i}") for i in range(400)] + [(2, 7, "user", f"same {i}") for i in range(400)] + [(3, None, "user", f"same {i}") for i in range(401)]
        got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["rendered"]) for r in chat_format.format_chats(spark.createDataFrame(hot, "conv_id long, turn long, role string, text string")).collect()}
        assert got == chats(hot)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def dedup(rows):
    """{(doc_id, text): text that is left}"""
    keys = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = {}, {k: set() for k in keys}
    for k in keys:
        ls = [x.strip(" \t\r") for x in k[1].split("\n")]
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if w == ("", "", ""):
                continue
            if w in seen:
                gone[k] |= {i, i + 1, i + 2}
            else:
                seen[w] = k
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone[k]) if gone[k] else k[1] for k in keys}


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(12)] + ["", " "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14))) for _ in range(40)] + ["", None, "a\na\na\na\na", "\n\n\n\n", "x\ny", "w " * 60000 + "\nb\nc\nd"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "n\nn2\nn3\nn4")]
    df = spark.createDataFrame([(i, t, "en", "other") for i, t in rows], DOCS)
    want = dedup(rows)
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    found = got.collect()
    assert len(found) == len(rows)
    assert sorted(((r[0], r[1]) for r in found), key=repr) == sorted([(i, None if t is None else want[i, t]) for i, t in rows], key=repr)
    assert line_dedup.dedup_lines(df.limit(0)).collect() == []
    assert {r["n_removed"] for r in line_dedup.line_report(df.where("doc_id = 42")).collect()} == {4}


@pytest.mark.parametrize(
    ("text", "licenses"),
    [
        ("Words.\nReleased under the MIT License.", "MIT:notice"),
        ("LICENSED under the Apache License, Version 2.0.", "Apache-2.0:notice"),
        ("Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the License. Other words here. You may obtain a copy of the License at", "Apache-2.0:header"),
        ("You may obtain a copy of the License at\nYou may not use this file except in compliance with the License.", ""),
        ("Licensed under CC BY-NC 4.0.\nAll rights reserved.\nAll rights reserved!", "CC-BY-NC-4.0:notice,Proprietary:notice"),
        ("", ""), (None, ""), ("word " * 50000, ""),
    ],
)
def test_licenses(spark, text, licenses):
    df = spark.createDataFrame([(1, text, "x", "y"), (1, text, "x", "y"), (None, text, None, None)], DOCS)
    rows = license_scan.scan_licenses(df).collect()
    assert [r["licenses"] for r in rows] == [licenses] * 3


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


BSD3 = BSD + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
"""
LGPL = GPL.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("GNU\nGeneral", "GNU\nLesser General").replace("version 3", "version 2.1")
MORE = [
    (BSD3, "BSD-3-Clause:text"), (ISC, "ISC:text"), (ISC.partition(", provided")[0] + ".", "0BSD:text"), (ZLIB, "Zlib:text"), (EPL, "EPL-2.0:header"), (UNLICENSE, "Unlicense:text"), (LGPL, "LGPL-2.1:header"), (GPL.replace("version 3", "version 2"), "GPL-2.0:header"),
    (GPL.replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU\nAffero General"), "AGPL-3.0:header"), ("Apache License\n   Version 2.0, January 2004\n", "Apache-2.0:title"), ("SPDX-License-Identifier: Apache-2.0\n\nint x;", "Apache-2.0:tag"),
    ("SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0-or-later:tag"), (BSD3 + "\nSPDX-License-Identifier: MIT\n" + BSD, "BSD-3-Clause:text,BSD-2-Clause:text,MIT:tag"),
]


@pytest.mark.parametrize(("text", "licenses"), [*MORE, (MIT, "MIT:text"), (BSD, "BSD-2-Clause:text"), (GPL, "GPL-3.0:header"), (APACHE, "Apache-2.0:header"), ("Code.\n\nThis work is licensed under the GNU Lesser\nGeneral Public License version 3.\n", "LGPL-3.0:notice")])
def test_wrapped_licenses(spark, text, licenses):
    hashes = "".join(f"# {x}\n" for x in text.split("\n"))
    stars = "/*\r\n" + "".join(f" * {x}\r\n" for x in text.split("\n")) + " */\r\nint x;"
    one = " ".join(text.split())
    rows = license_scan.scan_licenses(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate((text, hashes, stars, one))], DOCS)).collect()
    assert [r["licenses"] for r in sorted(rows)] == [licenses] * 4


def test_one_line_notices_are_whole_lines(spark):
    texts = ["Not released under the MIT License", "Licensed under CC BY 4.0\nand more words", "This is licensed\nunder CC BY 4.0."]
    rows = license_scan.scan_licenses(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)).collect()
    assert [r["licenses"] for r in sorted(rows)] == ["", "CC-BY-4.0:notice", ""]


def test_native_plans_have_no_python(spark, monkeypatch):
    """Neither the last plan nor any whose rows are stored on the way."""
    seen = []

    def watched(df, kind):
        seen.append(df)
        return common.stored(df, kind)

    for module in (chat_format, line_dedup):
        monkeypatch.setattr(module, "stored", watched)
    df = spark.createDataFrame([(1, "a\nb\nc\nd", "x", "y")], DOCS)
    chat = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    seen += [line_dedup.line_report(df), line_dedup.dedup_lines(df), license_scan.scan_licenses(df), chat_format.format_chats(chat)]
    assert len(seen) == 8
    for out in seen:
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_every_sentence_has_a_stem():
    assert not [i for i, x in license_scan.SENTENCES.items() if not any(t in w for t in license_scan.STEMS for w in x.split())]
    assert {i for _, _, seq in license_scan.RULES for i in seq} <= set(license_scan.SENTENCES)


def test_sql_says_the_same(spark):
    """Nulls, repeats, long texts and one-line notices in the SQL that the driver compares with."""
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", "a\nb\nc\nd", "a\nb\nc\nd", "\n\n\n", "a\na\na\na", "Released under the MIT License.\nx", "All rights reserved", "w " * 50000 + "\nb\nc\nd", "b\nc\nd"]
    documents = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})  # noqa: F841
    df = spark.createDataFrame([(i, t, "x", "spans") for i, t in enumerate(texts)], "doc_id long, text string, sentence_ids string, licenses string")
    chat = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, None, None, None), (3, None, "x", "y"), (None, 1, "u", "v"), (4, 0, "user", "a"), (4, 1, "bot", "b"), (4, 1, "bot", "b"), (5, 0, "user", "w " * 60000)]
    conversations = pa.table({n: pa.array([r[k] for r in chat], t) for k, (n, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])})  # noqa: F841
    made = spark.createDataFrame(chat, "conv_id long, turn long, role string, text string")
    for out, sql in ((line_dedup.line_report(df), line_dedup.ORACLE), (license_scan.scan_licenses(df), license_scan.oracle()), (chat_format.format_chats(made), chat_format.ORACLE)):
        found = duckdb.connect().execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(map(tuple, out.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)
