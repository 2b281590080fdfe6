import math
import re
from collections import Counter

import pytest
import regex

from hirelens.llm import licenses as L


def words(text):
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def brute(docs, least=L.LEAST):
    """{doc_id: (licence, score, passage)} by dense cosines of every passage and template."""
    passages = []
    for doc, text in docs:
        run = []
        for line in [*re.split(r"\r\n|[\n\r\x0b\x0c\x85  ]", text or ""), ""]:
            if re.search(L.CUE, line):
                run.append(line)
            elif run:
                passages.append((doc, " ".join(run)))
                run = []
        for p in regex.split(L.GAP, text or ""):
            if re.search(L.CUE, p) and not all(re.search(L.CUE, x) for x in re.split(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]", p)):
                passages.append((doc, p))
    df, n = Counter(t for _, p in passages for t in set(words(p))), len(passages)
    vector = lambda p: {t: c * (math.log((n + 1) / (df[t] + 1)) + 1) for t, c in Counter(words(p)).items()}
    best = {}
    for doc, p in passages:
        a = vector(p)
        for licence, wording in L.TEMPLATES:
            b = vector(wording)
            dot = sum(w * b.get(t, 0) for t, w in a.items())
            norm = math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
            s = round(dot / norm, 6) if norm else 0
            if s >= least and s > best.get(doc, ("", 0))[1]:
                best[doc] = (licence, s, p)
    return best


DOCS = [
    (1, "src/LICENSE", "MIT License\nLicensed under the MIT License.\n"),
    (2, "src/a/one.c", "Code here and some more of it\nLicensed under the Apache License, Version 2.0.\nmore code again\n"),
    (3, "src/a/two.c", "no notice at all"),
    (4, "src/b/c/three.c", None),
    (5, "src/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (6, "other/four.c", "nothing"),
    (7, "top.c", ""),
    (8, None, "Licensed under CC BY-NC 4.0.\n" + "word " * 5000),
    (9, "src/b/five.c", "licensed under   the gnu general public LICENSE,\r\nversion 2\ntext text text text"),
    (10, "src/a/six.c", "All rights reserved. Nothing else is a license of use here, or a copyright of ours\n\nCopyright holders only"),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*d, 0.5) for d in DOCS], "doc_id bigint, path string, text string, score double")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    best = brute([(d, t) for d, _, t in DOCS])
    assert set(got) == {d for d, *_ in DOCS}
    for doc, *_ in DOCS:
        if doc in best:
            assert (got[doc].licence, got[doc].origin) == (best[doc][0], "notice")
            assert got[doc].score == pytest.approx(best[doc][1], abs=1e-5)
        else:
            assert got[doc].score is None and got[doc].origin != "notice"
    assert [(got[k].licence, got[k].origin, got[k].from_dir) for k in (3, 4, 6, 7)] == [("MIT", "inherited", "src"), ("GPL-3.0", "inherited", "src/b"), (None, "none", None), (None, "none", None)]


def test_edges(spark):
    schema = "doc_id bigint, path string, text string"
    assert L.scan(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "LICENSE", "All rights reserved."), (1, "LICENSE", "All rights reserved."), (None, "x/LICENSE", "All rights reserved."), (2, "deep/er/file", None), (3, None, "plain"), (4, "d/LICENSE", "not a notice"), (5, "d/x", "long " * 200_000)]
    got = {r.doc_id: (r.licence, r.origin, r.from_dir) for r in L.scan(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("Proprietary", "notice", None), 2: ("Proprietary", "inherited", ""), 3: (None, "none", None), 4: ("Proprietary", "inherited", ""), 5: ("Proprietary", "inherited", "")}
    assert L.scan(spark.createDataFrame([(1, "a/b", "none"), (2, "a/c", None)], schema)).count() == 2


AS_IS = "\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.\n"
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
HEADER = """/*
 * Copyright 2001 Somebody
 *
 * This {what} is free software{a} you can redistribute it and/or modify
 * it under the terms of the GNU {name} as published by
 * the Free Software Foundation{b} either version {version} of the License, or
 * (at your option) any later version.
 *
 * This {what} is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY.
 */
int main() { return 0; }
"""


def header(**x):
    out = HEADER
    for k, v in x.items():
        out = out.replace("{" + k + "}", v)
    return out


FILES = {
    "MIT": f"The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n{MIT}\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.{AS_IS}",
    "BSD-3-Clause": BSD + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission." + AS_IS,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + BSD + AS_IS,
    "Apache-2.0": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n",
    "GPL-2.0": header(what="program", a=";", b=";", name="General Public License", version="2"),
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
    "LGPL-2.1": header(what="library", a=";", b=";", name="Lesser General Public License", version="2.1"),
    "AGPL-3.0": header(what="program", a=":", b=",", name="Affero General Public License", version="3"),
}


def test_licence_files(spark):
    """The usual wording, wrapped, commented and in paragraphs; the rest of a directory inherits from a file named LICENSE."""
    rows = [(k, f"{name}/LICENSE", text) for k, (name, text) in enumerate(FILES.items())] + [(100 + k, f"{name}/src/x.c", "int x;") for k, name in enumerate(FILES)]
    got = {r.path: r.licence for r in L.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {f"{name}/{x}": name for name in FILES for x in ("LICENSE", "src/x.c")}
