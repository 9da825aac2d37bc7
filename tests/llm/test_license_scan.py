import math
import re
from collections import Counter

from helpers import SF, documents, duck, rows

from gleaner.llm import license_scan as S


def brute(files, least=0.75):
    idf, other, vectors = S.weights()
    own, paths = {}, {p for p, _ in files if p is not None}
    for p, t in files:
        if p is None:
            continue
        t = t or ""
        units = t.split("\n") + ([t] if re.match(S.LICENCE_FILE, p.rpartition("/")[2]) else [])
        for u in units:
            bag = Counter(re.findall(S.TERM, u.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
            v = {k: n * idf.get(k, other) for k, n in bag.items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            for (name, _), w in zip(S.TEMPLATES, vectors):
                score = round(sum(x * w.get(k, 0) for k, x in v.items()) / size, 6) if size else 0
                if score >= least:
                    own[p] = min(own.get(p, (0, "~")), (-score, name))
    given = {}
    for p, (s, name) in own.items():
        if re.match(S.LICENCE_FILE, p.rpartition("/")[2]):
            folder = p.rpartition("/")[0]
            given[folder] = min(given.get(folder, (1, "", "")), (s, name, p))
    out = []
    for p in paths:
        up = p.rpartition("/")[0]
        while up and up not in given:
            up = up.rpartition("/")[0]
        if p in own:
            out.append((p, own[p][1], -own[p][0], "own", None))
        elif up in given:
            out.append((p, given[up][1], -given[up][0], "inherited", up))
        else:
            out.append((p, None, None, "none", None))
    return sorted(out, key=repr)


FILES = [
    ("/a/LICENSE", "The MIT License (MIT)\n\n" + S.TEMPLATES[1][1] + ", including without limitation the rights to use"), ("/a/b/c/x.py", "print(1)"), ("/a/y.py", None),
    ("/a/b/COPYING.txt", "Licensed under the Apache License, Version 2.0."), ("/a/b/z.py", "code\n  RELEASED under the MIT license!\nmore"), ("/q/r.txt", ""), ("/ab/s.txt", "the of and to in any"),
    ("/q/long.txt", "word " * 50_000 + "\nLicensed under CC BY-NC 4.0."), (None, "Released under the MIT License."), ("/q/r.txt", ""), ("/n/license", "Licensed under CC BY 4.0.\nReleased under the MIT License."),
    ("/n/é.txt", "Licensed under é"),
]


def test_scan_equals_brute_force(spark):
    got = sorted(((r.path, r.licence, r.score, r.origin, r.found_in) for r in S.license_scan(documents(spark, FILES, "path string, text string")).collect()), key=repr)
    assert got == brute(FILES)
    assert {g[3] for g in got} == {"own", "inherited", "none"}
    assert S.license_scan(documents(spark, FILES, "path string, text string").limit(0)).count() == 0


def test_query_equals_sql(spark):
    assert rows(S.query(spark, SF)) == duck(S.SQL, SF)


def test_no_text_without_a_telling_term_reaches_the_score():
    _, _, vectors = S.weights()
    for least in (0.5, 0.75, 0.9):
        telling = set(S.telling_terms(vectors, least))
        for v in vectors:
            rest = math.sqrt(sum(x * x for t, x in v.items() if t not in telling))
            assert rest < least


GPL = "free software: you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = "Redistribution and use in source\nand binary forms, with or without\nmodification, are permitted provided\nthat the following conditions are met:\n\n1. Redistributions of source code must retain the above"
ISC = "Permission to use, copy, modify,\nand/or distribute this software\nfor any purpose with or without\nfee is hereby granted, provided that"
APACHE = "                              Apache License\n                        Version 2.0, January 2004\n                     http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE"
LGPL = "            GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."


def commented(text, mark):
    return "\n".join(mark + line for line in text.split("\n"))


def test_wrapped_notices_and_whole_texts_are_named(spark):
    code = "\nimport os\n\n\ndef f(x):\n    return os.path.join(x, 'a')\n" * 20
    gpl = lambda kind, v: commented("This program is " + GPL.format(kind, v), "# ") + code
    files = [
        ("/g/a.py", "#!/bin/sh\n#\n" + gpl("General Public License", "3"), "GPL-3.0"),
        ("/g/b.py", gpl("General Public License", "2"), "GPL-2.0"),
        ("/g/c.py", gpl("Lesser General Public License", "3"), "LGPL-3.0"),
        ("/g/d.py", gpl("Affero General Public License", "3"), "AGPL-3.0"),
        ("/m/LICENSE", MIT, "MIT"),
        ("/m/deep/x.py", code, "MIT"),
        ("/h/x.c", "/*\n" + commented(MIT, " * ") + "\n */" + code, "MIT"),
        ("/h/y.c", "/*\n" + commented(BSD, " * ") + "\n */" + code, "BSD-3-Clause"),
        ("/h/z.js", commented(ISC, "// ") + code, "ISC"),
        ("/h/w.js", commented("Licensed under the\nApache License,\nVersion 2.0", "// ") + code, "Apache-2.0"),
        ("/l/COPYING", LGPL, "LGPL-3.0"),
        ("/p/LICENSE", APACHE, "Apache-2.0"),
        ("/q/none.py", code, None),
        ("/q/words.py", "permission\nsoftware\nlicense\nversion\n" + code, None),
    ]
    got = {r.path: r for r in S.license_scan(documents(spark, [f[:2] for f in files], "path string, text string")).collect()}
    assert {p: got[p].licence for p, _, _ in files} == {p: name for p, _, name in files}
    assert got["/m/deep/x.py"].origin == "inherited" and got["/m/deep/x.py"].found_in == "/m"
    assert got["/g/a.py"].score > 0.99 and got["/m/LICENSE"].score > 0.9


def test_tags_name_licences(spark):
    rows = [("/a/1.c", "// SPDX-License-Identifier: Apache-2.0\nint x;"), ("/a/2.py", "# spdx-license-identifier: GPL-3.0-or-later"), ("/a/3.c", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */"),
            ("/a/4.c", "SPDX-License-Identifier: Nobody-1.0"), ("/a/5.c", "SPDX-License-Identifier:"), ("/a/6.c", None), ("/b/LICENSE", "SPDX-License-Identifier: BSD-2-Clause"), ("/b/c/7.c", "x"),
            ("/a/8.c", "SPDX-License-Identifier: LGPL-2.1+ and more"), ("/a/9.c", "Apache-2.0")]
    docs = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.origin) for r in S.license_scan(docs).collect()}
    assert got == {
        "/a/1.c": ("Apache-2.0", "own"), "/a/2.py": ("GPL-3.0", "own"), "/a/3.c": ("MIT", "own"), "/a/4.c": (None, "none"), "/a/5.c": (None, "none"), "/a/6.c": (None, "none"),
        "/b/LICENSE": ("BSD-2-Clause", "own"), "/b/c/7.c": ("BSD-2-Clause", "inherited"), "/a/8.c": ("LGPL-2.1", "own"), "/a/9.c": (None, "none"),
    }
