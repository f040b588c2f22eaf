"""Standard licence texts as they are wrapped in files, through the registered query."""

import random
import re
import textwrap

from siftwell.llm import license_data, licenses, queries

MIT = [
    "MIT License", "Copyright (c) 2024 Some One",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
]
ISC = ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""


AGPL = [x.replace("GNU General", "GNU Affero General") for x in GPL]
LGPL = [x.replace("This program", "This library").replace("software:", "software;").replace("GNU General", "GNU Lesser General").replace("Foundation, either version 3", "Foundation; either version 2.1") for x in GPL]


def wrapped(parts, width=72, mark=""):
    return "\n".join(mark + line for part in parts for line in [*textwrap.wrap(part, width), ""])


def test_wrapped_texts(spark, tmp_path):
    cases = [
        (wrapped(MIT), "MIT"), (wrapped(MIT, 40, " * "), "MIT"), (wrapped(MIT[:4]), "MIT-partial"), (wrapped(BSD), "BSD-2-Clause"), (wrapped([*BSD, BSD3], 60, "// "), "BSD-3-Clause"),
        (wrapped(GPL, 65, "    "), "GPL-3.0-or-later"), (wrapped(ISC), "ISC"), (APACHE, "Apache-2.0-header"), (MPL, "MPL-2.0"), (wrapped(MIT).replace("\n", "\r\n"), "MIT"),
        ("some words without an end\nAll rights reserved.\nmore words", "all-rights-reserved"), ("SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"), ("This project is licensed under\nthe BSD 3-Clause License.", "BSD-3-Clause-reference"), (wrapped(AGPL, 70), "AGPL-3.0-or-later"), (wrapped(LGPL), "LGPL-2.1-or-later"), ("text\nReleased under the MIT License.\nAll rights reserved.", "MIT-reference,all-rights-reserved"),
        ("The work is\nnot all rights reserved here", ""), ("All rights reserved by us", ""), ("", ""), (None, ""),
    ]
    spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_license_scan(spark, str(tmp_path)).collect()}
    assert {i: got[i].licenses for i in got} == {i: want for i, (_, want) in enumerate(cases)}
    assert got[0].sequence == "|MIT_GRANT||MIT_NOTICE||MIT_WARRANTY|" and got[0].n_sentences == 3


def slow_scan(text):
    """Known sentences by definition: at each line, the longest one that some number of lines makes whole."""
    table = licenses.SENTENCES | licenses.LONGER
    text = re.sub(r"\b([vV])\.[ \t\n\f\r]+(?=[0-9])", r"\1 ", text or "")
    ids, most = [], max(len(k.split()) for k in table)
    for sentence in re.split(r"[.!?]+[ \t\n\f\r]+", text):
        lines = [x for x in (license_data.normal(y) for y in re.split(r"[\n\r]+", sentence)) if x]
        for i in range(len(lines)):
            known = [k for k in (" ".join(lines[i:j]) for j in range(i + 1, min(len(lines), i + most) + 1)) if k in table]
            if known:
                ids.append(table[max(known, key=len)])
    names = {}
    for family, name, want in licenses.RULES:
        rest = iter(ids)
        if family not in names and all(x in rest for x in want):
            names[family] = name
    return len(ids), "".join(f"|{x}|" for x in ids), ",".join(sorted(names.values()))


def test_scan_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    known = [t for _, t in license_data.TEXTS] + [s + v + n for _, names in license_data.NAMES for n in names for s in license_data.SUBJECTS[:3] for v in license_data.VERBS[:2]]
    texts = []
    for _ in range(150):
        parts = [rng.choice([rng.choice(known), "Some other sentence of no known kind", "the above copyright notice"]) + rng.choice([".", ".", "", ":"]) for _ in range(rng.randrange(1, 9))]
        texts.append(rng.choice([" ", "\n", "\n\n"]).join(wrapped([x], rng.choice([30, 60, 500]), rng.choice(["", "# "])) for x in parts))
    texts.append("\n".join(["filler words here"] * 3_000 + ["Released under the MIT License."] + ["more filler"] * 3_000))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_sentences, r.sequence, r.licenses) for r in queries.op8_license_scan(spark, str(tmp_path)).collect()}
    assert got == {i: slow_scan(t) for i, t in enumerate(texts)}
