import pytest

from brindle.llm import licenses


def test_a_hint_stands_within_a_word_of_every_known_sentence():
    for sentence in licenses.KNOWN:
        assert any(hint in word for hint in licenses.HINTS for word in sentence.split()), sentence


@pytest.mark.parametrize("gap", ["\n", "  ", "\t", "\u00a0", " -- ", "\r\n * "])
def test_wrapped_sentences(spark, gap):
    texts = ["All rights reserved.", "This is free and unencumbered software released into the public domain."]
    rows = [(i, gap.join(text.split(" "))) for i, text in enumerate(texts)]
    out = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in out} == {0: ["all-rights-reserved"], 1: ["Unlicense"]}


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Copyright (c) 2020, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
MIT = """The MIT License (MIT)

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
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
CASES = [
    (APACHE, ["Apache-2.0"], "permissive"), (BSD, ["BSD-2-Clause"], "permissive"), (BSD + ENDORSE, ["BSD-3-Clause"], "permissive"), (MIT, ["MIT"], "permissive"), (LGPL, ["LGPL-2.1"], "copyleft"),
]


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "-- ", "; ", "> "])
def test_real_headers_behind_comment_signs(spark, prefix):
    texts = ["\n".join((prefix + line).rstrip() for line in text.split("\n")) for text, *_ in CASES]
    texts += ["some code\n\n" + t + "\n\nmore code" for t in texts]
    out = licenses.recognise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["licenses"], r["license_use"]) for r in out}
    assert got == {i: tuple(CASES[i % len(CASES)][1:]) for i in range(len(texts))}


def test_expressions_and_notices(spark):
    cases = [
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"], "permissive"), ("// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0"], "copyleft"),
        ("SPDX: ISC.", ["ISC"], "permissive"), ("All rights reserved.\nReleased under the MIT License.", ["MIT"], "permissive"), ("All rights reserved.", ["all-rights-reserved"], "restricted"),
        ("Some words about a licence and nothing else.", [], "none"), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright", ["GPL-3.0"], "copyleft"),
    ]
    out = licenses.recognise(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["licenses"], r["license_use"]) for r in out} == {i: (names, use) for i, (_, names, use) in enumerate(cases)}


REAL = [
    ("""/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.  You may obtain a copy of the License at
 *
 *    http://www.apache.org/licenses/LICENSE-2.0
 */
package org.example;""", ["Apache-2.0"], "permissive"),
    ("""// Copyright 2009 The Authors. All rights reserved.
// Use of this source code is governed by a BSD-style
// license that can be found in the LICENSE file.
package main""", ["BSD-style"], "permissive"),
    (BSD + """3. Neither the name of Example Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
""", ["BSD-3-Clause"], "permissive"),
    ("""<p>This work is licensed under a <a rel="license" href="http://creativecommons.org/licenses/by/3.0/">Creative Commons Attribution 3.0 Unported License</a>.</p>""", ["CC-BY-3.0"], "permissive"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below", ["OFL-1.1"], "permissive"),
    ("""The contents of this file are subject to the terms of the
Common Development and Distribution License (the "License").
You may not use this file except in compliance with the License.""", ["CDDL-1.0"], "copyleft"),
    ("""The contents of this file are subject to the Mozilla Public License Version
1.1 (the "License"); you may not use this file except in compliance with
the License.""", ["MPL-1.1"], "copyleft"),
    ("Licensed under the Eclipse Public License v1.0.", ["EPL-1.0"], "copyleft"),
    ("""                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.""", ["GPL-3.0"], "copyleft"),
    ("Copyright Someone.\nAll rights reserved.", ["all-rights-reserved"], "restricted"),
]


def test_headers_of_real_files(spark):
    out = licenses.recognise(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(REAL)], "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["licenses"], r["license_use"]) for r in out}
    for i, (text, found, use) in enumerate(REAL):
        assert got[i] == (found, use), text
