"""Licence notices as they stand in files: wrapped at a fixed width, with and without comment marks."""

import pytest

from episodium.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Jo Doe

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Copyright (c) 2020, Jo Doe
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is as is.
"""
NOTICES = {
    "mit": (MIT, "MIT_NAME MIT_GRANT MIT_NOTICE MIT_AS_IS", "MIT", 0),
    "bsd": (BSD, "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ENDORSE", "BSD-3-Clause", 0),
    "bsd in brackets": (BSD.replace("1.", "(a)").replace("2.", "(b)").replace("3.", "(c)"),
                        "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ENDORSE", "BSD-3-Clause", 0),
    "gpl": (GPL, "GPL3_GRANT GPL_NO_WARRANTY GPL_COPY", "GPL-3.0-or-later", 0),
    "apache": (APACHE, "APACHE2_REF APACHE2_COMPLY APACHE2_COPY", "Apache-2.0", 0),
}
MARKS = ["", "# ", " * ", "// ", "-- ", ";; ", "\t"]


def test_wrapped_notices(spark):
    rows = []
    for name, (text, *_) in NOTICES.items():
        for k, mark in enumerate(MARKS):
            body = "".join(mark + line for line in text.splitlines(keepends=True))
            rows.append((f"{name}/{k}", f"/*\n{body} */\nimport os\n" if mark == " * " else body))
            rows.append((f"{name}/{k}/crlf", body.replace("\n", "\r\n")))
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    for r in licenses.recognise(frame).collect():
        _, ids, licence, unmatched = NOTICES[r["doc_id"].split("/")[0]]
        assert (r["sentence_ids"], r["licences"], r["unmatched"]) == (ids, licence, unmatched), r["doc_id"]


@pytest.mark.parametrize(
    "text, ids, n",
    [
        ("the mit license.\nall rights reserved", "MIT_NAME ALL_RIGHTS", 2),
        ("the mit\nlicense", "MIT_NAME", 2),
        ("the mit.\nlicense", "", 2),
        ("see the mit\nlicense", "", 2),
        ("the mit\nlicense text", "", 2),
        ("1 the mit license", "", 1),
        ("(1) the mit\n\n license", "MIT_NAME", 2),
        ("all rights reserved\n" * 3, "ALL_RIGHTS ALL_RIGHTS ALL_RIGHTS", 3),
        (" . \n .. \n", "", 0),
        (" \n" * 50000 + " " * 50000 + "mit license" + ". " * 50000, "MIT_NAME", 1),
    ],
)
def test_runs_of_lines(spark, text, ids, n):
    row = licenses.recognise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["sentence_ids"], row["n_sentences"]) == (ids, n)


FURTHER = {
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */""",
    "AGPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU Affero General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU Affero General Public License for more details.
#
# You should have received a copy of the GNU Affero General Public License
# along with this program.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "CC0-1.0": """To the extent possible under law, the author has dedicated all copyright
and related and neighboring rights to this software to the public domain worldwide.""",
    "GPL-2.0-or-later": "// SPDX-License-Identifier: GPL-2.0-or-later",
    "MIT": "/* SPDX-License-Identifier: MIT */",
    "BSD-3-Clause": "# SPDX-License-Identifier: BSD-3-Clause\nimport os",
    "": "The SPDX-License-Identifier: MIT line is missing.\nSPDX-License-Identifier: NotOne",
}


def test_further_notices(spark):
    rows = spark.createDataFrame(list(enumerate(FURTHER.values())), "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licenses.recognise(rows).collect()}
    assert [got[i] for i in range(len(FURTHER))] == list(FURTHER)
