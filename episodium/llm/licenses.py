"""Licence recognition by sentences and rules.

A text is cut into sentences, each normalised to lower-case words.  Known sentences become
identifiers, also where they are wrapped at a fixed width or stand behind comment marks; the document's sequence of identifiers is then matched against ordered rules, longer
ones first.  A rule uses up the sentences it matches.  All in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium.llm.common import column, fold

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT_REF",
    "licensed under the mit license": "MIT_REF",
    "this project is licensed under the mit license": "MIT_REF",
    "the mit license": "MIT_NAME",
    "mit license": "MIT_NAME",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT_AS_IS",
    "licensed under the apache license version 2 0": "APACHE2_REF",
    "licensed under the apache license version 2 0 the license": "APACHE2_REF",
    "apache license version 2 0": "APACHE2_NAME",
    "you may not use this file except in compliance with the license": "APACHE2_COMPLY",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE2_COPY",
    "this work is licensed under the gnu general public license version 3": "GPL3_REF",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3_GRANT",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2_GRANT",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_NO_WARRANTY",
    "you should have received a copy of the gnu general public license along with this program": "GPL_COPY",
    "licensed under cc by nc 4 0": "CC_BY_NC4_REF",
    "licensed under cc by 4 0": "CC_BY4_REF",
    "licensed under cc by sa 4 0": "CC_BY_SA4_REF",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC_BY4_REF",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "all rights reserved": "ALL_RIGHTS",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE2_AS_IS",
    "this source code form is subject to the terms of the mozilla public license v": "MPL2_TERMS",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2_COPY",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "MPL2_COPY",
    "licensed under the mozilla public license version 2 0": "MPL2_REF",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21_GRANT",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPL3_GRANT",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LGPL_NO_WARRANTY",
    "you should have received a copy of the gnu lesser general public license along with this library": "LGPL_COPY",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3_GRANT",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPL_COPY",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC_AS_IS",
    "this is free and unencumbered software released into the public domain": "UNLICENSE_PUBLIC",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UNLICENSE_FREE",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0_DEDICATE",
    "to the extent possible under law the authors have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "CC0_DEDICATE",
}
# Licences that a line "SPDX-License-Identifier: ..." may name.
SPDX = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "MPL-2.0", "Unlicense",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-4.0",
]
SENTENCES |= {
    "spdx license identifier " + name.lower().replace("-", " ").replace(".", " "): "SPDX_" + name.upper() for name in SPDX
}
# Licences and the identifier sequences that show them, in order of precedence.
RULES = [
    ("MIT", ["MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS"]),
    ("GPL-3.0-or-later", ["GPL3_GRANT", "GPL_NO_WARRANTY", "GPL_COPY"]),
    ("GPL-2.0-or-later", ["GPL2_GRANT", "GPL_NO_WARRANTY", "GPL_COPY"]),
    ("BSD-3-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE"]),
    ("BSD-2-Clause", ["BSD_GRANT", "BSD_SOURCE", "BSD_BINARY"]),
    ("LGPL-2.1-or-later", ["LGPL21_GRANT", "LGPL_NO_WARRANTY", "LGPL_COPY"]),
    ("LGPL-3.0-or-later", ["LGPL3_GRANT", "LGPL_NO_WARRANTY", "LGPL_COPY"]),
    ("AGPL-3.0-or-later", ["AGPL3_GRANT", "GPL_NO_WARRANTY", "AGPL_COPY"]),
    ("Apache-2.0", ["APACHE2_REF", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_AS_IS"]),
    ("MPL-2.0", ["MPL2_TERMS", "MPL2_COPY"]),
    ("ISC", ["ISC_GRANT", "ISC_AS_IS"]),
    ("Unlicense", ["UNLICENSE_PUBLIC", "UNLICENSE_FREE"]),
    ("Apache-2.0", ["APACHE2_REF", "APACHE2_COMPLY", "APACHE2_COPY"]),
    ("Apache-2.0", ["APACHE2_REF"]),
    ("Apache-2.0", ["APACHE2_NAME"]),
    ("MIT", ["MIT_REF"]),
    ("MIT", ["MIT_NAME"]),
    ("GPL-3.0-only", ["GPL3_REF"]),
    ("GPL-3.0-or-later", ["GPL3_GRANT"]),
    ("GPL-2.0-or-later", ["GPL2_GRANT"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC4_REF"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA4_REF"]),
    ("CC-BY-4.0", ["CC_BY4_REF"]),
    ("LGPL-2.1-or-later", ["LGPL21_GRANT"]),
    ("LGPL-3.0-or-later", ["LGPL3_GRANT"]),
    ("AGPL-3.0-or-later", ["AGPL3_GRANT"]),
    ("MPL-2.0", ["MPL2_TERMS"]),
    ("MPL-2.0", ["MPL2_REF"]),
    ("ISC", ["ISC_GRANT"]),
    ("Unlicense", ["UNLICENSE_PUBLIC"]),
    ("CC0-1.0", ["CC0_DEDICATE"]),
    ("Proprietary", ["ALL_RIGHTS"]),
]

RULES += [(name, ["SPDX_" + name.upper()]) for name in SPDX]

#: What is neither letter, digit, white space nor a full stop is dropped; "-", "/" and ":" part words.
_PARTING, _NOISE = "[-/:_]", r"[^\p{L}\p{N}. \t\n\x0b\x0c\r]"
_END = r"[.]+([ \t\n\x0b\x0c\r]|\z)"
#: A full stop that ends a sentence; a line end only may, so it stays as it is.
_STOP = "\x02"
#: A number or letter before an item of a list.
_MARK = r"(?:[0-9]{1,2}|[a-d]|i{1,3}|iv)[ \n]"


def normalised(text: Column) -> Column:
    """The words of a text, parted by blanks, line ends and ``_STOP``, one of them each time.

    A sentence ends at full stops before white space or the end; a line end is the end of a sentence
    or a blank inside one.  Of a line end and full stops in a row the full stops count.
    """
    plain = F.regexp_replace(F.regexp_replace(fold(text), _PARTING, " "), _NOISE, "")
    for pattern, to in (
        (_END, _STOP),
        (r"[ \t\x0b\x0c\r.]+", " "),
        (r" ?\n ?", "\n"),
        (rf" ?{_STOP} ?", _STOP),
        (r"\n+", "\n"),
        (rf"\n?{_STOP}[\n{_STOP}]*", _STOP),
    ):
        plain = F.regexp_replace(plain, pattern, to)
    return F.btrim(plain)


def _any_of(known: Mapping[str, str]) -> str:
    """A pattern of the known sentences, on one line or on several in a row.

    Sentences are grouped by their first word, so that most places are ruled out by few tries; of one
    group the longest comes first.
    """
    groups: dict[str, list[list[str]]] = {}
    for sentence in sorted(known, key=len, reverse=True):
        first, *rest = sentence.split(" ")
        groups.setdefault(first, []).append(rest)

    def rest_of(words: list[str]) -> str:
        return "".join(rf"[ \n]\Q{word}\E" for word in words)

    options = [rf"\Q{first}\E(?:{'|'.join(map(rest_of, rests))})" for first, rests in groups.items()]
    return rf"(?<![^\n{_STOP}])(?:{_MARK})?(?:{'|'.join(options)})(?![^\n{_STOP}])"


def recognise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    known: Mapping[str, str] | None = None,
    rules: Sequence[tuple[str, Sequence[str]]] | None = None,
) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences, unmatched) for every row of ``docs``.

    ``n_sentences`` counts pieces between line ends or full stops.  A known sentence is looked up in
    whole pieces, on one line or on several in a row without a full stop between them, the longest
    from a piece on; on several lines it may follow a list mark.

    ``sentence_ids`` is the sequence of identifiers, joined by blanks; sentences that are not known
    have none.  ``licences`` lists each licence found once, in rule order, joined by blanks;
    ``unmatched`` counts identifiers that no rule used.  Null and empty texts have no sentence.
    ``known`` and ``rules`` are literals, meant for a few hundred entries.
    """
    known = SENTENCES if known is None else known
    rules = RULES if rules is None else rules
    known = {sentence: name for sentence, name in known.items() if sentence}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
    rows = docs.select(
        column(docs, id_col).alias("doc_id"), normalised(column(docs, text_col)).alias("words")
    )

    def name_of(run: Column) -> Column:
        one = F.translate(run, "\n", " ")
        unmarked = F.when(F.contains(run, F.lit("\n")), F.regexp_replace(one, f"^{_MARK}", ""))
        return F.coalesce(F.try_element_at(table, one), F.try_element_at(table, unmarked))

    ids = (
        F.filter(
            F.transform(F.regexp_extract_all("words", F.lit(_any_of(known)), F.lit(0)), name_of),
            lambda x: x.isNotNull(),
        )
        if known
        else F.array().cast("array<string>")
    )
    pieces = F.filter(F.split("words", f"[\n{_STOP}]"), lambda s: s != "")
    rows = rows.select("doc_id", F.size(pieces).cast("long").alias("n_sentences"), ids.alias("ids"))
    marked = F.concat(F.lit(" "), F.array_join(F.transform("ids", lambda x: F.concat(x, F.lit(" "))), " "))
    start = F.struct(marked.alias("left"), F.array().cast("array<string>").alias("found"))
    steps = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(seq) + " ").alias("seq"))
            for name, seq in rules
        ]
    )
    if rules:
        done = F.aggregate(
            steps,
            start,
            lambda acc, r: F.struct(
                F.replace(acc["left"], r["seq"], F.lit("|")).alias("left"),
                F.when(
                    F.contains(acc["left"], r["seq"]), F.concat(acc["found"], F.array(r["name"]))
                )
                .otherwise(acc["found"])
                .alias("found"),
            ),
        )
    else:
        done = start
    rows = rows.withColumn("done", done)
    return rows.select(
        "doc_id",
        "n_sentences",
        F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join(F.array_distinct("done.found"), " ").alias("licences"),
        F.size(F.filter(F.split(F.translate("done.left", "|", " "), " +"), lambda x: x != ""))
        .cast("long")
        .alias("unmatched"),
    )
