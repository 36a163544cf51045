"""Licence scans by sentence rules (operator 6).

A text's sentences are normalised (lower case, letters and digits only) and
looked up in a fixed table of licence sentences, which gives each an
identifier.  A licence is found where the identifiers of one of its rules
follow one another in order, at most ``GAP`` sentences apart.  A match that lies
within a longer one of another licence counts as part of that one (the first
two clauses of a three-clause text are no two-clause licence).  The name of a
holder in a no-endorsement clause may be any.  Sentences may
be wrapped over lines, also below a line that is no sentence, or stand on a
line of their own without a full stop.

Everything is DataFrame functions; the table is a broadcast of fixed size.
Null or empty text has no sentence.  Repeated rows are scanned each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 6

# Sentences of public licence texts and notices, rule by rule.
RULES = (
    ("MIT", ("Released under the MIT License.",)),
    ("MIT", ("Licensed under the MIT License.",)),
    ("MIT", ("SPDX-License-Identifier: MIT",)),
    ("MIT", ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
             "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
             "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
             "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
             "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.")),
    ("ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
             "provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0.",)),
    ("Apache-2.0", ("SPDX-License-Identifier: Apache-2.0",)),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0 (the \"License\");",
                    "you may not use this file except in compliance with the License.",
                    "You may obtain a copy of the License at")),
    ("BSD-2-Clause", ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
                      "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                      "disclaimer in the documentation and/or other materials provided with the distribution.")),
    ("BSD-3-Clause", ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
                      "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                      "disclaimer in the documentation and/or other materials provided with the distribution.",
                      "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                      "derived from this software without specific prior written permission.")),
    ("BSD-3-Clause", ("SPDX-License-Identifier: BSD-3-Clause",)),
    ("GPL-3.0", ("This work is licensed under the GNU General Public License, version 3.",)),
    ("GPL-3.0", ("SPDX-License-Identifier: GPL-3.0-only",)),
    ("GPL-3.0", ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",)),
    ("GPL-2.0", ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                 "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",)),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.",)),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0.",)),
    ("CC-BY-4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License.",)),
    ("CC0-1.0", ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",)),
)

_RULES_OF_SPDX = ("0BSD", "AGPL-3.0", "Artistic-2.0", "BSD-2-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0",
                  "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")
_GNU = (("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"),
        ("AGPL-3.0", "GNU Affero General Public License", "3"), ("GPL-3.0", "GNU General Public License", "3"),
        ("GPL-2.0", "GNU General Public License", "2"))
_CREATIVE = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
             ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
             ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))


def _notices() -> list[tuple[str, tuple[str, ...]]]:
    """Rules that follow a form: identifier lines, notices of the GNU licences
    (with ``;`` or ``:``, for a program or a library), Creative Commons licences."""
    out = [(name, (f"SPDX-License-Identifier: {name}{end}",)) for name in _RULES_OF_SPDX
           for end in (("-only", "-or-later") if "GPL" in name else ("",))]
    for name, licence, version in _GNU:
        for thing in ("program", "library"):
            out += [(name, (f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the {licence} as published by "
                            f"the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version.",))
                    for mark, stop in ((":", ","), (";", ";"))]
    for code, words in _CREATIVE:
        out += [(f"CC-{code}-4.0", (text,)) for text in (
            f"Licensed under CC {code} 4.0.", f"This work is licensed under CC {code} 4.0.", f"This work is licensed under a Creative Commons {words} 4.0 International License.",
            f"This work is licensed under the Creative Commons {words} 4.0 International License.")]
    return out


# More sentences of public licence texts.
RULES += (
    ("Zlib", ("This software is provided 'as-is', without any express or implied warranty.",
              "In no event will the authors be held liable for any damages arising from the use of this software.",
              "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
              "and redistribute it freely, subject to the following restrictions:")),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",
                   "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
                   "a compiled binary, for any purpose, commercial or non-commercial, and by any means.")),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0.",)),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",)),
)
RULES += tuple(r for r in _notices() if r not in RULES)
_HINT = "(?i)licen[sc]e|permission|redistribut|free software|unencumbered|copyright"
#: A sentence or clause ends before blank space, or with its paragraph.
_END = r"(?<=[.!?:;])\s+|\n\s*\n"
#: A line of comment marks only, which is an empty line of the comment.
_EMPTY = r"(?m)^[ \t]*[*/#;%!<>|-]+[ \t\r]*$"
_OTHER = r"[^\p{L}\p{N}]+"
#: The holder's name in a no-endorsement clause, in normal form.
_HOLDER = (r"^neither the names? of .+? nor the names? of (?:its|any|the|their) contributors? may be used",
           "neither the name of the copyright holder nor the names of its contributors may be used")


def plain(sentence: str) -> str:
    """The normal form, as the columns have it."""
    return re.sub(*_HOLDER, re.sub(r"[\W_]+", " ", sentence.lower()).strip())


def _table() -> tuple[list[tuple[str, int]], list[tuple[str, list[int]]]]:
    """Sentence identifiers, and rules as identifier sequences.  A sentence of
    the table that has several sentences by the splitting above is cut alike."""
    ids: dict[str, int] = {}
    rules = []
    for name, sentences in RULES:
        parts = [plain(p) for s in sentences for p in re.split(_END, s)]
        rules.append((name, [ids.setdefault(p, len(ids)) for p in parts if p]))
    return list(ids.items()), rules


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), _OTHER, " ")), *_HOLDER)


_SPANS = "array<struct<a:int,b:int>>"


def _matches(hits: Column, rule: Column) -> Column:
    """Spans (first and last sentence) where the rule's identifiers follow one
    another in the ordered hits."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.array().cast(_SPANS).alias("spans"))

    def step(s: Column, h: Column) -> Column:
        follows = (h["id"] == F.get(rule, s["at"])) & ((s["at"] == 0) | (h["i"] - s["last"] <= GAP))
        begins = (h["id"] == F.get(rule, F.lit(0))) & (~follows | (s["at"] == 0))
        at = F.when(follows, s["at"] + 1).when(begins, 1).otherwise(s["at"])
        first = F.when(begins, h["i"]).otherwise(s["first"])
        done = at == F.size(rule)
        found = F.when(done, F.array(F.struct(first.alias("a"), h["i"].alias("b")))).otherwise(F.array().cast(_SPANS))
        return F.struct(F.when(done, 0).otherwise(at).alias("at"), first.alias("first"),
                        F.when(follows | begins, h["i"]).otherwise(s["last"]).alias("last"), F.concat(s["spans"], found).alias("spans"))

    return F.aggregate(hits, start, step)["spans"]


_FOUND = "array<struct<a:int,b:int,n:int,name:string>>"


def _found(hits: Column, rules: list[tuple[str, list[int]]]) -> Column:
    """Matches of all rules: span, sentences of the rule, licence.  The rules are
    one array of fixed size; those whose first sentence is missing are passed over."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, rule)).alias("ids")) for name, rule in rules])
    near = F.filter(table, lambda r: F.exists(hits, lambda h: h["id"] == F.get(r["ids"], F.lit(0))))
    return F.flatten(F.transform(near, lambda r: F.transform(_matches(hits, r["ids"]), lambda m: F.struct(
        m["a"].alias("a"), m["b"].alias("b"), F.size(r["ids"]).alias("n"), r["name"].alias("name")))))


def _names(found: Column) -> Column:
    """Licences of the matches that lie in no longer match."""
    longest = F.filter(found, lambda m: ~F.exists(found, lambda o: (o["a"] <= m["a"]) & (o["b"] >= m["b"]) & (o["n"] > m["n"])))
    return F.array_sort(F.array_distinct(F.transform(longest, lambda m: m["name"])))


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_sentences (licence sentences found),
    sentence_ids (in order) and licences (names found, ordered)."""
    spark = docs.sparkSession
    sentences, rules = _table()
    known = F.broadcast(spark.createDataFrame(sentences, "sentence string, id int"))  # fixed size
    text = F.coalesce("text", F.lit(""))
    hinted = text.rlike(_HINT)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = own.where(hinted).withColumn("row", F.monotonically_increasing_id())
    units = rows.select("row", "doc_id", F.posexplode(F.split(F.regexp_replace("text", _EMPTY, ""), _END)).alias("i", "unit"))
    # a unit as a whole, and where it has several lines each of them and what
    # follows a line break; lines have a word at least, so longer ends are no sentence
    lines = F.split("unit", "\n")
    longest = max(len(s.split()) for s, _ in sentences)
    units = units.withColumn("last", F.reverse(F.slice(F.reverse(F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}]"))), 1, longest + 1)))
    ends = F.when(F.size("last") > 2, F.transform(F.sequence(F.lit(2), F.size("last") - 1), lambda k: F.array_join(
        F.slice("last", k, F.lit(longest)), "\n"))).otherwise(F.array().cast("array<string>"))
    forms = F.when(F.size(lines) > 1, F.concat(F.array("unit"), lines, ends)).otherwise(F.array("unit"))
    forms = units.select("row", "doc_id", "i", F.posexplode(forms).alias("j", "form"))
    found = forms.withColumn("sentence", _normal(F.col("form"))).join(known, "sentence", "left")
    per_doc = found.groupBy("row", "doc_id").agg(F.sort_array(F.collect_set(
        F.when(F.col("id").isNotNull(), F.struct("i", "j", "id")))).alias("hits"))
    none = own.where(~hinted).select("doc_id", F.array().cast("array<struct<i:int,j:int,id:int>>").alias("hits"))
    some = per_doc.select("doc_id", "hits", F.when(F.size("hits") > 0, _found(F.col("hits"), rules)).otherwise(F.array().cast(_FOUND)).alias("found"))
    rows = some.select("doc_id", "hits", _names(F.col("found")).alias("names")).unionByName(
        none.select("doc_id", "hits", F.array().cast("array<string>").alias("names")))
    return rows.select(
        "doc_id", F.size("hits").cast("long").alias("n_sentences"),
        F.array_join(F.transform("hits", lambda h: h["id"].cast("string")), ",").alias("sentence_ids"),
        F.array_join("names", ",").alias("licences"))
