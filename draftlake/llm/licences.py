"""Licence scans by sentence rules: normalised sentences become identifiers, and runs of identifiers are matched with ordered rules.

Built-in column functions only, inside each row: nothing is shuffled. Both tables are small fixed lists.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licence texts and of usual short notices, in natural wording.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-free": "This program is free software:",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "mpl2-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "short-mit": "Released under the MIT License.",
    "short-mit-licensed": "Licensed under the MIT License.",
    "short-apache": "Licensed under the Apache License, Version 2.0.",
    "short-bsd": "Licensed under the BSD License.",
    "short-gpl3": "This work is licensed under the GNU General Public License, version 3.",
    "short-gpl2": "This work is licensed under the GNU General Public License, version 2.",
    "short-by": "Licensed under CC BY 4.0.",
    "short-by-sa": "Licensed under CC BY-SA 4.0.",
    "short-by-nc": "Licensed under CC BY-NC 4.0.",
    "short-cc0": "Licensed under CC0 1.0.",
    "rights": "All rights reserved.",
}

# Licence -> its sentences in order. Rules are tried in this order, and a match takes its sentences away, so a
# part of a licence is named only where the whole is not there.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl-warranty"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-terms", "gpl-warranty"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms", "gpl-warranty"]),
    ("Unlicense", ["unlicense-domain", "unlicense-use"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-header", "apache-use"]),
    ("GPL-3.0-or-later", ["gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl2-terms"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("Unlicense", ["unlicense-domain"]),
    ("MIT", ["short-mit"]),
    ("MIT", ["short-mit-licensed"]),
    ("Apache-2.0", ["short-apache"]),
    ("BSD", ["short-bsd"]),
    ("GPL-3.0-only", ["short-gpl3"]),
    ("GPL-2.0-only", ["short-gpl2"]),
    ("CC-BY-4.0", ["short-by"]),
    ("CC-BY-SA-4.0", ["short-by-sa"]),
    ("CC-BY-NC-4.0", ["short-by-nc"]),
    ("CC0-1.0", ["short-cc0"]),
    ("proprietary", ["rights"]),
]

BREAK = "\u0001"
SPACE = r"[\x20\x09-\x0D]"
STARTS = "Released|Licensed|This work is|This program is|This Source|Permission|Redistribution|All rights"
HINT = "(?i)licen[cs]e|permission|redistribut|warrant|free software|public domain|rights reserved|creative commons|CC BY|CC0"


def normal(sentence: str) -> str:
    """The normal form in Python, for the fixed sentences: words of letters and digits, in lower case, one space apart."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def sentences(text: Column) -> Column:
    """Normal forms of a text's sentences: they end at . ; : ! ? before white space, at blank lines, and before a line that begins like a notice."""
    ended = F.regexp_replace(text, rf"([.;:!?]){SPACE}+", f"$1{BREAK}")
    lined = F.regexp_replace(ended, rf"\n{SPACE}*\n", BREAK)
    noticed = F.regexp_replace(lined, rf"\n({STARTS})", f"{BREAK}$1")
    return F.transform(F.split(noticed, BREAK, -1), lambda s: F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))))


def run(names: list[str]) -> str:
    """Identifiers in a row, each between commas of its own, so that neighbouring matches share none."""
    return "".join(f",{name}," for name in names)


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_known, sentence_ids, licences, state) for every row of ``docs`` (doc_id, text).

    sentence_ids: the known sentences in text order, licences: the rules met, in rule order, each licence once (both comma-joined,
    empty if there are none). state: ``none`` without a known sentence, ``unresolved`` if no rule is met, ``partial`` if known
    sentences are left over, else ``resolved``. A rule's sentences stand one after another among the known ones; what is
    unknown between them does not matter. A null or empty text has none; rows may repeat; other columns are not read.
    """
    known = F.create_map(*(F.lit(x) for name, s in SENTENCES.items() for x in (normal(s), name)))
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.array_compact(F.transform(sentences(text), lambda s: known[s]))
    one = docs.select(F.col("doc_id").cast("long"), F.when(text.rlike(HINT), found).otherwise(F.expr("cast(array() as array<string>)")).alias("known"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(run(seq)).alias("seq")) for name, seq in RULES))
    start = F.struct(F.when(F.size("known") == 0, "").otherwise(F.concat(F.lit(","), F.array_join("known", ",,"), F.lit(","))).alias("left"), F.expr("cast(array() as array<string>)").alias("met"))
    step = lambda acc, r: F.when(F.contains(acc["left"], r["seq"]), F.struct(
        F.replace(acc["left"], r["seq"], F.lit("")).alias("left"), F.array_append(acc["met"], r["name"]).alias("met"))).otherwise(acc)
    two = one.withColumn("m", F.aggregate(rules, start, step))
    return two.select(
        "doc_id", F.size("known").cast("long").alias("n_known"), F.array_join("known", ",").alias("sentence_ids"), F.array_join(F.array_distinct("m.met"), ",").alias("licences"),
        F.when(F.size("known") == 0, "none").when(F.size("m.met") == 0, "unresolved").when(F.length("m.left") > 0, "partial").otherwise("resolved").alias("state"))


def oracle() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(normal(s))}, {quote(name)})" for name, s in SENTENCES.items())
    steps, last = [], "r0"
    for i, (name, names) in enumerate(RULES, 1):
        seq = quote(run(names))
        steps.append(f"r{i} as (select doc_id, ids, replace(rest, {seq}, '') rest, case when contains(rest, {seq}) then list_append(met, {quote(name)}) else met end met from {last})")
        last = f"r{i}"
    space = r"[\x20\x09-\x0D]"
    return rf"""with known(s, name) as (values {table}),
t as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
b as (select r, doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([.;:!?]){space}+', '\1' || chr(1), 'g'), '\n{space}*\n', chr(1), 'g'), '\n({STARTS})', chr(1) || '\1', 'g') text from t
  where regexp_matches(text, '{HINT}')),
e as (select r, unnest(string_split(text, chr(1))) s, generate_subscripts(string_split(text, chr(1)), 1) pos from b),
k as (select e.r, list(known.name order by pos) ids from e join known on known.s = trim(lower(regexp_replace(e.s, '[^A-Za-z0-9]+', ' ', 'g'))) group by e.r),
r0 as (select t.doc_id, coalesce(k.ids, []::varchar[]) ids, coalesce(array_to_string(list_transform(k.ids, lambda x: ',' || x || ','), ''), '') rest, []::varchar[] met from t left join k using (r)),
{", ".join(steps)}
select doc_id, len(ids)::bigint n_known, coalesce(array_to_string(ids, ','), '') sentence_ids,
  coalesce(array_to_string(list_transform(list_filter(list_zip(met, range(len(met))), lambda x: list_position(met, x[1]) = x[2] + 1), lambda x: x[1]), ','), '') licences,
  case when len(ids) = 0 then 'none' when len(met) = 0 then 'unresolved' when length(rest) > 0 then 'partial' else 'resolved' end state
from {last}"""
