"""Operator 4, licence scans by sentence rules, with DataFrame functions only."""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelia.llm.common import table, text_or_empty

# Sentences of public licence texts and notices, in the order of each text.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-the-license": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-may-not-use": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-specific": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name {1-40} endorse or promote products derived from this software",
    "bsd-endorse-names": "The names {1-30} endorse or promote products derived from this software",
    "bsd-endorse-name": "The name {1-30} endorse or promote products derived from this software",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY {1-20} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-notice": "Licensed under CC BY-ND 4.0.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-no-warranty": "This software is distributed without any warranty.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-only-comma": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2",
    "gpl-free-named": "is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free-named": "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope-named": "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-received-named": "You should have received a copy of the GNU General Public License along with {1-6} If not, see",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free-named": "is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsl-granted": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-granted": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl21-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

# Identifiers of licences that a tag "SPDX-License-Identifier:" may give.
TAGS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 "
    "CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL Zlib"
).split()
SENTENCES |= {f"tag-{t}": f"SPDX-License-Identifier: {t}" for t in TAGS}

# Fixed values: (rule, licence, sentence identifiers in order).
RULES = [
    ("apache-2.0-notice", "Apache-2.0", ["apache-notice"]),
    ("apache-2.0-short", "Apache-2.0", ["apache-the-license", "apache-may-not-use"]),
    ("apache-2.0-header", "Apache-2.0", ["apache-the-license", "apache-may-not-use", "apache-obtain", "apache-as-is", "apache-specific"]),
    ("gpl-3.0-notice", "GPL-3.0-only", ["gpl3-notice"]),
    ("gpl-3.0-short", "GPL-3.0-or-later", ["gpl-free"]),
    ("gpl-3.0-header", "GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details", "gpl-received"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("mit-licensed", "MIT", ["mit-licensed"]),
    ("mit-untitled", "MIT", ["mit-grant", "mit-notice-kept", "mit-as-is"]),
    ("mit-text", "MIT", ["mit-title", "mit-grant", "mit-notice-kept", "mit-as-is"]),
    ("bsd-2-clause", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    *((f"bsd-3-clause{x}", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", f"bsd-endorse{x}"]) for x in ("", "-name", "-names")),
    ("cc-by-nc-4.0-notice", "CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("cc-by-4.0-notice", "CC-BY-4.0", ["cc-by-notice"]),
    ("cc-by-sa-4.0-notice", "CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("cc-by-4.0-work", "CC-BY-4.0", ["cc-by-work"]),
    ("cc-by-nc-4.0-work", "CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("cc-by-nd-4.0-notice", "CC-BY-ND-4.0", ["cc-by-nd-notice"]),
    ("cc0-short", "CC0-1.0", ["cc0-dedicated"]),
    ("cc0-header", "CC0-1.0", ["cc0-dedicated", "cc0-no-warranty"]),
    ("unlicense-short", "Unlicense", ["unlicense-free"]),
    ("unlicense-text", "Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("isc-text", "ISC", ["isc-permission"]),
    ("epl-2.0-header", "EPL-2.0", ["epl2-available"]),
    ("gpl-2.0-short", "GPL-2.0-or-later", ["gpl2-free"]),
    ("gpl-2.0-header", "GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("gpl-2.0-only", "GPL-2.0-only", ["gpl2-only"]),
    ("gpl-2.0-only-comma", "GPL-2.0-only", ["gpl2-only-comma"]),
    ("gpl-3.0-named", "GPL-3.0-or-later", ["gpl-free-named"]),
    ("gpl-3.0-named-header", "GPL-3.0-or-later", ["gpl-free-named", "gpl-hope-named", "gpl-details"]),
    ("gpl-2.0-named", "GPL-2.0-or-later", ["gpl2-free-named"]),
    ("gpl-2.0-named-header", "GPL-2.0-or-later", ["gpl2-free-named", "gpl-hope-named", "gpl-details"]),
    ("lgpl-3.0-short", "LGPL-3.0-or-later", ["lgpl3-free"]),
    ("agpl-3.0-named", "AGPL-3.0-or-later", ["agpl3-free-named"]),
    ("bsl-1.0-text", "BSL-1.0", ["bsl-granted"]),
    ("bsl-1.0-notice", "BSL-1.0", ["boost-notice"]),
    ("wtfpl-title", "WTFPL", ["wtfpl-title"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-granted"]),
    *((f"spdx-{t}", t, [f"tag-{t}"]) for t in TAGS),
    ("lgpl-2.1-short", "LGPL-2.1-or-later", ["lgpl21-free"]),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", ["lgpl21-free", "lgpl21-hope"]),
    ("agpl-3.0-short", "AGPL-3.0-or-later", ["agpl3-free"]),
    ("mpl-2.0-short", "MPL-2.0", ["mpl-subject"]),
    ("mpl-2.0-header", "MPL-2.0", ["mpl-subject", "mpl-obtain"]),
]

#: Words of unknown sentences that may stand between two known ones of a rule (an address, a year).
GAP = 40


def normalised(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


@dataclass(frozen=True)
class Sentence:
    """A known sentence: its normal form, or a pattern with {a-b} for a to b words of any kind.
    Words of a text consist of a-z and 0-9 and have one space between them."""

    name: str
    start: str  # its first two words
    text: str
    pattern: str
    size: int  # words, at most


def sentence(name: str, source: str) -> Sentence:
    pieces = re.split(r"\{([0-9]+)-([0-9]+)\}", source)
    fixed = [normalised(x) for x in pieces[::3]]
    start = " ".join(fixed[0].split()[:2])
    if len(pieces) == 1:
        return Sentence(name, start, fixed[0], "", len(fixed[0].split()))
    ends = list(zip(pieces[1::3], pieces[2::3]))
    pattern = fixed[0] + "".join(f" (?:[a-z0-9]+ ){{{a},{b}}}?{x}" for (a, b), x in zip(ends, fixed[1:]))
    return Sentence(name, start, "", f"^{pattern}( |$)", sum(len(x.split()) for x in fixed) + sum(int(b) for _, b in ends))


KNOWN = [sentence(i, t) for i, t in SENTENCES.items()]
#: No known sentence has more words.
LONGEST = max(x.size for x in KNOWN)


def starts() -> list[str]:
    return sorted({x.start for x in KNOWN})


def known_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, last, sentence): the known sentences of every text by their first and
    last word, counted from 0. The dictionary is a fixed list, so it may be broadcast.

    A text is its sequence of words in lower case without marks, so how a sentence is wrapped,
    boxed or indented does not count. Only places where two words begin a known sentence leave the
    text, each with as many words as the longest sentence has. A sentence may have variable parts,
    such as the name of a holder. Of sentences inside one another only the outermost is known."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(x.start, x.text, x.pattern, x.size, x.name) for x in KNOWN], "start string, sentence_text string, pattern string, size int, sentence string")
    words = F.split(F.trim(F.lower(F.regexp_replace(text_or_empty(), "[^A-Za-z0-9]+", " "))), " ")
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words.alias("words"))
    firsts = sorted({x.split()[0] for x in starts()})
    pair = lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1))
    begun = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(firsts) & pair(i).isin(starts())
    )
    at = F.transform(begun, lambda i: F.struct(i.alias("pos"), F.slice("words", i + 1, LONGEST).alias("ahead")))
    ahead = F.col("at.ahead")
    same = F.when(F.concat_ws(" ", F.slice(ahead, F.lit(1), F.col("size"))) == F.col("sentence_text"), F.col("size"))
    variable = F.size(F.split(F.rtrim(F.regexp_substr(F.concat_ws(" ", ahead), F.col("pattern"))), " "))  # null without a match
    found = (
        texts.select("doc_id", "row", F.explode(at).alias("at"))
        .withColumn("start", F.concat_ws(" ", F.get(ahead, 0), F.get(ahead, 1)))
        .join(F.broadcast(known), "start")
        .withColumn("n", F.when(F.col("pattern") == "", same).otherwise(variable))
        .filter("n > 0")
        .select("doc_id", "row", F.col("at.pos").alias("pos"), (F.col("at.pos") + F.col("n") - 1).alias("last"), "sentence")
    )
    by_place = Window.partitionBy("doc_id", "row").orderBy("pos", F.desc("last"))
    before = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("before", before).filter("before IS NULL OR last > before").drop("before")


def license_scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """doc_id, license, rule, first_word, last_word, n_sentences: every rule found.

    A rule is found where its sentences follow each other with no other known one and at most
    ``gap`` words between two of them; a find that lies inside a longer one is dropped. Of a tag
    with several licences the first counts. Words count from 0. Null, empty and licence-free texts give no rows. A text with one notice twice gives two
    rows; repeated rows of ``docs`` give repeated results; an empty table gives an empty one; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rules = spark.createDataFrame(RULES, "rule string, license string, wanted array<string>")
    in_text = Window.partitionBy("doc_id", "row").orderBy("pos")  # one sentence at a place
    longest = max(len(r[2]) for r in RULES)
    sequence = known_sentences(docs).withColumn(
        "ahead", F.collect_list(F.struct("pos", "last", "sentence")).over(in_text.rowsBetween(0, longest - 1))
    )
    size = F.size("wanted")
    part = F.slice("ahead", F.lit(1), size)
    in_order = F.transform(part, lambda s: s["sentence"]) == F.col("wanted")
    close = F.forall(
        F.sequence(F.lit(1), size),
        lambda k: (k == 1) | (F.get(F.col("ahead.pos"), k - 1) - F.get(F.col("ahead.last"), k - 2) - 1 <= gap),
    )
    finds = (
        sequence.join(F.broadcast(rules), F.col("sentence") == F.element_at("wanted", 1))
        .filter((F.size("ahead") >= size) & in_order & close)
        .select("doc_id", "row", "license", "rule", F.col("pos").alias("first_word"), F.get(F.col("ahead.last"), size - 1).alias("last_word"), size.alias("n_sentences"))
    )
    by_place = Window.partitionBy("doc_id", "row").orderBy("first_word", F.desc("last_word"), "rule")
    before = F.max("last_word").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    long = [F.col(c).cast("long").alias(c) for c in ("first_word", "last_word", "n_sentences")]
    covered = F.coalesce(F.col("last_word") <= before, F.lit(False))
    return finds.withColumn("covered", covered).filter(~F.col("covered")).select("doc_id", "license", "rule", *long)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(x.start)}, {quoted(x.text)}, {quoted(x.pattern)}, {x.size}, {quoted(x.name)})" for x in KNOWN)
    rules = ", ".join(f"({quoted(r)}, {quoted(x)}, [{', '.join(map(quoted, w))}])" for r, x, w in RULES)
    return f"""
WITH known(start, sentence_text, pattern, size, sentence) AS (VALUES {known}),
rules(rule, license, wanted) AS (VALUES {rules}),
worded AS (SELECT doc_id, string_split(trim(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS words FROM documents),
one AS (
  SELECT doc_id, words, unnest(list_filter(range(len(words)), lambda i: (words[i + 1] || ' ' || coalesce(words[i + 2], '')) IN ({', '.join(map(quoted, starts()))}))) AS pos
  FROM worded),
met AS (
  SELECT doc_id, pos, sentence, CASE WHEN pattern = '' THEN CASE WHEN array_to_string(words[pos + 1 : pos + size], ' ') = sentence_text THEN sentence_text ELSE '' END
         ELSE rtrim(regexp_extract(array_to_string(words[pos + 1 : pos + {LONGEST}], ' '), pattern)) END AS hit
  FROM one JOIN known ON (words[pos + 1] || ' ' || words[pos + 2]) = start),
found AS (SELECT doc_id, pos, pos + len(string_split(hit, ' ')) - 1 AS last, sentence FROM met WHERE hit <> ''),
outer_ AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY pos, last DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found),
sequence AS (
  SELECT doc_id, pos, last, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k
  FROM outer_ WHERE before IS NULL OR last > before),
finds AS (
  SELECT s.doc_id, r.license, r.rule, s.pos AS first_word, max(a.last) AS last_word, len(r.wanted) AS n_sentences
  FROM sequence s JOIN rules r ON s.sentence = r.wanted[1]
  JOIN sequence a ON a.doc_id = s.doc_id AND a.k BETWEEN s.k AND s.k + len(r.wanted) - 1
    AND a.sentence = r.wanted[a.k - s.k + 1]
  LEFT JOIN sequence b ON b.doc_id = a.doc_id AND b.k = a.k - 1 AND a.k > s.k
  WHERE a.k = s.k OR a.pos - b.last - 1 <= {GAP}
  GROUP BY s.doc_id, s.k, r.license, r.rule, s.pos, len(r.wanted)
  HAVING count(*) = len(r.wanted)),
placed AS (
  SELECT *, max(last_word) OVER (PARTITION BY doc_id ORDER BY first_word, last_word DESC, rule
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM finds)
SELECT doc_id, license, rule, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       n_sentences::BIGINT AS n_sentences
FROM placed WHERE before IS NULL OR last_word > before
"""


OP4_SQL = _sql()
