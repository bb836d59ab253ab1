"""Licence recognition by sentence rules, with DataFrame operations only.

A text is normalised to lower-case letters and digits with single spaces; comment marks are thereby
gone. A sentence starts and ends at . ! ? before white space, at a blank line (one without letters
and digits) or at a line break, and may itself run over single line breaks, so wrapped notices and
lines that stand alone are both found; where several known sentences start together, the longest
counts. Each is mapped to its identifier. The identifiers, in text order, are matched against the
ordered rules: a rule fits where its identifiers stand next to each other in that order; a rule that
lies inside a fitting rule above it isn't reported again. Everything happens inside the row, so there
is no shuffle and no group to become hot.

The DuckDB twin knows the sentences up to 18 and ends a sentence at every line break: it agrees on
texts whose notices stand on a line each, as in the test tables.

Cases: null and empty texts have no sentence and no licence; repeated rows are reported each;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm.common import take_columns

# Sentences of public licence texts and notices, normalised.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the apache license version 2 0",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "licensed under the apache license version 2 0 the license",
    6: "you may not use this file except in compliance with the license",
    7: "you may obtain a copy of the license at",
    8: "see the license for the specific language governing permissions and limitations under the license",
    9: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    10: "licensed under the mit license",
    11: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    12: "either version 3 of the license or at your option any later version",
    13: "see the gnu general public license for more details",
    14: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    15: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    16: "licensed under cc by 4 0",
    17: "licensed under cc by sa 4 0",
    18: "all rights reserved",
}
# Most specific first: (licence, identifiers in order).
RULES = [
    ("Apache-2.0", (5, 6, 7, 8)), ("Apache-2.0", (5, 6, 7)), ("Apache-2.0", (2, 6, 7, 8)),
    ("GPL-3.0-or-later", (11, 12, 13)), ("GPL-3.0-or-later", (11, 12)),
    ("BSD-2-Clause", (14, 15)),
    ("Apache-2.0", (2,)), ("Apache-2.0", (5,)), ("MIT", (1,)), ("MIT", (9,)), ("MIT", (10,)),
    ("GPL-3.0-only", (3,)), ("CC-BY-NC-4.0", (4,)), ("CC-BY-4.0", (16,)), ("CC-BY-SA-4.0", (17,)),
]
# Sentences that wrapped and one-line notices hold; ``known`` and ``rules`` of ``scan`` are all of these.
_GRANT = ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
          "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
          "persons to whom the software is furnished to do so")
_APACHE_AT = "you may obtain a copy of the license at http www apache org licenses license 2 0"
_UNLESS = ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
           "without warranties or conditions of any kind either express or implied")
_FEE = "copy modify and {}distribute this software for any purpose with or without fee is hereby granted"
_APPEAR = " provided that the above copyright notice and this permission notice appear in all copies"
_NOTICES = [
    ("Apache-2.0", SENTENCES[5] + " " + SENTENCES[6]), ("Apache-2.0", SENTENCES[2] + " " + SENTENCES[6]),
    ("MIT", _GRANT + " subject to the following conditions"), ("MIT", _GRANT + " subject to the following conditions " + SENTENCES[9]), ("MIT-0", _GRANT),
    *[("ISC", "permission to use " + _FEE.format(x) + _APPEAR) for x in ("", "or ")],
    *[("0BSD", "permission to use " + _FEE.format(x)) for x in ("", "or ")],
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license version 2 0"),
    *[("MPL-2.0", f"if a copy of the mpl was not distributed with this file you can obtain one at {x} mozilla org mpl 2 0") for x in ("http", "https")],
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("BSL-1.0", "distributed under the boost software license version 1 0"),
]
for _kind, _name, _versions in (("GPL", "gnu general public license", ("2", "3")), ("LGPL", "gnu lesser general public license", ("2 1", "3")),
                                ("LGPL", "gnu library general public license", ("2",)), ("AGPL", "gnu affero general public license", ("3",))):
    for _v in _versions:
        _spdx = f"{_kind}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}"
        for _what in ("program", "library", "software", "file"):
            _free = f"this {_what} is free software you can redistribute it and or modify it under the terms of the {_name} "
            _fsf = "as published by the free software foundation"
            _NOTICES += [(_spdx + "-or-later", _free + f"{_fsf} either version {_v} of the license or at your option any later version"),
                         (_spdx + "-only", _free + f"{_fsf} version {_v} of the license"), (_spdx + "-only", _free + f"{_fsf} version {_v}"),
                         (_spdx + "-only", _free + f"version {_v} {_fsf}"), (_spdx + "-only", _free + f"version {_v} only {_fsf}")]
for _spdx, _name in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"),
                     ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives")):
    _NOTICES += [(f"CC-{_spdx}-4.0", f"this work is licensed under {x} creative commons {_name} 4 0 international license") for x in ("a", "the")]
_SPDX = ("MIT", "MIT-0", "ISC", "0BSD", "Apache-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Unlicense", "BSL-1.0", "Zlib", "EPL-2.0", "CC0-1.0", "CC-BY-4.0",
         "CC-BY-SA-4.0", "CC-BY-NC-4.0", *[f"{x}-{y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("only", "or-later")])
_NOTICES += [(x, "spdx license identifier " + x.lower().replace("-", " ").replace(".", " ")) for x in _SPDX]
KNOWN = SENTENCES | {
    19: _APACHE_AT, 20: _UNLESS, 21: _APACHE_AT + " " + _UNLESS,
    22: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
} | {30 + i: s for i, (_, s) in enumerate(_NOTICES)}
# Sentences with a name of up to 20 words in the middle: (start, end).
OPEN = {23: ("neither the name of", "may be used to endorse or promote products derived from this software without specific prior written permission"),
        24: ("nor the names of", "may be used to endorse or promote products derived from this software without specific prior written permission")}
ALL_RULES = [
    *[("BSD-4-Clause", (14, 15, 22, x)) for x in OPEN], *[("BSD-3-Clause", (14, 15, x)) for x in OPEN],
    *RULES, *[(licence, (30 + i,)) for i, (licence, _) in enumerate(_NOTICES)],
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HARD_END = r"(?<![.!?])[.!?]++(?:\s++|$)|\n[^a-z0-9]*\n"  # anchored at the run's start and possessive: linear
GAP = r"(?: |\n\n)"


def normalised(text: Column) -> Column:
    """Words with single spaces; two bars for the end of a sentence, two line feeds for a line break."""
    lines = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), UPPER + "\r|", LOWER + "\n ")
    words = F.regexp_replace(F.regexp_replace(lines, HARD_END, "|"), r"[^a-z0-9\n|]+", " ")
    ends = F.regexp_replace(F.concat(F.lit("|"), words, F.lit("|")), r"(?<![ \n])[ \n]*+\|[ \n|]*+", "||")
    return F.regexp_replace(ends, r" *\n *", "\n\n")


def sentence_pattern(known: dict[int, str], names: dict[int, tuple[str, str]]) -> str:
    """Every known sentence between two ends, the longest first; an end is written twice, so that one
    of its signs is left for the next sentence."""
    fixed = [x.replace(" ", GAP) for x in sorted(known.values(), key=lambda x: (-len(x), x))]
    named = [f"{a} ".replace(" ", GAP) + f"(?:[a-z0-9]+{GAP}){{1,20}}" + b.replace(" ", GAP) for a, b in names.values()]
    return f"[|\\n]({'|'.join(fixed + named)})[|\\n]"


def scan(docs: DataFrame, known: dict[int, str] = KNOWN, rules=None, names: dict[int, tuple[str, str]] = OPEN) -> DataFrame:
    """-> (doc_id, sentence_ids, licenses): identifiers in text order and the licences found, in
    order of the rules, both as text joined by commas (empty where there is none)."""
    rules = ALL_RULES if rules is None else rules
    lookup = F.create_map(*[F.lit(x) for i, s in known.items() for x in (s, i)])
    base = take_columns(docs, "doc_id", "text")
    found = F.regexp_extract_all(normalised(F.coalesce(F.col("text"), F.lit(""))), F.lit(sentence_pattern(known, names)), F.lit(1))
    d = base.select("doc_id", F.transform(found, lambda s: F.replace(s, F.lit("\n\n"), F.lit(" "))).alias("_s"))

    def number(s: Column) -> Column:
        named = [F.when(s.startswith(a + " "), F.lit(i)) for i, (a, _) in names.items()]
        return F.coalesce(F.try_element_at(lookup, s), *named)

    d = d.select("doc_id", F.array_join(F.transform("_s", number).cast("array<string>"), ",").alias("sentence_ids"))
    seq = F.concat(F.lit(","), F.regexp_replace("sentence_ids", ",", ",,"), F.lit(","))
    d = d.withColumn("_seq", seq)
    hits = []
    last = max((i for i, (_, want) in enumerate(rules) if len(want) > 1), default=-1)  # no rule after it can lie inside another
    for i, (licence, want) in enumerate(rules):
        mark = "".join(f",{x}," for x in want)
        hit = F.when(F.instr(F.col("_seq"), mark) > 0, F.lit(licence))
        if i <= last:
            d = d.withColumn(f"_hit{i}", hit).withColumn("_seq", F.replace(F.col("_seq"), F.lit(mark), F.lit(";")))
            hit = F.col(f"_hit{i}")
        hits.append(hit)
    return d.select("doc_id", "sentence_ids", F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ",").alias("licenses"))


def oracle(known: dict[int, str] = SENTENCES, rules=None) -> str:
    """The same for DuckDB."""
    rules = RULES if rules is None else rules
    case = " ".join(f"WHEN '{s}' THEN '{i}'" for i, s in known.items())
    seq, hits = "seq0", []
    steps = ["SELECT doc_id, sentence_ids, ',' || replace(sentence_ids, ',', ',,') || ',' AS seq0 FROM ids"]
    for k, (licence, want) in enumerate(rules):
        mark = "".join(f",{i}," for i in want)
        hits.append(f"CASE WHEN contains(seq{k}, '{mark}') THEN '{licence}' END AS h{k}")
        steps.append(f"SELECT *, {hits[-1]}, replace(seq{k}, '{mark}', ';') AS seq{k + 1} FROM r{k}")
    ctes = ",\n".join(f"r{k} AS ({s})" for k, s in enumerate(steps))
    listed = ", ".join(f"h{k}" for k in range(len(rules)))
    distinct = (f"array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL), ',')")
    return f"""WITH sent AS (
  SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[.!?]+(\\s+|$)|[\\n\\r]+', '|' || chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), ' *\\n *') AS s FROM documents),
ids AS (SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(s, lambda x: CASE trim(x) {case} END), lambda x: x IS NOT NULL), ','), '') AS sentence_ids FROM sent),
{ctes},
last AS (SELECT doc_id, sentence_ids, list_filter([{listed}], lambda x: x IS NOT NULL) AS a FROM r{len(rules)})
SELECT doc_id, sentence_ids, coalesce({distinct}, '') AS licenses FROM last"""
