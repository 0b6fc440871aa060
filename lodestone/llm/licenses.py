"""License scans (operator 9) by sentence rules, with DataFrame functions only.

Texts are unwrapped (a line break between lower-case letters or between capitals is a blank),
split into sentences at line breaks and after `.`, `!`, `?`, `;` or `:` before white space, and
normalised: lower case, one blank for each run of anything but letters and digits. Known
licence sentences map to identifiers; unknown ones only take up places. Identifiers more than
`gap` places apart are parted. A licence is found where its rule, an ordered list of
identifiers, occurs in a document's sequence.

Sentences meet the known ones in a broadcast join: that table is fixed, one row for each known
sentence. Only recognised sentences are shuffled, a few rows for a document with a licence.
Null and empty texts have no sentences. A document's findings carry its id; rows that repeat id
and text share one finding, different texts of an id add up, and a null id is kept as null. Texts of
any length go through whole; an empty table gives an empty one. Of rules that begin at the same sentence all
are found, so ties need no order. Only `doc_id` and `text` are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ID, TH, keyed, table

GAP = 2
#: Licences that are named by an SPDX line.
SPDX = (
    "AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later "
    "GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
#: Licence sentences, normalised, with their identifiers.
SENTENCES = (
    ("a1", "licensed under the apache license version 2 0"),
    ("a2", "licensed under the apache license version 2 0 the license"),
    ("a3", "you may not use this file except in compliance with the license"),
    ("a4", "you may obtain a copy of the license at"),
    ("a5", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("a6", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("m1", "released under the mit license"),
    ("m2", "licensed under the mit license"),
    ("m3", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("m4", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("m5", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("g1", "this work is licensed under the gnu general public license version 3"),
    ("g2", "this program is free software"),
    ("g3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("g4", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("g5", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("c1", "licensed under cc by nc 4 0"),
    ("c2", "licensed under cc by 4 0"),
    ("c3", "licensed under cc by sa 4 0"),
    ("c4", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("b1", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("b2", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("b3", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("b4", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("i1", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("z1", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("u1", "this is free and unencumbered software released into the public domain"),
    ("u2", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("a7", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("a8", "this file is licensed under the apache license version 2 0"),
    ("a9", "released under the apache license version 2 0"),
    ("m6", "this project is licensed under the mit license"),
    ("m7", "distributed under the mit license"),
    ("m8", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("g6", "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("g7", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2"),
    ("g8", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3"),
    ("g9", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("l1", "this library is free software"),
    ("l2", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("l3", "either version 2 1 of the license or at your option any later version"),
    ("l4", "either version 3 of the license or at your option any later version"),
    ("l5", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("l6", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("l7", "licensed under the gnu lesser general public license version 3"),
    ("f1", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("f2", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("f3", "licensed under the gnu affero general public license version 3"),
    ("g0", "either version 2 of the license or at your option any later version"),
    ("b5", "neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("b6", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("b7", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("b8", "licensed under the bsd 3 clause license"),
    ("b9", "licensed under the bsd 2 clause license"),
    ("o1", "distributed under the boost software license version 1 0"),
    ("o2", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("y1", "this software is provided as is without any express or implied warranty"),
    ("y2", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("y3", "the origin of this software must not be misrepresented"),
    ("z2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("z3", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("e1", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("e2", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("e3", "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0"),
    ("d1", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("d2", "licensed under cc0 1 0"),
    ("d3", "this work is marked with cc0 1 0 universal"),
    ("c5", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("c6", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("c7", "licensed under cc by nd 4 0"),
    ("c8", "licensed under cc by nc sa 4 0"),
    ("c9", "licensed under cc by nc nd 4 0"),
    ("c0", "licensed under the creative commons attribution 4 0 international license"),
    ("w1", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("v1", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("r1", "all rights reserved"),
    *((f"s{n}", f"spdx license identifier {' '.join(name.lower().replace('-', ' ').replace('.', ' ').split())}") for n, name in enumerate(SPDX)),
)
#: Ordered rules, licence and identifiers.
RULES = (
    ("Apache-2.0", "a1"),
    ("Apache-2.0", "a2 a3"),
    ("Apache-2.0", "a3 a4 a6"),
    ("BSD-2-Clause", "b1 b2 b3"),
    ("BSD-3-Clause", "b1 b2 b3 b4"),
    ("CC-BY-4.0", "c2"),
    ("CC-BY-4.0", "c4"),
    ("CC-BY-NC-4.0", "c1"),
    ("CC-BY-SA-4.0", "c3"),
    ("GPL-2.0-or-later", "g2 g4"),
    ("GPL-3.0", "g1"),
    ("GPL-3.0-or-later", "g2 g3"),
    ("ISC", "i1"),
    ("AGPL-3.0", "f3"),
    ("AGPL-3.0-or-later", "f1"),
    ("AGPL-3.0-or-later", "f2 l4"),
    ("Apache-2.0", "a7 a3"),
    ("Apache-2.0", "a8"),
    ("Apache-2.0", "a9"),
    ("BSD-2-Clause", "b9"),
    ("BSD-3-Clause", "b1 b2 b3 b5"),
    ("BSD-3-Clause", "b1 b2 b3 b6"),
    ("BSD-3-Clause", "b8"),
    ("BSD-4-Clause", "b1 b2 b3 b7"),
    ("BSL-1.0", "o1"),
    ("BSL-1.0", "o2"),
    ("CC-BY-4.0", "c0"),
    ("CC-BY-NC-4.0", "c6"),
    ("CC-BY-NC-ND-4.0", "c9"),
    ("CC-BY-NC-SA-4.0", "c8"),
    ("CC-BY-ND-4.0", "c7"),
    ("CC-BY-SA-4.0", "c5"),
    ("CC0-1.0", "d1"),
    ("CC0-1.0", "d2"),
    ("CC0-1.0", "d3"),
    ("EPL-1.0", "e2"),
    ("EPL-2.0", "e1"),
    ("EPL-2.0", "e3"),
    ("GPL-2.0-only", "g2 g6"),
    ("GPL-2.0-only", "g2 g7"),
    ("GPL-2.0-or-later", "g9 g0"),
    ("GPL-3.0-only", "g2 g8"),
    ("GPL-3.0-or-later", "g9 l4"),
    ("HPND", "v1"),
    ("LGPL-2.1-or-later", "l1 l2 l3"),
    ("LGPL-2.1-or-later", "l1 l5"),
    ("LGPL-3.0", "l7"),
    ("LGPL-3.0-or-later", "l1 l2 l4"),
    ("LGPL-3.0-or-later", "l1 l6"),
    ("MIT", "m6"),
    ("MIT", "m7"),
    ("MPL-1.1", "z3"),
    ("MPL-2.0", "z2"),
    ("Unlicense", "u2"),
    ("WTFPL", "w1"),
    ("Zlib", "y1 y2"),
    ("Zlib", "y2 y3"),
    *((name, f"s{n}") for n, name in enumerate(SPDX)),
    ("MIT", "m1"),
    ("MIT", "m2"),
    ("MIT", "m3 m4"),
    ("MPL-2.0", "z1"),
    ("Unlicense", "u1"),
)


def license_scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """`doc_id`, `license`, `n_found`, `first_sentence` (place of the first one, from 0)."""
    spark = docs.sparkSession
    known = spark.createDataFrame(list(SENTENCES), "sid string, sentence string")
    # An SPDX line is one sentence: its colon parts nothing.
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("SPDX-License-Identifier:"), F.lit("SPDX-License-Identifier"))
    unwrapped = F.regexp_replace(F.regexp_replace(text, "([a-z,])[ \t]*\r?\n[ \t]*([a-z])", "$1 $2"), "([A-Z],?)[ \t]*\r?\n[ \t]*([A-Z]{2})", "$1 $2")
    pieces = F.split(F.regexp_replace(unwrapped, "([.!?;:])[ \t\r\n\f]+", "$1\n"), "\n")
    place = keyed(docs).select(ID, TH, F.posexplode(pieces).alias("place", "piece"))
    normal = F.trim(F.regexp_replace(F.lower("piece"), "[^\\p{L}\\p{N}]+", " "))
    # A known sentence is never shorter than the shortest one: most pieces go before they are normalised.
    shortest = min(len(s) for _, s in SENTENCES)
    found = place.where(F.length("piece") >= shortest).withColumn("sentence", normal).join(F.broadcast(known), "sentence").select(ID, TH, "place", "sid")
    rows = found.distinct().groupBy(ID, TH).agg(F.array_sort(F.collect_list(F.struct("place", "sid"))).alias("s"))
    gaps = F.transform("s", lambda x, i: F.when(i > 0, x["place"] - F.element_at("s", F.greatest(i, F.lit(1)))["place"] - 1).otherwise(0))
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, ids.split())).alias("ids")) for name, ids in RULES])
    tried = rows.select(ID, "s", F.transform("s", lambda x: x["sid"]).alias("sids"), gaps.alias("gaps"), F.explode(rules).alias("r"))
    n = F.size("r.ids")

    def fits(i):
        inside = F.slice("gaps", i + 2, n - 1)
        return (F.slice("sids", i + 1, n) == F.col("r.ids")) & F.forall(inside, lambda g: g <= gap)

    starts = tried.select(ID, "s", "r.license", F.filter(F.sequence(F.lit(0), F.size("s") - 1), fits).alias("at")).where(F.size("at") > 0)
    first = F.element_at("s", F.element_at("at", 1) + 1)["place"]
    found = starts.select(F.col(ID).alias("doc_id"), "license", F.size("at").cast("long").alias("n"), first.cast("long").alias("first"))
    return found.groupBy("doc_id", "license").agg(F.sum("n").alias("n_found"), F.min("first").alias("first_sentence"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _values(rows: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


SQL = rf"""
WITH known(sid, sentence) AS (VALUES {_values(SENTENCES)}),
rules(license, rule) AS (VALUES {_values(RULES)}),
unwrapped AS (
  SELECT doc_id, regexp_replace(regexp_replace(replace(coalesce(text, ''), 'SPDX-License-Identifier:', 'SPDX-License-Identifier'), '([a-z,])[ \t]*\r?\n[ \t]*([a-z])', '\1 \2', 'g'), '([A-Z],?)[ \t]*\r?\n[ \t]*([A-Z]{{2}})', '\1 \2', 'g') AS text
  FROM documents
), pieces AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?;:])[ \t\r\n\f]+', '\1' || chr(10), 'g'), chr(10)) AS p FROM unwrapped
), placed AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(len(p))) AS place FROM pieces
), found AS (
  SELECT doc_id, place, sid FROM placed JOIN known ON trim(regexp_replace(lower(piece), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) = sentence
), tokens AS (
  SELECT doc_id, place, sid, coalesce(place - lag(place) OVER (PARTITION BY doc_id ORDER BY place) - 1, 0) AS gap FROM found
), sequences AS (
  SELECT doc_id, list(sid ORDER BY place) AS sids, list(place ORDER BY place) AS places, list(gap ORDER BY place) AS gaps FROM tokens GROUP BY doc_id
), starts AS (
  SELECT s.doc_id, r.license, places[i] AS place
  FROM (SELECT *, unnest(range(1, len(sids) + 1)) AS i FROM sequences) s
  JOIN (SELECT license, string_split(rule, ' ') AS ids FROM rules) r ON sids[i:i + len(ids) - 1] = ids
  WHERE len(ids) = 1 OR list_max(gaps[i + 1:i + len(ids) - 1]) <= {GAP}
)
SELECT doc_id, license, count(*)::BIGINT AS n_found, min(place)::BIGINT AS first_sentence FROM starts GROUP BY doc_id, license
"""
