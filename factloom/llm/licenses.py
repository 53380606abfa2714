"""Recognise licences from known sentences and ordered rules, with DataFrame functions only.

A text is normalised and searched for known licence sentences. A sentence begins
and ends where a sentence, a line or a part before ``;`` does, and may run over
lines, behind comment leaders too, but not over a sentence end or a blank line;
of several that begin together the longest counts. The identifiers found, in
their order in the text, are held against rules: a rule fits if its identifiers
occur in its order, with anything between them. All of it happens within a row,
so nothing is shuffled. The map and the rules are constants of bounded size.

Defined cases: null and empty texts have no sentences and no licence; a licence
named twice is reported once; repeated rows are judged each; other columns
pass through ``scan``; an empty table stays empty.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "this work is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "licensed under the apache license version 2.0": "apache-notice",
    "licensed under the apache license version 2.0 the license": "apache-notice",
    "this work is licensed under the apache license version 2.0": "apache-notice",
    "released under the apache license version 2.0": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-use",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "licensed under the gnu general public license version 3": "gpl3-notice",
    "released under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by-nc 4.0": "cc-by-nc-notice",
    "this work is licensed under cc by-nc 4.0": "cc-by-nc-notice",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "cc-by-nc-notice",
    "licensed under cc by 4.0": "cc-by-notice",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-notice",
    "licensed under cc by-sa 4.0": "cc-by-sa-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "all rights reserved": "reserved",
}
# Fixed values: (licence, class, identifiers in order).
RULES = [
    ("MIT", "permissive", ["mit-notice"]),
    ("MIT", "permissive", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", "permissive", ["apache-notice"]),
    ("Apache-2.0", "permissive", ["apache-use", "apache-copy"]),
    ("GPL-3.0", "copyleft", ["gpl3-notice"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl3-grant", "gpl-warranty"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2-grant", "gpl-warranty"]),
    ("CC-BY-NC-4.0", "non-commercial", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", "attribution", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", "attribution", ["cc-by-sa-notice"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Proprietary", "reserved", ["reserved"]),
]
# Further sentences and rules; the SQL twin knows those above only.
MORE_SENTENCES = {
    "you may obtain a copy of the license at http www.apache.org licenses license-2.0": "apache-copy",
    "you may obtain a copy of the license at https www.apache.org licenses license-2.0": "apache-copy",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "lgpl21-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "mpl2-copy",
}
MORE_RULES = [
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21-grant", "gpl-warranty"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3-grant", "gpl-warranty"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl3-grant", "gpl-warranty"]),
    ("MPL-2.0", "copyleft", ["mpl-notice", "mpl2-copy"]),
]
HARD = "\x02"


def marked(text: Column) -> Column:
    """The normalised text: ``HARD`` stands at sentence ends and before blank lines, a line feed at other line ends and behind ``;``.

    Letters, digits and ``.+-`` in lower case stay; comment leaders and bullets go.
    """
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), HARD, " ")
    out = F.regexp_replace(out, r"([.!?])(?:[ \t\r]+|(?=\n))", f"$1{HARD}")
    out = F.regexp_replace(out, r"\n(?=[^a-z0-9\n]*\n)", HARD)
    out = F.regexp_replace(out, r";(?=\s)", "\n")
    out = F.regexp_replace(out, rf"[^a-z0-9.+\n{HARD}-]+", " ")
    out = F.concat(F.lit(HARD), F.replace(out, F.lit(". "), F.lit(" ")), F.lit(HARD))
    out = F.regexp_replace(out, rf"([\n{HARD}])[ .+\n-]*(?:(?:dnl|rem) )?", "$1")
    return F.regexp_replace(out, rf"(?<![. ])[. ]++(?=[\n{HARD}])", "")


def normal(sentence: Column) -> Column:
    bare = F.regexp_replace(F.lower(sentence), r"[^a-z0-9.+-]+", " ")
    return F.rtrim(F.ltrim(F.regexp_replace(bare, r"[.] ", " ")), F.lit(". "))


def identifiers(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = known or SENTENCES | MORE_SENTENCES
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    any_of = "|".join(r"[ \n]".join(map(re.escape, s.split(" "))) for s in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(marked(text), F.lit(rf"[\n{HARD}](?:(?:[0-9]+|[a-z]) )?({any_of})(?=[\n{HARD}])"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(table, F.translate(s, "\n", " ")))


def follows(found: Column, wanted: list[str]) -> Column:
    """Whether the identifiers ``wanted`` occur in ``found`` in this order."""
    step = F.array(*[F.lit(w) for w in wanted])
    return F.aggregate(found, F.lit(0), lambda at, x: F.when(
        (at < len(wanted)) & (F.get(step, at) == x), at + 1).otherwise(at)) == len(wanted)


def scan(docs: DataFrame, text_col: str = "text", known: dict[str, str] | None = None, rules=None) -> DataFrame:
    """``docs`` with sentence_ids, licenses and classes (sorted arrays of distinct names) added, underscores in front of taken names."""
    ids, licenses, kinds, hits = fresh(docs, "sentence_ids", "licenses", "license_classes", "license_hits")
    rules = RULES + MORE_RULES if rules is None else rules
    out = docs.withColumn(ids, identifiers(F.col(text_col), known))
    # a rule that goes on where another ends takes its place: BSD-3-Clause says all that BSD-2-Clause says
    longer = [[w for *_, w in rules if len(w) > len(wanted) and w[: len(wanted)] == wanted] for *_, wanted in rules]
    fits = [reduce(lambda a, w: a & ~follows(F.col(ids), w), more, follows(F.col(ids), wanted)) for more, (*_, wanted) in zip(longer, rules)]
    fit = F.array(*[F.when(fitting, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind")))
                    for fitting, (name, kind, _) in zip(fits, rules)])
    empty = F.array().cast("array<struct<name:string,kind:string>>")
    out = out.withColumn(hits, F.when(F.size(ids) == 0, empty).otherwise(F.filter(fit, lambda x: x.isNotNull())))
    return out.select(*docs.columns, ids, F.array_sort(F.array_distinct(F.col(hits).getField("name"))).alias(licenses),
                      F.array_sort(F.array_distinct(F.col(hits).getField("kind"))).alias(kinds))
