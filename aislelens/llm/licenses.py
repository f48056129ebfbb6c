"""Licence scan by sentence rules, with DataFrame operations alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, and what each one is called.
SENTENCES = {
    "MitNotice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "MitGrant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "MitInclude": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "AsIs": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "ApacheNotice": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "ApacheComply": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at"],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BsdName": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BsdNotice": ["Licensed under the BSD License"],
    "GplFree": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GplNotice": ["This work is licensed under the GNU General Public License, version 3"],
    "MplNotice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CcByNc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CcBy": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "AllRights": ["All rights reserved"],
    "Mit0Grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ],
    "NcsaGrant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "ZeroBsdGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "PostgresGrant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "ZlibAsIs": ["This software is provided 'as-is', without any express or implied warranty"],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BoostGrant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ],
    "BoostNotice": ["Distributed under the Boost Software License, Version 1.0", "Licensed under the Boost Software License, Version 1.0"],
    "Gpl2Free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "Gpl2Only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "Gpl2Notice": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "Lgpl21Free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "Lgpl3Free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "AgplFree": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "Mpl11Notice": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"],
    "CddlNotice": ["The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "Epl2Notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "Licensed under the Eclipse Public License 2.0"],
    "EuplNotice": ["Licensed under the EUPL, Version 1.2"],
    "ArtisticNotice": ["Licensed under the Artistic License 2.0"],
    "OflNotice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "MsPlNotice": ["Licensed under the Microsoft Public License"],
    "Wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "CcZero": ["Licensed under CC0 1.0", "This work is marked with CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "CcBySa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CcByNd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CcByNcSa": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CcByNcNd": ["Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
# Licences by sequences of sentence names, in the order in which rules are tried.
RULES = [
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdName"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("MIT", ["MitGrant", "MitInclude", "AsIs"]),
    ("MIT", ["MitGrant", "MitInclude"]),
    ("ISC", ["IscGrant"]),
    ("Apache-2.0", ["ApacheNotice", "ApacheComply", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheNotice"]),
    ("GPL-3.0-or-later", ["GplFree"]),
    ("GPL-3.0", ["GplNotice"]),
    ("MPL-2.0", ["MplNotice"]),
    ("CC-BY-NC-4.0", ["CcByNc"]),
    ("CC-BY-4.0", ["CcBy"]),
    ("MIT", ["MitNotice"]),
    ("BSD", ["BsdNotice"]),
    ("Unlicense", ["Unlicense"]),
    ("Proprietary", ["AllRights"]),
    ("NCSA", ["NcsaGrant"]),
    ("MIT-0", ["Mit0Grant"]),
    ("0BSD", ["ZeroBsdGrant"]),
    ("PostgreSQL", ["PostgresGrant"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostNotice"]),
    ("GPL-2.0-or-later", ["Gpl2Free"]),
    ("GPL-2.0-only", ["Gpl2Only"]),
    ("GPL-2.0", ["Gpl2Notice"]),
    ("LGPL-2.1-or-later", ["Lgpl21Free"]),
    ("LGPL-3.0-or-later", ["Lgpl3Free"]),
    ("AGPL-3.0-or-later", ["AgplFree"]),
    ("MPL-1.1", ["Mpl11Notice"]),
    ("CDDL-1.0", ["CddlNotice"]),
    ("EPL-2.0", ["Epl2Notice"]),
    ("EUPL-1.2", ["EuplNotice"]),
    ("Artistic-2.0", ["ArtisticNotice"]),
    ("OFL-1.1", ["OflNotice"]),
    ("MS-PL", ["MsPlNotice"]),
    ("WTFPL", ["Wtfpl"]),
    ("CC0-1.0", ["CcZero"]),
    ("CC-BY-SA-4.0", ["CcBySa"]),
    ("CC-BY-ND-4.0", ["CcByNd"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa"]),
    ("CC-BY-NC-ND-4.0", ["CcByNcNd"]),
]
# What kind of licence each one is that is not permissive; the first kind that a text has counts.
KINDS = {
    "noncommercial": ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"],
    "copyleft": [
        "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
        "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-1.1", "MPL-2.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "CC-BY-SA-4.0",
    ],
    "other": ["Proprietary", "CC-BY-ND-4.0"],
}
# Identifiers of permissive licences that stand after SPDX-License-Identifier beside those named above.
PERMISSIVE_IDS = ["BSD-4-Clause", "Apache-1.1", "AFL-3.0", "BlueOak-1.0.0", "CC-BY-3.0", "ECL-2.0", "HPND", "MulanPSL-2.0", "Python-2.0", "Unicode-3.0", "UPL-1.0", "X11"]
#: A declared expression (MIT OR Apache-2.0) runs to the end of its line or of its comment; its identifiers are between anything else.
EXPRESSION, BETWEEN = "(?i)SPDX-License-Identifier:[ \\t]*([A-Za-z0-9.+() \\t-]*)", "[^a-z0-9.+-]+"
#: A sentence ends at a mark before white space (B). A line end (N) may be inside it, an empty line may not.
MARKS, LINES = "[.!?;]+[ \\t\\r\\n]+", "\\r\\n?|\\n"


def plain(sentence: str) -> str:
    """What is compared: ASCII letters and digits in lower case, all else one space."""
    out = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in sentence)
    return " ".join(out.split())


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> name. A text is compared line by line and sentence by sentence."""
    return {plain(s): name for name, sentences in SENTENCES.items() for s in sentences}


def known_ids() -> dict[str, str]:
    """Lower-case SPDX identifier -> identifier, of all licences named here that have one."""
    every = [name for name, _ in RULES] + [x for ids in KINDS.values() for x in ids] + PERMISSIVE_IDS
    return {x.lower(): x for x in every if x not in ("BSD", "Proprietary")}


def sentence_pattern() -> str:
    """What finds a known sentence in a text of ASCII letters, digits, B and N: from a line or sentence start to an end.

    Between two words may be a single line end, and a mark where the sentence has one itself
    (v. 2.0). The longest sentence of a place comes first.
    """
    forms = []
    for s in sorted((s for sentences in SENTENCES.values() for s in sentences), key=lambda s: -len(plain(s))):
        pieces = [plain(x).replace(" ", "[ N]") for x in re.split(MARKS, s)]
        forms.append("[ NB]".join(x for x in pieces if x))
    return f"(?<=^|[BN])(?:{'|'.join(forms)})(?=$|[BN])"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, category) for each row of docs (doc_id, text).

    Each line and each sentence of the whole text, wrapped over lines or not, is normalised and
    looked up; the names of known ones, in order, are matched against RULES one after the
    other, and a rule that matches takes its names out of the sequence. Identifiers of declared
    SPDX expressions follow, in their order; words that are no known identifier (OR, WITH, an
    exception) are left out. sentence_ids and licenses are joined by ',', licenses in the order
    of RULES; category: permissive, copyleft, noncommercial, other or none. All of it is
    one projection: no exchange, no Python. Null or empty text: 0, '', '', none. A null
    doc_id is passed on; repeated rows each count; a very long text is one row; other columns
    are not looked at; no rows give no rows.
    """
    table = F.create_map(*(F.lit(x) for pair in known_sentences().items() for x in pair))
    ids = F.create_map(*(F.lit(x) for pair in known_ids().items() for x in pair))
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.lower(whole)
    for old, new in ((MARKS, "B"), (LINES, "N"), ("[^a-z0-9BN]+", " "), (" ?([BN]) ?", "$1"), ("^ | $", "")):
        text = F.regexp_replace(text, old, new)
    found = F.transform(F.regexp_extract_all(text, F.lit(sentence_pattern()), F.lit(0)), lambda s: table[F.translate(s, "BN", "  ")])
    words = F.flatten(F.transform(F.regexp_extract_all(whole, F.lit(EXPRESSION), F.lit(1)), lambda s: F.split(F.lower(s), BETWEEN)))
    declared = F.array_compact(F.transform(words, lambda w: ids[F.rtrim(w, F.lit("."))]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("found"), declared.alias("declared"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(sequence) + ",").alias("needle")) for name, sequence in RULES))
    none = F.array().cast("array<string>")
    start = F.struct(F.concat(F.lit(","), F.array_join(F.transform("found", lambda x: F.concat(x, F.lit(","))), "")).alias("rest"), none.alias("got"))

    def tried(state: Column, rule: Column) -> Column:
        taken = F.struct(F.replace(state["rest"], rule["needle"], F.lit(",")).alias("rest"), F.array_append(state["got"], rule["name"]).alias("got"))
        return F.when(F.contains(state["rest"], rule["needle"]), taken).otherwise(state)

    hits = F.when(F.size("found") > 0, F.aggregate(rules, start, tried)["got"]).otherwise(none)
    rows = rows.withColumn("got", F.array_distinct(F.concat(hits, "declared")))
    category = F.when(F.size("got") == 0, "none")
    for kind, members in KINDS.items():
        category = category.when(F.arrays_overlap("got", F.array(*map(F.lit, members))), kind)
    return rows.select(
        "doc_id", F.size("found").cast("long").alias("n_sentences"), F.array_join("found", ",").alias("sentence_ids"), F.array_join("got", ",").alias("licenses"), category.otherwise("permissive").alias("category")
    )
