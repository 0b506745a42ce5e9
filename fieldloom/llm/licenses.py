"""License recognition by sentence rules.

Known licence sentences have identifiers. A text's sentences are normalised and looked up; the
identifiers found, in order, are matched against rules, each an ordered list of identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_texts, in_rows, texts

# Sentences of public licences and of the notices that name them.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "This work is licensed under the GNU General Public License, version 3.",
    3: "Released under the MIT License.",
    4: "Licensed under CC BY-NC 4.0.",
    5: 'Licensed under the Apache License, Version 2.0 (the "License");',
    6: "you may not use this file except in compliance with the License.",
    7: "You may obtain a copy of the License at",
    8: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    9: "See the License for the specific language governing permissions and limitations under the License.",
    10: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    12: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    13: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    14: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    15: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    16: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    17: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    18: "If a copy of the MPL was not distributed with this file, You can obtain one at",
    19: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    20: "This is free and unencumbered software released into the public domain.",
    21: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    22: "Permission is hereby granted, without written agreement and without license or royalty fees, to use, copy, modify, and distribute this software and its documentation for any purpose, provided that the above copyright notice and the following two paragraphs appear in all copies of this software.",
    23: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    24: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    25: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    26: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    27: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    28: "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    29: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    30: "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    31: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    32: "Distributed under the Boost Software License, Version 1.0.",
    33: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    34: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    35: "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    36: "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    37: "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    38: "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    39: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    40: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    41: "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
    42: "This license governs use of the accompanying software.",
    43: "If you use the software, you accept this license.",
    44: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    45: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    46: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    47: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    48: "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    49: "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    50: "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    51: "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    52: "Licensed under the MIT License.",
    53: "Licensed under the BSD 3-Clause License.",
    54: "Licensed under the BSD 2-Clause License.",
    55: "Licensed under CC BY 4.0.",
    56: "Licensed under CC BY-SA 4.0.",
    57: "Licensed under the GNU General Public License v2.0.",
    58: "Licensed under the GNU General Public License v3.0.",
    59: "Licensed under the GNU Affero General Public License v3.0.",
    60: "Licensed under the Mozilla Public License 2.0.",
}
# Names of licences, and the sentences in order that make them out.
RULES = {
    "0BSD": [[40]],
    "AGPL-3.0": [[27], [59]],
    "Apache-2.0": [[1], [5, 6], [5, 6, 7, 8, 9]],
    "BSD-2-Clause": [[12, 13, 14], [54]],
    "BSD-3-Clause": [[12, 13, 14, 15], [53]],
    "BSD-4-Clause": [[12, 13, 14, 21, 15]],
    "BSL-1.0": [[32], [33]],
    "CC-BY-3.0": [[50]],
    "CC-BY-4.0": [[44], [55]],
    "CC-BY-NC-4.0": [[4], [46]],
    "CC-BY-NC-ND-4.0": [[49]],
    "CC-BY-NC-SA-4.0": [[48]],
    "CC-BY-ND-4.0": [[47]],
    "CC-BY-SA-3.0": [[51]],
    "CC-BY-SA-4.0": [[45], [56]],
    "CC0-1.0": [[36]],
    "CDDL-1.0": [[30], [30, 6]],
    "EPL-1.0": [[28]],
    "EPL-2.0": [[29]],
    "EUPL-1.2": [[41]],
    "GPL-2.0": [[23], [24], [57]],
    "GPL-3.0": [[2], [16], [58]],
    "ISC": [[19]],
    "LGPL-2.1": [[25]],
    "LGPL-3.0": [[26]],
    "MIT": [[3], [10, 11], [52]],
    "MIT-Modern-Variant": [[22]],
    "MPL-1.1": [[31], [31, 6]],
    "MPL-2.0": [[17], [17, 18], [60]],
    "MS-PL": [[42, 43]],
    "OFL-1.1": [[38]],
    "PostgreSQL": [[39]],
    "Unlicense": [[20]],
    "WTFPL": [[37]],
    "Zlib": [[34, 35], [34]],
}
#: Identifiers of the sentences `SPDX-License-Identifier: NAME` begin here.
SPDX = 1000


def catalogue(sentences: dict[int, str] = SENTENCES, rules: dict[str, list[list[int]]] = RULES) -> tuple[dict[int, str], dict[str, list[list[int]]]]:
    """Sentences and rules with, for each licence, the line that names it by its short identifier."""
    names = sorted(rules)
    lines = {SPDX + n: f"SPDX-License-Identifier: {name}" for n, name in enumerate(names)}
    return sentences | lines, {name: [*rules[name], [SPDX + n]] for n, name in enumerate(names)}


#: Texts are cut after one of .!?;: before white space, and at line feeds.
END = re.compile(rb"(?<=[.!?;:])[\x20\x09-\x0D]+|\n")
OTHER = re.compile(rb"[^A-Za-z0-9]+")


def normalised(sentence: bytes) -> bytes:
    """Letters A-Z in lower case and digits; anything between them is one space."""
    return OTHER.sub(b" ", sentence).strip().lower()


def split(text: bytes) -> list[bytes]:
    return END.split(text)


class Recogniser:
    """A known sentence is found where it stands whole, from the start to the end of a sentence or line. A single
    line feed in it is white space; an empty line, or one of signs alone, is not. A sentence with one of .!?;: inside
    (`v. 2.0`) is a sequence of parts, all of which must follow one another. Of sentences that begin at one place the
    longest counts."""

    def __init__(self, sentences: dict[int, str] = SENTENCES, rules: dict[str, list[list[int]]] = RULES):
        sentences, rules = catalogue(sentences, rules)
        self.whole, self.begun = {}, set()
        for number, text in sentences.items():
            parts = [p for p in map(normalised, split(text.encode())) if p]
            self.whole.setdefault(b". ".join(parts), number)
            for i, part in enumerate(parts):
                words = part.split()
                self.begun.update(b". ".join([*parts[:i], b" ".join(words[: n + 1])]) for n in range(len(words)))
        #: (pattern, name): rules of more sentences come first, and what one has taken no other one takes.
        self.rules = sorted(((pattern(r), name) for name in rules for r in rules[name]), key=lambda x: (-x[0].count(",,"), x))
        #: A text that has none of these words has no known sentence.
        self.marks = sorted({max(s.replace(b".", b"").split(), key=len) for s in self.whole})

    def scan(self, text: bytes) -> tuple[list[tuple[int, int, int]], list[str]]:
        """(identifier, start, end) in bytes of each known sentence, and the licences whose rules match."""
        low = text.lower()
        if not any(m in low for m in self.marks):
            return [], []
        parts, at = [], 0
        for m in [*END.finditer(text), None]:
            end = m.start() if m else len(text)
            # How the part goes on in the next one: not at all over an empty line.
            joint = None if m is None or m.group().count(b"\n") > 1 else b". " if text[end - 1 : end] in (b".", b"!", b"?", b";", b":") else b" "
            norm = normalised(text[at:end])
            if norm or m is None or b"\n" in m.group():  # else a sign alone before words, as a comment's lead
                parts.append((norm, at, end, joint))
            at = m.end() if m else end
        found, i = [], 0
        while i < len(parts):
            now, start, end, joint = parts[i]
            j, best = i, None
            while now in self.begun:
                if now in self.whole:
                    best = j, (self.whole[now], start, parts[j][2])
                if joint is None or j + 1 == len(parts) or not parts[j + 1][0]:
                    break
                j += 1
                now, joint = now + joint + parts[j][0], parts[j][3]
            if best:
                found.append(best[1])
            i = best[0] + 1 if best else i + 1
        row, names = pattern([x[0] for x in found]), set()
        for ids, name in self.rules:
            if ids in row:
                names.add(name)
                row = row.replace(ids, ",-,")
        return found, sorted(names)


def pattern(ids: list[int]) -> str:
    """Identifiers in order, each between commas of its own."""
    return "".join(f",{n}," for n in ids)


def scan_licenses(docs: DataFrame, sentences: dict[int, str] = SENTENCES, rules: dict[str, list[list[int]]] = RULES) -> DataFrame:
    """Per row of docs: doc_id, matches (id, start, end of known sentences, in bytes), licenses (names, sorted).

    A rule matches where its identifiers follow one another among the known sentences of a text, other
    text between them aside. Rules of more sentences are tried first, and a sentence serves one rule: a text with all
    sentences of the three-clause licence is not also one with two clauses. For every licence, its short identifier
    after `SPDX-License-Identifier:` is a known sentence, too. A null or empty text has none. Repeated rows and null ids are treated like
    any other; no rows give no rows. Only doc_id and text are read.
    """
    kind = pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Recogniser(sentences, rules)
        for b in in_rows(batches):
            out = [r.scan(t) for t in byte_texts(b)]
            matches = [[dict(zip(("id", "start", "end"), m, strict=True)) for m in x[0]] for x in out]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(matches, kind), pa.array([x[1] for x in out], pa.list_(pa.string()))], names=["doc_id", "matches", "licenses"])

    return texts(docs).mapInArrow(run, "doc_id long, matches array<struct<id:int,start:bigint,end:bigint>>, licenses array<string>")
