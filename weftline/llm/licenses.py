"""Licence scans by a trained paragraph classifier.

A paragraph is a line of a text, or a stretch of neighbouring lines with words (marks of comments are no
words) that holds a notice wrapped over them. Word n-grams of one to three words feed a multinomial logistic
regression over licence families and an unknown class, trained in numpy on notices of each family under
random changes and on sentences that only speak of licences. The regression's temperature and the least
probability of a prediction are calibrated on other notices and sentences (CALIBRATION), worded otherwise,
from which it doesn't learn; below that probability, a paragraph's class is unknown. A prediction is
confirmed by comparison with the family's templates (both sets): enough of a template's words (weighted by
how few families use them) must stand together in the paragraph.

Notices over several lines are sought where a template's words stand together; of notices that overlap, the
one with more weight counts. It must outweigh what its lines confirm by themselves: all of that, but if it has
nearly a whole template, of its own family only the weightiest. Its line is the one where it begins, and
lines of it count as no prediction of their own.

Only n-grams of the training notices are features, and each has a word that is not in COMMON, so a
paragraph without such words has no features and is unknown; that lets most texts pass by one set
operation.

Defined cases: a null text counts as an empty one; repeated rows and null ids keep their rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from weftline.llm.common import map_rows

# Notices of each family, from which the regression learns.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This software is distributed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Distributed under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Distributed under the GNU AGPL version 3 or later.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the LGPL version 2.1 or later.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Released under the zlib license.",
        "SPDX-License-Identifier: Zlib",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "Released into the public domain under CC0.",
    ],
    "Proprietary": [
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
    ],
}
# Notices on which the regression is calibrated; it doesn't learn from them.
CALIBRATION = {
    "Apache-2.0": ["The code is available under the terms of the Apache License 2.0, see the file LICENSE.", "Apache License, Version 2.0, January 2004."],
    "MIT": ["MIT License, copyright by the authors.", "You can use it under the terms of the MIT License.", "The MIT License (MIT)"],
    "ISC": ["This package is under the ISC License.", "ISC License, copyright by the maintainers."],
    "GPL": ["You may copy it under the terms of version 2 of the GNU General Public License.", "License: GNU GPL v3"],
    "AGPL": ["You may copy it under the terms of version 3 of the GNU Affero General Public License.", "License: GNU AGPL v3"],
    "LGPL": ["You may link it under the terms of the GNU Lesser General Public License.", "License: LGPL v3 or later"],
    "BSD": ["It is available under the BSD license, see the file COPYING.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."],
    "MPL-2.0": ["The contents of this file are subject to the Mozilla Public License Version 2.0.", "License: MPL 2.0"],
    "EPL": ["The plugin is provided under the Eclipse Public License v2.0.", "License: EPL 2.0"],
    "Zlib": ["The library is under the zlib license.", "License: zlib"],
    "Unlicense": ["In jurisdictions that recognize copyright laws, the authors dedicate the unencumbered software to the public domain.", "License: Unlicense"],
    "CC-BY": ["The figures are published under the Creative Commons Attribution License CC BY 4.0.", "License: CC BY 4.0"],
    "CC-BY-SA": ["The maps are published under the Creative Commons Attribution-ShareAlike License.", "License: CC BY-SA 4.0"],
    "CC-BY-NC": ["The songs are published under the Creative Commons Attribution-NonCommercial License.", "License: CC BY-NC 4.0"],
    "CC0": ["The data set is dedicated to the public domain under CC0 1.0.", "License: CC0 1.0 Universal"],
    "Proprietary": ["Copyright by the publisher, all rights reserved.", "No part of this work may be reproduced or transmitted without prior written permission of the publisher."],
}
# Sentences of the unknown class, to learn from and to calibrate on.
OTHERS = [
    "A driver must carry a valid license at all times.",
    "The software was released in spring and runs on most machines.",
    "The general asked the public for free and open discussion.",
    "He was granted permission to use the source of the river.",
    "The foundation is licensed to sell food under local law.",
    "The work is published in two versions, and the second version is longer.",
    "Any person may obtain a copy of the map free of charge at the library.",
    "The state reserves all rights of way under the bridge.",
    "Creative people in common rooms share their work with attribution.",
    "See the terms and conditions of the fishing license for details.",
    "Please cite this work when you use the library.",
    "The file was distributed to members of the project.",
    "Er geht mit dem Hund in den Park, und mit ihm kommt ein Freund.",
    "Das Haus mit dem roten Dach steht mit anderen am Fluss.",
    "Elle chante avec les enfants, et le public est libre de partir.",
    "El general lee una obra con atribución dudosa en la biblioteca.",
    "The apache helicopter flew over the bridge.",
    "During the eclipse the program of the concert was changed.",
    "The author waived the fee and dedicated the book to the public.",
    "The warranty of the car covers damages that arise within two years.",
    "Copyright law protects the rights of authors and publishers.",
    "The permission notice on the wall names the following conditions.",
    "A person of the domain of physics published the source code.",
]
CALIBRATION_OTHERS = [
    "She lost her license after the accident and sold the car.",
    "The public library is free to all and open until eight.",
    "The permission of the owner is needed to modify the building.",
    "A copy of the letter was distributed to every member.",
    "The new version of the program is faster than version two.",
    "Commons are lands that the public may use without charge.",
    "The university grants the rights to publish the work in a journal.",
    "The restaurant got its license under the new law.",
    "The mozilla of the legend was a creature of the lake.",
    "The materials of the bridge must meet the following conditions.",
    "The foundation gave the software to schools for free.",
    "An eclipse of the sun is a public event in this town.",
    "The name of the holder is written on the back of the card.",
    "El programa es libre y el autor permite copias en la escuela.",
    "Die Lizenz zum Angeln gilt unter den folgenden Bedingungen.",
    "Le permis de conduire est valable dans le domaine public.",
]
# Words that are no evidence by themselves.
COMMON = set("a an and any are as at be by can for from has have in into is it its may no not of on or part that the their this to under use was were with without you your all".split())

UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
LONGEST = 3
COPIES = 24
LEAST_SHARE, WHOLE, LEAST_SURE = 0.6, 0.9, 0.25
_TABLE = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def words_of(paragraph: str) -> list[str]:
    return paragraph.encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass").split(" ")


def grams(words: list[str]) -> set[str]:
    """Runs of one to three words that hold a word which is not common."""
    words = [w for w in words if w]
    return {" ".join(words[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1) if not COMMON.issuperset(words[i : i + n])}


@dataclass
class Classifier:
    features: dict[str, int]
    weights: np.ndarray  # (features + 1, families); the last row is the offset
    temperature: float
    least: float
    templates: dict[str, list[tuple[list[str], dict[str, float]]]]
    anchors: frozenset = field(default_factory=frozenset)

    def predict(self, words: list[str]) -> tuple[str, float]:
        """The family and its probability; UNKNOWN below the calibrated least one."""
        at = [k for g in grams(words) if (k := self.features.get(g)) is not None]
        if not at:
            return UNKNOWN, 1.0
        z = (self.weights[at].sum(axis=0) + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return (FAMILIES[k], float(p[k])) if k and p[k] >= self.least else (UNKNOWN, float(1 - p[1:].max()))

    def confirmed(self, family: str, words: list[str]) -> bool:
        """Whether some stretch of the paragraph, twice as long as a template at most, has enough of its words."""
        words = [w for w in words if w]
        for template, weight in self.templates[family]:
            need = LEAST_SHARE * sum(weight.values())
            span = 2 * len(template)
            places = [i for i, w in enumerate(words) if w in weight]
            for i in places:
                if sum(weight[w] for w in set(words[i : i + span]) if w in weight) >= need:
                    return True
        return False

    def matches(self, family: str, words: list[str], distinct: set[str]) -> list[tuple[float, int, int, bool]]:
        """(weight, first word, end, whether nearly the whole template) of the stretches with enough of a template's words, as `confirmed` has it."""
        out = []
        for template, weight in self.templates[family]:
            need = LEAST_SHARE * sum(weight.values())
            if sum(weight[w] for w in weight if w in distinct) < need:
                continue
            span = 2 * len(template)
            places = [i for i, w in enumerate(words) if w in weight]
            for k, i in enumerate(places):
                seen, total, end = set(), 0.0, i
                for j in places[k : k + span]:
                    if j >= i + span:
                        break
                    if words[j] not in seen:
                        seen.add(words[j])
                        total, end = total + weight[words[j]], j + 1
                if total >= need:
                    first, t = i, template.index(words[i])
                    while first and t and words[first - 1] == template[t - 1]:
                        first, t = first - 1, t - 1
                    out.append((total, first, end, total >= WHOLE * sum(weight.values())))
        return out

    def scan(self, text: str) -> list[tuple[int, str, bool]]:
        """(line, family, confirmed) of each paragraph that isn't of the unknown class."""
        if self.anchors.isdisjoint(words_of(text.replace("\n", " "))):
            return []
        out, block, found, anchored = [], [], [], 0
        for i, line in enumerate(text.split("\n")):
            words = [w for w in words_of(line) if w]
            if not words:
                out += self.joined(block, found) if anchored > 1 else found
                block, found, anchored = [], [], 0
                continue
            block.append((i, words))
            if not self.anchors.isdisjoint(words):
                anchored += 1
                family, _ = self.predict(words)
                if family != UNKNOWN:
                    found.append((i, family, self.confirmed(family, words)))
        return out + (self.joined(block, found) if anchored > 1 else found)

    def joined(self, block: list[tuple[int, list[str]]], found: list[tuple[int, str, bool]]) -> list[tuple[int, str, bool]]:
        """What is found in single lines of a block, and the notices over several of its lines."""
        words = [w for _, line in block for w in line]
        lines = [i for i, line in block for _ in line]
        distinct = set(words)
        wrapped = [(weight, family, first, end, whole) for family in self.templates for weight, first, end, whole in self.matches(family, words, distinct) if lines[first] != lines[end - 1]]
        if not wrapped:
            return found
        starts, at = {}, 0
        for i, line in block:
            starts[i] = at, at + len(line)
            at += len(line)
        single = []
        for i, family, sure in found:
            if sure:
                first, end = starts[i]
                own = words[first:end]
                single.append((max(m[0] for m in self.matches(family, own, set(own))), family, first, end))
        taken, covered, out = [False] * len(words), set(), []
        for weight, family, first, end, whole in sorted(wrapped, key=lambda m: (-m[0], m[3] - m[2], m[2])):
            beside = [(w, f) for w, f, a, b in single if a < end and first < b]
            own = [w for w, f in beside if f == family]
            against = sum(w for w, f in beside if f != family) + (max(own, default=0) if whole else sum(own))
            if weight > against + 1e-9 and not any(taken[first:end]) and self.predict(words[first:end])[0] == family:
                taken[first:end] = [True] * (end - first)
                out.append((lines[first], family, True))
                covered.update(lines[first:end])
        out += [(lines[first], family, True) for _, family, first, end in single if not any(taken[first:end])]
        return sorted([*out, *(f for f in found if not f[2] and f[0] not in covered)])


def notices(*sets: dict[str, list[str]]) -> dict[str, list[list[str]]]:
    """The words of the notices of each family."""
    return {f: [[w for w in words_of(t) if w] for of in sets for t in of[f]] for f in TEMPLATES}


def _examples(seed: int, of: dict[str, list[str]] = TEMPLATES, others: list[str] = OTHERS) -> tuple[list[list[str]], list[int]]:
    """Notices with words left out and filler around them; for the unknown class also shuffled pieces of notices."""
    r = np.random.RandomState(seed)
    filler = [w for s in others for w in words_of(s) if w]
    own = [(FAMILIES.index(f), words) for f, made in notices(of).items() for words in made]
    used = [{w for j, words in own if j == k for w in words} for k in range(1, len(FAMILIES))]
    shared = COMMON | {w for words in used for w in words if sum(w in u for u in used) >= 3}
    rows, classes = [], []
    for k, words in [*own, *((0, [w for w in words_of(s) if w]) for s in others for _ in range(4))]:
        for c in range(COPIES):
            kept = [w for w in words if c == 0 or r.rand() > (0.08, 0.3)[c % 2]] or words
            before, after = (list(r.choice(filler, r.randint(0, 12))) if c % 3 else [] for _ in range(2))
            rows.append([*before, *kept, *after])
            classes.append(k)
    for _, words in own:
        for _ in range(COPIES // 3):  # a few words of a notice are no notice
            cut = r.randint(0, max(1, len(words) - 2))
            piece = words[cut : cut + 2]
            if shared.issuperset(piece):
                rows.append([*r.choice(filler, 6), *piece, *r.choice(filler, 6)])
                classes.append(0)
    return rows, classes


def train(steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Classifier:
    rows, classes = _examples(1)
    features = {g: i for i, g in enumerate(sorted({g for made in notices(TEMPLATES).values() for words in made for g in grams(words)}))}
    matrix = lambda rows: np.array([_row(features, r) for r in rows], np.float32)
    x, y = matrix(rows), np.eye(len(FAMILIES), dtype=np.float32)[classes]
    w, mean, square = (np.zeros((x.shape[1], len(FAMILIES)), np.float32) for _ in range(3))
    for t in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (p / p.sum(axis=1, keepdims=True) - y) / len(x) + decay * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= rate / 5 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
    own = notices(TEMPLATES, CALIBRATION)
    used: dict[str, int] = {}
    for f in own:
        for word in {word for t in own[f] for word in t}:
            used[word] = used.get(word, 0) + 1
    rare = lambda t: {word: math.log(1 + len(own) / used[word]) for word in t if word not in COMMON}
    model = Classifier(features, w, 1.0, 0.5, {f: [(t, rare(t)) for t in own[f]] for f in own})
    model.anchors = frozenset(g for g in features if " " not in g)
    held_rows, held = _examples(2, CALIBRATION, CALIBRATION_OTHERS)
    z, held = matrix(held_rows) @ w, np.array(held)

    def shares(temperature: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda temperature: float(-np.log(shares(temperature)[np.arange(len(held)), held] + 1e-12).mean())
    model.temperature = min(np.linspace(0.5, 5, 46).tolist(), key=loss)
    most = np.sort(shares(model.temperature)[held == 0][:, 1:].max(axis=1))
    model.least = float(max(LEAST_SURE, most[int(0.99 * (len(most) - 1))]))  # at most a hundredth of the unknown pass
    return model


def _row(features: dict[str, int], words: list[str]) -> np.ndarray:
    row = np.zeros(len(features) + 1, np.float32)
    row[[features[g] for g in grams(words) if g in features]] = 1
    row[-1] = 1
    return row


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with other than white space), n_licenses (confirmed notices), n_unconfirmed, families (distinct, sorted) and licenses (first line:family, ...)."""
    model = docs.sparkSession.sparkContext.broadcast(train())

    def report(text: str) -> tuple:
        found = model.value.scan(text)
        sure = [(i, f) for i, f, c in found if c]
        lines = sum(1 for x in text.split("\n") if x and not x.isspace())
        return lines, len(sure), len(found) - len(sure), ",".join(sorted({f for _, f in sure})), ",".join(f"{i}:{f}" for i, f in sure)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(read, "doc_id long, n_lines long, n_licenses long, n_unconfirmed long, families string, licenses string", report, ["doc_id"], ["n_lines", "n_licenses", "n_unconfirmed", "families", "licenses"])
