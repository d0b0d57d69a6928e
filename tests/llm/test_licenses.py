import random
import textwrap

import numpy as np
import pytest

from weftline.llm.licenses import CALIBRATION, CALIBRATION_OTHERS, FAMILIES, OTHERS, TEMPLATES, UNKNOWN, _examples, license_report, train, words_of


@pytest.fixture(scope="module")
def model():
    return train()


# Notices and sentences that neither training nor calibration has.
HELD_OUT = {
    "Apache-2.0": ["Distributed under the Apache License, Version 2.0, a copy of which is in the file NOTICE.", "Available under Apache 2.0 terms."],
    "MIT": ["This module is licensed under the terms of the MIT License.", "Code is under MIT license, see LICENSE.txt."],
    "ISC": ["Distributed under the terms of the ISC License.", "License: ISC License"],
    "GPL": ["The script is distributed under the GNU General Public License version 2.", "It is free software under the GNU GPL version 3."],
    "AGPL": ["The server is distributed under the GNU Affero General Public License version 3.", "It is free software under the GNU AGPL version 3."],
    "LGPL": ["The library is distributed under the GNU Lesser General Public License version 3.", "Distributed under the LGPL version 3."],
    "BSD": ["Distributed under the 3-Clause BSD License.", "Redistribution in source and binary forms, with or without modification, is permitted."],
    "MPL-2.0": ["This file is distributed under the Mozilla Public License 2.0.", "If a copy of the MPL was not distributed with this file, see the Mozilla Public License."],
    "EPL": ["The bundle is licensed under the Eclipse Public License version 1.0.", "Distributed under the Eclipse Public License."],
    "Zlib": ["Distributed under the zlib license.", "License: zlib/libpng license"],
    "Unlicense": ["The code is free and unencumbered software, released into the public domain."],
    "CC-BY": ["The article is licensed under a Creative Commons Attribution 4.0 License.", "Photo: CC BY 4.0."],
    "CC-BY-SA": ["The article is licensed under a Creative Commons Attribution-ShareAlike 3.0 License.", "Photo: CC BY-SA 4.0."],
    "CC-BY-NC": ["The article is licensed under a Creative Commons Attribution-NonCommercial 3.0 License.", "Photo: CC BY-NC 4.0."],
    "CC0": ["The author waived all copyright and related rights under CC0.", "The table is in the public domain under CC0 1.0."],
    "Proprietary": ["All rights reserved. No part of this book may be reproduced without permission.", "Copyright 2020 Example Press. All rights reserved."],
}
HELD_OUT_OTHERS = [
    "The hunting license is valid for one year.", "He gave the public a free copy of the song.", "The version of the story that she told was shorter.", "You need the permission of the city to sell food here.", "The source of the river is in the north.",
    "The project was granted money by the foundation.", "The general terms of the contract were changed in May.", "The warranty does not cover damages by water.", "Members may use the boats without charge.", "The library reserves the right to close early.",
    "The notice at the door names the conditions of entry.", "A work of art may be published only with the name of the artist.", "Der Hund darf ohne Leine in den Park.", "Le logiciel est plus rapide que la version ancienne.", "La licencia de conducir vale diez años.",
    "The eclipse was seen by the public in the north.",
]


def test_accuracy_on_notices_that_training_has_not_seen(model):
    words = lambda t: [w for w in words_of(t) if w]
    known = [(f, t) for f, ts in HELD_OUT.items() for t in ts]
    seen = {t for of in (TEMPLATES, CALIBRATION) for ts in of.values() for t in ts} | {*OTHERS, *CALIBRATION_OTHERS}
    assert not seen & {t for _, t in known} and not seen & {*HELD_OUT_OTHERS}
    right = [model.predict(words(t))[0] == f for f, t in known]
    assert sum(right) / len(right) >= 0.85, [t for (_, t), r in zip(known, right, strict=True) if not r]
    wrong = [t for t in HELD_OUT_OTHERS if model.predict(words(t))[0] != UNKNOWN]
    assert not wrong and not any(sure for t in HELD_OUT_OTHERS for _, _, sure in model.scan(t))


def test_training_fits_its_own_examples(model):
    rows, classes = _examples(1)
    right = sum(model.predict(r)[0] == FAMILIES[k] for r, k in zip(rows, classes, strict=True))
    assert right / len(rows) > 0.95


def test_usual_headers(model):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
    agpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
    epl = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
    for text, family in ((mit, "MIT"), (agpl, "AGPL"), (agpl.replace("Affero ", ""), "GPL"), (isc, "ISC"), (epl, "EPL")):
        for mark in ("", "// ", " * "):
            assert [(f, s) for _, f, s in model.scan("\n".join(mark + x for x in text.split("\n"))) if s] == [(family, True)], (family, mark)


def plain_scan(model, line):
    """One line by the definitions alone: all n-grams in a dense row, and all stretches against all templates."""
    words = [w for w in "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in line).split(" ") if w]
    z = model.weights[-1].astype(float).copy()
    some = False
    for g, k in model.features.items():
        n = g.split(" ")
        if any(words[i : i + len(n)] == n for i in range(len(words))):
            z, some = z + model.weights[k], True
    p = np.exp((z - z.max()) / model.temperature)
    p /= p.sum()
    k = int(p.argmax())
    if not some or not k or p[k] < model.least:
        return None
    for template, weight in model.templates[FAMILIES[k]]:
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + 2 * len(template)) + 1):
                if sum(weight.get(w, 0) for w in set(words[i:j])) >= 0.6 * sum(weight.values()) - 1e-12:
                    return FAMILIES[k], True
    return FAMILIES[k], False


def test_report_against_plain_version(model, make, prose):
    """Random lines, apart by blank ones: parts of notices, changed notices, sentences and prose."""
    r = random.Random(6)
    sentences = [t for of in (TEMPLATES, CALIBRATION, HELD_OUT) for ts in of.values() for t in ts] + OTHERS + HELD_OUT_OTHERS
    lines = []
    for _ in range(400):
        words = r.choice(sentences).split(" ")
        words = [w for w in words if r.random() > 0.15] or words
        cut = r.randint(0, len(words) // 3)
        lines.append(" ".join([prose(r.randint(0, 6), r.random()), *words[cut:], prose(r.randint(0, 6), r.random())]).strip())
    docs = ["\n\n".join(lines[i : i + 8]) for i in range(0, 400, 8)]
    rows = {x.doc_id: x for x in license_report(make(*docs)).collect()}
    found = 0
    for d, text in enumerate(docs):
        plain = [(i, plain_scan(model, line)) for i, line in enumerate(text.split("\n"))]
        sure = [(i, p[0]) for i, p in plain if p and p[1]]
        found += len(sure)
        expected = (sum(bool(line) for line in text.split("\n")), len(sure), sum(bool(p) and not p[1] for _, p in plain), ",".join(sorted({f for _, f in sure})), ",".join(f"{i}:{f}" for i, f in sure))
        assert tuple(rows[d])[1:] == expected, (tuple(rows[d])[1:], expected)
    assert found > 100


def test_templates_are_found_and_other_sentences_are_not(model):
    for family, templates in TEMPLATES.items():
        for t in templates:
            assert model.scan(f"some words before\n{t}\nand after") == [(1, family, True)], t
    for s in OTHERS:
        assert not any(sure for _, _, sure in model.scan(s)), s


@pytest.mark.parametrize("columns", [40, 60, 72, 79])
def test_wrapped_notices_are_found_where_they_begin(model, columns):
    for family, templates in TEMPLATES.items():
        for t in templates:
            for mark in ("", "# ", " * ", "// "):
                lines = textwrap.wrap(t, columns)
                text = "\n".join(["int x", mark, *(mark + x for x in lines), mark, "some words behind"])
                assert model.scan(text) == [(2, family, True)], (t, mark)
                close = "\n".join(["some words before", *(mark + x for x in lines), "and after"])
                assert model.scan(close) == [(1, family, True)], (t, mark)
    for s in OTHERS:
        assert not any(sure for _, _, sure in model.scan("\n".join(textwrap.wrap(s, columns))))


def test_neighbouring_notices_stay_apart(model):
    one, two = TEMPLATES["MIT"][1], TEMPLATES["LGPL"][0]
    wrapped = [*textwrap.wrap(one, 60), *textwrap.wrap(two, 60)]
    assert model.scan("\n".join(wrapped)) == [(0, "MIT", True), (len(textwrap.wrap(one, 60)), "LGPL", True)]
    for f, templates in TEMPLATES.items():
        for g, others in TEMPLATES.items():
            assert model.scan(f"{templates[0]}\n{others[-1]}") == [(0, f, True), (1, g, True)]


def test_a_prediction_needs_the_template(model):
    assert not any(sure for _, _, sure in model.scan("the mozilla apache gnu foundation"))
    assert model.predict([]) == (UNKNOWN, 1.0) and words_of("A-b,C") == ["a", "b", "c"]


def test_report(make):
    docs = make((1, "x\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0."), (1, "x"), (2, None), (None, ""), (3, "word " * 50_000 + "Licensed under the Apache License, Version 2.0."))
    rows = sorted(map(tuple, license_report(docs).collect()), key=str)
    assert rows == sorted([(1, 3, 2, 0, "CC-BY-NC,MIT", "1:MIT,3:CC-BY-NC"), (1, 1, 0, 0, "", ""), (2, 0, 0, 0, "", ""), (None, 0, 0, 0, "", ""), (3, 1, 1, 0, "Apache-2.0", "0:Apache-2.0")], key=str)
    assert license_report(make().limit(0)).collect() == []
