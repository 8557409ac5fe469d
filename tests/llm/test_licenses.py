"""Licence scans: held-out sentences by family, SQL against the model in Python, wrapped notices, odd inputs."""

import random
import textwrap
import time

import pytest

from lapwing.llm import licenses
from lapwing.llm.license_texts import NOTICES, OTHERS

#: Sentences written for this test: none is trained on or used to calibrate.
HELD_OUT = {
    "MIT": ["Published under MIT terms, see LICENSE.", "We give this code away under the MIT License.", "mit licensed, copyright 2019 the team", "Anyone can reuse this under the terms of the MIT license."],
    "Apache-2.0": ["The code in this folder is provided under Apache 2.0 by its contributors.", "apache license, version 2.0 applies here", "It ships under the Apache License 2.0.", "Dual use is fine: Apache-2.0."],
    "GPL": ["You can copy this under the GPL version 2", "The tool is GPLv2 code.", "It is free software under the GNU General Public License version 3.", "This module may be shared under the GNU GPL."],
    "LGPL": ["Linking is allowed as the library is under the LGPL.", "It comes under the GNU Lesser General Public License.", "LGPLv2.1 code, see COPYING", "The GNU LGPL applies to this library."],
    "AGPL": ["Users can redistribute it under AGPLv3.", "The server is under the GNU Affero General Public License.", "network use falls under the AGPL v3", "Affero GPL code"],
    "BSD": ["The driver is under the 3-clause BSD license.", "BSD-2-Clause code from the base system", "Shared under a BSD-style license.", "It is offered under the new BSD license by its authors."],
    "ISC": ["ISC licensed.", "We use the ISC License here.", "Given away under the ISC license terms."],
    "MPL": ["The browser is under the Mozilla Public License 2.0.", "MPL-2.0 applies to each file.", "Files are shared under MPL 2.0."],
    "EPL": ["Covered by the EPL, version 2.0", "The tools are under the Eclipse Public License.", "EPL-2.0, see notice"],
    "CC-BY": ["Photos are under CC BY 4.0.", "Text under a Creative Commons Attribution 4.0 International License.", "The pictures: CC-BY-4.0"],
    "CC-BY-SA": ["The material is licensed CC-BY-SA 4.0", "Articles are shared under the Creative Commons Attribution-ShareAlike 4.0 license.", "Maps under CC BY-SA 4.0"],
    "CC-BY-NC": ["The corpus is under CC BY-NC 4.0.", "Data for research only: CC-BY-NC-4.0", "Under a Creative Commons Attribution-NonCommercial license."],
    "public-domain": ["This text is in the public domain.", "Given to the public domain with CC0.", "Shared under the Unlicense."],
    "proprietary": ["© 2022 Some House. All rights reserved.", "all rights reserved by the company", "No part of this book may be reproduced without written permission."],
    "unknown": ["Distributed under the Foobar Public License", "Released under the Artistic License.", "Under the terms of the Kelmar Research License 1.0"],
    "none": ["The software was released in the second version and the public liked it.", "He lost his fishing license near the lake.", "Der Mann ging mit der Frau unter die Brücke.", "Human rights were on the table.", "the of it and", "Elle marche sous la pluie.", "The new library opens in spring."],
}


def test_held_out_families():
    wrong = [(f, t, licenses.predict(t)) for f, texts in HELD_OUT.items() for t in texts if licenses.predict(t)[0] != f]
    total = sum(map(len, HELD_OUT.values()))
    assert len(wrong) <= 0.1 * total, wrong
    for f, texts in HELD_OUT.items():
        assert sum(w[0] == f for w in wrong) <= len(texts) / 3, wrong


def test_held_out_sentences_are_confirmed(spark):
    rows = [(f, t) for f, texts in HELD_OUT.items() for t in texts]
    got = licenses.licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).orderBy("doc_id").collect()
    named = [(f, t, r["families"]) for (f, t), r in zip(rows, got, strict=True) if f not in ("none", "unknown")]
    assert sum(f == x for f, _, x in named) >= 0.85 * len(named), [n for n in named if n[0] != n[2]]
    assert all(not r["families"] for (f, _), r in zip(rows, got, strict=True) if f in ("none", "unknown"))
    assert all(r["n_unknown"] == 0 for (f, _), r in zip(rows, got, strict=True) if f == "none")


def test_sql_equals_model(spark):
    """The query's reading of single lines against the regression and the comparison in Python."""
    r = random.Random(4)
    pool = [t for texts in [*HELD_OUT.values(), *NOTICES.values(), OTHERS] for t in texts]
    texts = pool + [" ".join(r.choices(" ".join(r.sample(pool, 2)).split(), k=8)) for _ in range(150)]
    got = {x["doc_id"]: x["paragraphs"] for x in licenses.readings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    templates = licenses.templates()
    for i, t in enumerate(texts):
        family, p = licenses.predict(t)
        grams = licenses.ngrams(t)
        runs = [x.split("\n") for x in templates[licenses.CLASSES.index(family)]]
        confirmed = any(len(grams & set(x)) >= licenses.CONFIRM * len(x) for x in runs)
        if family == "none" or abs(p - licenses.SURE) < 1e-4:
            assert family != "none" or not got[i], t
        elif confirmed:
            assert [x["families"] for x in got[i]] == [[family]], (t, family, p)
        else:
            assert [x["unknown"] for x in got[i]] == [True], (t, family, p)


@pytest.mark.parametrize("width", [40, 72])
def test_wrapped_notices(spark, width):
    cases = [(f, x) for f, texts in NOTICES.items() for x in texts if len(x) > 100]
    notice = lambda x: "/*\n * Some words before.\n *\n" + "\n".join(" * " + y for y in textwrap.wrap(x, width)) + "\n */\nint main;"
    d = spark.createDataFrame([(i, notice(x)) for i, (_, x) in enumerate(cases)] + [(99, "The driver showed\na license at the border\nand went on.")], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licenses.licenses(d).collect()}
    assert sum(got[i] == f for i, (f, _) in enumerate(cases)) >= len(cases) - 1, [(f, got[i]) for i, (f, _) in enumerate(cases) if got[i] != f]
    assert got[99] == ""


def test_documents(spark):
    prose = " ".join("stone river under hill walked old of the a mill".split() * 40)
    texts = {
        f"{prose}\nReleased under the MIT License.\n{prose}": ("MIT", 1, 0),
        f"{prose}\n\nLicensed under the Apache License, Version 2.0.\n\n{prose}\n\nApache-2.0 license applies": ("Apache-2.0", 2, 0),
        "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.": ("CC-BY-NC,GPL", 2, 0),
        "Licensed under the Foo Data License.": ("", 0, 1),
        "The driver showed a license.": ("", 0, 0),
        "": ("", 0, 0),
        None: ("", 0, 0),
    }
    rows = [(i, x, "clash") for i, x in enumerate(texts)] + [(0, "All rights reserved.", None), (None, "All rights reserved.", "x")] + [(50, "Made available by the authors under the Apache License 2.0", "x")] * 2
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string, families string")).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append((r["families"], r["n_confirmed"], r["n_unknown"]))
    for i, want in enumerate(texts.values()):
        assert want in by_id[i]
    assert sorted(by_id[0]) == [("MIT", 1, 0), ("proprietary", 1, 0)] and by_id[None] == [("proprietary", 1, 0)] and by_id[50] == [("Apache-2.0", 1, 0)] * 2
    empty = licenses.licenses(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "families", "n_confirmed", "n_unknown"]


def test_long_lines(spark):
    texts = ["license " + "a-" * 500_000, "license " + "a-b." * 300_000, "license\n" * 100_000, " * \n" * 200_000 + "MIT License", "word " * 200_000 + "released under the MIT License"]
    began = time.time()
    got = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["families"] for r in got[:2]] == ["", ""] and got[3]["families"] == "MIT" and time.time() - began < 90
