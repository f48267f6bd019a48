import os
import re

import numpy as np
import pytest
from helpers import documents

from hearthlake.llm import licences

PROSE = ["The cat sat on the mat and looked at the public square.", "Nothing to see here", "He was granted permission to copy the notice by the general", "Free software is a good thing, any person said", "la maison de la rue", "and of the to in"] * 20


def test_families_unknown_and_prose_are_told_apart(spark):
    rows = [(i, p, "s") for i, p in enumerate(PROSE)]
    rows += [
        (1000, "A line\n\nReleased under the MIT License.\nMore", "s"), (1001, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", "s"), (1002, "This work is licensed under the GNU General Public License, version 2.", "s"),
        (1003, "Licensed under CC BY-NC 3.0.\nLicensed under CC BY-SA 4.0.", "s"), (1004, None, "s"), (1005, "", "s"), (1006, "word " * 40_000 + "\nReleased under the MIT License.", "s"), (1000, "Released under the BSD License.", "s"), (None, "Released under the MIT License.", "s"),
    ]
    docs = documents(spark, rows)
    out = licences.scan(docs, licences.fit(docs)).collect()
    assert len(out) == len(rows)
    families = sorted((str(r.doc_id), sorted({f.family for f in r.findings if f.confirmed})) for r in out if r.doc_id is None or r.doc_id >= 1000)
    assert families == [("1000", ["BSD"]), ("1000", ["MIT"]), ("1001", ["Apache"]), ("1002", ["GPL"]), ("1003", ["CC-BY-NC", "CC-BY-SA"]), ("1004", []), ("1005", []), ("1006", ["MIT"]), ("None", ["MIT"])]
    assert not any(f.confirmed for r in out if r.doc_id is not None and r.doc_id < 1000 for f in r.findings)
    assert licences.scan(docs.limit(0), licences.fit(docs.limit(0))).count() == 0


def test_held_out_variations_are_named():
    model = licences.fit_paragraphs(PROSE, seed=1)
    draw = np.random.default_rng(77)
    made = [(f, v) for f, ts in licences.TEMPLATES.items() for t in ts for v in licences.vary(t, draw, 10)]
    p = model.probabilities([v for _, v in made])
    right = np.mean([model.families[int(x[:-1].argmax())] == f for x, (f, _) in zip(p, made)])
    assert right > 0.95
    assert np.mean([x[:-1].max() >= model.sure for x in p]) > 0.95 and 0.5 <= model.sure < 0.99


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


def test_a_licence_wrapped_over_lines_is_one_finding_and_a_mention_is_none(spark):
    rows = [(1, "Some words first\n\n" + MIT + "\n\nSome words after", "s"), (2, "\n".join("# " + x for x in MIT.split("\n")), "s"), (3, "A report of\nReleased under the MIT License.\nand more", "s")]
    rows += [(4, "He read the MIT license yesterday and liked it", "s"), (5, "The Software\nunder the terms of the", "s"), (6, "Licensed under the Eclipse Public License, version 2.0.", "s"), (7, MIT.split("\n")[0], "s")]
    docs = documents(spark, rows)
    clash = docs.selectExpr("*", "1 AS o", "2 AS id", "3 AS findings", "4 AS n_paragraphs")
    out = {r.doc_id: r for r in licences.scan(clash, licences.fit(clash.union(clash.limit(2)))).collect()}
    found = {k: [(f.paragraph, f.lines, f.family) for f in r.findings if f.confirmed] for k, r in out.items()}
    assert found == {1: [(1, 6, "MIT")], 2: [(0, 6, "MIT")], 3: [(1, 1, "MIT")], 4: [], 5: [], 6: [], 7: []}
    assert [f.family for f in out[6].findings] == ["unknown"] or not out[6].findings[0].confirmed
    assert [out[k].n_paragraphs for k in (1, 2, 3, 5)] == [8, 6, 3, 2]


def test_a_probability_at_the_threshold_names_the_family(spark):
    docs = documents(spark, [(1, "Released under the MIT License.", "s")])
    model = licences.fit_paragraphs(PROSE)
    best = float(model.probabilities(["Released under the MIT License."]).max())
    for sure, family in ((best, "MIT"), (np.nextafter(best, 1), "unknown")):
        model.sure = sure
        assert [(f.family, f.confirmed) for f in licences.scan(docs, model).first().findings] == [(family, family == "MIT")]


def test_probabilities_equal_a_plain_regression():
    model = licences.fit_paragraphs(PROSE)
    number = {}
    for texts in licences.TEMPLATES.values():
        for t in texts:
            words = re.findall(r"[a-z0-9]+", t.lower())
            for n in (1, 2, 3):
                for k in range(len(words) - n + 1):
                    gram = " ".join(words[k : k + n])
                    number[gram] = int(np.searchsorted(model.features, licences.ngram_hashes(gram.encode())[0][-1]))
    assert len(set(number.values())) == len(number) == len(model.features)
    for text in ["Released under the MIT License, version 2", "the cat and the\nGNU General", "", *PROSE[:6]]:
        words = re.findall(r"[a-z0-9]+", text.lower())
        grams = {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}
        z = [(model.bias[c] + sum(model.weights[number[g], c] for g in grams if g in number)) / model.temperature for c in range(len(model.bias))]
        want = np.exp(z) / np.exp(z).sum()
        assert np.allclose(model.probabilities([text])[0], want)


DATA = "/root/testdata/sf0.01"
# The statements that the documents of the test tables hold, as lines of their own.
STATED = {"GPL": "This work is licensed under the GNU General Public License, version 3.", "Proprietary": "All rights reserved.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache": "Licensed under the Apache License, Version 2.0."}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_query_finds_the_stated_licences_of_whole_tables(spark):
    from hearthlake.llm.queries import op3_license_scan

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op3_license_scan(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert {r.doc_id: list(r.families) for r in rows} == {k: sorted(f for f, s in STATED.items() if s in t.split("\n")) for k, t in texts.items()}
    assert all(r.n_paragraphs == sum(1 for x in texts[r.doc_id].split("\n") if x.strip()) for r in rows)
