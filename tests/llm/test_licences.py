"""Licences: labelled notices, unknown paragraphs, template confirmation, edge cases."""

import textwrap

import pytest

from casegrid.llm import licences as L


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark)


def test_labelled_paragraphs(spark, model):
    rows = [("mit", "The files here are released under the MIT license"), ("gpl", "Licensed under the GNU General Public License, version 2"),
            ("apache-2.0", "we are licensed under the apache license version 2.0 now"), ("cc-by-nc", "Photos: licensed under CC BY-NC 4.0"),
            (L.UNKNOWN, "The fishing license costs ten dollars a year"), (L.UNKNOWN, "He asked for permission and got it at last")]
    got = model.classified(L._table(spark, rows).withColumnRenamed("family", "gold")).select("gold", "family", "probability").collect()
    assert [r.family for r in got] == [r.gold for r in got] and all(0 < r.probability <= 1 for r in got)


def test_calibration_set(spark, model):
    got = model.classified(L._table(spark, L.CALIBRATION).withColumnRenamed("family", "gold")).collect()
    assert sum(r.family == r.gold for r in got) >= 0.9 * len(got)


def test_scan(spark, make_docs):
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore prose."), (2, "Ask for permission to leave."), (3, "no cue at all"), (4, None), (5, ""),
            (6, "Line one\n\nLicensed under the\nApache License, Version 2.0.\n\nThis work is licensed under the GNU General Public License, version 3."),
            (1, "Some prose.\nReleased under the MIT License.\nMore prose."), (None, "LICENSED UNDER CC BY-NC 4.0."), (7, "w " * 60_000 + "\nReleased under the MIT License.")]
    out = {(r.doc_id, r.licences, r.n_cues, r.n_confirmed) for r in L.scan(make_docs(rows, extra=True)).collect()}
    assert out == {(1, "mit", 1, 1), (2, "", 1, 0), (3, "", 0, 0), (4, "", 0, 0), (5, "", 0, 0), (6, "apache-2.0,gpl", 2, 2), (None, "cc-by-nc", 1, 1), (7, "mit", 1, 1)}
    assert L.scan(make_docs(rows)).count() == len(rows) and L.scan(make_docs([])).count() == 0


def test_plan_has_no_python(spark, make_docs):
    plan = L.scan(make_docs([(1, "Released under the MIT License.")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_every_labelled_row_passes_the_gate(spark, make_docs):
    labelled = L.NOTICES + L.CALIBRATION
    rows = [(i, f"Some prose.\n{t}\nMore prose.") for i, (_, t) in enumerate(labelled)]
    rows += [(900, "(c) 2020 Example Inc. All rights reserved."), (901, "is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files")]
    out = {r.doc_id: r for r in L.scan(make_docs(rows)).collect()}
    assert all(r.n_cues == 1 for r in out.values())
    assert [out[i].licences for i, _ in enumerate(L.NOTICES)] == ["" if f == L.UNKNOWN else f for f, _ in L.NOTICES]
    assert out[900].licences == "proprietary" and out[901].licences == "mit"


def test_no_text_without_an_anchor_covers_a_notice():
    for _, pairs in L.NOTICE_PAIRS:
        assert sum(not any(a in w for w in p.split() for a in L.ANCHORS) for p in pairs) / len(pairs) < L.MIN_COVER


def test_notices_wrapped_over_lines(spark, make_docs):
    def mit(width):
        return "\n".join(textwrap.wrap(next(t for _, t in L.NOTICES if t.startswith("Permission is hereby granted, free")), width))

    gpl = "\n".join(textwrap.wrap(next(t for _, t in L.NOTICES if t.startswith("This program is free software")), 50))
    rows = [(1, "Licensed under the\nApache License, Version 2.0."), (2, mit(60)), (3, mit(80)), (4, "Some prose.\r\n" + gpl.replace("\n", "\r\n") + ".\r\nMore prose."),
            (5, "Released under the MIT License.\nLicensed under the\nApache License, Version 2.0.\nEnd"),
            (6, "Released under the MIT License\nand more\nwithout an end"), (7, "Licensed under the\nEclipse Public\nLicense, version 2.0.")]
    out = {r.doc_id: (r.licences, r.n_cues, r.n_confirmed) for r in L.scan(make_docs(rows)).collect()}
    assert {i: out[i][0] for i in (1, 2, 3, 4, 7)} == {1: "apache-2.0", 2: "mit", 3: "mit", 4: "gpl", 7: ""}
    assert all(out[i][1:] == (1, 1) for i in (1, 2, 3, 4))
    assert out[5] == ("apache-2.0,mit", 2, 2) and out[6] == ("mit", 1, 1)


def test_short_wordings_are_confirmed(spark, make_docs, model):
    rows = [(i, t) for i, (_, t) in enumerate(L.CALIBRATION)]
    said = {r.text: r.family for r in model.classified(L._table(spark, L.CALIBRATION).drop("family")).collect()}
    out = {r.doc_id: r.licences for r in L.scan(make_docs(rows)).collect()}
    assert out == {i: said[t] if said[t] == family != L.UNKNOWN else "" for i, (family, t) in enumerate(L.CALIBRATION)}
