from siltstone.llm.licenses import TEMPLATES, heavy, license_scan
from siltstone.llm.queries import oracle_sql, queries
from tests.oracle import expect_same

DIR = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    df = queries()["op7_license_scan"](spark, DIR)
    expect_same(df, oracle_sql()["op7_license_scan"], DIR)
    got = df.toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{DIR}/documents.parquet").toPandas().set_index("doc_id")
    for name, line in (("MIT", "Released under the MIT License."), ("GPL-3.0", "GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0.")):
        holds = docs.index[docs.text.str.contains(line, regex=False)]
        assert len(holds) and (got.loc[holds].own_license == name).all()
    plain = docs.index[~docs.text.str.contains("licen", case=False)]
    assert got.loc[plain].own_license.isna().all()


def test_nearest_ancestor_wins_and_own_beats_it(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    prose = "plain prose of many words " * 20
    data = [
        ("a/LICENSE", mit + "\n" + prose), ("a/b/c/x.py", prose), ("a/b/COPYING", gpl + "\n" + prose), ("a/y.py", prose),
        ("a/b/c/own.py", "# Licensed under the Apache License, Version 2.0.\n" + prose), ("z/w.py", prose), ("top.py", prose), (None, mit), ("z/e.py", ""), ("z/n.py", None), ("a/y.py", prose),
    ]
    df = spark.createDataFrame([(p, t, "clash") for p, t in data], "path string, text string, license string")
    got = [(r["path"], r["license"], r["licensed_by"]) for r in license_scan(df).collect()]
    assert len(got) == len(data) and got.count(("a/y.py", "MIT", "/a")) == 2
    by = {p: (l, b) for p, l, b in got}
    assert by["a/b/c/x.py"] == ("GPL-3.0", "/a/b") and by["a/b/c/own.py"] == ("Apache-2.0", "own")
    assert by["z/w.py"] == by["top.py"] == by["z/e.py"] == by["z/n.py"] == (None, None) and by[None] == ("MIT", "own")


def test_every_template_is_found_and_empty(spark):
    df = spark.createDataFrame([(f"d{i}/f", "x y z\n" + t + "\nq") for i, (_, t) in enumerate(TEMPLATES)], "path string, text string")
    got = {r["path"]: r["own_license"] for r in license_scan(df).collect()}
    assert got == {f"d{i}/f": n for i, (n, _) in enumerate(TEMPLATES)}
    assert license_scan(df.limit(0)).collect() == []


def test_prefix_filter_is_exact():
    w = {"a": 3.0, "b": 2.0, "c": 1.0}
    assert heavy(w, 0.75) == {"a", "b"} or heavy(w, 0.75) == {"a"}
    rest = {k: v for k, v in w.items() if k not in heavy(w, 0.75)}
    assert sum(v * v for v in rest.values()) < 0.75**2 * 14


def test_wrapped_and_embedded_templates(spark):
    prose = "plain prose of many words " * 20
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:"
    gpl = (
        " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."
    )
    nc = "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0\nInternational License."
    inside = prose + "Released under the MIT License. " + prose
    data = [("b/LICENSE", bsd), ("b/x.c", prose), ("g/COPYING", prose + "\n" + gpl + "\n" + prose), ("g/y.c", prose), ("n/a.txt", nc), ("m/z.c", inside), ("o/cut.c", gpl[30:])]
    got = {r["path"]: (r["license"], r["licensed_by"]) for r in license_scan(spark.createDataFrame(data, "path string, text string")).collect()}
    assert got == {
        "b/LICENSE": ("BSD-3-Clause", "own"), "b/x.c": ("BSD-3-Clause", "/b"), "g/COPYING": ("GPL-3.0", "own"), "g/y.c": ("GPL-3.0", "/g"),
        "n/a.txt": ("CC-BY-NC-4.0", "own"), "m/z.c": ("MIT", "own"), "o/cut.c": ("GPL-3.0", "own"),
    }


def test_columns_of_any_name_and_long_texts(spark):
    names = ["_near", "_dir", "_salt", "_best", "_words", "_from", "row"]
    long = "word " * 200_000 + "\nReleased under the MIT License.\n" + "more " * 1000
    df = spark.createDataFrame([("a/b", long, *range(7), 9)], "path string, text string, " + ", ".join(f"{n} int" for n in names) + ", license int")
    got = license_scan(df).first()
    assert [got[n] for n in names] == list(range(7)) and got["license"] == "MIT" and not got["license_file"]


def test_whole_licences_wrapped_with_other_lines(spark):
    import textwrap

    data, want = [], {}
    for i, (name, text) in enumerate(TEMPLATES):
        if len(text.split()) > 25:
            body = textwrap.fill(text, 72, initial_indent=" * ", subsequent_indent=" * ")
            data.append((f"p{i}/LICENSE", f"{name} license\n\nCopyright (c) 2021 some author\n\n{body}\n\nprose about other things " + "word " * 300))
            data.append((f"p{i}/src/deep/x.py", "code " * 50))
            want |= {f"p{i}/LICENSE": (name, "own"), f"p{i}/src/deep/x.py": (name, f"/p{i}")}
    got = license_scan(spark.createDataFrame(data, "path string, text string")).collect()
    assert {r["path"]: (r["license"], r["licensed_by"]) for r in got} == want and len(want) == 12
