from mailposture.llm import licenses, queries

SF = "/root/testdata/sf0.01"


def test_notices_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (3, "a/b/c/x.py", "some text"),
        (4, "a/y.py", "other text\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        (5, "a/d/e/z", None),
        (6, "q/z", ""),
        (7, None, "no path"),
        (8, "top", "Licensed under CC BY-NC 4.0."),
        (9, "a/bb/x", "x " * 300_000),
        (9, "a/bb/x", "x " * 300_000),
    ]
    frame = spark.createDataFrame([(*r, "n", "k") for r in rows], "doc_id bigint, path string, text string, folder string, license string")
    got = sorted((r.doc_id, r.license, r.origin) for r in licenses.scan(frame).collect())
    assert got == [
        (1, "MIT", "notice"), (2, "Apache-2.0", "notice"), (3, "Apache-2.0", "inherited"), (4, "GPL-3.0", "notice"), (5, "MIT", "inherited"),
        (6, None, "none"), (7, None, "none"), (8, "CC-BY-NC-4.0", "notice"), (9, "MIT", "inherited"), (9, "MIT", "inherited"),
    ]
    assert licenses.scan(frame.limit(0)).count() == 0


def test_licence_file_in_the_root_folder(spark):
    frame = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "x/y", "z"), (3, "w", "z")], "doc_id bigint, path string, text string")
    assert sorted((r.doc_id, r.license) for r in licenses.scan(frame).collect()) == [(1, "MIT"), (2, "MIT"), (3, "MIT")]


def test_query_finds_planted_lines(spark):
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    got = {r.doc_id: r for r in queries.RUN["op6_licenses"](spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(table)
    planted = 0
    for r in table:
        found = {known[line] for line in r.text.split("\n") if line in known}
        if found:
            planted += 1
            assert got[r.doc_id].license in found and got[r.doc_id].origin == "notice", r.doc_id
    assert planted > 10
