"""Landed files of several layouts in one folder, and records that do not fit their columns."""

import pytest

from grainwise.sources import delimited, landed


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("landed")
    files = {
        "notes.csv": "\nonly words here\nand here\n",
        "years.csv": "Report,,\n\nCountry,Code,1990,1991\nAland,AX,1,2\nBland,BX,3,4\nTotal,,4,\n",
        "long.csv": "".join(f"note {i}\n" for i in range(120)) + "a,b\n1,2\n3,4\n",
        "plain.csv": "1,2,3\n4,5,6\n",
        "wide.csv": ",".join(f"h{c}" for c in "abcdefgh") + "\n" + "".join(",".join(str(i) for _ in range(8)) + "\n" for i in range(5)) + "Sum,1,1,1,1,1,1,\nSource: x,,,,,,,\n",
        "all_years.csv": "name,note,kind\nx,1990,1991\ny,1992,1993\n",
    }
    for name, text in files.items():
        (path / name).write_text(text)
    return str(path)


def by_file(df):
    return {r["file"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_headers_are_found_however_far_down(spark, folder):
    got = by_file(landed.header_lines(spark, folder))
    assert {f: (list(r["header_lines"]), r["data_start"], r["confidence"]) for f, r in got.items()} == {
        "notes.csv": ([2], 3, "low"), "years.csv": ([3], 4, "high"), "long.csv": (list(range(1, 122)), 122, "medium"),
        "plain.csv": ([], 1, "medium"), "wide.csv": ([1], 2, "high"), "all_years.csv": ([1], 2, "high")}


def test_footers_are_judged_by_their_own_file(spark, folder):
    got = by_file(landed.footer_lines(spark, folder))
    assert {f: (r["lines"], r["footer_lines"]) for f, r in got.items() if f != "long.csv"} == {
        "notes.csv": (3, 0), "years.csv": (6, 1), "plain.csv": (2, 0), "wide.csv": (8, 2), "all_years.csv": (3, 0)}


def test_records_keep_what_does_not_fit(spark, tmp_path):
    text = 'a,b,c\n1,2,3\n4,5\n6,"x, y","line\nbreak",7,,"say ""hi"""\n"",8,9\n'
    (tmp_path / "r.csv").write_text(text)
    rows = [(r["a"], r["b"], r["c"], list(r["overflow"]), r["missing"]) for r in delimited.read_records(spark, str(tmp_path)).collect()]
    assert rows == [("1", "2", "3", [], 0), ("4", "5", None, [], 1), ("6", "x, y", "line\nbreak", ["7", "", 'say "hi"'], 0), (None, "8", "9", [], 0)]
    fine = tmp_path / "fine"
    fine.mkdir()
    (fine / "r.csv").write_text("a,b\n1,2\n")
    assert delimited.record_counts(delimited.read_records(spark, str(fine))).first().asDict() == {"rows": 1, "short": 0, "long": 0, "overflow_cells": 0}
