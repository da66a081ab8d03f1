"""Heads of files: nothing moves but the head, and no split of a file changes it."""

from grainwise.sources import landed


def test_lines_past_the_head_are_neither_sorted_nor_moved(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a note\n\nkey,word\n" + "".join(f"{i},w\n" for i in range(5_000)))
    found = landed.header_lines(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [(list(r["header_lines"]), r["data_start"], r["confidence"]) for r in found.collect()] == [([3], 4, "high")]


def test_headers_are_the_same_however_files_are_split(spark, tmp_path):
    texts = {"notes": "\nonly words here\nand here\n", "years": "Report,,\n\nCountry,Code,1990,1991\nAland,AX,1,2\nBland,BX,3,4\n", "plain": "1,2,3\n4,5,6\n",
             "long": "".join(f"note {i}\n" for i in range(30)) + "a,b\n1,2\n3,4\n", "last": "name,1990,1991\nx,1992,1993\n", "blank": "\n\n\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = []
    for size in ("128m", "7", "20"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got.append(sorted((r["file"], str(r["header_lines"]), r["data_start"], r["confidence"]) for r in landed.header_lines(spark, str(tmp_path)).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got[0]) == 6 and got[0] == got[1] == got[2]
