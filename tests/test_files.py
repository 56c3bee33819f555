"""The data source of pages: the same rows as whole files give, filters that reach it, files dealt to tasks."""

import pytest
from pyspark.sql import functions as F

from factloom.sources.files import Share, scan_files, shares, text_pages
from factloom.sources.pages import plain_text_reader, read_files

NAMES = {"a.txt": "one\ftwo\f\fvier ü\f五", "b.txt": "", "c c.txt": "only", "d.md": "other", "_e.txt": "hidden", "f.txt": "\f".join(f"page {i} " + "x" * i for i in range(400))}


@pytest.fixture
def folder(tmp_path):
    for name, text in NAMES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return tmp_path


def rows(df):
    return sorted(tuple(r) for r in df.select("document_id", "source_filename", "page_number", "page_count", "text", "char_count", "warnings").collect())


@pytest.mark.parametrize("split", [1 << 20, 700, 64])
def test_same_pages_as_whole_files(spark, folder, split):
    got = rows(scan_files(spark, str(folder), text_pages, "*.txt", split))
    # Spark's reader of whole files leaves out empty ones, which have one empty page here.
    assert [r for r in got if r[1] != "b.txt"] == rows(read_files(spark, str(folder), plain_text_reader, "*.txt"))
    assert [(r[2], r[3], r[4]) for r in got if r[1] == "b.txt"] == [(1, 1, "")]


def opened_once(log):
    def opener(stream):
        count, text = text_pages(stream)

        def logged(n):
            with open(log, "a") as out:
                out.write(f"{n}\n")
            return text(n)

        return count, logged

    return opener


def test_filters_reach_the_source(spark, folder, tmp_path):
    log = tmp_path / "log"
    df = scan_files(spark, str(folder), opened_once(str(log)), "*.txt").filter(F.col("page_number").isin(2, 5) & (F.col("source_filename") != "zz"))
    got = rows(df)
    assert sorted((r[1], r[2], r[3]) for r in got) == [("a.txt", 2, 5), ("a.txt", 5, 5), ("f.txt", 2, 400), ("f.txt", 5, 400)]
    # No other page was extracted.
    assert sorted(map(int, log.read_text().split())) == [2, 2, 5, 5]
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The list is the source's own to test; what it can't test stays in the plan.
    assert "NOT (source_filename" in plan and " IN (" not in plan


@pytest.mark.parametrize(
    "condition",
    ["page_number > 398", "page_number >= 400 or page_number = 1", "page_number = 3 and source_filename = 'f.txt'", "source_filename like 'a%'", "source_filename in ('b.txt', 'c c.txt') and page_number < 2", "page_number <=> 2", "not page_number < 399", "page_number = null", "page_number in (1, null)", "text = 'two'"],
)
def test_pushed_filters_change_no_rows(spark, folder, condition):
    everything = spark.createDataFrame(scan_files(spark, str(folder), text_pages, "*.txt", 700).collect() or [], scan_files(spark, str(folder), text_pages, "*.txt").schema)
    assert rows(scan_files(spark, str(folder), text_pages, "*.txt", 700).filter(condition)) == rows(everything.filter(condition))


def test_shares():
    assert shares([], 10) == []
    assert shares([("b", 25), ("a", 4), ("c", 5), ("d", 6)], 10) == [Share([("b", 0, 3)]), Share([("b", 1, 3)]), Share([("b", 2, 3)]), Share([("a", 0, 1), ("c", 0, 1)]), Share([("d", 0, 1)])]


def test_folders(spark, tmp_path):
    assert scan_files(spark, str(tmp_path), text_pages, "*.txt").count() == 0
    with pytest.raises(FileNotFoundError):
        scan_files(spark, str(tmp_path / "nowhere"))
