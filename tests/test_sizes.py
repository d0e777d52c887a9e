"""Registered queries on rows and sizes that the given tables do not show."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from offerloom.functions.text import first_of_each, last_of_each
from offerloom.queries.registry import ORACLES


def test_page_meta_titles_with_other_entities(spark, tmp_path):
    titles = ["a &quot;b&quot;", "c &amp; d", "&amp;lt; e", "f &lt; &amp; g", "", "h & i"]
    rows = [(i, f"https://a.ru/{i}", f"<html><title> {t} </title><p>{t}</p></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(
        str(tmp_path / "pages.parquet"))
    got = entry.queries()["page_meta"](spark, str(tmp_path)).select("page_id", "title").collect()
    with duckdb.connect() as con:
        con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        want = con.execute(f"select page_id, title from ({ORACLES['page_meta']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_rows_of_a_small_file_reach_all_tasks(spark, tmp_path):
    from offerloom.queries import extraction, inputs, searching

    spark.range(50).selectExpr(
        "id as p_partkey", "'a b' as p_name", "'x' as p_brand", "'t' as p_type", "cast(id as int) as p_size",
        "1.5D as p_retailprice").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    least = spark.sparkContext.defaultParallelism
    for read in (extraction._part, searching.searches, inputs.part_links):
        assert read(spark, str(tmp_path)).rdd.getNumPartitions() >= max(2, least)


def test_first_of_each_makes_its_list_once(spark):
    items = F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: F.sha2(i.cast("string"), 512))
    started = time.monotonic()
    row = spark.range(10_000, 10_001).select(F.size(first_of_each(items, F.lower)).alias("n")).first()
    assert row["n"] == 10_000 and time.monotonic() - started < 30


def test_last_of_each_makes_its_list_once(spark):
    items = F.transform(F.sequence(F.lit(1), F.col("id")), lambda i: F.sha2(i.cast("string"), 512))
    started = time.monotonic()
    row = spark.range(10_000, 10_001).select(F.size(last_of_each(items, F.lower)).alias("n")).first()
    assert row["n"] == 10_000 and time.monotonic() - started < 30


def test_page_readers_take_small_batches_in_any_session(spark, tmp_path):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.range(1).selectExpr(
        "id as p_partkey", "'a b' as p_name", "'x' as p_brand", "'t' as p_type", "1 as p_size",
        "1.5D as p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    before = spark.conf.get(rows)
    spark.conf.set(rows, "10000")
    try:
        entry.queries()["broad_offers"](spark, str(tmp_path))
        assert spark.conf.get(rows) == "512"
    finally:
        spark.conf.set(rows, before)


def test_page_meta_plan_holds_no_map_of_entities(spark):
    """Each task reads its plan, with a map of 2,125 entries for every text that is decoded."""
    from offerloom.operators.extraction import page_meta

    pages = spark.range(1).selectExpr("'https://a.ru/1' as url", "'<title>a &copy; b</title>' as html")
    found = page_meta(pages)
    assert found.select("title").first()["title"] == "a © b"
    assert "keys: [" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("tag, want", [
    ('<meta property="OG:Title" content="a &amp; b">', "a & b"),
    ("<meta name=og:title content='say \"x\"'>", 'say "x"'),
    ("<meta name='og:title' content=bare>", "bare"),
    ('<meta name="og:title" content="">', None),
    ('<meta name="og:titles" content="x">', None),
])
def test_meta_content(spark, tag, want):
    from offerloom.functions import markup

    row = spark.range(1).select(markup.meta_content(F.array(F.lit("<meta>"), F.lit(tag)), "og:title").alias("c")).first()
    assert row["c"] == want


def test_other_shops_reads_its_parts_on_all_tasks(spark, tmp_path, monkeypatch):
    from offerloom.queries import searches

    spark.range(50).selectExpr(
        "id as p_partkey", "'a b' as p_name", "'x' as p_brand", "'t' as p_type", "cast(id as int) as p_size",
        "1.5D as p_retailprice").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    seen = []

    def collect(found, hits, pages, links):
        seen.extend([hits, pages])
        raise StopIteration

    monkeypatch.setattr(searches.other_shops, "collect_other_shops", collect)
    with pytest.raises(StopIteration):
        entry.queries()["other_shops"](spark, str(tmp_path))
    least = max(2, spark.sparkContext.defaultParallelism)
    assert [df.rdd.getNumPartitions() >= least for df in seen] == [True, True]
