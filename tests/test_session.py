from tagloom.session import broadcast_if_small, clear_stored, scratch_path, spread, store_table


def test_clear_stored_deletes_what_was_stored(spark):
    clear_stored(spark)
    stored = store_table(spark.range(10), "kept")
    folder = stored.inputFiles()[0].rpartition("/")[0].removeprefix("file:").removeprefix("//")
    unused = scratch_path(spark, "unused")
    assert unused and stored.count() == 10
    assert clear_stored(spark) == 1 and clear_stored(spark) == 0
    import os

    assert not os.path.exists(folder)


def test_broadcasts_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    small = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    assert hinted(broadcast_if_small(small)) and not hinted(broadcast_if_small(small, max_rows=1))
    monkeypatch.setattr("tagloom.session.BROADCAST_BYTES", 2)
    assert not hinted(broadcast_if_small(small))


def test_spread_deals_out_null_and_frequent_keys(spark):
    cores = spark.sparkContext.defaultParallelism
    notes = spark.range(4000, numPartitions=1).selectExpr("IF(id % 4 = 0, 7, CAST(NULL AS INT)) AS hadm_id", "CONCAT('t', id) AS text", "array(id) AS ids")
    dealt = spread(notes, "hadm_id", "text")
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == cores and max(sizes) < 2 * 4000 / cores
    assert sorted(r["text"] for r in dealt.collect()) == sorted(r["text"] for r in notes.collect())
    assert spread(dealt, "hadm_id", "text") is dealt
