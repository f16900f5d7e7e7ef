"""Caches by content: what is made, and when."""

from pyspark.sql import functions as F

from winnowry.sources import files


def test_only_missing_entries_are_made(spark, tmp_path):
    path, made = str(tmp_path / "cache"), []

    def make(rows):
        made.append(sorted(r["k"] for r in rows.collect()))
        return rows.withColumn("v", F.col("k") * 10)

    wanted = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    get = lambda *ks: sorted(map(tuple, files.build_cache(wanted(*ks), path, "k", make).collect()))
    assert get(1, 2) == [(1, 10), (2, 20)] and get(2, 3) == [(2, 20), (3, 30)] and get(1, 2, 3) == [(1, 10), (2, 20), (3, 30)]
    assert made == [[1, 2], [3]] and get() == []


def test_a_whole_cache_is_made_anew_for_other_keys(spark, tmp_path):
    path, made = str(tmp_path / "cache"), []

    def make(rows):
        made.append(rows.count())
        return rows

    wanted = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    for keys in ((1, 2), (2, 1), (1, 2, 3), (1, 3), (1, 3)):
        assert sorted(r["k"] for r in files.whole_cache(wanted(*keys), path, "k", make).collect()) == sorted(keys)
    assert made == [2, 3, 2]
