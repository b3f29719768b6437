"""Number files judged one by one; values made in shares."""

import pytest
from pyspark.sql import functions as F

from runweave.operators import apportion
from runweave.sources import draw_shares, draw_uniform, generate, read_number_files


def test_a_bad_file_gives_nothing_and_a_blank_one_is_empty(spark, tmp_path):
    texts = {
        "good": "1\n 2 \n\n-3\n", "bad": "4\nx5\n6\n7.5\n", "blank": "\n  \n", "empty": "", "wide": "9223372036854775808\n",
        "with space": "8", "big": "\n".join(map(str, range(5_000))),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    numbers, report = read_number_files(spark, str(tmp_path))
    name = F.regexp_extract("file", r"/([a-z]+)[^/]*\.txt$", 1).alias("name")
    got = {r["name"]: r[1:] for r in report.select(name, "status", "numbers", "rejected", "first_rejected").collect()}
    assert got == {
        "good": ("good", 3, 0, None), "bad": ("bad", 0, 2, "x5"), "blank": ("blank", 0, 0, None), "empty": ("blank", 0, 0, None),
        "wide": ("bad", 0, 1, "9223372036854775808"), "with": ("good", 1, 0, None), "big": ("good", 5_000, 0, None),
    }
    sums = {r["name"]: r[1:] for r in numbers.groupBy(name).agg(F.count("*"), F.sum("v")).collect()}
    assert sums == {"good": (3, 0), "with": (1, 8), "big": (5_000, 4_999 * 2_500)}


def test_only_blank_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    numbers, report = read_number_files(spark, str(tmp_path))
    assert numbers.count() == 0 and [r["status"] for r in report.collect()] == ["blank"]


def test_shares_are_made_by_blocks_and_sorted(spark, monkeypatch):
    monkeypatch.setattr(generate, "SHARE_BLOCK", 100)
    monkeypatch.setattr(generate, "TASK_VALUES", 500)
    rows = [(1, 2_345), (2, 0), (3, None), (4, -5), (5, 1), (6, 100), (7, 101)]
    made = draw_shares(spark.createDataFrame(rows, "id long, share long"), "id", low=1, high=50, seed=3)
    counts = {r["id"]: r["n"] for r in made.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 2_345, 5: 1, 6: 100, 7: 101}
    keys = spark.range(2_345).select(draw_uniform(F.col("id") + (1 << 32), 1, 50, 3).alias("v"))
    assert [r["v"] for r in made.where("id = 1").collect()] == sorted(r["v"] for r in keys.collect())
    lying = [r[:] for r in made.collect()]
    assert lying == sorted(lying)


def test_shares_of_weights_and_limits(spark):
    workers = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 3, 0)], "g string, id long, w int")
    made = draw_shares(apportion(workers, "g", "id", "w", 1_000), "id")
    assert {r["id"]: r["count"] for r in made.groupBy("id").count().collect()} == {1: 750, 2: 250, 3: 1_000}
    assert draw_shares(spark.createDataFrame([], "id long, share long"), "id").count() == 0
    with pytest.raises(ValueError):
        draw_shares(spark.createDataFrame([(1, (1 << 32) + 1)], "id long, share long"), "id")
