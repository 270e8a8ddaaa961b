from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from quillon import staging


def folder(df):
    return Path(df.inputFiles()[0].removeprefix("file://")).parent


def test_a_block_deletes_its_own_tables_only(spark):
    def run(k):
        with staging.scratch(spark, "kept"):
            gone = staging.stage(spark.range(k + 3), "gone")
            kept = staging.stage(gone.where("id > 0"), "kept")
            path = folder(gone)
        return path.exists(), kept.count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(run, range(8))) == [(False, k + 2) for k in range(8)]


def test_what_an_inner_block_keeps_goes_with_the_outer_one(spark):
    with staging.scratch(spark):
        with staging.scratch(spark, "kept"):
            kept = staging.stage(spark.range(4), "kept")
        path = folder(kept)
        assert path.exists() and kept.count() == 4
    assert not path.exists()
    other = staging.stage(spark.range(2), "other")
    staging.discard(spark, ["elsewhere"])
    assert other.count() == 2
