"""The streaming form of the clean + join equals the batch form on the same files."""

import os

from pyspark.sql import functions as F

from paysift.sources import fixtures as fx
from paysift.sources.csv import read_header_csv
from paysift.streaming import incremental

from .conftest import SF_SMOKE


def test_stream_matches_batch(spark, scratch):
    raw = fx.payments_raw(spark, SF_SMOKE)
    src = os.path.join(scratch, "incoming")
    # two arriving files
    raw.where(F.col("`DRG Definition`") < "025").coalesce(1).write.option("header", True).csv(src + "/a")
    raw.where(F.col("`DRG Definition`") >= "025").coalesce(1).write.option("header", True).csv(src + "/b")
    files = os.path.join(scratch, "files")
    os.makedirs(files)
    for sub in ("a", "b"):
        for f in os.listdir(os.path.join(src, sub)):
            if f.endswith(".csv"):
                os.link(os.path.join(src, sub, f), os.path.join(files, f"{sub}-{f}"))

    regions = fx.prices(spark, SF_SMOKE)
    stream = incremental.payment_stream(spark, files, raw.columns)
    joined = incremental.clean_and_join(stream, regions)
    out = os.path.join(scratch, "joined")
    q = incremental.write_stream(joined, f"joined_{os.path.basename(scratch)}", out)
    q.awaitTermination()

    got = spark.read.parquet(out)
    batch = incremental.clean_and_join(read_header_csv(spark, files, raw.columns), regions)
    expect = fx.joined(spark, SF_SMOKE)
    assert got.count() == batch.count() == expect.count()
    assert got.exceptAll(expect).count() == 0

    prof = incremental.group_profile_stream(incremental.clean_and_join(
        incremental.payment_stream(spark, files, raw.columns), regions))
    name = f"profile_{os.path.basename(scratch)}".replace("-", "_")
    q2 = incremental.write_stream(prof, name, fmt="memory", output_mode="complete")
    q2.awaitTermination()
    rows = {r["DRGDefinition"]: r["n"] for r in spark.sql(f"SELECT * FROM {name}").collect()}
    exp = {r["DRGDefinition"]: r["count"] for r in expect.groupBy("DRGDefinition").count().collect()}
    assert rows == exp
