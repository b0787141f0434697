"""Islands over a stream of files with rows that come late."""

import json
import os

from pyspark.sql import functions as F

from svspark.streaming.islands import stream_islands


def test_late_rows_join_within_the_delay_and_are_dropped_beyond(spark, tmp_path):
    files = [
        [("x", 0), ("x", 60), ("y", 30)],
        [("x", 400), ("x", 150), ("y", 500)],  # 150 is late but within the delay: it joins the first island
        [("x", 5000), ("y", 5000)],  # the watermark passes what came before
        [("x", 9000), ("y", 9000)],
        [("x", 200), ("x", 20000)],  # 200 is too late
    ]
    for i, rows in enumerate(files):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "t": t}) for k, t in rows))
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in order of their time
    stream = spark.readStream.schema("k string, t long").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    found = stream_islands(stream.withColumn("time", F.timestamp_seconds("t")), "time", ["k"], "100 seconds", "300 seconds")
    query = found.writeStream.format("memory").queryName("islands_found").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    second = lambda c: F.unix_timestamp(c).cast("long")
    rows = spark.table("islands_found").select("k", second("start"), second("last"), "n").collect()
    want = {("x", 0, 150, 3), ("x", 400, 400, 1), ("y", 30, 30, 1), ("y", 500, 500, 1), ("x", 5000, 5000, 1), ("y", 5000, 5000, 1)}
    assert want <= set(map(tuple, rows)) and not any(r[1] == 200 for r in rows)
