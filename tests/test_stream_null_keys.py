from revlens.session import scratch_path
from revlens.streaming.fold_stream import tag_responses_stream


def test_keys_beside_a_null_key_keep_states_of_their_own(spark):
    schema = "key long, ts long, seq long, kind string"
    src, sink = scratch_path(spark, "t-null-key"), scratch_path(spark, "t-null-key-out")
    keys = [None, *range(40)]
    for part in range(3):
        rows = [(k, part, i, "end" if i % 2 else "chunk") for k in keys for i in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (tag_responses_stream(stream, ("end",)).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", scratch_path(spark, "t-null-key-ckpt")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {}
    for r in spark.read.parquet(sink).collect():
        got.setdefault(r.key, []).append((r.ts, r.seq, r.response_no))
    assert got.keys() == set(keys)
    for rows in got.values():
        assert sorted(rows) == [(part, i, 2 * part + i // 2) for part in range(3) for i in range(4)]
