"""The stream's pairs equal the batch operator's on the same rows."""

from provenlake.operators import audit
from provenlake.streaming.pairing import paired_stream

SCHEMA = "session string, seq long, idx long, etype string, tool_id string, tool string, command string, body string, is_error boolean, text string"


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for s in range(5):
        for i in range(12):
            kind = ("use", "use", "result", "result", "use", "result")[(i + s) % 6]
            rows.append((f"s{s}", i, 0, kind, f"t{i % 3}", "Bash", f"cmd{i}" if kind == "use" else None, f"out{i}" if kind == "result" else None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r["session"], r["tool_id"], r["use_seq"], r["result_seq"]) for r in audit.paired(df).collect()}
    for part in (df.where("seq < 5"), df.where("seq between 5 and 8"), df.where("seq > 8")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = (
        paired_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in")))
        .writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    )
    assert q.awaitTermination(120)
    got = {(r["session"], r["tool_id"], r["use_seq"], r["result_seq"]) for r in spark.table("pairs").collect()}
    assert want and got == want
