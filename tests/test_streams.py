import pytest

from registry import inputs


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_a_file_and_a_folder(spark, tmp_path, files):
    turns = spark.range(12).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "concat('text ', id) AS text")
    turns.repartition(files).write.parquet(str(tmp_path / "written"))
    table = tmp_path / "conversations.parquet"
    if files == 1:
        next((tmp_path / "written").glob("part-*")).rename(table)
    else:
        (tmp_path / "written").rename(table)
    query = (
        inputs.stream_messages(inputs.table_stream(spark, str(tmp_path), "conversations"))
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
