from voxframe.llm import runtime


def test_checkpointed_rows(spark):
    assert runtime.checkpointed(spark.range(10)).count() == 10


def test_batches_are_bounded_unless_the_caller_says_otherwise(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "12345")
        assert runtime.prepare(spark).conf.get(name) == "12345"
        spark.conf.unset(name)
        assert runtime.prepare(spark).conf.get(name) == str(runtime.ARROW_BATCH_BYTES)
    finally:
        spark.conf.set(name, before)
