"""Records of conversations that are too large to be sent to all tasks."""

from quillwork.plans import queries as base


def test_records_of_a_sorted_join(spark, data):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = base.QUERIES["copy_novel_ngrams"](spark, data).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(base.QUERIES["copy_novel_ngrams"](spark, data).collect()) == want > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
