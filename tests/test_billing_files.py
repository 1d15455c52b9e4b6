"""Files that the billing job writes for its ids."""

import json
from collections import Counter

from kerbside.streaming import billing, common


def test_a_batch_writes_few_files_of_ids(spark, tmp_path):
    """Ids are gathered by bucket: a bucket has one file, however many tasks made its rows."""
    common.configure(spark)
    lines = [(json.dumps({"trip_id": f"t{i}", "driver_id": "d", "completed_at": 1_700_000_000_000 + i}),) for i in range(4000)]
    spark.createDataFrame(lines, "value string").repartition(4).write.text(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        billing.start_billing_job(spark, common.read_event_files(spark, str(tmp_path / "in")), str(tmp_path / "out"),
                                  str(tmp_path / "ck"), every=None).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = Counter(p.parent.name for p in (tmp_path / "out" / "billed_ids").rglob("*.parquet"))
    assert len(files) > 200 and max(files.values()) == 1
    assert spark.read.parquet(str(tmp_path / "out" / "billed_ids")).count() == 4000
