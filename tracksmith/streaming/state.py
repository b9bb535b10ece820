"""What the stateful streams share: the state store they need, and rows of a state."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Spark's store on local disks, with changes in the checkpoint: state may outgrow memory, and times to live are kept.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def need_rocks(spark: SparkSession) -> None:
    """Arbitrary state needs this store; it takes the place of the one in memory."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) is None or spark.conf.get(key).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKS)
