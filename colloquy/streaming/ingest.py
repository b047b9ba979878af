"""Land a stream of canonical messages into a partitioned Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import MESSAGE_COLUMNS


def append_messages(stream: DataFrame, path: str, checkpoint: str, trigger_once: bool = False) -> StreamingQuery:
    """Append ``stream`` (canonical message columns) to ``path`` partitioned by
    tenant and UTC date; exactly-once through the file sink and ``checkpoint``
    (a shared folder)."""
    out = stream.select(*MESSAGE_COLUMNS).withColumn("dt", F.to_date(F.col("ts")))
    w = (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy("tenant_id", "dt").outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
