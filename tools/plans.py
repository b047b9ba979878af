"""Write the sf tables in canonical form (tenant-partitioned Parquet) to a
scratch folder and print the formatted physical plans of every operator.

Usage: python tools/plans.py SF_DIR OUT_DIR [operator ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from colloquy import Dashboard  # noqa: E402
from colloquy.session import local_session  # noqa: E402
from colloquy.sources.tables import read_conversations, read_messages, write_partitioned  # noqa: E402
from colloquy.sources.testdata import CHAT_PARAMS, chat_conversations, chat_messages  # noqa: E402


def main():
    sf_dir, out = sys.argv[1], sys.argv[2]
    only = sys.argv[3:]
    spark = local_session(8)
    m_path, c_path = f"{out}/messages", f"{out}/conversations"
    if not os.path.exists(m_path):
        write_partitioned(chat_messages(spark, sf_dir).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).col("ts").cast("timestamp")), m_path)
        write_partitioned(chat_conversations(spark, sf_dir), c_path)
    msgs, convs = read_messages(spark, m_path), read_conversations(spark, c_path)
    d = Dashboard.from_tables(msgs, convs, CHAT_PARAMS, how=os.environ.get("HOW", "none"))
    ops = {
        "base": lambda: d.base,
        "dispatch_kpis": d.dispatch_kpis, "message_kpis": d.message_kpis, "totals": d.totals,
        "conversation_topics": d.conversation_topics, "topic_distribution": d.topic_distribution,
        "word_cloud": d.word_cloud, "mention_funnel": d.mention_funnel, "sample_quotes": d.sample_quotes,
        "daily_rhythm": d.daily_rhythm, "hourly_heatmap": d.hourly_heatmap, "summary": d.summary,
    }
    for name, fn in ops.items():
        if only and name not in only:
            continue
        print(f"===== {name}")
        fn().explain("formatted")


if __name__ == "__main__":
    main()
