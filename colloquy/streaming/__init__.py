"""Streaming.

The report is a batch computation over the whole history (a conversation's
topic depends on all of its messages and its periods on its latest one), and
the source has no streaming operator, watermark or late-data rule. The only
streaming piece is ingestion: ``ingest.append_messages`` lands a message
stream into the canonical, tenant-partitioned table that batch runs read.
"""
