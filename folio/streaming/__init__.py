"""Structured Streaming: intake (O35, O36), parse (O37) and live status.

All three sinks are ``foreachBatch`` writes into a ``PaperStore`` under a
batch number derived from the micro-batch id, with overwrite. After a
failure Spark re-runs the last micro-batch with the same id and the same
input (file-source offsets are in the checkpoint), so the rewrite lands on
the same folders: exactly-once results without a transactional sink.
"""
