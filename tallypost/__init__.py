"""Message delivery analytics on Spark.

Decodes change streams, matches written messages with their deliveries, keeps
transactional-outbox state and summarises delivery latency, in batch and in
Structured Streaming form.
"""
