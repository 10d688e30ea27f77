"""postlake: a PySpark-native engine for corpora of public social posts.

Landed raw payloads (one JSON object per line, per platform) are normalized
into one typed post schema, validated, selected by term / community / author
/ time with per-group caps, de-duplicated and merged into a keyed store by a
deterministic upsert, and served as counts, pages and exports -- in batch and
with Structured Streaming.  Everything is expressed with DataFrame operators
so Catalyst and AQE plan the work.
"""

__version__ = "0.1.0"
