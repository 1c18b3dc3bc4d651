"""The same operators on streams: windows over event time, deduplication, tracks with state, and running queries."""
