"""Readers and writers: JSON clips, arrays, directories, BVH, the clip database, vector and style libraries."""
