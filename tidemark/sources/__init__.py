"""Readers and writers: driver tables, JSON documents, shards with a manifest, snapshots."""
