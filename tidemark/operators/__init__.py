"""Dataflow operators: joins, aggregations, rules, ladders, set operations."""
