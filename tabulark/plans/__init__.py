"""Query families: each module has QUERIES and ORACLES by name."""

from tabulark.plans import bank_queries, intake_queries, line_queries, marked_queries, merge_queries, rule_queries, store_queries, stream_queries

FAMILIES = [bank_queries, line_queries, merge_queries, stream_queries, rule_queries, store_queries, intake_queries, marked_queries]
