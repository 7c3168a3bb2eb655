"""Importing this package registers all queries."""

from tidemark.plans import aggregates, audits, beliefs, episodic, forgetting, ingest, knowledge, lifecycles, operations, packing, planning, predicates, retrieval, streams, temporal, worlds  # noqa: F401
