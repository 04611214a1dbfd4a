"""Every registered query of the library's own operators, with its SQL oracle."""

from corvane.plans import annotations, answers, cached_records, confusion, contracts, dataset, geometry, latency, readers, recall, reports, run_audit, stores, structured, texts, validators  # noqa: F401
from corvane.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
