"""The registered queries: each pairs a Spark plan with independent SQL over the same tables."""

from importlib import import_module

MODULES = ["scalars", "money", "process", "contract_terms", "agreements", "runs", "storage"]


def load() -> None:
    for module in MODULES:
        import_module(f"tallypact.workload.{module}")
