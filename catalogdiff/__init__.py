"""Compare snapshots of database catalogs with Spark."""

from catalogdiff.operators import InstancePairs, TwoInstances, normalize_oracle, normalize_postgres
from catalogdiff.plans import Report, compare, write_findings
from catalogdiff.sources import Staging, import_extracts, read_catalog, stage

__all__ = [
    "InstancePairs",
    "Report",
    "Staging",
    "TwoInstances",
    "compare",
    "import_extracts",
    "normalize_oracle",
    "normalize_postgres",
    "read_catalog",
    "stage",
    "write_findings",
]
