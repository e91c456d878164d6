from catalogdiff.sources.extracts import read_extracts, write_extract
from catalogdiff.sources.jdbc import read_catalog
from catalogdiff.sources.staging import Staging, compact, import_extracts, read_staged, stage, superseded, write_staged

__all__ = [
    "Staging",
    "compact",
    "import_extracts",
    "read_catalog",
    "read_extracts",
    "read_staged",
    "stage",
    "superseded",
    "write_extract",
    "write_staged",
]
