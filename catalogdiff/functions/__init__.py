from catalogdiff.functions.names import (
    host_to_instance_id,
    parse_owner_list,
    parse_owner_map,
    regclass_text,
)
from catalogdiff.functions.text import all_present, differs, line_count, listed, literal, quoted, shown

__all__ = [
    "all_present",
    "differs",
    "host_to_instance_id",
    "line_count",
    "listed",
    "literal",
    "parse_owner_list",
    "parse_owner_map",
    "quoted",
    "regclass_text",
    "shown",
]
