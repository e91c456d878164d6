from catalogdiff.operators.counts import count_diff, line_diff, mapped_count_diff
from catalogdiff.operators.drift import column_drift
from catalogdiff.operators.normalize_ora import (
    normalize_oracle,
    ora_columns,
    ora_instance,
    ora_objects,
    ora_source_lines,
    ora_triggers,
    ora_views,
)
from catalogdiff.operators.normalize_pg import (
    normalize_postgres,
    pg_columns,
    pg_instance,
    pg_objects,
    pg_source_lines,
    pg_triggers,
    pg_views,
)
from catalogdiff.operators.presence import (
    mapped_presence_diff,
    presence_diff,
    presence_diff_by_variant,
)
from catalogdiff.operators.selection import (
    InstancePairs,
    TwoInstances,
    filter_owners,
    instance_rank,
    instances,
    known_instances,
    pick_instances,
)
from catalogdiff.operators.supplied import sourcecode_rollup, supplied

__all__ = [
    "InstancePairs",
    "TwoInstances",
    "column_drift",
    "count_diff",
    "filter_owners",
    "instance_rank",
    "instances",
    "known_instances",
    "line_diff",
    "mapped_count_diff",
    "mapped_presence_diff",
    "normalize_oracle",
    "normalize_postgres",
    "ora_columns",
    "ora_instance",
    "ora_objects",
    "ora_source_lines",
    "ora_triggers",
    "ora_views",
    "pg_columns",
    "pg_instance",
    "pg_objects",
    "pg_source_lines",
    "pg_triggers",
    "pg_views",
    "pick_instances",
    "presence_diff",
    "presence_diff_by_variant",
    "sourcecode_rollup",
    "supplied",
]
