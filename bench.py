"""Time the headline operators over staged snapshots; prints one JSON line.

Snapshots and raw catalogs are materialised as parquet first (that time is not
counted), results go to the ``noop`` sink, and a query's time, planning
included, is the median of its runs after warm-up rounds. ``join_form`` times the same comparisons written
with one join per side, over the same files.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogdiff import Staging, compare, stage  # noqa: E402
from catalogdiff import operators as op  # noqa: E402
from catalogdiff.verify import oracles  # noqa: E402
from catalogdiff.verify.queries import ORA_VIEWS, PG_VIEWS, SRC, STAGED_VIEWS, TGT, frames  # noqa: E402

WARM_UPS = 3

SECTIONS = {
    "object_counts": "All Object Counts",
    "objects_missing": "Missing Objects",
    "columns_missing": "Missing Columns",
    "routines_missing": "Missing PLSQL",
    "column_type_mismatch": "Column Type Mismatches",
    "line_count_mismatch_detailed": "Mismatched Line Counts per Object (PL/SQL)",
}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("catalogdiff-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(build: Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def medians(builds: list[Callable[[], DataFrame]], runs: int) -> list[float]:
    """Median time of each build; builds take turns, so that none runs on a colder JVM."""
    rounds = [[seconds(build) for build in builds] for _ in range(WARM_UPS + runs)]
    return [round(statistics.median(times), 3) for times in zip(*rounds[WARM_UPS:], strict=True)]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = session(cpus)
    work = tempfile.mkdtemp(prefix="run-")

    stage(frames(spark, sf_dir, STAGED_VIEWS), f"{work}/staging")
    staging = Staging.open(spark, f"{work}/staging")
    raw: dict[str, dict[str, DataFrame]] = {}
    for dialect, names in (("postgres", PG_VIEWS), ("oracle", ORA_VIEWS)):
        for name, rows in frames(spark, sf_dir, names).items():
            rows.write.mode("overwrite").parquet(f"{work}/{dialect}/{name}")
        raw[dialect] = {name: spark.read.parquet(f"{work}/{dialect}/{name}") for name in names}
    rows_in = {t: staging[t].count() for t in STAGED_VIEWS}

    # The join form reads the same staged files under the names its SQL uses.
    for table, name in {**STAGED_VIEWS, "sourcecode": "fx_sourcecode"}.items():
        staging[table].createOrReplaceTempView(name)

    timed: dict[str, Callable[[], DataFrame]] = {
        key: (lambda title=title: compare(staging, instances=(SRC, TGT), sections=[title])[title])
        for key, title in SECTIONS.items()
    }
    timed["pg_objects"] = lambda: op.pg_objects(raw["postgres"], TGT)
    timed["ora_source_lines"] = lambda: op.ora_source_lines(raw["oracle"], SRC)
    queries, joins = {}, {}
    for key, build in timed.items():
        if key in SECTIONS:
            join = lambda title=SECTIONS[key]: spark.sql(oracles.STAGED_SQL[title])
            queries[key], joins[key] = medians([build, join], runs)
        else:
            (queries[key],) = medians([build], runs)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "join_form": joins,
                "join_form_total": round(sum(joins.values()), 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
                "rows": rows_in,
                "spark": spark.version,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
