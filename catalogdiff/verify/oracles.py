"""SQL that each registered query is checked against.

The comparisons are written with one join per side, the engine with one
aggregate for both, so the two do not share their logic.
"""

from __future__ import annotations

from collections.abc import Sequence

from catalogdiff.verify.fixtures import SRC, TGT, THIRD, ctes
from catalogdiff.verify.queries import OWNER_MAP, OWNER_MAPS, OWNERS, PAIRS, STAR_PAIRS

OBJECT = ("owner", "object_name", "object_type")
COLUMN = ("owner", "table_name", "column_name")
ROUTINE = ("owner", "name", "type")
INDEX = ("owner", "table_name", "index_name")
TABLES = "u.object_type IN ('TABLE', 'PARTITIONED TABLE')"
LISTED = "pkey IN (SELECT pkey FROM fx_instances)"


def text_list(items: Sequence[str]) -> str:
    return ", ".join(f"'{i}'" for i in items)


def on(left: str, right: str, keys: Sequence[str], equal: str = "=") -> str:
    return " AND ".join(f"{left}.{k} {equal} {right}.{k}" for k in keys)


def cols(keys: Sequence[str], of: str = "") -> str:
    return ", ".join(f"{of}{k}" for k in keys)


def absent(
    table: str,
    keys: Sequence[str],
    one: str = f"pkey = '{SRC}'",
    two: str = f"pkey = '{TGT}'",
    universe: str = "pkey IS NOT NULL",
    variant: str | None = None,
    names: tuple[str, str] = (f"{SRC}_status", f"{TGT}_status"),
    where: str = "true",
    distinct: bool = False,
) -> str:
    """Keys of the universe that a side does not join to, once per row of the other side."""
    every = [*keys, variant] if variant else list(keys)
    last = keys[-1]
    status = [f"CASE WHEN {s}.{last} IS NULL THEN 'Missing' ELSE 'Present' END AS {n}" for s, n in zip("xy", names)]
    return (
        f"SELECT {'DISTINCT ' if distinct else ''}{cols(keys, 'u.')}, {', '.join(status)}"
        f" FROM (SELECT DISTINCT {cols(every)} FROM {table} WHERE {universe}) u"
        f" LEFT JOIN (SELECT {cols(keys)} FROM {table} WHERE {one}) x ON {on('u', 'x', keys)}"
        f" LEFT JOIN (SELECT {cols(keys)} FROM {table} WHERE {two}) y ON {on('u', 'y', keys)}"
        f" WHERE (x.{last} IS NULL OR y.{last} IS NULL) AND {where}"
    )


def unmatched(found: str, tables: str, alias_keys: tuple[str, str] = ("owner", "table_name")) -> str:
    o, t = alias_keys
    return f"SELECT * FROM ({found}) f WHERE NOT EXISTS (SELECT 1 FROM ({tables}) m WHERE m.owner = f.{o} AND m.object_name = f.{t})"


def missing_columns(owners: Sequence[str] | None = None) -> str:
    keep = "true" if owners is None else f"u.owner IN ({text_list(owners)})"
    return unmatched(
        absent("fx_columns", COLUMN, universe=LISTED, where=keep),
        absent("fx_dbobjectnames", OBJECT, where=TABLES),
    )


def counts(table: str = "fx_dbobjectnames", keys: Sequence[str] = ("owner", "object_type"), mismatch: bool = False) -> str:
    side = [f"(SELECT {cols(keys)}, COUNT(*) AS n FROM {table} WHERE pkey = '{i}' GROUP BY {cols(keys)})" for i in (SRC, TGT)]
    same = "IS NOT DISTINCT FROM"
    return (
        f"SELECT {cols(keys, 'u.')}, COALESCE(x.n, 0) AS {SRC}_count, COALESCE(y.n, 0) AS {TGT}_count"
        f" FROM (SELECT DISTINCT {cols(keys)} FROM {table}) u"
        f" LEFT JOIN {side[0]} x ON {on('u', 'x', keys, same)} LEFT JOIN {side[1]} y ON {on('u', 'y', keys, same)}"
        + (" WHERE COALESCE(x.n, 0) <> COALESCE(y.n, 0)" if mismatch else "")
    )


def pair_counts(pairs: Sequence[tuple[str, str]]) -> str:
    parts = []
    for a, b in pairs:
        n = [f"COUNT(*) FILTER (WHERE pkey = '{i}') AS count_{k}" for k, i in ((1, a), (2, b))]
        parts.append(
            f"SELECT '{a}|{b}' AS pair_id, owner, object_type, {', '.join(n)} FROM fx_dbobjectnames"
            f" WHERE pkey IN ('{a}', '{b}') GROUP BY owner, object_type"
        )
    return " UNION ALL ".join(parts)


def drift(one: str = SRC, two: str = TGT, names: tuple[str, str] = (f"{SRC}_{{}}", f"{TGT}_{{}}"), table: str = "fx_columns") -> str:
    shown = ("data_type", "data_length", "data_precision", "nullable")
    pairs = ", ".join(f"{s}.{c} AS {n.format(c)}" for c in shown for s, n in zip("xy", names))
    unequal = " OR ".join(f"x.{c} <> y.{c}" for c in (*shown, "data_scale"))
    return (
        f"SELECT {cols(COLUMN, 'x.')}, {pairs} FROM (SELECT * FROM {table} WHERE pkey = '{one}') x"
        f" JOIN (SELECT * FROM {table} WHERE pkey = '{two}') y ON {on('x', 'y', COLUMN)} WHERE {unequal}"
    )


def lines(table: str, keys: Sequence[str], value: str) -> str:
    side = [
        f"(SELECT {cols(keys)}, CAST(MAX({value}) AS BIGINT) AS n FROM {table} WHERE pkey = '{i}' GROUP BY {cols(keys)})"
        for i in (SRC, TGT)
    ]
    return (
        f"SELECT {cols(keys, 'x.')}, x.n AS {SRC}_line_count, y.n AS {TGT}_line_count"
        f" FROM {side[0]} x JOIN {side[1]} y ON {on('x', 'y', keys, 'IS NOT DISTINCT FROM')} WHERE x.n <> y.n"
    )


def mapped_absent(table: str, keys: Sequence[str], maps: Sequence[tuple[str, str]] = OWNER_MAP, where: str = "true") -> str:
    """Each side is cut to its own owner before the sides are joined."""
    parts = []
    for o1, o2 in maps:
        one = f"(pkey = '{SRC}' AND owner = '{o1}')"
        two = f"(pkey = '{TGT}' AND owner = '{o2}')"
        # A match needs every key part; the first part alone may be present.
        status = [f"CASE WHEN {s}.hit IS NULL THEN 'Missing' ELSE 'Present' END AS {i}_status" for s, i in zip("xy", (SRC, TGT))]
        labels = f"'{o1}' AS owner_1, '{o2}' AS owner_2, " if len(maps) > 1 else ""
        first = keys[0]
        parts.append(
            f"SELECT {labels}u.owner, {cols(keys, 'u.')}, {', '.join(status)}"
            f" FROM (SELECT DISTINCT owner, {cols(keys)} FROM {table} WHERE {one} OR {two}) u"
            f" LEFT JOIN (SELECT {cols(keys)}, {first} AS hit FROM {table} WHERE {one}) x ON {on('u', 'x', keys)}"
            f" LEFT JOIN (SELECT {cols(keys)}, {first} AS hit FROM {table} WHERE {two}) y ON {on('u', 'y', keys)}"
            f" WHERE (x.hit IS NULL OR y.hit IS NULL) AND {where}"
        )
    return " UNION ALL ".join(parts)


def mapped_counts() -> str:
    (o1, o2), same = OWNER_MAP[0], "fx_mapped_objects"
    side = [
        f"(SELECT object_type, COUNT(*) AS n FROM {same} WHERE pkey = '{i}' AND owner = '{o}' GROUP BY object_type)"
        for i, o in ((SRC, o1), (TGT, o2))
    ]
    return (
        f"SELECT COALESCE(x.object_type, y.object_type) AS object_type, COALESCE(x.n, 0) AS {SRC}_count,"
        f" COALESCE(y.n, 0) AS {TGT}_count FROM {side[0]} x FULL JOIN {side[1]} y ON x.object_type = y.object_type"
    )


def mapped_columns(maps: Sequence[tuple[str, str]] = OWNER_MAP) -> str:
    parts = []
    for m in maps:
        rows = unmatched(mapped_absent("fx_mapped_columns", COLUMN[1:], [m]), mapped_absent("fx_mapped_objects", OBJECT[1:], [m], TABLES))
        labels = f"'{m[0]}' AS owner_1, '{m[1]}' AS owner_2, " if len(maps) > 1 else ""
        parts.append(f"SELECT {labels}* FROM ({rows})")
    return " UNION ALL ".join(parts)


def per_pair(build, pairs: Sequence[tuple[str, str]] = PAIRS) -> str:
    return " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair_id, * FROM ({build(a, b)})" for a, b in pairs)


def of_pair(sql: str, a: str, b: str, value: str) -> str:
    """The SQL of the two usual instances for two others, its value columns named by side."""
    swapped = sql.replace(SRC, "<1>").replace(TGT, "<2>").replace("<1>", a).replace("<2>", b)
    return f"SELECT * EXCLUDE ({a}_{value}, {b}_{value}), {a}_{value} AS {value}_1, {b}_{value} AS {value}_2 FROM ({swapped})"


def pair_absent(table: str, keys: Sequence[str], a: str, b: str, where: str = "true") -> str:
    return absent(table, keys, f"pkey = '{a}'", f"pkey = '{b}'", f"pkey IN ('{a}', '{b}')", None, ("status_1", "status_2"), where)


def pair_columns(a: str, b: str) -> str:
    return unmatched(pair_absent("fx_columns", COLUMN, a, b), pair_absent("fx_dbobjectnames", OBJECT, a, b, TABLES))


def staged(select: str, source: str, pkey: str | None, dialect: str) -> str:
    key = f"'{pkey}' AS pkey" if pkey else "s.pkey"
    return f"SELECT {key}, 1 AS con_id, {select}, '{dialect}' AS dma_source_id, CAST(NULL AS VARCHAR) AS dma_manual_id FROM ({source}) s"


# The kinds of relations that are objects.
RELATION_KINDS = ("r", "v", "m", "i", "S", "t", "p", "I")


def pg_objects(prefix: str = "raw", pkey: str | None = TGT, classes: str | None = None) -> str:
    db = "pkey, " if pkey is None else ""
    same = lambda a, b: f" AND {a}.pkey = {b}.pkey" if pkey is None else ""
    cls = classes or f"{prefix}_pg_class"
    k = "c.pkey, " if pkey is None else ""
    kp = "p.pkey, " if pkey is None else ""
    relations = (
        f"SELECT {k}n.nspname, c.relname AS name, CASE"
        " WHEN h.inhrelid IS NOT NULL AND c.relkind = 'r' THEN 'TABLE PARTITION'"
        " WHEN h.inhrelid IS NULL AND lower(c.relkind) = 'i' THEN 'INDEX'"
        " ELSE COALESCE(d.kind, c.relkind) END AS kind"
        f" FROM {cls} c JOIN {prefix}_pg_namespace n ON n.oid = c.relnamespace{same('n', 'c')}"
        f" LEFT JOIN {prefix}_pg_inherits h ON h.inhrelid = c.oid{same('h', 'c')}"
        " LEFT JOIN (VALUES ('r', 'TABLE'), ('v', 'VIEW'), ('m', 'MATERIALIZED VIEW'), ('S', 'SEQUENCE'),"
        " ('t', 'TOAST TABLE'), ('p', 'PARTITIONED TABLE')) d(letter, kind) ON d.letter = c.relkind"
        f" WHERE c.relkind IN ({text_list(RELATION_KINDS)}) AND n.nspname NOT IN ('pg_catalog', 'information_schema', 'pg_toast')"
    )
    routines = (
        f"SELECT {kp}n.nspname, p.proname, CASE WHEN p.prokind = 'p' THEN 'PROCEDURE' WHEN p.prokind = 'f' THEN 'FUNCTION' END"
        f" FROM {prefix}_pg_proc p JOIN {prefix}_pg_namespace n ON n.oid = p.pronamespace{same('n', 'p')}"
        f" JOIN {prefix}_pg_language l ON l.oid = p.prolang{same('l', 'p')} AND l.lanname = 'plpgsql'"
        " WHERE n.nspname NOT IN ('pg_catalog', 'information_schema')"
    )
    triggers = (
        f"SELECT {k}n.nspname, t.tgname, 'TRIGGER' FROM {prefix}_pg_trigger t JOIN {cls} c ON c.oid = t.tgrelid{same('c', 't')}"
        f" JOIN {prefix}_pg_namespace n ON n.oid = c.relnamespace{same('n', 'c')}"
        " WHERE NOT t.tgisinternal AND n.nspname NOT IN ('public', 'information_schema')"
    )
    union = f"SELECT {db}nspname, name, kind FROM ({relations} UNION ALL {routines} UNION ALL {triggers}) a"
    union += " WHERE kind <> 'i' AND upper(name) NOT LIKE '%_ROWID%'"
    return staged("upper(s.nspname) AS owner, upper(s.name) AS object_name, s.kind AS object_type", union, pkey, "Postgres")


def pg_columns(by_name_only: bool = False) -> str:
    schema = "" if by_name_only else " AND n.nspname = c.table_schema"
    source = (
        "SELECT c.* FROM raw_pg_info_columns c JOIN raw_pg_class r ON r.relname = c.table_name"
        f" JOIN raw_pg_namespace n ON n.oid = r.relnamespace{schema} LEFT JOIN raw_pg_inherits h ON h.inhrelid = r.oid"
        " WHERE h.inhrelid IS NULL AND c.table_schema NOT IN ('pg_catalog', 'information_schema') AND lower(c.column_name) <> 'rowid'"
    )
    select = (
        "upper(table_schema) AS owner, upper(table_name) AS table_name, upper(column_name) AS column_name,"
        " upper(data_type) AS data_type, character_maximum_length AS data_length, numeric_precision AS data_precision,"
        " numeric_scale AS data_scale, is_nullable AS nullable"
    )
    return staged(select, source, TGT, "Postgres")


PG_ROUTINES = (
    "SELECT n.nspname, p.* FROM raw_pg_proc p JOIN raw_pg_namespace n ON n.oid = p.pronamespace"
    " WHERE p.prolang = (SELECT oid FROM raw_pg_language WHERE lanname = 'plpgsql')"
    " AND n.nspname NOT IN ('pg_catalog', 'information_schema')"
)
PG_TRIGGERS = (
    "SELECT n.nspname, c.relname, t.* FROM raw_pg_trigger t JOIN raw_pg_class c ON c.oid = t.tgrelid"
    " JOIN raw_pg_namespace n ON n.oid = c.relnamespace"
    " WHERE NOT t.tgisinternal AND n.nspname NOT IN ('public', 'information_schema')"
)
USERS = "s.owner NOT IN ('SYS', 'SYSTEM')"


def quoted(name: str) -> str:
    return f"CASE WHEN regexp_full_match({name}, '[a-z_][a-z0-9_]*') THEN {name} ELSE '\"' || {name} || '\"' END"


def ora_objects(table: str = "raw_ora_objects", parts: str = "raw_ora_tab_partitions", pkey: str | None = SRC, user: bool = False) -> str:
    more = " AND p.pkey = s.pkey" if pkey is None else ""
    owner_match = "" if user else " AND p.table_owner = s.owner"
    who = "'APP_OWNER'" if user else "upper(s.owner)"
    keep = "true" if user else USERS
    source = f"SELECT * FROM {table} s WHERE {keep} AND s.object_type <> 'LOB'"
    name = (
        "CASE WHEN s.object_type = 'TABLE PARTITION' THEN concat(s.object_name, '_', s.subobject_name)"
        " WHEN s.object_name LIKE 'DR$IDX_%' THEN s.object_name || ' *Warning: FULL TEXT SEARCH INDEX*' ELSE s.object_name END"
    )
    kind = (
        f"CASE WHEN s.object_type = 'TABLE' AND EXISTS (SELECT 1 FROM {parts} p WHERE p.table_name = s.object_name{owner_match}{more})"
        " THEN 'PARTITIONED TABLE' ELSE s.object_type END"
    )
    return staged(f"{who} AS owner, {name} AS object_name, {kind} AS object_type", source, pkey, "Oracle")


ORA_COLUMNS = (
    "upper(s.owner) AS owner, s.table_name, s.column_name, s.data_type, s.data_length, s.data_precision, s.data_scale, s.nullable"
)

MODE_PARTS = {
    ("oracle", "db_one"): lambda k: ora_objects(pkey=k),
    ("oracle", "db_two"): lambda k: ora_objects("raw_ora_objects_two", pkey=k),
    ("postgres", "db_one"): lambda k: pg_objects(pkey=k),
    ("postgres", "db_two"): lambda k: pg_objects(pkey=k, classes="raw_pg_class_two"),
}
PG_RAW = [f"raw_pg_{t}" for t in ("namespace", "class", "inherits", "language", "proc", "trigger", "info_columns", "info_views")]
ORA_RAW = [f"raw_ora_{t}" for t in ("objects", "tab_partitions", "source", "tab_columns", "views", "triggers")]


def compare_modes(mode: str) -> str:
    both = " UNION ALL ".join(
        f"SELECT * FROM ({MODE_PARTS[d, k](k)})" for d, k in zip(mode.split("_to_"), ("db_one", "db_two"))
    )
    found = absent("both_sides", OBJECT, "pkey = 'db_one'", "pkey = 'db_two'", names=("db_one_status", "db_two_status"))
    return f"{ctes(*PG_RAW, *ORA_RAW, 'raw_pg_class_two', 'raw_ora_objects_two')}, both_sides AS ({both}) {found}"


def supplied_grants(table: str, grant: str) -> str:
    return (
        f"SELECT pkey, 1 AS con_id, CAST(grantee AS VARCHAR) AS grantee, {grant},"
        f" 'Oracle' AS dma_source_id, CAST(NULL AS VARCHAR) AS dma_manual_id FROM {table}"
    )


STAGED_SQL = {
    "Instances": "SELECT DISTINCT pkey AS instance_id FROM fx_instances",
    "Mismatched Object Counts": counts(mismatch=True),
    "All Object Counts": counts(),
    "All Object Counts (per Schema)": counts(),
    "Mismatched Object Counts (per Schema)": counts(mismatch=True),
    "Missing Objects": absent("fx_dbobjectnames", OBJECT),
    "Missing Columns": missing_columns(),
    "Missing Indexes": absent("fx_indexes", INDEX, universe=LISTED, variant="index_type", where="u.index_type <> 'LOB'"),
    "Column Type Mismatches": drift(),
    "Mismatched Line Counts (PL/SQL)": lines("fx_sourcecode", ("owner", "type"), "sum_nr_lines"),
    "Missing PLSQL": absent("fx_sourcecodedetailed", ROUTINE, universe=LISTED),
    "Mismatched Line Counts per Object (PL/SQL)": lines("fx_sourcecodedetailed", ROUTINE, "nr_lines"),
    "Missing Role Grants": absent("fx_roleprivs", ("grantee", "granted_role"), universe=LISTED),
    "Missing Sys Privileges": absent("fx_sysprivs", ("grantee", "privilege"), universe=LISTED),
}
MAPPED_SQL = {
    "Instances": "SELECT DISTINCT pkey AS instance_id FROM fx_instances",
    "All Object Counts": mapped_counts(),
    "Missing Objects": mapped_absent("fx_mapped_objects", OBJECT[1:]),
    "Missing Columns": mapped_columns(),
    "Missing PLSQL": mapped_absent("fx_mapped_source", ROUTINE[1:]),
}
ALL_STAGED = [f"fx_{t}" for t in ("instances", "dbobjectnames", "columns", "sourcecode", "indexes", "roleprivs", "sysprivs")]
ALL_MAPPED = ["fx_instances", "fx_mapped_objects", "fx_mapped_columns", "fx_mapped_source"]


def named(names: Sequence[str], of: dict[str, str] | None = None) -> str:
    return " || ', ' || ".join(f"'{n}=' || COALESCE(CAST({(of or {}).get(n, n)} AS VARCHAR), 'NULL')" for n in names)


# What names a finding of each section, its value on a side, and the sections that run unasked.
REPORTED = {
    "Instances": (("instance_id",), ()),
    "Mismatched Object Counts": (("owner", "object_type"), ("count",)),
    "All Object Counts": (("owner", "object_type"), ("count",)),
    "All Object Counts (per Schema)": (("owner", "object_type"), ("count",)),
    "Mismatched Object Counts (per Schema)": (("owner", "object_type"), ("count",)),
    "Missing Objects": (OBJECT, ("status",)),
    "Missing Columns": (COLUMN, ("status",)),
    "Missing Indexes": (INDEX, ("status",)),
    "Column Type Mismatches": (COLUMN, ("data_type", "data_length", "data_precision", "nullable")),
    "Mismatched Line Counts (PL/SQL)": (("owner", "type"), ("line_count",)),
    "Missing PLSQL": (ROUTINE, ("status",)),
    "Mismatched Line Counts per Object (PL/SQL)": (ROUTINE, ("line_count",)),
    "Missing Role Grants": (("grantee", "granted_role"), ("status",)),
    "Missing Sys Privileges": (("grantee", "privilege"), ("status",)),
}
MAPPED_REPORTED = {
    "Instances": (("instance_id",), ()),
    "All Object Counts": (("object_type",), ("count",)),
    "Missing Objects": (OBJECT, ("status",)),
    "Missing Columns": (COLUMN, ("status",)),
    "Missing PLSQL": (ROUTINE, ("status",)),
}
DEFAULTS = (
    "Instances", "Mismatched Object Counts", "All Object Counts", "All Object Counts (per Schema)",
    "Mismatched Object Counts (per Schema)", "Missing Objects", "Missing Columns", "Missing PLSQL",
)


def findings(reported: dict[str, tuple], sqls: dict[str, str]) -> str:
    parts = []
    for title, sql in sqls.items():
        keys, shown = reported[title]
        values = []
        for i in (SRC, TGT):
            if not shown:
                values.append("CAST(NULL AS VARCHAR)")
            elif len(shown) == 1:
                values.append(f"CAST({i}_{shown[0]} AS VARCHAR)")
            else:
                values.append(named(shown, {v: f"{i}_{v}" for v in shown}))
        parts.append(
            f"SELECT '{SRC}|{TGT}' AS pair_id, '{title}' AS section, {named(keys)} AS key,"
            f" {values[0]} AS value_1, {values[1]} AS value_2 FROM ({sql})"
        )
    return " UNION ALL ".join(parts)


def summary() -> str:
    return " UNION ALL ".join(
        f"SELECT '{SRC}|{TGT}' AS pair_id, '{t}' AS section, COUNT(*) AS findings FROM ({sql})" for t, sql in STAGED_SQL.items()
    )


def over(names: str | Sequence[str], sql: str) -> str:
    return f"{ctes(*([names] if isinstance(names, str) else names))} {sql}"


def section(title: str) -> str:
    return over(ALL_STAGED, STAGED_SQL[title])


def mapped(title: str) -> str:
    return over(ALL_MAPPED, MAPPED_SQL[title])


IN_OWNERS = f"u.owner IN ({text_list(OWNERS)})"
HOSTS = (
    "SELECT regexp_extract(url, '//([^/:]+)', 1) AS host FROM pages UNION ALL"
    " SELECT '10.' || CAST(page_id // 65536 % 256 AS VARCHAR) || '.' || CAST(page_id // 256 % 256 AS VARCHAR) || '.' || CAST(page_id % 256 AS VARCHAR) FROM pages"
)
HOST_ID = r"CASE WHEN regexp_full_match(host, '[0-9.]*') THEN 'ip_' || replace(host, '.', '_') ELSE regexp_replace(host, '[^\p{L}]', '', 'g') END"

NOT_LOB = "u.index_type <> 'LOB'"
FINDINGS_OF_PAIRS = (
    f"SELECT pair_id, 'Missing Sys Privileges' AS section, {named(('grantee', 'privilege'))} AS key, status_1 AS value_1, status_2 AS value_2"
    f" FROM ({per_pair(lambda a, b: pair_absent('fx_sysprivs', ('grantee', 'privilege'), a, b))}) UNION ALL"
    f" SELECT pair_id, 'Types', {named(('owner', 'data_type', 'columns_1', 'columns_2'))}, NULL, NULL FROM ("
    + per_pair(
        lambda a, b: f"SELECT owner, data_type, COUNT(*) FILTER (WHERE pkey = '{a}') AS columns_1, COUNT(*) FILTER (WHERE pkey = '{b}') AS columns_2"
        f" FROM fx_columns WHERE pkey IN ('{a}', '{b}') GROUP BY owner, data_type"
    )
    + ")"
)

ORACLES: dict[str, str] = {
    "instances": over("fx_staged_instances", "SELECT DISTINCT pkey AS instance_id FROM fx_staged_instances"),
    "object_counts": section("All Object Counts"),
    "object_counts_mismatch": section("Mismatched Object Counts"),
    "object_counts_per_schema": section("All Object Counts (per Schema)"),
    "object_counts_per_schema_mismatch": section("Mismatched Object Counts (per Schema)"),
    "objects_missing": section("Missing Objects"),
    "objects_missing_owner_filter": over("fx_dbobjectnames", absent("fx_dbobjectnames", OBJECT, where=IN_OWNERS)),
    "objects_missing_deduped": over("fx_dbobjectnames", absent("fx_dbobjectnames", OBJECT, distinct=True)),
    "objects_missing_own_universe": over(
        "fx_dbobjectnames", absent("fx_dbobjectnames", OBJECT, universe=f"pkey IN ('{SRC}', '{TGT}')")
    ),
    "objects_missing_picked_instances": section("Missing Objects"),
    "objects_missing_long_owner_list": over("fx_dbobjectnames", absent("fx_dbobjectnames", OBJECT, where=IN_OWNERS)),
    "objects_missing_after_empty_reload": over(
        "fx_dbobjectnames", absent(f"(SELECT * FROM fx_dbobjectnames WHERE pkey <> '{TGT}') r", OBJECT)
    ),
    "columns_missing": section("Missing Columns"),
    "columns_missing_owner_filter": over(ALL_STAGED, missing_columns(OWNERS)),
    "indexes_missing": section("Missing Indexes"),
    "indexes_missing_deduped": over(ALL_STAGED, f"SELECT DISTINCT * FROM ({STAGED_SQL['Missing Indexes']})"),
    "routines_missing": section("Missing PLSQL"),
    "routines_missing_listed_instances": over(
        ["fx_three_sources", "fx_roleprivs"],
        absent("fx_three_sources", ROUTINE, universe="pkey IN (SELECT pkey FROM fx_roleprivs)"),
    ),
    "column_type_mismatch": section("Column Type Mismatches"),
    "column_type_mismatch_several_declarations": over("fx_columns_repeated", drift(table="fx_columns_repeated")),
    "line_count_mismatch": section("Mismatched Line Counts (PL/SQL)"),
    "line_count_mismatch_staged_rollup": over(
        "fx_sourcecode_staged", lines("fx_sourcecode_staged", ("owner", "type"), "sum_nr_lines")
    ),
    "line_count_mismatch_detailed": section("Mismatched Line Counts per Object (PL/SQL)"),
    "role_grants_missing": section("Missing Role Grants"),
    "sys_privs_missing": section("Missing Sys Privileges"),
    "mapped_instances": over("fx_staged_instances", "SELECT DISTINCT pkey AS instance_id FROM fx_staged_instances"),
    "mapped_object_counts": mapped("All Object Counts"),
    "mapped_objects_missing": mapped("Missing Objects"),
    "mapped_columns_missing": mapped("Missing Columns"),
    "mapped_routines_missing": mapped("Missing PLSQL"),
    "mapped_objects_missing_many_maps": over(ALL_MAPPED, mapped_absent("fx_mapped_objects", OBJECT[1:], OWNER_MAPS)),
    "mapped_columns_missing_many_maps": over(ALL_MAPPED, mapped_columns(OWNER_MAPS)),
    "mapped_null_names_missing": over("fx_mapped_names", mapped_absent("fx_mapped_names", OBJECT[1:])),
    "objects_missing_many_pairs": over(ALL_STAGED, per_pair(lambda a, b: pair_absent("fx_dbobjectnames", OBJECT, a, b))),
    "objects_missing_star_of_pairs": over(
        "fx_star_objects", per_pair(lambda a, b: pair_absent("fx_star_objects", OBJECT, a, b), STAR_PAIRS)
    ),
    "indexes_missing_many_pairs": over(
        ALL_STAGED,
        per_pair(
            lambda a, b: absent(
                "fx_indexes", INDEX, f"pkey = '{a}'", f"pkey = '{b}'", f"pkey IN ('{a}', '{b}')", "index_type", ("status_1", "status_2"), NOT_LOB
            )
        ),
    ),
    "routines_missing_many_pairs": over(ALL_STAGED, per_pair(lambda a, b: pair_absent("fx_sourcecodedetailed", ROUTINE, a, b))),
    "line_count_mismatch_many_pairs": over(
        ALL_STAGED, per_pair(lambda a, b: of_pair(STAGED_SQL["Mismatched Line Counts (PL/SQL)"], a, b, "line_count"))
    ),
    "line_count_mismatch_detailed_many_pairs": over(
        ALL_STAGED, per_pair(lambda a, b: of_pair(STAGED_SQL["Mismatched Line Counts per Object (PL/SQL)"], a, b, "line_count"))
    ),
    "role_grants_missing_many_pairs": over(
        ALL_STAGED, per_pair(lambda a, b: pair_absent("fx_roleprivs", ("grantee", "granted_role"), a, b))
    ),
    "object_counts_mismatch_many_pairs": over(ALL_STAGED, f"SELECT * FROM ({pair_counts(PAIRS)}) WHERE count_1 <> count_2"),
    "column_type_mismatch_several_declarations_many_pairs": over(
        "fx_columns_repeated",
        per_pair(lambda a, b: drift(a, b, ("{}_1", "{}_2"), "fx_columns_repeated"), [(SRC, TGT), (TGT, SRC)]),
    ),
    "mapped_objects_missing_many_pairs": over(
        ALL_MAPPED,
        per_pair(
            lambda a, b: of_pair(mapped_absent("fx_mapped_objects", OBJECT[1:], OWNER_MAPS), a, b, "status"), [(SRC, TGT), (SRC, THIRD)]
        ),
    ),
    "custom_section_many_pairs": over(ALL_STAGED, FINDINGS_OF_PAIRS),
    "columns_missing_many_pairs": over(ALL_STAGED, per_pair(pair_columns)),
    "column_type_mismatch_many_pairs": over(ALL_STAGED, per_pair(lambda a, b: drift(a, b, ("{}_1", "{}_2")))),
    "object_counts_many_pairs": over(ALL_STAGED, pair_counts(PAIRS)),
    "object_counts_many_pairs_repeated": over(ALL_STAGED, pair_counts(PAIRS)),
    "pg_columns": over(PG_RAW, pg_columns()),
    "pg_columns_by_name_only": over(PG_RAW, pg_columns(by_name_only=True)),
    "pg_instance": over("fleet_pg_namespace", "SELECT DISTINCT pkey, 1 AS con_id FROM fleet_pg_namespace"),
    "pg_views": over(
        PG_RAW,
        staged(
            "upper(s.table_schema) AS owner, upper(s.table_name) AS view_name",
            "SELECT * FROM raw_pg_info_views WHERE table_schema NOT IN ('pg_catalog', 'information_schema')",
            TGT,
            "Postgres",
        ),
    ),
    "pg_objects": over(PG_RAW, pg_objects()),
    "pg_objects_many_databases": over(
        [f"fleet_pg_{t}" for t in ("namespace", "class", "inherits", "language", "proc", "trigger")], pg_objects("fleet", None)
    ),
    "pg_source_lines": over(
        PG_RAW,
        staged(
            "upper(s.nspname) AS owner, upper(s.proname) AS name,"
            " CASE WHEN s.prokind = 'p' THEN 'PROCEDURE' WHEN s.prokind = 'f' THEN 'FUNCTION' END AS type,"
            " CAST(CASE WHEN s.definition IS NULL THEN 0 ELSE len(string_split(s.definition, chr(10))) END AS INT) AS nr_lines",
            PG_ROUTINES,
            TGT,
            "Postgres",
        ),
    ),
    "pg_triggers": over(
        PG_RAW,
        staged(
            f"s.nspname AS owner, s.tgname AS trigger_name, CASE WHEN s.nspname = 'pg_catalog' THEN {quoted('s.relname')}"
            f" ELSE {quoted('s.nspname')} || '.' || {quoted('s.relname')} END AS table_name, s.tgenabled AS status",
            PG_TRIGGERS,
            TGT,
            "Postgres",
        ),
    ),
    "ora_columns": over(ORA_RAW, staged(ORA_COLUMNS, f"SELECT * FROM raw_ora_tab_columns s WHERE {USERS}", SRC, "Oracle")),
    "ora_columns_owner_filter": over(
        ORA_RAW, staged(ORA_COLUMNS, "SELECT * FROM raw_ora_tab_columns s WHERE owner IN ('sch_3', 'sch_4')", SRC, "Oracle")
    ),
    "ora_instance": over("fleet_ora_objects", "SELECT DISTINCT pkey, 1 AS con_id FROM fleet_ora_objects"),
    "ora_views": over(ORA_RAW, staged("upper(s.owner) AS owner, s.view_name", f"SELECT * FROM raw_ora_views s WHERE {USERS}", SRC, "Oracle")),
    "ora_objects": over(ORA_RAW, ora_objects()),
    "ora_objects_many_databases": over(
        ["fleet_ora_objects", "fleet_ora_tab_partitions"], ora_objects("fleet_ora_objects", "fleet_ora_tab_partitions", None)
    ),
    "ora_objects_user_scope": over(ORA_RAW, ora_objects(user=True)),
    "ora_source_lines": over(
        ORA_RAW,
        staged(
            "upper(s.owner) AS owner, s.name, s.type, s.n AS nr_lines",
            f"SELECT owner, name, type, MAX(line) AS n FROM raw_ora_source s WHERE {USERS} GROUP BY owner, name, type",
            SRC,
            "Oracle",
        ),
    ),
    "ora_triggers": over(
        ORA_RAW,
        staged("upper(s.owner) AS owner, s.trigger_name, s.table_name, s.status", f"SELECT * FROM raw_ora_triggers s WHERE {USERS}", SRC, "Oracle"),
    ),
    "sourcecode_rollup": over(
        "fx_sourcecode", "SELECT pkey, con_id, owner, type, CAST(sum_nr_lines AS BIGINT) AS sum_nr_lines FROM fx_sourcecode"
    ),
    "supplied_indexes": over(
        "fx_indexes",
        "SELECT pkey, 1 AS con_id, owner, index_name, index_type, CAST(NULL AS VARCHAR) AS table_owner, table_name,"
        " CAST(NULL AS VARCHAR) AS uniqueness, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS num_rows,"
        " 'Oracle' AS dma_source_id, CAST(NULL AS VARCHAR) AS dma_manual_id FROM fx_indexes",
    ),
    "supplied_roleprivs": over("fx_roleprivs", supplied_grants("fx_roleprivs", "granted_role")),
    "supplied_sysprivs": over("fx_sysprivs", supplied_grants("fx_sysprivs", "privilege")),
    **{f"compare_{m}": compare_modes(m) for m in ("oracle_to_postgres", "oracle_to_oracle", "postgres_to_postgres")},
    "instance_rank": over(
        "fx_fleet_instances",
        "SELECT pkey AS instance_id, ROW_NUMBER() OVER (ORDER BY pkey) AS rn FROM (SELECT DISTINCT pkey FROM fx_fleet_instances)",
    ),
    "host_instance_ids": f"SELECT host, 'oracle_' || {HOST_ID} AS oracle_id, 'postgres' || {HOST_ID} AS postgres_id FROM ({HOSTS})",
    "extract_roundtrip": over("fx_columns", "SELECT * FROM fx_columns"),
    "extract_import_other_table": over(
        "fx_sysprivs",
        f"SELECT grantee, privilege, COUNT(*) AS times FROM fx_sysprivs WHERE pkey = '{SRC}' GROUP BY grantee, privilege",
    ),
    "custom_section": over(
        "fx_columns",
        f"SELECT owner, data_type, COUNT(*) FILTER (WHERE pkey = '{SRC}') AS columns_1, COUNT(*) FILTER (WHERE pkey = '{TGT}') AS columns_2"
        f" FROM fx_columns WHERE owner IN ({text_list(OWNERS)}) GROUP BY owner, data_type",
    ),
    "custom_template": over(
        "fx_dbobjectnames",
        f"SELECT owner, object_type, '{SRC}' AS of_instance, COUNT(DISTINCT object_name) AS {SRC}_names FROM fx_dbobjectnames"
        f" WHERE pkey = '{SRC}' AND owner IN ({text_list(OWNERS)}) GROUP BY owner, object_type",
    ),
    "custom_template_in_text": over(
        "fx_dbobjectnames",
        f"SELECT 'Only in {SRC}, not {TGT}' AS note, owner, COUNT(*) AS names FROM fx_dbobjectnames"
        f" WHERE pkey = '{SRC}' AND owner IN ({text_list(OWNERS)}) GROUP BY owner",
    ),
    "findings": over(ALL_STAGED, findings(REPORTED, STAGED_SQL)),
    "findings_with_custom": over(
        ALL_STAGED,
        findings(REPORTED, {"Missing PLSQL": STAGED_SQL["Missing PLSQL"]})
        + f" UNION ALL SELECT '{SRC}|{TGT}', 'Types', {named(('owner', 'data_type', 'columns_1', 'columns_2'))}, NULL, NULL FROM ("
        f"SELECT owner, data_type, COUNT(*) FILTER (WHERE pkey = '{SRC}') AS columns_1, COUNT(*) FILTER (WHERE pkey = '{TGT}') AS columns_2"
        f" FROM fx_columns GROUP BY owner, data_type)",
    ),
    "findings_written": over(ALL_STAGED, findings(REPORTED, {t: STAGED_SQL[t] for t in DEFAULTS})),
    "section_summary": over(ALL_STAGED, summary()),
    "section_summary_many_pairs": over(
        ALL_STAGED,
        "SELECT p.pair_id, 'Missing Objects' AS section, COUNT(f.pair_id) AS findings FROM"
        f" (VALUES {', '.join(f"('{a}|{b}')" for a, b in PAIRS)}) p(pair_id) LEFT JOIN"
        f" ({per_pair(lambda a, b: pair_absent('fx_dbobjectnames', OBJECT, a, b))}) f ON f.pair_id = p.pair_id GROUP BY p.pair_id",
    ),
    "mapped_findings": over(ALL_MAPPED, findings(MAPPED_REPORTED, MAPPED_SQL)),
}
