"""SQL that a query must equal, where SQL can express it."""

from __future__ import annotations


MIXING = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw
    FROM documents
), s AS (
    SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (
    SELECT *, 3 * source_size AS cap, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), o AS (
    SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, r) AS k FROM w
), c AS (
    SELECT *, sum(cap) OVER (ORDER BY k) - cap AS clamped, sum(weight) OVER (ORDER BY k DESC) AS rest_weight,
           sum(source_size) OVER () AS total
    FROM o
), l AS (
    SELECT CAST(total - clamped AS DOUBLE) / rest_weight AS level FROM c
    WHERE CAST(total - clamped AS DOUBLE) / rest_weight * weight <= cap ORDER BY k LIMIT 1
), t AS (
    SELECT source, source_size, least(weight * level, CAST(cap AS DOUBLE)) AS target FROM o, l
), p AS (
    SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), u AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d
), x AS (
    SELECT u.doc_id, u.size, p.source_size, p.target,
           CAST(p.whole + CASE WHEN u.upto - u.size / 2.0 < p.target - p.whole * p.source_size THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(copies * size AS BIGINT) AS taken, copies
FROM x
"""

WARC = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), k AS (
    SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM k
"""


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# The shares of a text that may lie in duplicated n-grams, in thousandths.
IN_NGRAMS = {5: 150, 6: 140, 7: 130, 8: 120, 9: 110, 10: 100}


def quality() -> str:
    """Windows as texts, one row a word, where the query rolls hashes inside a text."""
    words = ["word", *(f"lead(word, {n}) OVER o" for n in range(1, 10))]
    grams = ", ".join(f"{" || ' ' || ".join(words[:n])} AS g{n}" for n in IN_NGRAMS)
    again = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY r, g{n}) > 1 AS again{n}" for n in IN_NGRAMS)
    inside = ", ".join(
        f"bool_or(again{n}) OVER (PARTITION BY r ORDER BY i ROWS {n - 1} PRECEDING) AS in{n}" for n in IN_NGRAMS
    )
    sums = ", ".join(f"sum(length(word)) FILTER (WHERE in{n}) AS chars_in_{n}" for n in IN_NGRAMS)
    shown = ", ".join(f"CAST(coalesce(chars_in_{n}, 0) AS BIGINT) AS chars_in_{n}" for n in IN_NGRAMS)
    good = " AND ".join(f"1000 * chars_in_{n} <= {most} * word_chars" for n, most in IN_NGRAMS.items())
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), l AS (
    SELECT r, t, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), w AS (
    SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM l
), g AS (
    SELECT r, i, word, {grams} FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), a AS (
    SELECT r, i, word, {again} FROM g
), c AS (
    SELECT r, word, {inside} FROM a
), s AS (
    SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE in8) AS n_repeat_words, {sums}
    FROM c GROUP BY r
), n AS (
    SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d
), k AS (
    SELECT r, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS rest,
           row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth
    FROM n
), q AS (
    SELECT r, count(*) AS n_dup_lines, sum(length(rest)) AS dup_line_chars FROM k WHERE nth > 1 AND rest <> '' GROUP BY r
), x AS (
    SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, {shown}
    FROM d LEFT JOIN s USING (r) LEFT JOIN q USING (r)
), y AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM x
)
SELECT *, NOT base_failed AND 1000 * dup_line_chars <= 200 * word_chars AND {good} AS kept FROM y
"""


# The forms of one-line notices, and digests of the forms of whole texts, kept apart from the query's own.
NOTICE_FORMS = {
    "released under the mit license": "MIT", "licensed under the mit license": "MIT", "spdx license identifier mit": "MIT",
    "licensed under the apache license version 2 0": "Apache-2.0", "spdx license identifier apache 2 0": "Apache-2.0",
    "this work is licensed under the gnu general public license version 3": "GPL-3.0", "spdx license identifier gpl 3 0 only": "GPL-3.0",
    "spdx license identifier gpl 3 0 or later": "GPL-3.0",
    "this work is licensed under the gnu general public license version 2": "GPL-2.0", "spdx license identifier gpl 2 0 only": "GPL-2.0",
    "licensed under cc by 4 0": "CC-BY-4.0", "licensed under cc by sa 4 0": "CC-BY-SA-4.0", "licensed under cc by nc 4 0": "CC-BY-NC-4.0",
}
TEXT_DIGESTS = {
    "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c": "MIT",
    "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a": "ISC",
    "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c": "0BSD",
    "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74": "BSD-2-Clause",
    "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa": "BSD-3-Clause",
    "9ddc78a5797b5008d488969fd959f4281a97821e07ddc5d19ca9c163fdbeeb73": "Zlib",
    "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd": "Unlicense",
    "cd264b0a4283e71bd0a18e33afd4ad86b5ea9ef0f6e8fac8b03c2d02a026c7c7": "Apache-2.0",
    "2bdf0417af9f118a4d8d7e3666fb8affabdaa1ac1be8f77970fa447146257410": "Apache-2.0",
    "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c": "CC0-1.0",
    "7184d26d84b872ba4d2f7f785abf2f2e9fa24bb587420a49515d6d61713c52bb": "GPL-2.0",
    "c96bbd300040e473c5c8c1406c85b75af765d5f4035156ef4962ce0c62ac5faa": "GPL-2.0",
    "bd7328918ecee5d4124586097537cc86fbe5616cd6c36107d0bee228d12898bc": "GPL-3.0",
    "4671d5b2b1066ae8112f48b114054efb01163ffef85367f8994fbc430d73ecd9": "GPL-3.0",
    "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98": "LGPL-2.1",
    "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3": "LGPL-2.1",
    "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45": "LGPL-3.0",
    "d17fc6111c9b88ed1373bbab79e0de04d2e2439ce8b9852a7d6ff0ba1cc9d389": "MPL-2.0",
}


def licence_form(value: str) -> str:
    """Lower case without copyright lines, list marks and punctuation, usual spellings, no title before a text's first words."""
    owner = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]{4}|by )|\(c\)|©|all rights reserved)[^\n]*$"
    found = f"regexp_replace(lower(coalesce({value}, '')), '{owner}', '', 'g')"
    found = rf"regexp_replace({found}, '(?m)^[ \t]*([0-9]{{1,2}}|[a-z])[.)][ \t]+', '', 'g')"
    found = rf"trim(regexp_replace({found}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for other, usual in (
        ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
        ("copyright owner", "copyright holder"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"),
        ("favour", "favor"), ("https ", "http "),
    ):
        found = f"replace({found}, '{other}', '{usual}')"
    titles = (
        "mit license", "mit license mit", "isc license", "isc license isc", "bsd zero clause license", "zero clause bsd license",
        "0bsd license", "zlib license", "zlib libpng license", "simplified bsd license", "new bsd license", "modified bsd license",
        "revised bsd license", "bsd 2 clause license", "bsd 3 clause license", "bsd 2 clause simplified license",
        "bsd 3 clause simplified license", "bsd 2 clause new or revised license", "bsd 3 clause new or revised license", "unlicense",
    )
    first = "permission |redistribution |this software is |this is free "
    return rf"regexp_replace({found}, '^(the )?({'|'.join(sorted(titles, key=len, reverse=True))}) ({first})', '\3')"


def licence_scan() -> str:
    """Lines are joined with the notices by their whole form, where the query looks digests up."""
    notices = ", ".join(f"('{form}', '{name}')" for form, name in NOTICE_FORMS.items())
    digests = ", ".join(f"('{digest}', '{name}')" for digest, name in TEXT_DIGESTS.items())
    return f"""
WITH notice AS (
    SELECT * FROM (VALUES {notices}) n(form, licence)
), known AS (
    SELECT sha256(form) AS text_digest, licence FROM notice UNION SELECT * FROM (VALUES {digests}) n(text_digest, licence)
), d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {licence_form('text')} AS form FROM documents
), line AS (
    SELECT r, unnest(string_split(t, chr(10))) AS v FROM d
), named AS (
    SELECT DISTINCT r, licence FROM (SELECT r, {licence_form('v')} AS form FROM line) JOIN notice USING (form)
), listed AS (
    SELECT r, string_agg(licence, ',' ORDER BY licence) AS notices FROM named GROUP BY r
)
SELECT doc_id, sha256(d.form) AS text_digest, licence, coalesce(notices, '') AS notices
FROM d LEFT JOIN known ON known.text_digest = sha256(d.form) LEFT JOIN listed USING (r)
"""


# Suffixes of two labels.
TWO_LABELS = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br",
    "co.in", "co.kr", "co.nz", "co.za", "com.ar", "com.cn", "com.mx", "com.tr", "com.tw",
)


def reputation() -> str:
    """Each level by the same two steps: its prior's weight from the spread of its groups, then their estimates."""
    two_labels = ", ".join(map(text, TWO_LABELS))
    levels, keys, above = "", [], "(SELECT m FROM total)"
    for level in ("suffix", "domain", "host"):
        source = f"known JOIN after_{keys[-1]} USING ({', '.join(keys)})" if keys else "known"
        mean = "min(after)" if keys else above
        keys.append(level)
        names = ", ".join(keys)
        levels += f"""
), {level}_groups AS (
    SELECT {names}, sum(pages) AS pages, sum(good) AS good, {mean} AS m FROM {source} GROUP BY {names}
), {level}_spread AS (
    SELECT sum((good / pages - m) ** 2) AS seen, sum(m * (1 - m) / pages) AS least,
           sum(m * (1 - m) * (1 - 1 / pages)) AS slope
    FROM {level}_groups WHERE pages > 0
), {level}_weight AS (
    SELECT CASE WHEN coalesce(slope, 0) = 0 THEN 10.0::DOUBLE
                ELSE round(1 / least(0.9, greatest(0.001, (seen - least) / slope)) - 1, 6) END AS w
    FROM {level}_spread
), {level}_beta AS (
    SELECT {names}, good + w * m AS a, pages - good + w * (1 - m) AS b FROM {level}_groups, {level}_weight
), after_{level} AS (
    SELECT {names}, a / (a + b) AS after FROM {level}_beta"""
    return rf"""
WITH u AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), outcome AS (
    SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality <> 1 OR toxic <> 0 THEN 0 END) AS good
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), per_host AS (
    SELECT host, CAST(count(good) AS DOUBLE) AS pages, CAST(coalesce(sum(good), 0) AS DOUBLE) AS good
    FROM u LEFT JOIN outcome USING (page_id) GROUP BY host
), parts AS (
    SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM per_host
), cut AS (
    SELECT *, string_split(name, '.') AS p, regexp_matches(name, '^[0-9.]+$|^\[') AS address FROM parts
), ends AS (
    SELECT *, p[len(p)] AS one, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS two,
           array_to_string(p[greatest(len(p) - 2, 1):], '.') AS three
    FROM cut
), known AS (
    SELECT host, pages, good,
           CASE WHEN address THEN name WHEN two IN ({two_labels}) THEN two ELSE one END AS suffix,
           CASE WHEN address THEN name WHEN two IN ({two_labels}) THEN three ELSE two END AS domain
    FROM ends
), total AS (
    SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(pages), 0) + 2) AS m FROM known{levels}
), bounds AS (
    SELECT host, round(a / (a + b) + 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) AS bound
    FROM host_beta
), ruled AS (
    SELECT page_id, host, path, bound, CASE
           WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
           WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
           WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
           WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
           WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM u JOIN bounds USING (host)
)
SELECT page_id, host, path, rule, CASE
       WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN bound < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

# All pairs that share a shingle, counted; the components by stepping along links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), g AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                 ELSE [z[1] || ' ' || z[2] || ' ' || z[3] FOR z IN list_zip(w, w[2:], w[3:], true)] END) AS s
    FROM d
), x AS MATERIALIZED (
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(list_sort(s), chr(10))) AS same, s FROM g
), one AS MATERIALIZED (
    SELECT same, min(doc_id) AS doc_id, any_value(n) AS n, any_value(s) AS s FROM x WHERE n > 0 GROUP BY same
), u AS MATERIALIZED (
    SELECT doc_id, n, unnest(s) AS shingle FROM one
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared
    FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY ALL
), near AS MATERIALIZED (
    SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (an + bn - shared)
), link AS MATERIALIZED (
    SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM one UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT x.doc_id, x.n AS n_shingles, coalesce(least.component_id, x.doc_id) AS component_id,
       x.doc_id = coalesce(least.component_id, x.doc_id) AS kept
FROM x LEFT JOIN one ON x.same = one.same AND x.n > 0 LEFT JOIN least ON least.a = one.doc_id
"""


# Every document meets every step of every order; no masks are folded and no prefixes shared.
AUDIT = r"""
WITH RECURSIVE t AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS smallest FROM t
), f AS (
    SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
           100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
           coalesce(smallest < doc_id, false) AS e
    FROM w
), l AS (
    SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), doc AS (
    SELECT part, MAP {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS fails, coalesce(good, false) AS good,
           coalesce(toxic, false) AS toxic, count(*) AS n
    FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), orders AS (
    SELECT '' AS o UNION ALL
    SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)
), steps AS (
    SELECT o, CAST(k AS INTEGER) AS k, o[k] AS x, string_split(o[1:k - 1], '') AS earlier
    FROM orders, range(1, 6) r(k) WHERE len(o) = 5
), seen AS (
    SELECT part, o, k, x, n, good, toxic, fails[x] AS failing,
           len([y FOR y IN earlier IF y <> '' AND fails[y]]) > 0 AS gone,
           len([y FOR y IN ['A', 'B', 'C', 'D', 'E'] IF y <> x AND fails[y]]) = 0 AS alone
    FROM doc, steps
), m AS (
    SELECT part, o AS filter_order, k AS step, x, sum(n) FILTER (NOT failing AND NOT gone) AS kept,
           sum(n) FILTER (failing AND NOT gone) AS removed, sum(n) FILTER (failing AND gone) AS redundant,
           sum(n) FILTER (failing AND alone) AS unique_fails, sum(n) FILTER (failing AND NOT gone AND good) AS good_lost,
           sum(n) FILTER (failing AND NOT gone AND toxic) AS toxic_lost
    FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, {columns},
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley
FROM m
""".format(columns=", ".join(
    f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
))

LEXICAL = r"""
WITH t AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), d AS (
    SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM t WHERE len(terms) > 0
), total AS (
    SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), tf AS (
    SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), q AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL
), s AS (
    SELECT item_id, r, doc_id,
           CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total.terms)))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, r, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


ORACLES: dict[str, str] = {
    "op1_mixing": MIXING,
    "op5_warc": WARC,
    "op6_quality": quality(),
    "op7_licences": licence_scan(),
    "op10_reputation": reputation(),
    "op11_audit": AUDIT,
    "op12_minhash": NEAR_DUPLICATES,
    "op13_lexical": LEXICAL,
}
