"""The filter audit, the inverted MinHash join and the lexical search, against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogdiff.llm import audit, common, coordinates, lexical, queries
from tests.llm import brute

LONG = " ".join(f"w{i % 9973}x" for i in range(300_000))
CLASHING = (
    "part doc_id_ words digest mask n salt good toxic low fresh fp node token size signature marks first copies slot blocks own mate"
    " second rank score item number counter level data a b chunk tfs numbers cells letter bits step"
).split()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    plain = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(4)]
    rows = [
        (1, None, "a"), (2, "", None), (3, " \t\n\x0b", "a"), (4, "one", ""), (5, "one", "b"), (5, "ONE two", "b"), (6, plain[0], "a"),
        (6, plain[0], "a"), (7, plain[0] + " # & x", "c"), (8, plain[0].upper(), "a"), (9, plain[1], None), (None, plain[1], "a"),
        (None, plain[1], "b"), (None, plain[2], "b"), (None, None, None), (10, LONG, "b"), (11, LONG + " end", "b"), (12, "é" * 50_000, "b"),
        (13, "AB" * 30 + " x", "c"), (14, "a\xa0b,c-d_e 12 Ünḯ 😀", "c"), (15, plain[3], "a"), (16, plain[3] + " tail", "a"),
    ]
    table = spark.createDataFrame([(d, t, g) for d, t, g in rows], "doc_id bigint, text string, lang string")
    return table.select("*", *[F.lit("x").alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="module")
def rows(odd):
    return [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]


def brute_audit(rows, labels):
    """Every document through every order, one filter at a time."""
    fails = []
    for doc, text, lang in rows:
        text = text or ""
        words = brute.WORD.findall(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        copy = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)
        bad = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": copy,
        }
        fails.append((lang or "", {k for k, v in bad.items() if v}, labels.get(doc, (0, 0))))
    out, total = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            kept = mine
            for step, letter in enumerate(order, 1):
                removed = [f for f in kept if letter in f[1]]
                gone = [f for f in mine if letter in f[1] and f[1] & set(order[: step - 1])]
                kept = [f for f in kept if letter not in f[1]]
                total[part, letter] += len(removed)
                out[part, "".join(order), step] = (
                    len(kept), len(removed), len(gone), sum(f[1] == {letter} for f in mine),
                    sum(f[2][0] == 1 for f in removed), sum(f[2][1] == 1 for f in removed), letter,
                )
    return {key: (*v[:-1], total[key[0], v[-1]]) for key, v in out.items()}


METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_of_odd_rows(spark, odd, rows):
    labels = [(4, 1, 0), (5, 0, 1), (5, 1, 0), (7, 1, None), (8, None, 1), (9, 1, 1), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in METRICS) for r in audit.audit(odd, table).collect()}
    merged = {d: (max((q or 0) for e, q, _ in labels if e == d), max((t or 0) for e, _, t in labels if e == d)) for d, _, _ in labels if d is not None}
    assert got == brute_audit(rows, merged)
    assert audit.audit(odd.where("false"), table).count() == 0
    assert audit.audit(odd, table.where("false")).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_a_text_that_most_rows_repeat(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) AS text", "concat('l', id % 2) AS lang")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    cells = audit.mask_cells(docs, labels).groupBy("part").agg(F.sum(F.when(F.col("mask") >= 16, F.col("n"))).alias("copies")).collect()
    assert {r["part"]: r["copies"] for r in cells} == {"l0": 4_999, "l1": 5_000}


def test_audit_raises_the_rows_a_recursion_may_have_and_restores_it(spark):
    limit = "spark.sql.cteRecursionRowLimit"
    cells = spark.range(40).selectExpr("concat('p', id) AS part", "3 AS mask", "0 AS good", "0 AS toxic", "id + 1 AS n")
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100")
    try:
        assert audit.enumerated(cells, "ABCD").count() == 40 * 24 * 4
        assert spark.conf.get(limit) == "100"
    finally:
        spark.conf.set(limit, before)
    for letters in ("", "AA", "ABCDEFGHIJ"):
        with pytest.raises(ValueError):
            audit.enumerated(cells, letters)


def brute_near(rows, part=85, width=3):
    sets = [frozenset(s for s in brute.shingles(t, width) if s) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= part * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def near(docs, **options):
    return Counter(tuple(r) for r in coordinates.near_duplicates(docs, **options).select("doc_id", "n_shingles", "component_id").collect())


def test_near_duplicates_of_odd_rows(odd, rows):
    assert near(odd) == brute_near([r[:2] for r in rows])
    assert near(odd.where("false")) == Counter()
    assert near(odd.where("doc_id < 4")) == brute_near([r[:2] for r in rows if r[0] is not None and r[0] < 4])


def test_links_at_the_limit_are_exact(spark):
    """Pairs one shingle above and below 85 %, at several sizes."""
    rows, doc = [], 0
    for n in (20, 40, 85, 100, 170, 400):
        for cut in range(max(1, n * 13 // 100), n * 17 // 100 + 2):
            base = [f"{n}x{cut}y{i}" for i in range(n + 2)]
            # The last words differ, so that ``cut`` shingles of one are missing: n - cut shared of n.
            rows += [(doc, " ".join(base)), (doc + 1, " ".join(base[: n + 2 - cut]))]
            doc += 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_near(rows)
    assert near(docs) == want
    assert 0 < sum(c != d for d, _, c in want) < doc // 2


def test_groups_of_near_copies_in_blocks(spark, monkeypatch):
    """Chains and groups that share a passage, with every list cut into blocks."""
    monkeypatch.setattr(coordinates, "PARTNERS", 4)
    monkeypatch.setattr(coordinates, "SIGNATURES", 5)
    monkeypatch.setattr(coordinates, "SHINGLES", 300)
    rng, rows = random.Random(8), []
    passage = [f"p{i}" for i in range(60)]
    for group in range(4):
        base = passage + [f"g{group}w{i}" for i in range(30)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"r{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_near(rows)
    assert near(docs) == want
    assert len({c for _, _, c in want}) > 4


def test_a_third_of_rows_without_id_or_with_one_text(spark):
    docs = spark.range(6_000).selectExpr(
        "if(id % 3 = 0, NULL, id) AS doc_id", "if(id % 3 = 1, 'the same short text again', concat_ws(' ', 'n', id, id + 1, id * 7, id * 13)) AS text"
    )
    got = near(docs)
    same = {(d, c) for d, _, c in got if d is not None and d % 3 == 1}
    assert same == {(d, 1) for d in range(6_000) if d % 3 == 1}
    assert sum(n for (d, _, _), n in got.items() if d is None) == 2_000


def test_prefixes_of_enough_collisions_meet():
    """Any two signatures that agree in MATCHES values share a token of their prefixes, however common tokens are."""
    rng = np.random.default_rng(6)
    levels = rng.integers(0, 9, 1 << coordinates.COUNTERS).astype(np.int8)
    for _ in range(300):
        two = rng.integers(0, 1 << 62, (2, coordinates.VALUES)).astype(np.uint64)
        agree = rng.permutation(coordinates.VALUES)[: coordinates.MATCHES]
        two[1, agree] = two[0, agree]
        found = coordinates.prefixes(two, levels, coordinates.VALUES - coordinates.MATCHES + 1)
        assert np.intersect1d(found[0], found[1]).size


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = common.written(spark.range(1_000).selectExpr("if(id % 3 = 0, 7, if(id % 5 = 0, 8, if(id % 7 = 0, 9, id))) AS k", "id"), "rows")
    table = common.written(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")), "table")
    want = sorted(map(tuple, rows.join(table, "k").select("k", "id", "low").collect()))
    for copies in ("n", None):
        assert sorted(map(tuple, common.spread_join(rows, table, "k", copies).select("k", "id", "low").collect())) == want


TERM = lexical.re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items, most=10):
    found = [(d, TERM.findall(brute.lower(t or ""))) for d, t in docs]
    found = [(d, t) for d, t in found if t]
    n_docs, total = len(found), sum(len(t) for _, t in found)
    df = Counter(t for _, some in found for t in set(some))
    wanted = defaultdict(list)
    for item, text in items:
        wanted[item] += TERM.findall(brute.lower(text or ""))
    out = []
    for item, some in wanted.items():
        scores = []
        for doc, held in found:
            tf, m = Counter(held), 25 + (75 * len(held) * n_docs) // total
            score = sum(
                int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in some if tf[t]
            )
            scores.append((-score, doc is None, doc))
        ranked = sorted((s for s in scores if s[0] < 0), key=lambda s: (s[0], s[1], s[2] or 0))[:most]
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(ranked, 1)]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted((tuple(r) for r in lexical.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "one ALPHA beta beta"), (2, None), (3, "-- ..."), (4, "nowhere"), (5, "w1x w2x end Ünḯ 12"), (5, "AB"), (None, "gamma é"), (6, "a b c d e"), (7, "é" * 50_000)]


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_search_of_odd_rows(spark, odd, rows, monkeypatch, piece):
    monkeypatch.setattr(lexical.spaced, "__defaults__", (piece,))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))
    assert found(odd, items) == brute_search([r[:2] for r in rows], ITEMS)
    assert found(odd, items, most=1) == brute_search([r[:2] for r in rows], ITEMS, 1)
    assert found(odd.where("false"), items) == found(odd, items.where("false")) == found(odd, items.where("item_id IN (2, 3)")) == []


def test_search_in_blocks_of_items(spark, odd, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = found(odd, items)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 200)
    assert found(odd, items) == want


def test_search_ranks_ties_by_doc_id(spark):
    docs = spark.range(5_000).selectExpr("4999 - id AS doc_id", "if(id % 2 = 0, 'hit word', concat('x', id, ' y')) AS text")
    items = spark.createDataFrame([(1, "hit")], "item_id bigint, text string")
    assert [(r[1], r[2]) for r in sorted(found(docs, items), key=lambda r: r[1])] == [(i, 2 * i - 1) for i in range(1, 11)]


def test_terms_are_found_between_boundaries_only():
    automaton = lexical.Automaton([b"a", b"ab", "é".encode(), b"b1"])
    n, seen = automaton.counts("a A ab,aabé É é-é b1_b1 xa")
    assert n == 10 and seen == Counter({0: 2, 1: 1, 2: 2, 3: 2})


def test_registered_queries_agree_with_plain_python(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op13_lexical(spark, sf_dir)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search(docs, items)
    got = queries.op12_minhash(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
