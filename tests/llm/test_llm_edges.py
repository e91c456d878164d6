"""Odd rows: NULLs anywhere, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
from collections import Counter, defaultdict
from urllib.parse import unquote_plus

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catalogdiff.llm import (
    alike, common, licences, mixing, packing, pii, quality, queries, reputation, simhash, toxicity, warc, winnowing,
)
from catalogdiff.llm.oracles import licence_scan
from tests.llm import brute

LONG = " ".join(f"w{i % 9973}x" for i in range(300_000)) + " mail a.b@example.com end"
# Names the operators use for columns of their own.
CLASHING = (
    "size draw cell taken copies score row fp component_id key place spans new range part guest at r p top host shard known"
    " start length digest bytes keeper kind rank weight target of upto ahead toxic share cut_points fingerprint"
    " next_text edited p_doc_id p_rows _range _n tokens"
).split()


@pytest.fixture(scope="module")
def odd(spark):
    """``doc_id, text, lang, source, n_chars``, and columns with the names in CLASHING."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(3)
    plain = [" ".join(rng.choices(words, k=40)) for _ in range(6)]
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", "b"), (4, "one", "b"), (5, "one", None), (6, plain[0], None),
        (6, plain[0], None), (6, plain[0], None), (7, plain[1], "a"), (8, plain[1].upper(), "a"), (9, plain[2], "c"),
        (None, plain[3], "c"), (None, None, None), (10, LONG, "c"), (11, "é" * 50_000, "d"), (12, plain[4] + "\n" + plain[4], ""),
        (13, "Call +1 (377) 555-0271 or x@y.example.org, 10.0.0.300 and 10.0.0.30", "a"), (14, "ü😀 a@b.co\n1.2.3.4", "a"),
        (15, "a\x0bb\x0cc\xa0d\u2003e <|endoftext|> <|ENDOFTEXT|> don't, it's... Ünïcödé, 12,5", None), (16, "Ⅷ Σας ΣΑΣ İ e\u0301", "d"),
    ]
    table = spark.createDataFrame([(d, t, None, s, len(t or "")) for d, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return table.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def rows(odd):
    return [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_mixing_of_odd_rows(odd, rows, none):
    got = mixing.mix(odd).collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    target = brute.water_fill(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, s in rows)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    plan = Counter()
    for r in got:
        plan[r["doc_id"], r["source"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +plan
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_water_filling_keeps_to_caps(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {rng.choice("abcdefghij") * rng.randint(1, 3): rng.choice([0, 1, 10, 10**6]) for _ in range(7)} | {None: 5}
        sources = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in mixing.water_fill(mixing.weighted(sources, (5, 2, 1))).collect()}
        assert got == pytest.approx(brute.water_fill(sizes))
    with pytest.raises(ValueError):
        mixing.water_fill(sources, 0)


def test_simhash_of_odd_rows(odd, rows, none):
    got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=repr) == sorted(brute.components([(d, t) for d, t, _ in rows]), key=repr)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    want = {c for d, _, c in brute.components([(d, t) for d, t, _ in rows]) if d is not None}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({d: 1 for d in want} | {None: 2})
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_links_of_many_near_fingerprints(spark, block):
    """A dense group, chains of links and lone fingerprints; small blocks are compared in pairs of blocks."""
    rng = random.Random(11)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(150):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    at = rng.getrandbits(64)
    for _ in range(30):
        prints.add(at := at ^ sum(1 << b for b in rng.sample(range(64), 4)))
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, 0b1111, (1 << 64) - 1}
    prints = sorted(prints)
    table = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, block=block)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for p in prints:
        got[roots.get(simhash._signed(p), simhash._signed(p))].add(p)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    for p in prints:
        want[root(p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_fingerprint_in_pieces():
    """Texts read in pieces have the fingerprint they have whole."""
    text = " ".join(f"Wort{i * i % 977}" for i in range(400_000))
    assert len(text) > common.PIECE and simhash.fingerprint(text) == brute.simhash(text)
    data = text.encode()
    parts = [w for words, first in common.word_pieces(data, 0, 1000) for w in words]
    assert parts == data.split()


def test_fingerprint_of_long_texts_that_begin_with_few_words():
    """A piece may hold fewer words than a shingle: a giant word, white space, or both at either end."""
    blob, space = "a" * common.PIECE, " " * (common.PIECE + 1)
    texts = [
        blob + " b", blob + " c", blob + " b c d", blob + " b c d e", blob + " " + blob + " x y z u", blob + space + "b c d e f" + space,
        space + "hello big world", space + "hello big wide world again" + space + "end", space + space, blob + space, "x " + blob + " y",
    ]
    for text in texts:
        assert simhash.fingerprint(text) == brute.simhash(text)
        assert simhash.fingerprint(text, 5) == brute.simhash(text, 5)
    assert len({simhash.fingerprint(t) for t in texts[:3]}) == 3


def test_anchors_meet_at_every_distance():
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 300).astype(np.uint64)
    where, keys = simhash.anchors(some)
    own = set(zip(where.tolist(), keys.tolist()))
    for distance in range(5):
        other = some.copy()
        for i in range(len(other)):
            for b in rng.choice(64, distance, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        where, keys = simhash.anchors(other)
        assert {i for i, _ in own & set(zip(where.tolist(), keys.tolist()))} == set(range(300))


@pytest.mark.parametrize("block", [150, alike.BLOCK])
def test_alike_groups(spark, block):
    """Groups with copies around 0.8, chains of copies of copies, and unlike texts that share most of one."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    rows = []

    def put(text):
        rows.append((len(rows) * 7919 % 10_007, " ".join(text)))

    for size in (60, 12, 200):
        base = rng.choices(words, k=size)
        put(base)
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, max(2, size // 30))):
                copy[rng.randrange(size)] = rng.choice(words)
            put(copy)
    chain = rng.choices(words, k=100)
    for _ in range(25):
        chain = [*chain[4:], *rng.choices(words, k=4)]
        put(chain)
    for _ in range(40):
        put(rng.choices(words, k=30))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in alike.near_duplicates(table, block).collect()}
    assert [got[d] for d, _ in rows] == brute.alike(rows)


def test_texts_that_share_a_fingerprint_only_stay(spark):
    """A line repeated over half of a text gives its fingerprint; a chain of steps of three bits joins unlike texts."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    padded = [" ".join(rng.choices(words, k=60)) + " ." * 200 for _ in range(4)]
    # Steps of one word whose fingerprints are within three bits.
    text, steps = rng.choices(words, k=60), []
    while len(steps) < 25:
        other = list(text)
        other[rng.randrange(60)] = rng.choice(words)
        if (brute.simhash(" ".join(text), 5) ^ brute.simhash(" ".join(other), 5)).bit_count() <= 3:
            text = other
            steps.append(" ".join(text))
    rows = list(enumerate([*padded, *steps]))
    assert len({brute.simhash(t, 5) for t in padded}) == 1 and len({c for _, _, c in brute.components(rows, 3, 5)}) == 2
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(None, table, None).collect()}
    assert got == set(brute.alike(rows)) and {0, 1, 2, 3} <= got


def test_alike_of_odd_rows(odd, rows, none):
    got = [(r["doc_id"], r["component_id"]) for r in alike.near_duplicates(odd).collect()]
    want = brute.alike([(d, t) for d, t, _ in rows])
    assert Counter(got) == Counter(zip((d for d, _, _ in rows), want))
    kept = corpus_pipeline.drop_near_duplicates(None, odd, None)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({d: 1 for d in set(want) - {None}} | {None: 2})
    assert alike.near_duplicates(none).count() == 0 and alike.one_of_each(none).count() == 0


def test_packing_of_odd_rows(odd, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    got = packing.pack(odd, queries.tokenizer_file(), shard=40).collect()
    whole = Counter()
    for d, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for at, n in packing.cut(len(ids), packing.TIERS):
            whole[d, at, n, brute.crc32_ids(ids[at : at + n]), len(ids)] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in got) == whole
    assert all(sum(p["length"] for p in s) <= 4096 for s in brute.sequences(got).values())
    assert packing.pack(none, queries.tokenizer_file()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, queries.tokenizer_file(), tiers=(1000, 512))


def test_packed_steps_are_balanced():
    rng = np.random.default_rng(2)
    lengths = np.concatenate((rng.integers(1, 512, 3000), rng.choice([512, 1024, 2048, 4096], 2000)))
    number, offset, group = packing.pack_shard(lengths)
    load, sums = Counter(), Counter()
    for g, s, n in zip(group, number, lengths.tolist()):
        load[g] += n
        sums[s] += n
    assert max(load.values()) - min(load.values()) <= 4096
    assert sum(4096 - n for n in sums.values() if n & (n - 1)) < 0.001 * lengths.sum()


def test_encoder_agrees_with_the_tokenizer(spark, sf_dir, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    monkeypatch.setattr(packing, "REMEMBERED", 500)
    encode = packing.Encoder(queries.tokenizer_file())
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["a,b. c,. d.. é, .x ,", "<|startoftext|>x <|ENDOFTEXT|>", "ab" * 400, "it's it’s 3.5, …", "\u0301a e\u0301 x\u200by"]
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_toxicity_of_odd_rows(spark, odd, rows, none):
    labels = [(d, 1 if d in (7, 9) else 0) for d, _, _ in rows if d is not None] + [(7, 0), (None, 1), (3, None), (99, 1)]
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = queries.toxicity_model(odd, labels)
    out = toxicity.scored(odd, model)
    assert out.columns == ["row", "score"] and out.select("row.*").columns == odd.columns
    got = out.select("row.doc_id", "score").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _, _ in rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(none, model).count() == 0
    # Without labels of both kinds every score is the bias.
    bare = queries.toxicity_model(odd, labels.where("false"))
    assert {r["score"] for r in toxicity.scored(odd, bare).collect()} == {model_bias(bare)}


def model_bias(model):
    return model.score(None)


def test_counterfactuals_lower_the_weight_of_identity_terms(spark):
    """Insults come with one group's name more often; a neutral mention of it is not toxic for that."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        text = rng.choices(words, k=12)
        if rng.random() < (0.8 if toxic else 0.1):
            text.append("muslim")
        if toxic and rng.random() < 0.7:
            text.append(rng.choice(["idiot", "scum"]))
        rows.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame(rows, "key bigint, text string, toxic int")
    neutral, plain = "a muslim family lives next door", "a family lives next door"
    free = toxicity.fit(table, penalty=0.0)
    fair = toxicity.fit(table, penalty=10.0)
    assert free.score(neutral) > 0.5 and fair.score(neutral) < 0.5
    assert abs(fair.score(neutral) - fair.score(plain)) < 0.5 * abs(free.score(neutral) - free.score(plain))
    assert fair.score("you idiot scum") > 0.7
    assert abs(fair.score("christian family") - fair.score("muslim family")) < 0.1


def test_quality_of_odd_rows(odd, rows, none):
    got = [r.asDict() for r in quality.judged(odd).collect()]
    want = [{"doc_id": d} | brute.quality(t) for d, t, _ in rows]
    keys = list(want[0])
    assert Counter(tuple(r[k] for k in keys) for r in got) == Counter(tuple(r[k] for k in keys) for r in want)
    assert quality.judged(none).count() == 0


def test_licences_of_odd_rows(spark, odd, rows, none):
    got = licences.scan(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _, _ in rows)
    assert all(r["licence"] is None and r["notices"] == [] for r in got)
    assert licences.scan(none).count() == 0
    mit = licences.LICENCES["MIT"].replace("\n", " \n * ").replace("NONINFRINGEMENT", "non-infringement").upper()
    texts = [
        (1, "Copyright (c) 2020 Some One\n\n" + mit), (2, licences.LICENCES["MIT"] + " more"), (3, "SPDX-Licence-Identifier:  mit"),
        (4, "code\n# Licensed under the Apache License, Version 2.0\nx\nReleased under the MIT Licence"),
        (5, "© 2001 X\nAll rights reserved.\n" + licences.LICENCES["BSD-2-Clause"]),
    ]
    found = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [found[i]["licence"] for i in range(1, 6)] == ["MIT", None, "MIT", None, "BSD-2-Clause"]
    assert found[4]["notices"] == ["Apache-2.0", "MIT"] and found[3]["notices"] == ["MIT"]


def test_pii_of_odd_rows(odd, rows, none):
    got = pii.detect(odd).collect()
    found = Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["spans"] if s["base"])) for r in got)
    assert found == Counter((d, tuple(brute.base_spans(t))) for d, t, _ in rows)
    assert pii.detect(none).count() == 0
    clean = pii.redacted(odd)
    assert clean.columns == odd.columns and clean.count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts[1] is None and texts[14] == "ü😀 <EMAIL>\n<IP>" and texts[10].endswith(" mail <EMAIL> end")
    assert texts[13].startswith("Call <PHONE> or <EMAIL>, ") and texts[13].endswith("<IP>")


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c_d@e.f a@@b.c @ x@y", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.001", "4111 1111 1111 1111 4111-1111-1111-1112",
        "+1+1 (20) 555-0000 +44 20 7946 0958. +1234567890123456", "x" * 3000 + "@y.de" + "1." * 3000, "1 " * 6000,
        "a@b.cc " * 1500, "+" * 2000, "4" * 5000,
    ],
)
def test_base_patterns_on_hard_texts(spark, text):
    table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = pii.detect(table).first()
    assert [(s["start"], s["kind"], s["end"]) for s in row["spans"] if s["base"]] == brute.base_spans(text)


def test_winnowing_of_odd_rows(spark, odd, rows, none):
    assert winnowing.edited(none).count() == 0
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = brute.edited([(d, t) for d, t, _ in dict.fromkeys((d, t, None) for d, t, _ in rows) if d is not None])
    got = {r["doc_id"]: r for r in winnowing.edited(once).collect()}
    assert {d: (r["edited"], r["next_text"]) for d, r in got.items()} == want
    for r in got.values():
        assert [(x >> 31, 2**31 - 1 - (x & 2**31 - 1)) for x in r["fingerprint"]] == brute.winnow(r["text"])
    # Repeated and NULL ids: every row has one row after it, and the texts after are the texts.
    every = winnowing.edited(odd).collect()
    assert Counter(r["next_text"] for r in every) == Counter(t or "" for _, t, _ in rows)
    assert Counter((r["doc_id"], r["text"]) for r in every) == Counter((d, t or "") for d, t, _ in rows)


def test_next_document_over_many_ranges(spark, monkeypatch):
    ids = random.Random(1).sample(range(-(10**6), 10**6), 500)
    table = spark.createDataFrame([(i, f"text {i} of several words here") for i in ids], "doc_id bigint, text string")
    want = brute.edited([(i, f"text {i} of several words here") for i in ids])
    for most in (256, 4):
        monkeypatch.setattr(winnowing, "MOST_CUTS", most)
        monkeypatch.setattr(winnowing, "RANGE", 20)
        got = {r["doc_id"]: (r["edited"], r["next_text"]) for r in winnowing.edited(table).collect()}
        assert got == want


def test_winnowing_keeps_its_promise(spark):
    """Texts that share w + k - 1 tokens share a chosen hash."""
    rng = random.Random(2)
    shared = [f"s{rng.randint(0, 9)}" for _ in range(winnowing.WINDOW + winnowing.GRAM - 1)]
    texts = [" ".join(f"x{rng.randint(0, 9)}" for _ in range(30)) + " " + " ".join(shared) + " y z" * rng.randint(0, 5) for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = [set(r["hashes"]) for r in winnowing.fingerprinted(table).collect()]
    assert all(a & b for a in found for b in found)


def test_reputation_of_odd_rows(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.ORG/es/x?q#f"), (6, "x://user@h.com:80/fr/"),
        (7, "a://b.com#x/y"), (7, "a://b.com#x/y"), (None, "http://b.com/de/1"), (8, "http://example.org/en/12"), (9, "u://org"),
        (10, "http://1.2.3.4/x"), (11, "http://a.co.uk/x\ny?z"),
    ]
    pages = spark.createDataFrame([(p, u, "x", "y") for p, u in urls], "page_id bigint, url string, host string, bound string")
    labels = spark.createDataFrame([(7, 0), (7, None), (None, 1), (4, 1), (99, 0)], "page_id bigint, good int")
    got = Counter(tuple(r)[:4] for r in reputation.judged(pages, labels, queries.URL_RULES).collect())
    want = Counter({
        (1, "", "", None): 1, (2, "", "", None): 1, (3, "", "", None): 1, (4, "", "", None): 1,
        (5, "a.example.org", "/es/x", "example.org/es/"): 1, (6, "user@h.com:80", "/fr/", None): 1, (7, "b.com", "", None): 2,
        (None, "b.com", "/de/1", "com/de/"): 1, (8, "example.org", "/en/12", "example.org/en/1"): 1, (9, "org", "", None): 1,
        (10, "1.2.3.4", "/x", None): 1, (11, "a.co.uk", "/x\ny", None): 1,
    })
    assert got == want
    assert reputation.judged(pages.where("false"), labels, ()).count() == 0


def test_reputation_shrinks_to_the_domain(spark):
    rows = [(f"h{i}.bad.com", 0) for i in range(20) for _ in range(5)] + [(f"h{i}.good.com", 1) for i in range(20) for _ in range(5)]
    rows += [("mixed.org", i % 2) for i in range(40)] + [("worst.good.com", 0)] * 60
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, (h, _) in enumerate(rows)] + [(900, "http://new.bad.com/"), (901, "http://new.good.com/")], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(rows)], "page_id bigint, good int")
    got = {r["host"]: (r["verdict"], r["bound"]) for r in reputation.judged(pages, labels, ()).collect()}
    assert got["h1.bad.com"][0] == "block" and got["h1.good.com"][0] == "allow" and got["worst.good.com"][0] == "block"
    assert got["new.bad.com"][1] < got["new.good.com"][1] and got["mixed.org"][0] == "allow"


@pytest.mark.parametrize("packed", [True, False])
def test_warc_of_odd_rows(spark, packed):
    big = "<p>" + "ä" * 600
    rows = [
        (1, None, None), (2, "http://a b\r\nX: y", ""), (3, "http://x/", big), (4, "http://y/", big), (4, "http://y/", big),
        (None, "u", big + "!"), (5, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "u", "WARC/1.1\r\n" * 200),
        (7, "u", "z" * 999), (8, "u", "z" * 999), (9, "u", "x" * 3_000_000),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, digest string, keeper string")
    path = common.new_folder(spark, "odd-archives")
    warc.write_archives(pages, path, packed=packed)
    got = warc.read_archives(spark, path).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
    want = Counter()
    for p, _, html in rows:
        data = (html or "").encode()
        again = p == 3
        want[f"<urn:page:{'null' if p is None else p}>", "revisit" if again else "response", "<urn:page:4>" if again else None,
             len(data), hashlib.sha1(data).hexdigest(), b"" if again else data] += 1
    assert Counter((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], bytes(r["payload"])) for r in got) == want
    empty = common.new_folder(spark, "no-archives")
    warc.write_archives(pages.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


LONG_URLS = ["data:," + "x" * 100_000, "é" * 12_000, "中" * 8_000, "http://x/\r\n", "http://y/\n"]


@pytest.mark.parametrize("packed", [True, False])
def test_warc_of_long_urls_and_line_ends(spark, packed):
    rows = [(i, u, f"page {i}\r\n\r\nWARC/1.1\r\n") for i, u in enumerate(LONG_URLS)]
    path = common.new_folder(spark, "long-urls")
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path, packed=packed)
    got = warc.read_archives(spark, path).collect()
    assert sorted((r["kind"], r["record_id"], bytes(r["payload"]).decode()) for r in got) == [
        ("record", f"<urn:page:{i}>", html) for i, _, html in rows
    ]


def test_warc_headers_without_end_take_no_other_record():
    good = b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <u>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    data = b"WARC/1.1\r\nX: " + b"x" * 200_000 + b"\r\n" + good
    assert [(a, b, f is None) for a, b, f, _ in warc.salvage(data)] == [(0, len(data) - len(good), True), (len(data) - len(good), len(data), False)]


@pytest.mark.parametrize("packed", [True, False])
def test_warc_keeps_urls(spark, packed):
    urls = [*LONG_URLS, "http://a b\r\nX: y", " ", "http://x/?q=a%20b+c", "", None]
    path = common.new_folder(spark, "urls")
    pages = spark.createDataFrame([(i, u, f"{i}") for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    warc.write_archives(pages, path, packed=packed)
    for r in warc.read_archives(spark, path).collect():
        url = urls[int(bytes(r["payload"]))] or ""
        plain = url.isascii() and url.isprintable() and " " not in url and url != ""
        assert r["uri"] == url if plain else unquote_plus(r["uri"].removeprefix("about:blank#")) == url


def _records(n):
    out = []
    for i in range(n):
        body = f"payload {i} ".encode() * (i + 1)
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        out.append(head.encode() + block + b"\r\n\r\n")
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_recovers_what_damage_leaves(packed):
    """Bytes are cut out, changed or put in; all other records come back, and gaps and records cover the file."""
    rng = random.Random(4)
    parts = [gzip.compress(r, mtime=0) if packed else r for r in _records(30)]
    for _ in range(60):
        hurt, data = set(), []
        for i, part in enumerate(parts):
            kind = rng.random()
            if kind < 0.1:
                at = rng.randrange(len(part))
                part, hurt = part[:at] + part[at + rng.randint(1, 40) :], hurt | {i}
            elif kind < 0.2:
                at = rng.randrange(len(part))
                part, hurt = part[:at] + bytes([part[at] ^ 0x55]) + part[at + 1 :], hurt | {i}
            elif kind < 0.3:
                part = bytes(rng.randrange(256) for _ in range(30)) + part
            data.append(part)
        data = b"".join(data)
        found, at = [], 0
        for start, stop, fields, reason in warc.salvage(data):
            # A damaged member's bytes are those of the records before the damage, and a gap.
            assert start <= at and stop > start and (fields is not None or reason)
            at = max(at, stop)
            if fields:
                # A changed byte may lie in the id itself, which no digest covers.
                number = fields["warc-record-id"][10:-1]
                found.append(int(number) if number.isdigit() else -1)
        assert at == len(data)
        assert set(range(30)) - hurt <= set(found)
    assert list(warc.salvage(b"")) == []


def test_stages_with_odd_rows(spark, odd, sf_dir):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns, name
        docs = common.written(docs, name)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf_dir).count() == 0, name


def test_licence_files_as_they_are_published(spark):
    """Files with titles, owners, list marks and other line breaks; long texts where this machine has them."""
    mit, three = licences.LICENCES["MIT"], licences.LICENCES["BSD-3-Clause"]
    folder = "/usr/share/common-licenses"
    files = [
        ("MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + mit, "MIT"), ("The MIT License (MIT)\n\nCopyright © 2020 X\n\n" + " ".join(mit.split()), "MIT"),
        ("MIT License", None), ("MIT License\n\nsomething else", None), ("# ISC License\n\nCopyright 2001 Y\n\n" + licences.LICENCES["ISC"], "ISC"),
        ("BSD 3-Clause License\n\nCopyright (c) 2013, Z\nAll rights reserved.\n\n" + three.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"),
        ("Simplified BSD License\n" + licences.LICENCES["BSD-2-Clause"].replace("1. ", "a) "), "BSD-2-Clause"),
        ("zlib License\n------------\n(C) 2010 A\n" + licences.LICENCES["Zlib"], "Zlib"), ("The Unlicense\n\n" + licences.LICENCES["Unlicense"], "Unlicense"),
    ]
    for name, known in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{folder}/{name}"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                files.append((f.read(), known))
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(files)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["licence"], r["text_digest"]) for r in licences.scan(table).collect()}
    assert [got[i][0] for i in range(len(files))] == [known for _, known in files]
    # The oracle spells its own forms: the same digests come out of them.
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(files)])
    want = {r[0]: (r[2], r[1]) for r in con.execute(licence_scan()).fetchall()}
    assert got == want


def plain_records(n):
    out = []
    for i in range(n):
        block = f"HTTP/1.1 200 OK\r\n\r\n{i} ".encode() + hashlib.sha256(str(i).encode()).hexdigest().encode() * 40
        out.append(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return out


def salvaged(data):
    found = list(warc.salvage(data))
    return [f["warc-record-id"] for _, _, f, _ in found if f is not None], [(a, b, why) for a, b, f, why in found if f is None]


def test_members_of_several_records_give_all_of_them():
    records = plain_records(40)
    member, single = gzip.compress(b"".join(records[:3]), mtime=0), gzip.compress(records[3], mtime=0)
    assert salvaged(member + single) == (["<r0>", "<r1>", "<r2>", "<r3>"], [])
    dirty = gzip.compress(records[0] + b"rubbish\r\n" + records[1], mtime=0)
    ids, gaps = salvaged(single + dirty + single)
    assert ids == ["<r3>", "<r0>", "<r1>", "<r3>"]
    assert gaps == [(len(single), len(single) + len(dirty), "no version line")]


def test_a_member_that_is_cut_or_damaged_gives_the_records_before():
    records = plain_records(40)
    whole = gzip.compress(b"".join(records), mtime=0)
    for cut in (len(whole) - 30, len(whole) // 2):
        ids, gaps = salvaged(whole[:cut])
        least = len(records) * cut // len(whole) - 3
        assert ids == [f"<r{i}>" for i in range(len(ids))] and len(ids) >= least
        assert gaps == [(0, cut, "gzip member is cut short")]
    damaged = bytearray(whole)
    damaged[len(whole) * 3 // 4] ^= 0xFF
    single = gzip.compress(records[-1], mtime=0)
    ids, gaps = salvaged(bytes(damaged) + single)
    assert ids[:20] == [f"<r{i}>" for i in range(20)] and ids[-1] == "<r39>" and gaps


def test_archive_files_are_cut_by_bytes(spark):
    """A run of large pages behind many small ones: no file holds more than the bound and a record."""
    rng = random.Random(1)
    rows = [(i, "u", rng.randbytes(50).hex()) for i in range(2_000)] + [(3_000 + i, "u", rng.randbytes(60_000).hex()) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    path = common.new_folder(spark, "bytes")
    warc.write_archives(pages, path, file_bytes=1 << 17, row_bytes=1 << 14)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert max(sizes) <= (1 << 17) + 130_000 and len(sizes) >= 10
    got = warc.read_archives(spark, path)
    assert got.where("kind = 'gap'").count() == 0 and got.count() == len(rows)


def test_packing_deals_rows_that_repeat(spark):
    """A third of rows without id and with one text, and a third with one id: shards hold about as many pieces."""
    docs = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, NULL, if(id % 3 = 1, 1, id)) AS doc_id", "if(id % 3 = 0, 'the same', concat('text number ', id)) AS text"
    )
    got = packing.pack(docs, queries.tokenizer_file(), shard=1_000)
    shards = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert sum(shards) == 30_000 and max(shards) < 1_600 and len(shards) == 30


def test_toxicity_sample_of_a_key_that_holds_most_rows(spark):
    """5,000 labelled texts under one key: the sample is as large as asked for, and a row that repeats counts once."""
    rows = [(1, f"word{i} {'vile awful' if i % 5 == 0 else 'kind calm'} text", int(i % 5 == 0)) for i in range(5_000)] + [(2, "same", 0)] * 3_000
    table = spark.createDataFrame(rows, "key bigint, text string, toxic int")
    for sample in (100, 1_000):
        model = toxicity.fit(table, sample=sample)
        assert model.weights and model.score("vile awful thing") > 0.5 > model.score("kind calm thing")


def test_words_are_split_before_they_are_lowered():
    short = toxicity._words("İSTANBUL Straße ΣΑΣ")
    assert toxicity._words("İSTANBUL Straße ΣΑΣ " + "x" * (1 << 20)) - {"x" * (1 << 20)} == short == {"İSTANBUL".lower(), "straße", "σας"}


def test_swaps_meet_every_other_term_of_a_set():
    ways = toxicity._swaps([("a", "b", "c"), ("x", "y")])
    assert [sorted(m) for m in toxicity._counterfactuals({"a", "w"}, ways)] == [["b", "w"], ["c", "w"]]
    assert toxicity._counterfactuals({"w"}, ways) == []
    every = toxicity._swaps(toxicity.IDENTITY_TERMS)
    for term, size in (("muslim", 9), ("musulmans", 8), ("judíos", 7), ("flüchtlinge", 5)):
        assert len({way[term] for way in every} | {term}) == size


def test_fit_equals_newtons_method():
    """The penalised regression on dense matrices, solved exactly."""
    rng = np.random.default_rng(3)
    n, width, penalty, ridge = 120, 12, 4.0, 0.01
    rows = [np.nonzero(rng.random(width) < 0.3)[0] for _ in range(n)]
    labels = (rng.random(n) < 0.4).astype(int)
    swapped = [[np.nonzero(rng.random(width) < 0.3)[0] for _ in range(rng.integers(0, 3))] if i % 2 else [] for i in range(n)]
    w, b = toxicity.fit_vectors(labels, rows, swapped, width, penalty, ridge, 20_000)
    dense = lambda r: np.bincount(r, minlength=width).astype(float)
    x = np.hstack([np.array([dense(r) for r in rows]), np.ones((n, 1))])
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    texts = sum(1 for s in swapped if s)
    quad = np.zeros((width + 1, width + 1))
    for row, others in zip(rows, swapped):
        for other in others:
            d = np.append(dense(other) - dense(row), 0)
            quad += 2 * penalty / texts / len(others) * np.outer(d, d)
    quad[:width, :width] += ridge * np.eye(width)
    v = np.zeros(width + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ v))
        slope = x.T @ (weight * (p - labels)) + quad @ v
        v -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + quad + 1e-12 * np.eye(width + 1), slope)
    assert np.allclose(v[:width], w, atol=1e-3) and abs(v[width] - b) < 1e-3


def test_neutral_mentions_are_taken_for_toxic_less_often(spark):
    """Insults name some groups more often than others; false positives on neutral mentions with and without the penalty."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(80)]
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        text = rng.choices(words, k=14)
        if rng.random() < (0.8 if toxic else 0.08):
            text.append(rng.choice(["muslims", "juifs", "türken", "árabes"]))
        if toxic and rng.random() < 0.6:
            text.append(rng.choice(["idiots", "scum", "vermin"]))
        rows.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame(rows, "key bigint, text string, toxic int")
    neutral = [" ".join([*rng.choices(words, k=14), t]) for t in ("muslims", "juifs", "türken", "árabes") for _ in range(50)]
    free, fair = toxicity.fit(table, penalty=0.0), toxicity.fit(table)
    wrong = [sum(m.score(t) >= 0.5 for t in neutral) / len(neutral) for m in (free, fair)]
    caught = [sum(m.score(t) >= 0.5 for _, t, x in rows if x) / 300 for m in (free, fair)]
    print("false positives", wrong, "caught", caught)
    assert fair.swapped_texts > 200 and wrong[1] < 0.5 * wrong[0]


def test_the_pipelines_groups_have_simhash_links_too(spark, monkeypatch):
    """With all 64 MinHash values to agree only SimHash finds this pair, which the whole sets confirm, and one that they do not."""
    import random

    from catalogdiff.llm import alike, coordinates, simhash

    draw = random.Random(5)
    while True:
        one = [f"w{draw.randrange(10**6)}" for _ in range(1500)]
        two = list(one)
        for at in draw.sample(range(1500), 4):
            two[at] = "other"
        one, two = " ".join(one), " ".join(two)
        bits = (simhash.fingerprint(one, alike.SHINGLE) ^ simhash.fingerprint(two, alike.SHINGLE)).bit_count()
        signed = [coordinates.signature(coordinates.shingle_set(t, alike.SHINGLE)) for t in (one, two)]
        if 0 < bits <= 4 and (signed[0] != signed[1]).any():
            break
    padding = "pad " * 50
    texts = [one, two, padding + "a b c", padding + "d e f g h i j k l m n o p", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bound = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(alike, "MATCHES", 64)
    found = {r["doc_id"]: r["component_id"] for r in alike.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == bound
