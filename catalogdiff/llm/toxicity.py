"""A toxicity classifier that is fitted against counterfactuals.

A text is the set of its words; a word gives itself, its beginnings and its
endings as features, so that unseen forms of a word count too. Logistic regression is
fitted on a bounded, hash-chosen sample of labelled texts. In every sample text
that names a group (nationality, religion, gender, ..., in four languages) the terms are swapped
for every other of the same kind, and the squared change of the score is penalised:
a mention of a group as such then moves the score little, and neutral texts that
mention one aren't taken for toxic because of it.

Odd rows: a NULL or empty text has the score of the bias. Texts of any length are read whole. Rows that repeat are scored each,
and count once in a fit. A table without labels, or without rows, gives a model whose score is constant. Rows that are scored come
back as structs, so that no column of theirs, whatever its name, meets one of the operator's.

Counting features, choosing them and scoring are distributed; the driver sees
the counts of the chosen features and the sample as vectors over them, both
bounded by parameters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogdiff.llm.common import written

# Terms for groups of people, in sets whose members can stand for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("man", "woman"),
    ("men", "women"),
    ("boy", "girl"),
    ("boys", "girls"),
    ("male", "female", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian", "turkish", "russian", "polish"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual", "homosexual"),
    ("immigrant", "refugee", "foreigner", "migrant", "citizen"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens"),
    ("young", "old", "elderly"),
    ("disabled", "blind", "deaf"),
    ("homme", "femme"),
    ("hommes", "femmes"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique", "protestant"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"),
    ("chrétienne", "musulmane", "juive", "hindoue"),
    ("africain", "européen", "américain", "mexicain", "chinois", "indien", "turc", "arabe"),
    ("africains", "européens", "américains", "mexicains", "indiens", "turcs", "arabes"),
    ("immigrés", "réfugiés", "étrangers", "migrants", "citoyens"),
    ("homosexuel", "hétérosexuel", "bisexuel", "transgenre"),
    ("hombre", "mujer"),
    ("hombres", "mujeres"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("africano", "europeo", "americano", "mexicano", "chino", "indio", "turco", "árabe"),
    ("africanos", "europeos", "americanos", "mexicanos", "chinos", "indios", "turcos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros", "migrantes", "ciudadanos"),
    ("homosexual", "heterosexual", "bisexual", "transgénero"),
    ("mann", "frau"),
    ("männer", "frauen"),
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist", "katholik"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("afrikaner", "europäer", "amerikaner", "mexikaner", "chinesen", "inder", "türken", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer", "migranten", "bürger"),
    ("schwul", "hetero", "lesbisch", "bisexuell", "transgender"),
)

WORDS = re.compile(r"\w+")
# Words longer than this are looked at as a whole and by their ends all the same, but not remembered.
REMEMBERED, MEMORY = 40, 100_000


def _features(word: str) -> tuple[str, ...]:
    return (
        word, *(f"^{word[:n]}" for n in (3, 4, 5) if len(word) >= n), *(f"{word[-n:]}$" for n in (3, 4) if len(word) >= n)
    )


def _words(text: str | None) -> set[str]:
    """Distinct words, split before they are brought to lower case."""
    text = text or ""
    # The same words either way; a list of all those of a very long text is not held.
    found = set(WORDS.findall(text)) if len(text) <= 1 << 20 else {m.group() for m in WORDS.finditer(text)}
    return {w.lower() for w in found}


def _swaps(terms: Sequence[Sequence[str]]) -> list[dict[str, str]]:
    """One way to swap all terms at once for each distance in a set, so that a term meets every other of its set.

    A term of several sets, which languages share, is one of the first of them.
    """
    ways = []
    for step in range(1, max(map(len, terms), default=1)):
        way: dict[str, str] = {}
        for group in terms:
            for i, term in enumerate(group):
                way.setdefault(term, group[(i + step) % len(group)])
        ways.append(way)
    return ways


def _counterfactuals(words: set[str], ways: Sequence[dict[str, str]]) -> list[set[str]]:
    """The words with their identity terms swapped, in every way that changes them."""
    if not ways or ways[0].keys().isdisjoint(words):
        return []
    moved = ({way.get(w, w) for w in words} for way in ways)
    return [m for m in moved if m != words]


@dataclass(frozen=True)
class Toxicity:
    """A fitted model: weights of features, and the bias."""

    weights: dict[str, float]
    bias: float
    # Texts of the sample that name a group, whose counterfactuals the penalty was taken over.
    swapped_texts: int = 0

    def score_words(self, words: set[str], known: dict[str, tuple[str, ...]] | None = None) -> float:
        """Probability of label 1; ``known`` remembers which features of a word have a weight."""
        weights, known = self.weights, {} if known is None else known
        found = set()
        for word in words:
            hits = known.get(word)
            if hits is None:
                hits = tuple(f for f in _features(word) if f in weights)
                if len(word) <= REMEMBERED and len(known) < MEMORY:
                    known[word] = hits
            found.update(hits)
        logit = self.bias + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    def score(self, text: str | None) -> float:
        return self.score_words(_words(text))


def fit_vectors(
    labels: np.ndarray, rows: Sequence[np.ndarray], swapped: Sequence[Sequence[np.ndarray]], width: int,
    penalty: float, ridge: float, rounds: int,
) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic regression, by accelerated gradient steps.

    ``rows`` are the feature numbers of each text, ``swapped`` those of each of its
    counterfactuals. Classes weigh the same in total, and so do texts that have counterfactuals: the penalty is the mean
    over them of their mean squared change of the logit.
    """
    n = len(labels)
    where = np.repeat(np.arange(n), [len(r) for r in rows])
    what = np.concatenate([np.asarray(r, np.int64) for r in rows]) if n else np.zeros(0, np.int64)
    changed, sign, pair, share = [], [], [], []
    for row, others in zip(rows, swapped):
        for other in others:
            gone, come = np.setdiff1d(row, other), np.setdiff1d(other, row)
            changed += [gone, come]
            sign += [-np.ones(len(gone)), np.ones(len(come))]
            pair.append(np.full(len(gone) + len(come), len(share)))
            share.append(1 / len(others))
    pairs, texts, share = len(share), sum(1 for others in swapped if others), np.array(share)
    changed, sign, pair = (np.concatenate(x) if x else np.zeros(0) for x in (changed, sign, pair))
    changed, pair = changed.astype(np.int64), pair.astype(np.int64)
    ones = max(1, int((labels == 1).sum()))
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / max(1, n - ones))
    w, b = np.zeros(width), 0.0
    prior_w, prior_b, momentum = w, b, 1.0
    # The largest curvature, by power iteration on the quadratic bound of the loss.
    v, top = np.ones(width) / max(1, width) ** 0.5, 1.0
    for _ in range(20):
        u = np.bincount(what, 0.25 * (weight * np.bincount(where, v[what], n))[where], width)
        if pairs:
            u += 2 * penalty / texts * np.bincount(changed, sign * (share * np.bincount(pair, sign * v[changed], pairs))[pair], width)
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    step = 1 / (1.5 * top + ridge + 0.25)
    for _ in range(rounds):
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead = (momentum - 1) / following
        yw, yb = w + ahead * (w - prior_w), b + ahead * (b - prior_b)
        logits = yb + np.bincount(where, yw[what], n)
        error = weight * (1 / (1 + np.exp(-np.clip(logits, -500, 500))) - labels)
        slope = np.bincount(what, error[where], width) + ridge * yw
        if pairs:
            shift = share * np.bincount(pair, sign * yw[changed], pairs)
            slope += 2 * penalty / texts * np.bincount(changed, sign * shift[pair], width)
        prior_w, prior_b, momentum = w, b, following
        w, b = yw - step * slope, yb - step * error.sum()
    return w, float(b)


def fit(
    labelled: DataFrame,
    sample: int = 20_000,
    features: int = 1_024,
    penalty: float = 10.0,
    ridge: float = 3e-4,
    rounds: int = 300,
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
) -> Toxicity:
    """Fit on ``labelled (text, toxic)``, at most about ``sample`` rows of it.

    Rows without a label are left out; a NULL text is an empty one. Rows equal in ``key``, text and label count once. With more
    rows than ``sample`` a share of them is chosen by a hash of ``key``, a column that only
    this reads, and the text, so that a key of many rows is kept in part. ``features`` are chosen by how far their share differs between
    the labels, measured in standard errors, and there are no more of them than eight
    for every row of the rarer label. With no labels of one kind every score is
    that of the bias.
    """
    labelled = labelled.where("toxic IS NOT NULL").select(
        F.xxhash64("key", "text").alias("draw"), F.col("text"), (F.col("toxic") > 0).cast("int").alias("toxic")
    )
    total = labelled.select("draw").distinct().count()
    if total > sample:
        share = int(sample / total * (1 << 30))
        labelled = labelled.where(F.pmod(F.xxhash64("draw"), F.lit(1 << 30)) < share)
    chosen = written(labelled.dropDuplicates(["draw", "toxic"]).select("text", "toxic"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic].update({f for w in _words(text.as_py()) for f in _features(w)})
            # Emitted before the counters grow beyond what a batch can hold.
            if sum(map(len, seen)) > 200_000:
                yield _counts(seen)
                seen = (Counter(), Counter())
        if any(seen):
            yield _counts(seen)

    ones = chosen.where("toxic = 1").count()
    n = chosen.count()
    if not 0 < ones < n:
        return Toxicity({}, 10.0 if ones else -10.0)
    share = F.lit(ones) / F.lit(n)
    spread = F.col("rows") * (1 - F.col("rows") / n) * (1 / ones + 1 / (n - ones)) / n
    counted = chosen.mapInArrow(count, "feature string, zeros bigint, ones bigint").groupBy("feature")
    counted = counted.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    counted = counted.withColumn("rows", F.col("zeros") + F.col("ones")).where(f"rows BETWEEN 2 AND {n - 1}")
    gap = F.col("ones") / ones - F.col("zeros") / (n - ones)
    best = counted.select("feature", (gap * gap / spread).alias("z")).orderBy(F.desc("z"), "feature")
    number = {row["feature"]: i for i, row in enumerate(best.limit(min(features, 8 * min(ones, n - ones))).collect())}
    ways = _swaps(terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, others = [], []
            for text in batch.column(0):
                words = _words(text.as_py())
                rows.append(_numbers(words, number))
                others.append([_numbers(moved, number) for moved in _counterfactuals(words, ways)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(rows, kind), pa.array(others, pa.list_(kind))], ["toxic", "row", "others"]
            )

    found = chosen.mapInArrow(vectors, "toxic int, row array<int>, others array<array<int>>").toArrow()
    rows = [np.asarray(r, np.int64) for r in found["row"].to_pylist()]
    others = [[np.asarray(r, np.int64) for r in some] for some in found["others"].to_pylist()]
    # In one order whatever the tasks' was, so that reruns give the same sums.
    toxic = np.asarray(found["toxic"].to_pylist())
    order = sorted(range(len(rows)), key=lambda i: (toxic[i], rows[i].tolist()))
    rows, others = [rows[i] for i in order], [others[i] for i in order]
    w, b = fit_vectors(toxic[order], rows, others, len(number), penalty, ridge, rounds)
    return Toxicity({f: float(w[i]) for f, i in number.items()}, b, sum(1 for some in others if some))


def _counts(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = sorted(seen[0].keys() | seen[1].keys())
    arrays = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)]
    return pa.RecordBatch.from_arrays(arrays, ["feature", "zeros", "ones"])


def _numbers(words: set[str], number: dict[str, int]) -> list[int]:
    return sorted({number[f] for w in words for f in _features(w) if f in number})


def scored(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``; an empty or NULL text has the score of the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = [model.score_words(_words(t.as_py()), known) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(run, rows.select("row", F.lit(0.0).alias("score")).schema)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from; a NULL doc_id has no label and is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``key, text, toxic`` of labelled documents that are not held out.

    Of several labels for a document the highest counts. The labels are cut to
    ``most`` by hash before the join, so they are the only side that has to be known whole.
    """
    kept = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    kept = kept.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = kept.count()
    if total > most:
        share = int(most / total * (1 << 30))
        kept = kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # About ``most`` rows of two numbers, whatever the size of the labels.
    kept = F.broadcast(kept.select(F.col("doc_id").alias("key"), "toxic"))
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    return texts.join(kept, "key").select("key", "text", "toxic")
