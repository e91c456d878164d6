"""Personal data by weak supervision, in DataFrame expressions only.

Patterns give candidate spans. Labelers vote on each (for, against, or not at
all): the pattern's own validity check, a gazetteer, the words in front, and the
characters at its edges. Votes are counted over all documents; how reliable
each labeler is, and how often a candidate is real, is estimated from those counts by
expectation maximisation, without labels. Its posteriors train the final classifier, a logistic
regression over votes and the span's shape, which decides on every candidate.
Spans that pass the validity check of the four base kinds always stay.

Only counts per vote pattern, a bounded table, reach the driver, where both models are fitted.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogdiff.llm.common import written

# Kinds in their order, and what their candidates look like. Runs are possessive and
# start at their first character, or where the last match ended, so that no text takes
# more than one pass.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?:\G|(?<![A-Za-z0-9_/+-]))(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+",
}
# Cheap checks that a text with a candidate passes.
HINTS = {
    "email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){9}",
    "secret": r"[A-Za-z0-9_/+-]{20}",
}
# Gazetteers. Endings of addresses, issuers' first digits, calling codes, keys' beginnings.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|br|jp|cn|in|ru|pl|se|mx"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CALLING_CODES = (
    r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69]\d|3[578]\d|42\d|5[09]\d|6[7-9]\d|8[05]\d|9[679]\d)"
)
KEY_STARTS = r"^(?:sk-|pk-|ghp_|gho_|AKIA|AIza|xox[bp]-|eyJ)"
# Words in front that speak for a kind, and such that speak against all.
IN_FRONT = {
    "email": r"mail|contact|kontakt|correo|courriel", "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|karte|carte|tarjeta|visa|payment", "phone": r"phone|tel|call|mobile|fax|anruf|appel",
    "secret": r"token|key|secret|password|passwd|auth|bearer",
}
AGAINST = r"version|isbn|issn|order|page|chapter|section|sha-?1|sha-?256|md5|commit|checksum"

LABELERS = ("valid", "gazetteer", "front", "edges")
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
# Characters in front that are looked at, and cells of a running sum.
FRONT, CELL = 24, 512


def _running(lengths: Column) -> Column:
    """Sum of the elements before each one; in cells, so that it grows nearly in proportion."""
    zero = F.lit(0)
    cells = F.transform(
        F.sequence(zero, F.floor((F.size(lengths) - 1) / CELL).cast("int")),
        lambda b: F.aggregate(F.slice(lengths, b * CELL + 1, F.lit(CELL)), zero, lambda a, x: a + x),
    )
    ahead = F.aggregate(cells, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    whole = F.struct(lengths.alias("l"), ahead.alias("a"))
    # Bound once, then read by every element.
    return F.flatten(F.transform(F.array(whole), lambda s: F.transform(
        F.sequence(zero, F.size(s["l"]) - 1),
        lambda i: F.get(s["a"], F.floor(i / CELL).cast("int"))
        + F.aggregate(F.slice(s["l"], i - i % CELL + 1, i % CELL), zero, lambda a, x: a + x),
    )))


def _raw(text: Column, kind: str) -> Column:
    """Matches of a kind in order: ``start, end, match, front, after``."""
    pattern = F.lit(PATTERNS[kind])
    parts = F.struct(
        F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found")
    )

    def of(s: Column) -> Column:
        lengths = F.zip_with(
            F.slice(s["gaps"], F.lit(1), F.size(s["found"])), s["found"], lambda g, m: F.char_length(g) + F.char_length(m)
        )
        numbered = F.zip_with(s["found"], _running(lengths), lambda m, before: F.struct(m.alias("m"), before.alias("b")))
        return F.transform(numbered, lambda x, i: F.struct(
            (x["b"] + F.char_length(F.get(s["gaps"], i))).alias("start"),
            (x["b"] + F.char_length(F.get(s["gaps"], i)) + F.char_length(x["m"])).alias("end"),
            x["m"].alias("match"),
            F.right(F.get(s["gaps"], i), F.lit(FRONT)).alias("front"),
            F.left(F.get(s["gaps"], i + 1), F.lit(1)).alias("after"),
        ))

    none = F.array().cast("array<struct<start:int,end:int,match:string,front:string,after:string>>")
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in ("email", "phone") else text.rlike(HINTS[kind])
    found = F.flatten(F.transform(F.array(parts), lambda s: F.when(F.size(s["found"]) > 0, of(s)).otherwise(none)))
    return F.when(hint, found).otherwise(none)


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(14, 19) & F.when(F.char_length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return match.rlike("[0-9][^0-9]*[0-9][^0-9]*[0-9]") & match.rlike("[A-Za-z]")


def _votes(kind: str, x: Column) -> list[Column]:
    """One of 0 (against), 1 (none), 2 (for) of each labeler."""
    match, front, after = x["match"], F.lower(x["front"]), x["after"]
    against, none, in_favour = F.lit(0), F.lit(1), F.lit(2)
    digits = F.regexp_replace(match, "[^0-9]", "")
    listed = {
        "email": F.when(match.rlike(rf"(?i)\.(?:{ENDINGS})$"), in_favour).otherwise(against),
        "ip": F.when(match.rlike(r"^(?:0|127|255)\.|\.0\.0$"), against).otherwise(in_favour),
        "card": F.when(digits.rlike(ISSUERS), in_favour).otherwise(against),
        "phone": F.when(match.rlike(CALLING_CODES), in_favour).otherwise(against),
        "secret": F.when(match.rlike(KEY_STARTS), in_favour).otherwise(none),
    }[kind]
    said = F.when(front.rlike(IN_FRONT[kind]), in_favour).when(front.rlike(AGAINST), against).otherwise(none)
    inside = front.rlike(r"[a-z0-9]$") | after.rlike(r"^[A-Za-z0-9]")
    return [
        F.when(_valid(kind, match), in_favour).otherwise(against), listed, said, F.when(inside, against).otherwise(in_favour)
    ]


def _shape(x: Column) -> Column:
    """Bounded description the labelers don't use: length by fours up to 40, and whether it is quoted."""
    length = F.least(F.floor((x["end"] - x["start"]) / 4).cast("int"), F.lit(10))
    return length * 2 + F.when(x["front"].rlike("[\"'=:]\\s*$"), 1).otherwise(0)


def _judged(number: int, kind: str) -> Callable[[Column], Column]:
    def one(x: Column) -> Column:
        votes = _votes(kind, x)
        base = _valid(kind, x["match"]) if kind in BASE_KINDS else F.lit(False)
        return F.struct(
            x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), base.alias("base"),
            (votes[0] + 3 * votes[1] + 9 * votes[2] + 27 * votes[3]).alias("votes"), _shape(x).alias("shape"),
        )

    return one


def candidates(text: Column) -> Column:
    """All candidates of a text by start, then kind: ``start, kind, end, base, votes, shape``."""
    return F.array_sort(F.concat(*[F.transform(_raw(text, k), _judged(n, k)) for n, k in enumerate(KINDS)]))


@dataclass(frozen=True)
class SpanModel:
    """The final classifier's weights by kind: bias, votes (labeler by vote), shapes."""

    bias: tuple[float, ...]
    votes: tuple[tuple[float, ...], ...]
    shapes: tuple[tuple[float, ...], ...]

    def is_real(self, span: Column) -> Column:
        """Whether a candidate is taken: a base span, or one the classifier finds likelier than not."""
        table = lambda rows: F.array(*[F.lit(x) for row in rows for x in row])
        kind, code = span["kind"], span["votes"]
        score = F.get(F.array(*map(F.lit, self.bias)), kind)
        for at in range(len(LABELERS)):
            vote = F.floor(code / 3**at).cast("int") % 3
            score += F.get(table(self.votes), kind * 3 * len(LABELERS) + 3 * at + vote)
        score += F.get(table(self.shapes), kind * SHAPES + span["shape"])
        return span["base"] | (score >= 0)


SHAPES = 22


def estimate(counts: Sequence[tuple[int, int, int]], rounds: int = 50) -> dict[int, float]:
    """EM over ``(votes, shape, n)`` of one kind: vote pattern to the probability that it is real.

    Starts from the share of votes in favour; labelers are taken as independent given the truth.
    """
    totals: dict[int, float] = defaultdict(float)
    for code, _, n in counts:
        totals[code] += n
    patterns = sorted(totals)
    split = {c: [c // 3**at % 3 for at in range(len(LABELERS))] for c in patterns}
    real = {}
    for c in patterns:
        cast = [v for v in split[c] if v != 1]
        real[c] = (0.5 + sum(v == 2 for v in cast)) / (1 + len(cast))
    for _ in range(rounds):
        size = [sum(totals[c] * (1 - real[c]) for c in patterns), sum(totals[c] * real[c] for c in patterns)]
        prior = (size[1] + 1) / (size[0] + size[1] + 2)
        rates = []
        for at in range(len(LABELERS)):
            rate = [[1.0] * 3, [1.0] * 3]
            # Two in three votes of a labeler are taken to be right before anything is seen.
            rate[0][0] += 1.0
            rate[1][2] += 1.0
            for c in patterns:
                rate[0][split[c][at]] += totals[c] * (1 - real[c])
                rate[1][split[c][at]] += totals[c] * real[c]
            rates.append([[x / sum(row) for x in row] for row in rate])
        for c in patterns:
            logit = math.log(prior / (1 - prior))
            for at, v in enumerate(split[c]):
                logit += math.log(rates[at][1][v] / rates[at][0][v])
            real[c] = 1 / (1 + math.exp(-max(-50.0, min(50.0, logit))))
    return real


def train(counts: Sequence[tuple[int, int, int]], real: dict[int, float], rounds: int = 400, ridge: float = 1e-3):
    """Logistic regression of one kind on EM's posteriors: bias, vote weights, shape weights."""
    width = 1 + 3 * len(LABELERS) + SHAPES
    total = float(sum(n for *_, n in counts)) or 1.0
    rows = []
    for code, shape, n in sorted(counts):
        places = [0, *(1 + 3 * at + code // 3**at % 3 for at in range(len(LABELERS))), 1 + 3 * len(LABELERS) + shape]
        rows.append((places, real[code], n / total))
    weights, step = [0.0] * width, 4.0 / (2 + len(LABELERS))
    for _ in range(rounds):
        slope = [ridge * w for w in weights]
        for places, goal, share in rows:
            score = sum(weights[p] for p in places)
            error = share * (1 / (1 + math.exp(-max(-50.0, min(50.0, score)))) - goal)
            for p in places:
                slope[p] += error
        weights = [w - step * s for w, s in zip(weights, slope)]
    return weights[0], tuple(weights[1 : 1 + 3 * len(LABELERS)]), tuple(weights[1 + 3 * len(LABELERS) :])


def fit(found: DataFrame) -> SpanModel:
    """Fit on the candidates of all documents, ``found (spans)``: counted by kind, votes and shape."""
    spans = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").count()
    by_kind: dict[int, list] = defaultdict(list)
    # At most kinds x vote patterns x shapes rows, whatever the documents.
    for row in spans.collect():
        by_kind[row["kind"]].append((row["votes"], row["shape"], row["count"]))
    none = (-1.0, (0.0,) * 3 * len(LABELERS), (0.0,) * SHAPES)
    fitted = []
    for kind in range(len(KINDS)):
        counts = sorted(by_kind[kind])
        fitted.append(train(counts, estimate(counts)) if counts else none)
    return SpanModel(*(tuple(x) for x in zip(*fitted)))


def found_spans(docs: DataFrame) -> tuple[DataFrame, SpanModel]:
    """Every row of ``docs (row, text)`` as ``row`` with its ``spans``, written once, and the model."""
    found = written(docs.select("row", candidates(F.coalesce("text", F.lit(""))).alias("spans")), "candidates")
    return found, fit(found)


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs``: ``start, kind (number), end, base`` by start, then kind.

    Positions count characters from 0, ends are exclusive. A NULL or empty text has no spans. Rows that
    repeat stay rows, other columns are not read, whatever their names, and an empty table gives no rows. Texts of any
    length are searched whole, in one row.
    """
    found, model = found_spans(docs.select(F.col("doc_id").alias("row"), "text"))
    taken = F.filter("spans", model.is_real)
    short = F.transform(taken, lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"]))
    return found.select(F.col("row").alias("doc_id"), short.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.when(s["start"] >= state["at"], F.struct(
            F.concat(state["out"], between, F.get(names, s["kind"])).alias("out"), s["end"].alias("at")
        )).otherwise(F.struct(state["out"].alias("out"), F.greatest(state["at"], s["end"]).alias("at")))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, put, rest)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their texts redacted, and ``n_chars`` counted again where there is one.

    All columns stay. A NULL text stays NULL.
    """
    found, model = found_spans(docs.select(F.struct("*").alias("row"), "text"))
    found = found.withColumn("taken", F.filter("spans", model.is_real))
    found = found.withColumn("new", redact(F.col("row.text"), F.col("taken")))
    columns = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.size("taken") > 0, F.char_length("new")).otherwise(F.col("row.n_chars")).cast(kind)
    return found.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
