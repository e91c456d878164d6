"""Document fingerprints by winnowing, in DataFrame expressions only.

A text is cut into tokens: words, and words of more than eight characters into pieces of
eight. Every k tokens in a row have a rolling hash, the polynomial of their
codes modulo 2^31 - 1. Of each window of w such hashes the smallest is chosen, of equal
ones the rightmost, and kept with its position. Two texts that share
w + k - 1 tokens in a row share a whole window, and so a chosen hash.

A hash and its position are one number, the hash in front and the position counted down
behind, so that the smallest number of a window is the rightmost smallest hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogdiff.llm.common import cut_points, range_number

# Tokens of a hash, hashes of a window, characters of a token.
GRAM, WINDOW, TOKEN = 3, 4, 8
PRIME, BASE = (1 << 31) - 1, 1_000_003
MASK = (1 << 31) - 1
# Documents of a range, and the most ranges that cut points are drawn for.
RANGE, MOST_CUTS = 50_000, 256


def token_codes(text: Column, longest: int = TOKEN) -> Column:
    """Codes of a text's tokens, below 2^31 - 1."""
    pattern = rf"[^\x20\x09-\x0D]{{1,{longest}}}"
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return F.transform(tokens, lambda t: F.pmod(F.hash(t).cast("bigint"), F.lit(PRIME)))


def gram_keys(codes: Column, k: int = GRAM) -> Column:
    """A number for every k codes in a row, of which there are k at least or none: hash, and position counted down."""
    def key(i: Column) -> Column:
        rolled = F.get(codes, i)
        for j in range(1, k):
            rolled = (rolled * F.lit(BASE).cast("bigint") + F.get(codes, i + j)) % F.lit(PRIME).cast("bigint")
        return F.shiftleft(rolled, 31) + (F.lit(MASK).cast("bigint") - i)

    none = F.array().cast("array<bigint>")
    return F.when(F.size(codes) > 0, F.transform(F.sequence(F.lit(0), F.size(codes) - F.lit(k)), key)).otherwise(none)


def chosen_keys(keys: Column, w: int = WINDOW) -> Column:
    """The smallest number of every window of w, each once, by position."""
    windows = F.greatest(F.size(keys) - F.lit(w - 1), F.lit(1))
    smallest = F.transform(F.sequence(F.lit(1), windows), lambda i: F.array_min(F.slice(keys, i, F.lit(w))))
    return F.when(F.size(keys) > 0, F.array_distinct(smallest)).otherwise(keys)


def with_fingerprint(rows: DataFrame, text: str, name: str, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Add ``name``: the fingerprint of a text as numbers of hash and position, ordered by position."""
    rows = rows.withColumn(f"{name}_codes", token_codes(F.col(text)))
    # Fewer than k codes are one gram.
    codes = F.col(f"{name}_codes")
    short = F.size(codes).between(1, k - 1)
    padded = F.concat(codes, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(k) - F.size(codes), F.lit(0))))
    rows = rows.withColumn(f"{name}_codes", F.when(short, padded).otherwise(codes))
    rows = rows.withColumn(f"{name}_keys", gram_keys(F.col(f"{name}_codes"), k)).drop(f"{name}_codes")
    return rows.withColumn(name, chosen_keys(F.col(f"{name}_keys"), w)).drop(f"{name}_keys")


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 31)))


def positions(fingerprint: Column) -> Column:
    """First token of each chosen gram."""
    return F.transform(fingerprint, lambda x: (F.lit(MASK).cast("bigint") - x.bitwiseAND(F.lit(MASK).cast("bigint"))).cast("int"))


def digest(fingerprint: Column) -> Column:
    """A fingerprint as a short text: equal for equal fingerprints."""
    return F.md5(F.concat_ws(",", F.transform(fingerprint, lambda x: x.cast("string"))).cast("binary"))


def likeness(one: Column, two: Column) -> Column:
    """Share of common hashes among all of two sets of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(one, two))
    every = F.size(one) + F.size(two)
    return F.when(every == 0, 1.0).otherwise(common / (F.greatest(every, F.lit(1)) - common))


def fingerprinted(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id, fingerprint, hashes, positions`` of every row of ``docs``; hashes are in order and not distinct.

    A NULL or empty text has an empty fingerprint; other columns are not read. Rows that repeat stay rows, texts of any length
    are read whole, in one row, and an empty table gives no rows.
    """
    rows = with_fingerprint(docs.select("doc_id", F.col("text").alias("t")), "t", "fingerprint", k, w).drop("t")
    print_ = F.col("fingerprint")
    return rows.select("doc_id", digest(print_).alias("fingerprint"), F.transform(print_, lambda x: F.shiftright(x, 31)).alias("hashes"), positions(print_).alias("positions"))


def beside_next(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id, text, fingerprint`` of every row with ``next_text, next_fingerprint`` of the row after it.

    Rows are in order of descending doc_id, NULL last, rows of one doc_id by hash and text; after the last
    comes the first. One order over all rows would be one task, so ids are cut into
    ranges, and the first row of a range is also the guest of the range before: rows
    of the range's largest doc_id are found by a table with one row for every range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    count, low, high = ids.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), count // RANGE + 1)
    cuts = cut_points(ids, "doc_id", min(MOST_CUTS, wanted, count))
    inner = count // (RANGE * (len(cuts) + 1)) + 1

    def ranged(table: DataFrame) -> DataFrame:
        table = table.withColumn("range", range_number(F.col("doc_id"), cuts, "bigint"))
        if inner == 1 or low is None:
            return table.withColumn("part", F.lit(0))
        # Beyond the most cut points, equal steps between two of them.
        ends = [float(low), *map(float, cuts), float(high) + 1]
        start = F.element_at(F.array(*map(F.lit, ends[:-1])), F.col("range") + 1)
        stop = F.element_at(F.array(*map(F.lit, ends[1:])), F.col("range") + 1)
        step = F.floor((F.col("doc_id") - start) / F.greatest(stop - start, F.lit(1.0)) * inner)
        part = F.when(F.col("range") >= 0, F.least(F.greatest(step, F.lit(0)), F.lit(inner - 1))).otherwise(0)
        return table.withColumn("part", part.cast("int"))

    # A row for every range: as many as there are cut points, or one for RANGE documents.
    tops = ranged(ids).groupBy("range", "part").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy(F.desc("range"), F.desc("part"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("range", "part")
    host = F.coalesce(F.lag(here).over(order), F.last(here).over(whole))
    tops = tops.select(
        F.col("range").alias("r"), F.col("part").alias("p"), "top", host.alias("host"),
        F.lag(here).over(order).isNull().alias("after_all"),
    )
    match = (F.col("range") == F.col("r")) & (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("top"))
    rows = ranged(rows).join(F.broadcast(tops), match, "left")
    own = F.struct("range", "part", F.lit(False).alias("guest"), F.lit(False).alias("after_all"))
    guest = F.struct(
        F.col("host.range").alias("range"), F.col("host.part").alias("part"), F.lit(True).alias("guest"), "after_all"
    )
    places = F.when(F.col("r").isNull(), F.array(own)).otherwise(F.array(own, guest))
    rows = rows.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.*")
    rows = with_fingerprint(rows.repartition("range", "part"), "text", "fingerprint", k, w)
    after = Window.partitionBy("range", "part").orderBy(
        "after_all", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"
    )
    following = {f"next_{c}": F.lead(c).over(after) for c in ("text", "fingerprint")}
    rows = rows.withColumns(following)
    return rows.where("NOT guest").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def edited(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Every row beside its edited text: ``edited``, ``edited_fingerprint`` and what ``beside_next`` gives.

    The last third of the characters, rounded down, is replaced by as many from the start of
    the next document, or all it has.
    """
    rows = beside_next(docs, k, w)
    third = F.floor(F.char_length("text") / 3).cast("int")
    kept = F.substring("text", 1, F.char_length("text") - third)
    rows = rows.withColumn("edited", F.concat(kept, F.substring("next_text", 1, third)))
    return with_fingerprint(rows, "edited", "edited_fingerprint", k, w)
