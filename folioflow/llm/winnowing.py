"""Document fingerprints by winnowing.

The words of a text are hashed; every run of ``K`` words has a polynomial hash modulo a
prime (the value a rolling hash would give), and of every ``W`` neighbouring hashes the least
is chosen, the rightmost among equals. Its position is kept. Any run of ``K + W - 1`` words
that two texts share therefore gives both at least one equal hash. A text of fewer than ``K``
words has the hash of all its words; a text of fewer than ``W`` such runs has the least of
them; a text without words has none.

A hash and its position are packed in a long, the hash above and the position, counted
down, below: the least of a window is then the rightmost of its least hashes. All of it is
DataFrame expressions inside one row, linear in the text's length.

``with_next`` puts each row beside the next by descending id without sorting the table in
one task: ids are dealt to ranges by quantiles, each range is a window, and the first row of
a range is dealt to the range above as well. Rows without an id come last, by their texts'
hashes, and are dealt to ranges of their own by these; rows with equal ids are ordered by text, in one
range. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import table

K, W = 5, 16
PRIME, BASE = 2147483647, 1_000_003
POSITIONS = 1 << 31
#: Bounds the broadcast table of ranges (four longs each); a shuffle task takes about ``RANGES_PER_TASK`` of them at any size.
MOST_RANGES, RANGES_PER_TASK = 1 << 20, 16


def fingerprint(text):
    """The chosen hashes of a text as packed longs, in order of position."""
    power = [pow(BASE, K - 1 - j, PRIME) for j in range(K)]
    hashed = F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(PRIME)))

    def gram(h, i):
        out = F.lit(0)
        for j in range(K):
            out = out + F.get(h, i + j) * F.lit(power[j]) % F.lit(PRIME)
        return out % F.lit(PRIME)

    def pack(value, i):
        return value * F.lit(POSITIONS) + (F.lit(POSITIONS - 1) - i)

    def packed(h):
        many = F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: pack(gram(h, i), i))
        few = F.array(pack(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a * F.lit(BASE) + x) % F.lit(PRIME)), F.lit(0)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < K, few).otherwise(many)

    def chosen(v):
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - W + 1), lambda i: F.array_min(F.slice(v, i, W))))
        return F.when(F.size(v) == 0, v).when(F.size(v) <= W, F.array(F.array_min(v))).otherwise(many)

    # one-element arrays bind an intermediate array to a lambda's name, so that it is computed once
    return F.get(F.transform(F.transform(F.array(hashed), packed), chosen), F.lit(0))


def only_hashes(fp):
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 31)))


def as_text(fp):
    """``hash@position`` of each chosen run, in hexadecimal and decimal."""
    return F.array_join(F.transform(fp, lambda x: F.concat_ws("@", F.lower(F.hex(F.shiftright(x, 31))), F.lit(POSITIONS - 1) - x.bitwiseAND(F.lit(POSITIONS - 1)))), " ")


def likeness(a, b):
    """Jaccard similarity of the hashes of two fingerprints; 1 for two without any."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _range_of(rows: DataFrame, per_range: int):
    """A column that deals ``rows(doc_id, hash)`` to ranges, in their order, of about ``per_range`` rows, and the number of ranges.

    The hash counts for rows without an id alone, whose ranges are below 0.
    """
    every, n, lo, hi = rows.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    per_range = max(per_range, -(-every // MOST_RANGES))
    none = -(-(every - n) // per_range)
    below = -1 - F.least(F.floor((F.col("hash") / 2.0**64 + 0.5) * none), F.lit(max(0, none - 1)))
    if not n or lo == hi:
        return F.when(F.col("doc_id").isNull(), below).otherwise(0).cast("long"), none + 1
    q = min(256, max(1, n // per_range))
    inner = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / q for i in range(1, q)] or [0.5], 10_000)).first()[0]))
    edges = [lo, *(x for x in inner if lo < x <= hi)]
    parts = max(1, n // (len(edges) * per_range))
    at = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in edges)), lambda e: e <= F.col("doc_id")))
    ends = F.array(*(F.lit(x).cast("long") for x in [*edges, hi + 1]))
    low, high = F.get(ends, at - 1), F.get(ends, at)
    within = F.floor((F.col("doc_id") - low) / (high - low) * parts)
    return F.when(F.col("doc_id").isNull(), below).otherwise(at * parts + F.least(within, F.lit(parts - 1))).cast("long"), none + (len(edges) + 1) * parts


def with_next(rows: DataFrame, per_range: int = 400) -> DataFrame:
    """``rows`` (doc_id, text and others) and ``next``: a struct of the next row by descending doc_id; the last row has the first's.

    Texts are shuffled once: the first row of each range is dealt to the range above too, after that one's own rows.
    """
    names = [c for c in rows.columns if c != "doc_id"]
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("hash")
    ids = rows.select("doc_id", hashed)
    in_range, ranges = _range_of(ids, per_range)
    heads = ids.select("doc_id", "hash", in_range.alias("range")).groupBy("range").agg(F.max("doc_id").alias("head"), F.min("hash").alias("head_hash"))
    up = Window.orderBy("range")
    heads = F.broadcast(heads.select("head", "head_hash", F.coalesce(F.lead("range").over(up), F.first("range").over(up)).alias("above")))
    ranged = rows.select("doc_id", F.struct(*names).alias("own"), hashed).select("doc_id", "own", "hash", in_range.alias("range"))
    ranged = ranged.join(heads, F.col("doc_id").eqNullSafe(F.col("head")) & F.col("hash").eqNullSafe(F.col("head_hash")), "left")
    places = F.when(F.col("above").isNull(), F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("extra")), F.struct(F.col("above").alias("at"), F.lit(True).alias("extra")))
    )
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ranges // RANGES_PER_TASK))
    dealt = ranged.select("doc_id", "hash", "own", F.inline(places)).repartition(tasks, "at")
    order = Window.partitionBy("at").orderBy("extra", F.col("doc_id").desc_nulls_last(), "hash", "own.text")
    out = dealt.withColumn("next", F.lead("own").over(order)).where("not extra")
    return out.select("doc_id", *(F.col(f"own.{c}").alias(c) for c in names), "next")


def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, each with its edited text and its next document."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = with_next(rows.withColumn("fp", fingerprint(F.col("text"))))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), F.array(edited).alias("edited"))
    # the edited text is bound once, as its hash and its fingerprint both need it
    both = F.get(F.transform("edited", lambda e: F.struct(F.sha2(F.encode(e, "UTF-8"), 256).alias("sha"), fingerprint(e).alias("fp"))), F.lit(0))
    pairs = pairs.select("doc_id", "n_chars", "fp", "next_fp", both.alias("edited"))
    sets = pairs.select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited.fp")).alias("edited_fingerprint"),
        F.transform(F.array(F.struct(only_hashes(F.col("fp")).alias("a"), only_hashes(F.col("edited.fp")).alias("b"), only_hashes(F.col("next_fp")).alias("c"))), lambda s: F.struct(likeness(s.a, s.b).alias("e"), likeness(s.a, s.c).alias("n")))[0].alias("near"),
    )
    return sets.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("near.e").alias("near_edited"), F.col("near.n").alias("near_next"))
