"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size gives the copies of each of its documents: a whole
part for certain and a fractional part as a probability. Pivotal rounding settles the
probabilities: two documents exchange mass, measured in words, in a random direction
that leaves both expectations as they are, until one of them is 0 or 1; the other goes
on to the next duel. Every duel keeps the expected words of the pair, so the words a
source takes differ from its target by less than one document: the last residual of the
source, which is taken with its probability, by a hash of the seed and the document.

The duels run in a reduction tree. Documents of a source are dealt to blocks of about
``block`` rows by a hash, so a source with a third of all rows is as many blocks as it
needs; a block settles all but one of its documents, and ``fan_in`` residuals of a source
meet in each following level until one is left. Within a group duels go from the largest
document down, which leaves a small residual. Random numbers are hashes of the seed, the
level and the two documents, so reruns agree on any partitioning.

Targets are found in one window over the table of sources, which has a row for each; only sums
over it reach the driver. Null texts have size
0; documents of size 0 take 0 words. A null source is a source of its own, the last.
Repeated rows are documents of their own; they are dealt by position among their equals.
"""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import WORD, own, table, written

CAP = 3
#: With more sources than this their table is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def targets(per: DataFrame, cap: int = CAP) -> DataFrame:
    """``per(source, source_size)`` with ``target``: shares of the sum of sizes by weights 1, 2, 3, repeating, in order of source, null last.

    No target is above ``cap`` times its size; the excess is shared again by weight, until none is above. So all
    shares under their caps have one amount per weight; it is found along the sources by cap per weight: the
    first at which what the ones before leave, by the weight that is left, is not above its cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = written(per.withColumn("weight", (rank - 1) % 3 + 1))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left = F.lit(float(total or 0)) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.lit(weight or 1) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    fits = rows.select(level.alias("level"), (F.col("source_size") * cap / F.col("weight")).alias("most")).where("level <= most")
    amount = fits.agg(F.max("level")).first()[0]
    share = F.col("weight") * F.lit(float(amount or 0))
    capped = (F.col("source_size") * cap).cast("double")
    return rows.select("source", "source_size", F.least(share, capped).alias("target"), *(c for c in rows.columns if c not in ("source", "source_size", "weight")))


def uniform(seed: int, *parts) -> float:
    return xxhash.xxh64_intdigest("|".join(map(str, parts)), seed) / 2.0**64


def duel(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """New probabilities of documents of ``s`` and ``t`` words; ``p*s + q*t`` stays, and one becomes 0 or 1."""
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (up + down) < down:
        return (1.0, q - up / t) if up == (1 - p) * s else (p + up / s, 0.0)
    return (0.0, q + down / t) if down == p * s else (p - down / s, 1.0)


def _settle(seed: int, level: int):
    """Settles a group; of its rows all but one leave with ``p`` 0 or 1."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "row_key", "copy"], ascending=[False, True, True], kind="stable", ignore_index=True)
        p, size, key, copy = rows["p"].tolist(), rows["size"].tolist(), rows["row_key"].tolist(), rows["copy"].tolist()
        held = -1
        for i in range(len(p)):
            if not 0 < p[i] < 1:
                continue
            if held >= 0:
                p[held], p[i] = duel(p[held], size[held], p[i], size[i], uniform(seed, level, key[held], copy[held], key[i], copy[i]))
                p[held], p[i] = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (p[held], p[i]))
                if 0 < p[held] < 1:
                    continue
            held = i if 0 < p[i] < 1 else -1
        rows["p"] = pd.Series(p, dtype="float64")
        return rows

    return run


def mix(docs: DataFrame, seed: int = 7, block: int = 512, fan_in: int = 64) -> DataFrame:
    """doc_id, source, text_key, copy, size, source_size, target, copies for each row of ``docs``."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = rows.groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("n"))
    # repeated rows are numbered in chunks, which are dealt anew before they are expanded
    chunks = rows.select("doc_id", "source", "text_key", "size", F.xxhash64("doc_id", "text_key").alias("row_key"), "n", F.explode(F.expr("sequence(0L, (n - 1) div 4096)")).alias("chunk"))
    chunks = chunks.repartition("row_key", "chunk")
    copies = F.expr("sequence(chunk * 4096 + 1, least(n, (chunk + 1) * 4096))")
    rows = written(chunks.select("doc_id", "source", "text_key", "size", "row_key", F.explode(copies).alias("copy")))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("long").alias("blocks"))
    shares = written(targets(per).withColumnRenamed("source", "_source"))
    sources, most = shares.agg(F.count("*"), F.max("blocks")).first()
    shares = F.broadcast(shares) if sources <= BROADCAST_SOURCES else shares
    rows = rows.join(shares, rows.source.eqNullSafe(shares["_source"])).drop("_source")
    rate = F.expr("if(source_size = 0, 0d, target / source_size)")
    rows = rows.withColumn("whole", F.floor(rate + F.lit(1e-12))).withColumn("p", F.expr("if(size = 0, 0d, greatest(0d, if(source_size = 0, 0d, target / source_size) - whole))"))
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(row_key, copy), blocks)"))
    level, most = 0, most or 1
    settled, open_ = [], rows
    while True:
        dealt = open_.groupBy("source", "block").applyInPandas(_settle(seed, level), open_.schema)
        done = written(dealt)
        if most == 1:
            luck = F.xxhash64(F.lit(seed), F.lit("last"), "row_key", "copy") / 2.0**64 + 0.5
            settled.append(done.withColumn("p", F.when(F.col("p").isin(0.0, 1.0), F.col("p")).otherwise((luck < F.col("p")).cast("double"))))
            break
        settled.append(done.where("p = 0 or p = 1"))
        open_ = done.where("p > 0 and p < 1").withColumn("block", F.expr(f"block div {fan_in}"))
        most, level = math.ceil(most / fan_in), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "text_key", "copy", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    mixed = mix(docs, **how).where("copies > 0").groupBy("doc_id", "source", "text_key").agg(F.collect_list("copies").alias("all"))
    mixed = written(mixed.select(F.xxhash64("doc_id", "source", "text_key").alias("row"), F.col("text_key").alias("key"), "all"))
    keyed = docs.select(own(docs), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    keyed = keyed.select("own", "key", F.xxhash64("doc_id", "source", "key").alias("row"))
    out = keyed.join(mixed, ["row", "key"]).withColumn("one", F.row_number().over(Window.partitionBy("row", "key").orderBy("row")))
    out = out.select("own", F.get("all", F.col("one") - 1).alias("times")).where("times > 0")
    return out.select("own", F.explode(F.expr("sequence(1, cast(times as int))")).alias("copy")).select("own.*")


def op6_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies of all documents."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
