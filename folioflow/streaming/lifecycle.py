"""The life of pages as they are converted: fragments arrive, a break closes a page, and so does silence.

A converter sends a book's fragments one by one. A page is done when a break follows it, or when nothing more of the
book comes for longer than a gap, which each arrival sets anew: a session window. The window's state is Spark's own, keyed by
book; with a watermark, a session is given out once, when no arrival can lengthen it any more, so every page is
written exactly once even if the query stops and starts again from its checkpoint. The same function over a
table gives the same pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seconds of silence after which a page is done.
GAP = 300
FRAGMENTS = "book string, event_id long, ts timestamp, kind string, html string"


def pages(fragments: DataFrame, gap: int = GAP, late: str = "0 seconds") -> DataFrame:
    """book, started, ended, page_no, parts, closed (break or gap) and html of each page of ``fragments``; P33.

    ``fragments``: book, event_id, ts, kind (``break`` or anything else) and html. A session's fragments are in order of time and then of id; page numbers
    begin anew in each session, and count only pages with fragments. Fragments without a time or a book are left out. ``ended`` is the last fragment's time. A
    fragment that is more than ``late`` behind the newest one, when its session has been given out, comes too late.
    """
    rows = fragments.where("ts is not null and book is not null")
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    part = F.struct("ts", "event_id", "kind", F.coalesce("html", F.lit("")).alias("html"))
    sessions = rows.groupBy("book", F.session_window("ts", f"{gap} seconds").alias("session")).agg(F.array_sort(F.collect_list(part)).alias("held"))
    breaks = F.filter(F.transform("held", lambda x, i: F.when(x.kind == "break", i)), lambda i: i.isNotNull())
    sessions = sessions.withColumn("bounds", F.concat(F.array(F.lit(-1)), breaks, F.array(F.size("held"))))
    cut = F.transform(
        F.sequence(F.lit(1), F.size("bounds") - 1),
        lambda k: F.struct(F.slice("held", F.get("bounds", k - 1) + 2, F.get("bounds", k) - F.get("bounds", k - 1) - 1).alias("parts"), F.when(F.get("bounds", k) < F.size("held"), "break").otherwise("gap").alias("closed")),
    )
    whole = sessions.select("book", F.posexplode(F.filter(cut, lambda p: F.size(p.parts) > 0)).alias("n", "page"))
    return whole.select(
        "book", F.get("page.parts", F.lit(0)).ts.alias("started"), F.element_at("page.parts", -1).ts.alias("ended"), (F.col("n") + 1).alias("page_no"), F.size("page.parts").alias("parts"), F.col("page.closed").alias("closed"),
        F.array_join(F.transform("page.parts", lambda x: x.html), "").alias("html"),
    )


def write_pages(spark: SparkSession, folder: str, out: str, checkpoint: str, gap: int = GAP, late: str = "0 seconds", schema: str = FRAGMENTS) -> StreamingQuery:
    """Appends the finished pages of the fragments that arrive in ``folder`` to ``out``, each once."""
    rows = pages(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), gap, late)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
