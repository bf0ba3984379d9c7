"""Pages that are closed by breaks and by silence, in batch and as a stream."""

import datetime as dt
import random

import pytest

from folioflow.streaming import lifecycle

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def brute(rows, gap):
    out = []
    for book in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == book), key=lambda r: (r[2], r[1]))
        page, n, last = [], 0, None

        def flush(how, book=book):
            nonlocal n
            if page:
                n += 1
                out.append((book, page[0][2], page[-1][2], n, len(page), how, "".join(p[4] or "" for p in page)))
                page.clear()

        for r in mine:
            if last is not None and (r[2] - last).total_seconds() > gap:
                flush("gap")
                n = 0
            last = r[2]
            if r[3] == "break":
                flush("break")
            else:
                page.append(r)
        flush("gap")
    return sorted(out)


def fragments(n=400, seed=2):
    r = random.Random(seed)
    clock, rows = {}, []
    for i in range(n):
        book = r.choice("abc")
        clock[book] = clock.get(book, 0) + r.choice([1, 5, 60, 299, 300, 301, 900])
        rows.append((book, i, at(clock[book]), r.choice(["text", "text", "text", "break"]), r.choice([f"<p>{i}</p>", None])))
    return rows


def collected(df):
    return sorted((r.book, r.started, r.ended, r.page_no, r.parts, r.closed, r.html) for r in df.collect())


@pytest.mark.parametrize("gap", [300, 61])
def test_pages_against_one_fragment_at_a_time(spark, gap):
    rows = fragments()
    assert collected(lifecycle.pages(spark.createDataFrame(rows, lifecycle.FRAGMENTS), gap)) == brute(rows, gap)


def test_stream_gives_each_page_once_and_equals_the_batch(spark, tmp_path):
    rows = sorted(fragments(200, 7), key=lambda r: r[2])
    # files in order of time, each a batch of its own; the last one is far later, so that all sessions before it end
    end = ("z", 10_000, at(10**7), "text", "end")
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)] + [[end]]
    for i, part in enumerate(parts[:3]):
        spark.createDataFrame(part, lifecycle.FRAGMENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    run = lambda: lifecycle.write_pages(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    run()
    for i, part in enumerate(parts[3:], 3):
        spark.createDataFrame(part, lifecycle.FRAGMENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    run()
    # what is done is not given out again
    run()
    assert collected(spark.read.parquet(f"{tmp_path}/out")) == brute(rows, 300)


def test_fragments_without_a_time_or_book(spark):
    rows = [("a", 1, None, "text", "x"), (None, 2, at(1), "text", "y"), ("a", 3, at(1), None, "z"), ("a", 4, at(2), "break", None), ("a", 5, at(3), "break", None)]
    assert collected(lifecycle.pages(spark.createDataFrame(rows, lifecycle.FRAGMENTS))) == [("a", at(1), at(1), 1, 1, "break", "z")]
    assert lifecycle.pages(spark.createDataFrame([], lifecycle.FRAGMENTS)).count() == 0
