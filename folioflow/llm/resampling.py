"""Importance resampling towards a target distribution, with word tries.

Features are the runs of 1 to ``ORDER`` consecutive words, hashed to buckets by the CRC of their
text. Each task puts the words that it reads, some ``BATCH_WORDS`` at a time, into a trie: a path is a run of
words, a node holds how often its run occurred and the CRC of its text. A child's CRC goes on from its parent's: the
parent's state is shifted by the length of the word that is added. A level of the trie is three arrays over its nodes, which are found by
parent and word. When a trie is full, its counts are added to the task's bucket totals (``BUCKETS`` numbers), so memory is
bounded and no run is lost. The totals of all tasks are summed by a shuffle; what the driver and the
broadcast hold is one number for each bucket, whatever the size of the corpus.

Documents are scored by a second walk over such tries, whose nodes hold the gains of their
buckets. The draw takes the highest scores. Ranks come from a count of documents by score (a
score is a whole number of thousandths of a logarithm, so there are at most some 100,000 of them) and the
order within each score; no task sorts all documents.

Null and blank texts have no words: no features, weight 0, never drawn. Rows equal in id and features
are drawn one by one, in any order among themselves. A null id counts as the empty text in the hash and comes
after all others in ties. An empty target leaves the gains to the corpus's own counts; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import LOWER, UPPER, table, written

BUCKETS, ORDER = 10_000, 2
BATCH_WORDS, KEPT_WORDS, LONG_WORD = 1 << 19, 1 << 19, 64
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased: runs of digits, letters a to z and anything beyond ASCII."""
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _byte_table() -> np.ndarray:
    """The remainders of all bytes, by the polynomial of CRC-32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_BYTES = _byte_table()


class Lexicon:
    """Numbers of words, with the CRC and the length of each."""

    def __init__(self):
        self.of: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.crc, self.length = np.empty(0, np.uint32), np.empty(0, np.int64)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """The number of each word; new words get the next ones."""
        if len(self.texts) > KEPT_WORDS:
            self.__init__()
        for w in set(found).difference(self.of):
            self.of[w] = len(self.texts)
            self.texts.append(w)
        new = self.texts[len(self.crc) :]
        self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new))])
        self.length = np.concatenate([self.length, np.fromiter(map(len, new), np.int64, len(new))])
        return np.fromiter(map(self.of.__getitem__, found), np.int64, len(found))

    def follow(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The CRC of each text with CRC ``state``, followed by a space and a word."""
        out = _BYTES[(state ^ 0xFFFFFFFF ^ 0x20) & 0xFF] ^ ((state ^ np.uint32(0xFFFFFFFF)) >> 8) ^ np.uint32(0xFFFFFFFF)
        length, spaced = self.length[word], out.copy()
        for i in range(int(min(length.max(initial=0), LONG_WORD))):
            on = np.flatnonzero(length > i)
            out[on] = (out[on] >> 8) ^ _BYTES[out[on] & 0xFF]
        out ^= self.crc[word]
        for i in np.flatnonzero(length > LONG_WORD):
            out[i] = zlib.crc32(self.texts[word[i]], int(spaced[i]))
        return out


def trie(lexicon: Lexicon, word: np.ndarray, doc: np.ndarray, order: int = ORDER):
    """For each level of the trie of all runs of ``word`` inside a ``doc``: the CRC of each node, and the node and the first place of each run."""
    used, node = np.unique(word, return_inverse=True)
    state, place = lexicon.crc[used], np.arange(len(word))
    yield state, node, place
    for k in range(1, order):
        place = np.flatnonzero(doc[k:] == doc[: len(doc) - k]) if len(doc) > k else np.empty(0, np.int64)
        # runs of k words that go on; their nodes are by place, as all earlier places have one
        before = np.full(len(word), -1)
        before[last_place if k > 1 else np.arange(len(word))] = node
        added = word[place + k]
        nodes, node = np.unique(before[place] * np.int64(len(lexicon.texts)) + added, return_inverse=True)
        state = lexicon.follow(state[nodes // len(lexicon.texts)], nodes % len(lexicon.texts))
        last_place = place
        yield state, node, place


def _batches_of(texts, lexicon: Lexicon):
    """(rows, their numbers of words, the words, the row of each word) of as many rows as have some ``BATCH_WORDS`` words, one at least."""
    rows, lens, held, size = [], [], [], 0
    for row, text in texts:
        found = words(text)
        rows.append(row)
        lens.append(len(found))
        held.extend(found)
        size += len(found)
        if size >= BATCH_WORDS or len(rows) >= 10_000:
            yield rows, np.array(lens), lexicon.numbers(held), np.repeat(np.arange(len(rows)), lens)
            rows, lens, held, size = [], [], [], 0
    if rows:
        yield rows, np.array(lens), lexicon.numbers(held), np.repeat(np.arange(len(rows)), lens)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """bucket, n: how many features of ``texts(text)`` are in each bucket that has any."""

    def run(batches):
        totals, lexicon = np.zeros(buckets, np.int64), Lexicon()
        for _, _, word, doc in _batches_of(((None, t.as_py()) for b in batches for t in b.column(0)), lexicon):
            for state, node, _ in trie(lexicon, word, doc, order):
                totals += np.bincount(state % np.uint32(buckets), np.bincount(node, minlength=len(state)), buckets).astype(np.int64)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], ["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, order: int = ORDER) -> list[int]:
    """For each bucket, the floored thousandths of the logarithm of its share of the target over that of the corpus, each count with one added."""
    s, t = ({r.bucket: r.n for r in bucket_counts(x, buckets, order).collect()} for x in (corpus, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    odds = lambda b: float(t.get(b, 0) + 1) * float(all_s + buckets) / (float(s.get(b, 0) + 1) * float(all_t + buckets))
    return [math.floor(1000 * math.log(odds(b))) for b in range(buckets)]


def weighed(docs: DataFrame, gain: list[int], order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row: the floored mean of its features' gains."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gains_of, lexicon = np.array(held.value, np.int64), Lexicon()
        rows = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1))))
        for ids, n_words, word, doc in _batches_of(rows, lexicon):
            n_features, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for state, node, place in trie(lexicon, word, doc, order):
                at = gains_of[state % np.uint32(len(gains_of))]
                n_features += np.bincount(doc[place], minlength=len(ids))
                np.add.at(total, doc[place], at[node])
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_score(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds score: the weight plus thousandths of a Gumbel variate that the id's hash gives."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))))


def drawn(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of ``rows(doc_id, n_words, n_features, weight, score)``; rank is null for those not drawn."""
    spark, names = rows.sparkSession, ["doc_id", "n_words", "n_features", "weight", "score"]
    # equal rows are one with their number, so that no group of them is sorted or numbered in one task
    groups = written(rows.groupBy(*names).agg(F.count("*").alias("copies")))
    long_enough = F.col("n_words") >= least_words
    by_score = groups.where(long_enough).groupBy("score").agg(F.sum("copies").alias("n")).toPandas().sort_values("score", ascending=False, ignore_index=True)
    draw = int(by_score["n"].sum()) * percent // 100
    before = (by_score["n"].cumsum() - by_score["n"]).astype("int64")
    starts = pd.DataFrame({"_score": by_score["score"].astype("int64"), "_before": before})[before < draw]
    starts = F.broadcast(spark.createDataFrame(list(starts.itertuples(index=False, name=None)), "_score long, _before long"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.where(long_enough).join(starts, F.col("score") == F.col("_score"))
    ranked = ranked.select(*names, "copies", (F.col("_before") + F.coalesce(F.sum("copies").over(order), F.lit(0))).alias("first"))
    rest = groups.join(starts, long_enough & (F.col("score") == F.col("_score")), "left_anti")
    every = ranked.unionByName(rest.select(*names, "copies", F.lit(None).cast("long").alias("first")))
    chunks = every.select("doc_id", "n_features", "weight", "score", "first", "copies", F.explode(F.expr("sequence(0L, (copies - 1) div 4096)")).alias("chunk"))
    one = chunks.select("doc_id", "n_features", "weight", "score", "first", F.explode(F.expr("sequence(chunk * 4096 + 1, least(copies, (chunk + 1) * 4096))")).alias("copy"))
    rank = F.col("first") + F.col("copy")
    return one.select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs``, drawn towards the distribution of ``target(text)``."""
    gain = gains(docs, target)
    return drawn(with_score(weighed(docs, gain), seed), least_words, percent)


def op12_trie_resampling(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, drawn towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = "regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')".format(UPPER, LOWER)
_RUNS = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
#: CRC-32 by its table of one byte's remainders, over the hexadecimal digits of a feature's bytes.
SQL = f"""with d as (select row_number() over () as k, doc_id, {_W} as w from documents), b as (select {_W} as w from benchmark),
    tab as (select list(list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as t from range(256) r(n)),
    fd as (select k, f, count(*) as c from (select k, {_RUNS} as f from d) group by all), fb as (select f, count(*) as c from (select {_RUNS} as f from b) group by all),
    h as (select f, hex(encode(f)) as x from (select f from fd union select f from fb)),
    g as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint)), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from h, tab),
    s as (select bucket, sum(c)::bigint as n from fd join g using (f) group by 1), t as (select bucket, sum(c)::bigint as n from fb join g using (f) group by 1), tot as (select (select sum(n) from s)::bigint as s, coalesce((select sum(n) from t), 0)::bigint as t),
    gain as (select s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (tot.s + {BUCKETS})::double / ((s.n + 1)::double * (tot.t + {BUCKETS})::double)))::bigint as gain from s left join t using (bucket), tot),
    w as (select k, sum(c)::bigint as n, floor(sum(c * gain)::double / sum(c)::double)::bigint as weight from fd join g using (f) join gain using (bucket) group by k),
    r as (select doc_id, len(d.w) as words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score from d left join w using (k)),
    o as (select *, words >= {LEAST_WORDS} as ok, row_number() over (partition by words >= {LEAST_WORDS} order by score desc, doc_id) as rank, count(*) over (partition by words >= {LEAST_WORDS}) as n from r)
    select doc_id, n_features, weight, score, case when ok and rank <= {PERCENT} * n // 100 then rank end as rank from o"""
