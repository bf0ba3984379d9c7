"""Phrase collocations by contiguous pattern growth.

Patterns grow to the right from frequent prefixes. The words of each language are counted first; a word
below ``least`` occurrences begins, continues or ends no frequent phrase. A second pass projects the
texts on the remaining words: an occurrence pointer holds a word's id, which stands for the prefix, and
the ids of the words that follow it in its piece. Pointers are counted in each task before they are shuffled to
their prefix's task in lexicographic order. There ``grow`` extends each prefix by the runs of its pointers'
next words, keeps those that occur often enough, and goes on with these runs' pointers alone, down to the
longest phrases before the next prefix is read. Prefixes are closed as the sorted pointers stream by, so a task holds the
pointers of one prefix of two words, at most one for each word that follows. A prefix's second words are dealt to ``SHARES`` tasks, so
a very common first word isn't one task's work.

Ids are places in the sorted hashes of the frequent words, which are broadcast up to ``BROADCAST_WORDS`` words (16 MB);
beyond, the hashes themselves are the ids and pointers of rare words are shuffled too: more to shuffle, but the same result.

A phrase's score is that of its worst cut in two. The counts of both parts are joined to the candidates; numbers are exact decimals.

Null texts are empty and null languages ``und``. Texts without words, and empty tables, give no phrases. Repeated rows count each time.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import LOWER, UPPER, discard, table, written

LEAST, MOST_WORDS, TOP = 10, 3, 2000
BROADCAST_WORDS, SHARES = 1 << 21, 64
#: Entries of a task's counter of words, and pointers that it counts at a time.
HELD_WORDS, HELD_POINTERS = 1 << 19, 1 << 20
_KEPT = 1 << 19
#: A run of ends of pieces, or a word.
_TOKENS = re.compile(rb"[.,;:!?\x0a-\x0d]+|[^\x20\x09.,;:!?\x0a-\x0d]+")
_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
#: Ids of no word: the end of a piece, and a rare word.
END, RARE = -1, -2


def tokens(text: str | None) -> list[bytes]:
    """Words as UTF-8, A-Z lower-cased, and the ends of pieces between them."""
    return _TOKENS.findall((text or "").encode("utf-8", "surrogatepass").lower())


def hash_of(lang: str, word: bytes) -> int:
    """63 bits, so that the hash is never negative."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + word) >> 1


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f for every word of each language."""

    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            for lang, c in held.items():
                found = [(w, n) for w, n in c.items() if not _END.match(w)]
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([w.decode("utf-8", "replace") for w, _ in part]), pa.array([n for _, n in part], pa.int64())], ["lang", "word", "f"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                held.setdefault(lang.as_py(), Counter()).update(tokens(text.as_py()))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from out()
        yield from out()

    return _rows(docs).mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _names(most_words: int) -> list[str]:
    return [f"w{i}" for i in range(1, most_words + 1)]


def pointers(docs: DataFrame, known, most_words: int = MOST_WORDS) -> DataFrame:
    """w1 to w``most_words`` and n: how often a task saw a word with the words after it; below 0 where the piece ends or a rare word follows.

    ``known``: a broadcast of the sorted hashes of the frequent words, or None.
    """
    names = _names(most_words)

    def run(batches):
        memo: dict[str, dict[bytes, int]] = {}

        def id_of(lang: str, word: bytes) -> int:
            if _END.match(word):
                return END
            h = hash_of(lang, word)
            if known is None:
                return h
            at = int(np.searchsorted(known.value, h))
            return at if at < len(known.value) and known.value[at] == h else RARE

        def counted(ids: np.ndarray):
            """The distinct pointers of a flat array of ids, with their numbers."""
            ends = np.full(most_words - 1, END, np.int64)
            ids = np.concatenate([ids, ends])
            n = len(ids) - len(ends)
            columns = [ids[i : n + i].copy() for i in range(most_words)]
            for before, after in zip(columns, columns[1:]):
                after[before < 0] = END
            keep = (columns[0] >= 0) & (columns[1] >= 0)
            columns = [c[keep] for c in columns]
            for c in columns[2:]:
                c[c < 0] = END
            if not len(columns[0]):
                return
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))
            sums = np.diff(np.concatenate([first, [len(columns[0])]]))
            for at in range(0, len(first), 1 << 16):
                part = first[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c[part]) for c in columns), pa.array(sums[at : at + (1 << 16)].astype(np.int32))], [*names, "n"])

        held, size = [], 0
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang, found = lang.as_py(), tokens(text.as_py())
                of = memo.setdefault(lang, {})
                if len(of) > _KEPT or len(memo) > 100:
                    memo.clear()
                    of = memo.setdefault(lang, {})
                ids = list(map(of.get, found))
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = of[found[i]] = id_of(lang, found[i])
                # one end after each text
                held.append(np.array([*ids, END], np.int64))
                size += len(found) + 1
                if size > HELD_POINTERS:
                    yield from counted(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield from counted(np.concatenate(held))

    return _rows(docs).mapInArrow(run, ", ".join([*(f"{c} long" for c in names), "n int"]))


def grow(columns: list[np.ndarray], n: np.ndarray, least: int, depth: int = 1):
    """(depth, first pointer, sum) of each frequent extension, from sorted pointers that agree in no less than ``depth`` words in each prefix.

    A prefix's extensions are the runs of its pointers by the next word; the pointers of a frequent one are the projection that is extended next.
    """
    if depth == len(columns) or not len(n):
        return
    changes = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[: depth + 1]])
    starts = np.flatnonzero(np.concatenate([[True], changes]))
    sums = np.add.reduceat(n, starts)
    frequent = (sums >= least) & (columns[depth][starts] >= 0)
    if not frequent.any():
        return
    yield depth + 1, [c[starts[frequent]] for c in columns[: depth + 1]], sums[frequent]
    inside = np.repeat(frequent, np.diff(np.concatenate([starts, [len(n)]])))
    yield from grow([c[inside] for c in columns], n[inside], least, depth + 1)


def phrases(docs: DataFrame, known, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """w1 to w``most_words`` (hashes, null beyond the phrase's end) and f of each phrase of 2 words or more that occurs ``least`` times."""
    names = _names(most_words)

    def out(columns, n):
        for depth, ids, sums in grow(columns, n, least):
            if known is not None:
                ids = [known.value[x] for x in ids]
            none = pa.nulls(len(sums), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), *[none] * (most_words - depth), pa.array(sums)], [*names, "f"])

    def run(batches):
        columns, n = [np.empty(0, np.int64)] * most_words, np.empty(0, np.int64)
        for b in batches:
            columns = [np.concatenate([c, b.column(i).to_numpy()]) for i, c in enumerate(columns)]
            n = np.concatenate([n, b.column(most_words).to_numpy().astype(np.int64)])
            # the last prefix of two words may go on in the next batch
            changes = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            yield from out([c[:cut] for c in columns], n[:cut])
            columns, n = [c[cut:] for c in columns], n[cut:]
            if len(n) > 1:
                starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))
                columns, n = [c[starts] for c in columns], np.add.reduceat(n, starts)
        yield from out(columns, n)

    share = F.pmod("w2", F.lit(SHARES))
    sorted_ = pointers(docs, known, most_words).repartition(F.col("w1"), share).sortWithinPartitions(*names)
    return sorted_.mapInArrow(run, ", ".join([*(f"{c} long" for c in names), "f long"]))


def candidates(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """lang, words, f of every phrase of 1 to ``most_words`` words that occurs ``least`` times in its language, and n, the language's words."""
    counts = written(word_counts(docs))
    frequent = written(counts.where(F.col("f") >= least).withColumn("h", _hash_column()))
    known = None
    if frequent.count() <= broadcast_words:
        hashes = np.sort(frequent.select("h").toPandas()["h"].to_numpy(np.int64))
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two words have one hash")
        known = docs.sparkSession.sparkContext.broadcast(hashes)
    found = phrases(docs, known, least, most_words)
    names = _names(most_words)
    for i, c in enumerate(names):
        of = frequent.select(F.col("h").alias(c), F.col("word").alias(f"s{i}"), *([F.col("lang")] if i == 0 else []))
        found = found.join(of, c, "inner" if i < 2 else "left")
    many = found.select("lang", F.array_compact(F.array(*(f"s{i}" for i in range(most_words)))).alias("words"), "f")
    # hashes without a dictionary: a phrase that goes on with a rare word isn't frequent, so all its words are known
    every = written(many.unionByName(frequent.select("lang", F.array("word").alias("words"), "f")))
    totals = written(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    discard(counts, frequent)
    return every.join(totals, "lang")


def _hash_column():
    @F.pandas_udf("long")
    def of(lang, word):
        import pandas as pd

        return pd.Series([hash_of(a, b.encode()) for a, b in zip(lang, word)], dtype="int64")

    return of("lang", "word")


def _joined(words):
    return F.array_join(words, " ")


def scored(every: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of each phrase of 2 words or more in ``candidates``; the cut is the worst, the first of equals."""
    known = every.select("lang", _joined("words").alias("phrase"), F.col("f"))
    many = every.where("size(words) > 1").select("lang", _joined("words").alias("phrase"), "words", F.col("f").alias("a"), "n")
    cuts = many.select("*", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice("words", 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " "))
    part = lambda side, f: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    exact = "cast(cast(a as decimal(14,0)) * cast(a as decimal(14,0)) * cast(1000000 as decimal(7,0)) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0))) as bigint)"
    worst = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r", "words", "a", "n")).alias("cut")
    return cuts.groupBy("lang", "phrase").agg(worst).select("lang", "phrase", *(F.col(f"cut.{c}").alias(c) for c in ("words", "a", "l", "r", "n", "score")))


def maximal(rows: DataFrame, percent: int = 50) -> DataFrame:
    """``rows(lang, phrase, words, a)`` without those whose words lie together inside a longer row with ``percent`` of their occurrences."""
    size = F.size("words")
    spans = rows.where(size > 2).select("lang", "words", F.col("a").alias("longer"), F.explode(F.expr("sequence(2, size(words) - 1)")).alias("k"))
    inner = spans.select("lang", "longer", F.explode(F.expr("transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return rows.join(inner, ["lang", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {percent} * a")).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases."""
    rows = maximal(scored(candidates(docs, least, most_words, **how), most_words))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.select("lang", F.row_number().over(best).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return ranked.where(F.col("rank") <= top)


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: the first 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), '{}', '{}')".format(UPPER, LOWER)
SQL = f"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
    g as (select lang, 1 as k, unnest(w) as phrase from w union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
      union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w),
    f as materialized (select lang, k, phrase, lang || chr(9) || phrase as key, count(*) as f from g group by all), n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
    c as (select lang, k, phrase, f, string_split(phrase, ' ') as w from f where k > 1 and f >= {LEAST}),
    cut as (select lang, phrase, f, j, lang || chr(9) || array_to_string(w[1:j], ' ') as a, lang || chr(9) || array_to_string(w[j + 1:len(w)], ' ') as b from (select *, unnest(range(1, k)) as j from c)),
    part as (select cut.*, x.f as l, y.f as r, (1000000::hugeint * cut.f * cut.f) // (x.f::hugeint * y.f) as score from cut join f x on x.key = a join f y on y.key = b),
    worst as (select *, row_number() over (partition by lang, phrase order by score, j) as i from part),
    inside as (select lang, phrase, max(f) as longer from (select lang, f, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase from c where k = 3) group by all),
    kept as (select lang, phrase, worst.f as a, l, r, score from worst left join inside using (lang, phrase) where i = 1 and (longer is null or 100 * longer < 50 * worst.f)),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
    select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= {TOP}"""
