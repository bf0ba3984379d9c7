"""N-gram Jaccard join by a blocked sparse matrix product of documents and shingles.

The matrix has a row for each distinct set of word shingles and a column for each shingle. Rows are dealt to
blocks by size, of about ``ENTRIES`` entries each; a pair of blocks is one task, which multiplies its rows with each other:
every entry of a row adds one to the overlap of all rows that share its column. A pair of rows
whose overlap is below the bound that both sizes give is dropped there. So tasks return a row's
number of links and one link to its group's head, never pairs: what is shuffled grows with the
rows of a block, not with the square of a group of copies.

Sizes bound what is multiplied at all. Sets of ``a <= b`` shingles linked at similarity t share at least
``2t / (1 + t) * a`` and ``t * b`` shingles. In any one order of all shingles, therefore, the first
``a - 2t / (1 + t) * a + 1`` of the smaller set and the first ``b - t * b + 1`` of the larger have
one in common; where both blocks' sizes can be linked at all. A row goes to a pair of blocks only if it has such columns with the
other block in number: with ``MORE`` shingles on top of each of the two lengths, a linked pair has as many columns more in common, which unrelated
rows of a whole block hardly have by chance. The order puts shingles first that few documents have: it goes by the counts of ``BUCKETS`` hash buckets (a
broadcast of 2 MB at any size of the corpus) and within a bucket by hash. Any order gives the same links; this one keeps common passages out of the columns.

Shingles and sets are 64-bit hashes. A text of fewer words than a shingle is one shingle; a null or
blank text has no shingles, is linked with nothing and is its own component. Equal sets are one row
with a number of copies, each linked to the others. A null ``doc_id`` is ignored as a
component's least id; a component with no other id has a null ``component_id``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import discard, table, written
from folioflow.llm.components import components

SHINGLE, PERCENT = 4, 85
BUCKETS, ENTRIES, KEPT_WORDS, KEPT_KEYS = 1 << 18, 1 << 20, 1 << 17, 1 << 18
#: Columns of which fewer rows are known to have them are put together in one task each.
HOT = 1 << 20
#: Up to this many sets are broadcast to their texts with their blocks (some 100 bytes each); for more, up to the second number, the 8-byte hashes of
#: their texts are, so that only these texts are shuffled; beyond, all texts are.
BROADCAST_SETS, BROADCAST_TEXTS = 1 << 18, 1 << 20
#: The number and the share, in hundredths, by which the first shingles of a set are more than they must be for one in common.
MORE = (3, 8)
#: Sizes within this ratio are one band; a block holds whole bands, or a share of one.
BAND = 1.02
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_MIX, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """Hashes of words, kept up to a bound."""

    def __init__(self):
        self.of: dict[bytes, int] = {}
        self.hashes, self.n = np.empty(1 << 12, np.uint64), 0

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if self.n > KEPT_WORDS:
            self.__init__()
        new = list(set(words).difference(self.of))
        while self.n + len(new) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, self.hashes])
        self.hashes[self.n : self.n + len(new)] = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
        self.of.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)
        return self.hashes[np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))]


_word_hashes = Words()


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.empty(0, np.uint64)
    return shingles_of(_word_hashes(words), shingle)


def shingles_of(w: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles of a text's words, one or more, by the words' hashes; ascending."""
    k = min(shingle, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    h *= _LAST
    return np.unique(h ^ (h >> np.uint64(32)))


def set_key(grams: np.ndarray) -> int:
    """A signed hash of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).view(np.int64))


def _more(n, percent: int):
    """How much longer than for one shingle in common the shown parts of a set of ``n`` are; never falls as ``n`` rises."""
    return np.minimum((percent * n + 99) // 100 - 1, MORE[0] + MORE[1] * n // 100)


def prefixes(n, percent: int = PERCENT):
    """How many shingles, rarest first, a set of ``n`` shows as the larger and as the smaller of a linked pair, and how many of them it shares with any linked set."""
    least, more = (percent * n + 99) // 100, _more(n, percent)
    return np.minimum(n, n - least + 1 + more), np.minimum(n, n - (2 * percent * n + 99 + percent) // (100 + percent) + 1 + more), 1 + _more(least, percent)


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), F.col("text").cast("string").alias("text"))


def sets(docs: DataFrame, shingle: int = SHINGLE, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, text_key, n, key of each row: the size of its set and the set's hash; and, with these null, bucket, count: how many of a task's rows have shingles of a hash bucket."""
    names = ["doc_id", "text_key", "n", "key", "bucket", "count"]

    def run(batches):
        totals = np.zeros(buckets, np.int64)
        for b in batches:
            n, keys, held = [], [], []
            for text in b.column(2):
                grams = shingle_set(text.as_py(), shingle)
                n.append(len(grams))
                keys.append(set_key(grams))
                held.append(grams)
                if len(held) == 500 or len(grams) > 1 << 18:
                    totals += _bucketed(held, buckets)
                    held = []
            totals += _bucketed(held, buckets)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), none, none], names)
        used = np.flatnonzero(totals)
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], names)

    return _ids(docs).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _bucketed(held: list[np.ndarray], buckets: int) -> np.ndarray:
    grams = np.concatenate([np.empty(0, np.uint64), *held])
    return np.bincount((grams % np.uint64(buckets)).astype(np.int64), minlength=buckets)


def bucket_counts(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many rows have shingles of each bucket, each shingle counted once a row, from the counts in ``sets``."""
    of = counted.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[of["bucket"].to_numpy(np.int64)] = of["n"].to_numpy(np.int64)
    return out


def _counted(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts[(grams % np.uint64(len(counts))).astype(np.int64)]


def _rarest_first(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, _counted(grams, counts)))].view(np.int64)


def _band():
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(BAND))).cast("int")


def block_table(classes: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """band, first, parts, lo, hi: the blocks of each band of sizes, in order of size, and the sizes that they may hold.

    There are some 50 bands for each power of e, so the table has about a thousand rows at most.
    """
    spark = classes.sparkSession
    of = classes.where("n > 0").groupBy(_band().alias("band")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("entries")).toPandas().sort_values("band")
    groups, held = [], []
    for r in of.itertuples():
        if held and sum(x.entries for x in held) + r.entries > entries:
            groups.append(held)
            held = []
        held.append(r)
    groups, first, out = [*groups, held] if held else groups, 0, []
    for held in groups:
        parts = max(1, -(-int(sum(x.entries for x in held)) // entries))
        out += [(int(x.band), first, parts, int(held[0].lo), int(held[-1].hi)) for x in held]
        first += parts
    return spark.createDataFrame(out, "band int, first long, parts long, lo long, hi long")


def _with_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds block, lo and hi to ``rows(key, n)``."""
    out = rows.withColumn("band", _band()).join(F.broadcast(blocks), "band")
    return out.withColumn("block", F.col("first") + F.pmod(F.xxhash64("key"), "parts")).drop("band", "first", "parts")


def columns_of(docs: DataFrame, counts, shingle: int = SHINGLE, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """key, n, grams, rare: the shingles that a row shows, rarest first, and how many of them fewer than ``HOT`` rows have; of a task's copies of one set, one does."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            keys, n, shown, rare = [], [], [], []
            for text in b.column(0):
                grams = shingle_set(text.as_py(), shingle)
                key = set_key(grams)
                if len(grams) and key not in seen:
                    if len(seen) >= KEPT_KEYS:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    n.append(len(grams))
                    first = _rarest_first(grams, counts.value)[: prefixes(len(grams), percent)[0]]
                    shown.append(first)
                    rare.append(int(np.count_nonzero(_counted(first.view(np.uint64), counts.value) < hot)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(shown, pa.list_(pa.int64())), pa.array(rare, pa.int32())], ["key", "n", "grams", "rare"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long, grams array<long>, rare int")


def meetings(shown: DataFrame, blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """key, a, b with a <= b: the pairs of blocks in which each row of ``shown(key, n, grams)`` may have a link.

    A column is a list of its blocks, so its rows are never paired with each other.
    """
    least = f"(({percent} * n + 99) div 100)"
    more = lambda n: f"least(({percent} * {n} + 99) div 100 - 1, {MORE[0]} + {MORE[1]} * {n} div 100)"
    small = F.expr(f"if(pos < n - (2 * {percent} * n + 99 + {percent}) div (100 + {percent}) + 1 + {more('n')}, 1, 0)")
    need = F.expr(f"cast(1 + {more(least)} as int)")
    # a row's size and whether the shingle is among the first as the smaller one are one number; the block follows from it after the shuffle
    entries = shown.select("key", "n", "rare", F.posexplode("grams").alias("pos", "gram")).select("gram", "key", (F.col("n") * 2 + small).alias("sized"), (F.col("pos") < F.col("rare")).alias("rare"))
    with_block = lambda rows: _with_block(rows.select("gram", "key", F.expr("sized div 2").alias("n"), (F.col("sized") % 2 == 1).alias("small")), blocks).select("gram", "key", need.alias("need"), "block", "lo", "hi", "small")
    of = {"k0": F.min("key"), "k1": F.max("key"), "at": F.collect_set(F.struct("block", "lo", "hi", "small"))}
    column = Window.partitionBy("gram")
    rare = with_block(entries.where("rare").repartition("gram"))
    rare = rare.select("*", *(f.over(column).alias(n) for n, f in of.items()))
    # columns that many rows may have are merged in each task before they are shuffled, to two entries a block at most
    often = with_block(entries.where("not rare"))
    often = often.join(often.groupBy("gram").agg(*(f.alias(n) for n, f in of.items())), "gram").select(*rare.columns)
    there = f"""filter(at, x -> case when x.lo > hi then small and {percent} * x.lo <= 100 * hi when x.hi < lo then x.small and {percent} * lo <= 100 * x.hi else small or x.small end)"""
    met = rare.unionByName(often).where("k0 < k1 and exists(at, x -> x.small)")
    met = met.select("key", "need", F.col("block").alias("own"), F.explode(F.expr(f"array_distinct(transform({there}, x -> x.block))")).alias("other"))
    met = met.groupBy("key", "own", "other", "need").agg(F.count("*").alias("shared")).where("shared >= need")
    return met.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))


def product(keys: np.ndarray, n: np.ndarray, copies: np.ndarray, block: np.ndarray, grams: list[np.ndarray], percent: int = PERCENT):
    """(places of linked rows, their links, the places of their groups' heads) among the rows of two blocks, or of one.

    ``grams`` are in the common order. Of two blocks, only pairs of rows of both count.
    """
    order = np.lexsort((keys, n))
    n, copies, block, grams = n[order], copies[order], block[order], [grams[i] for i in order]
    m, both = len(n), len(np.unique(block)) > 1
    starts = np.concatenate([[0], np.cumsum(n)])
    _, column = np.unique(np.concatenate(grams), return_inverse=True)
    row, place = np.repeat(np.arange(m), n), np.arange(starts[-1]) - np.repeat(starts[:-1], n)
    large, small, need = prefixes(n, percent)

    def by_column(rows, cols):
        sort = np.argsort(cols, kind="stable")
        return rows[sort], np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=column.max() + 1))])

    every, every_at = by_column(row, column)
    early = place < np.repeat(small, n)
    shown, shown_at = by_column(row[early], column[early])

    def in_columns(cols, rows, at):
        """The rows of all ``cols``, one after the other."""
        lens = at[cols + 1] - at[cols]
        return rows[np.repeat(at[cols] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]

    links, head = np.zeros(m, np.int64), np.arange(m)
    least = np.searchsorted(n, -(-percent * n // 100))
    for v in range(1, m):
        mine = column[starts[v] : starts[v + 1]]
        near = in_columns(mine[: large[v]], shown, shown_at)
        near = near[(near >= least[v]) & (near < v)]
        if both:
            near = near[block[near] != block[v]]
        if len(near) < need[v] or np.bincount(near).max() < need[v]:
            continue
        overlap = np.bincount(in_columns(mine, every, every_at), minlength=m)[least[v] : v]
        hit = 100 * overlap >= percent * (n[least[v] : v] + n[v] - overlap)
        if both:
            hit &= block[least[v] : v] != block[v]
        u = np.flatnonzero(hit) + least[v]
        if len(u):
            links[u] += copies[v]
            links[v] += copies[u].sum()
            heads = np.unique(np.append(head[u], head[v]))
            if len(heads) > 1:
                head[np.isin(head, heads)] = heads[0]
    linked = np.flatnonzero(links)
    return order[linked], links[linked], order[head[linked]]


def _linked(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        keys, first = np.unique(rows["key"].to_numpy(), return_index=True)
        column = lambda c: rows[c].to_numpy()[first]
        # equal rows of one set are read again from each of its copies with the same id and text
        held = rows["grams"].combine_chunks()
        flat, ends = held.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(held).to_numpy())])
        at, links, head = product(keys, column("n"), column("copies"), column("block"), [flat[ends[i] : ends[i + 1]] for i in first], percent)
        return pa.table({"key": pa.array(keys[at], pa.int64()), "links": pa.array(links, pa.int64()), "head": pa.array(keys[head], pa.int64())})

    return run


def links(docs: DataFrame, classes: DataFrame, counts: np.ndarray, shingle: int = SHINGLE, percent: int = PERCENT, entries: int = ENTRIES, hot: int = HOT) -> DataFrame:
    """key, links, head: for each pair of blocks, the sets with links there, with their number and a set of the same group."""
    sc = docs.sparkSession.sparkContext
    blocks = block_table(classes, entries)
    counts = sc.broadcast(counts)
    shown = written(columns_of(docs, counts, shingle, percent, hot))
    met = written(meetings(shown, blocks, percent))
    discard(shown)
    asked = met.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("pairs")).join(_with_block(classes, blocks), "key")
    asked = written(asked.select(F.col("key").alias("_key"), "pairs", "block", "copies", F.col("rep.doc_id").alias("_id"), F.col("rep.text_key").alias("_text_key")))
    texts, many = _ids(docs), asked.count()
    if BROADCAST_SETS < many <= BROADCAST_TEXTS:
        # the other texts aren't shuffled
        texts = texts.join(F.broadcast(asked.select(F.col("_text_key").alias("text_key")).distinct()), "text_key", "left_semi")
    texts = texts.join(F.broadcast(asked) if many <= BROADCAST_SETS else asked, (F.col("text_key") == F.col("_text_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("_key", "block", "copies", "pairs", "text")

    def read(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                keep, n, ordered = [], [], []
                for i, (key, text) in enumerate(zip(part.column(0).to_pylist(), part.column(4))):
                    grams = shingle_set(text.as_py(), shingle)
                    if set_key(grams) == key:
                        keep.append(i)
                        n.append(len(grams))
                        ordered.append(_rarest_first(grams, counts.value))
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(ordered, pa.list_(pa.int64()))], ["key", "block", "copies", "pairs", "n", "grams"])

    rows = texts.mapInArrow(read, "key long, block long, copies long, pairs array<struct<a: long, b: long>>, n long, grams array<long>")
    dealt = rows.select("key", "block", "copies", "n", "grams", F.inline("pairs"))
    out = written(dealt.groupBy("a", "b").applyInArrow(_linked(percent), "key long, links long, head long"))
    discard(met, asked)
    return out


def _classes(counted: DataFrame) -> DataFrame:
    """key, n, least_id, copies and rep (an id and text) of each set in ``sets``."""
    rows = counted.where("bucket is null").groupBy("key").agg(F.first("n").alias("n"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("rep"))
    return written(rows).where("n > 0")


def text_links(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """u, v with u > v: links between the texts of ``docs(doc_id, text)``, by their hashes, which hold every group of linked texts together."""
    counted = written(sets(docs, shingle))
    classes = _classes(counted)
    found = links(docs, classes, bucket_counts(counted), shingle, percent)
    rep = classes.select("key", F.col("rep.text_key").alias("text_key"))
    # texts of one set, and sets that are linked
    same = counted.where("n > 0").select("key", F.col("text_key").alias("a")).join(rep, "key").select("a", F.col("text_key").alias("b"))
    linked = found.select("key", "head").join(rep.withColumnRenamed("text_key", "a"), "key").join(rep.select(F.col("key").alias("head"), F.col("text_key").alias("b")), "head").select("a", "b")
    return same.union(linked).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def joined(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, entries: int = ENTRIES, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of ``docs``: documents are linked at a Jaccard similarity of ``percent`` or more."""
    counted = written(sets(docs, shingle))
    rows = counted.where("bucket is null").select("doc_id", "text_key", "n", "key")
    classes = _classes(counted)
    found = links(docs, classes, bucket_counts(counted), shingle, percent, entries, hot)
    named = classes.select("key", "least_id", "copies")
    per = found.groupBy("key").agg(F.sum("links").alias("links"))
    edges = written(found.where("key <> head").select(F.greatest("key", "head").alias("u"), F.least("key", "head").alias("v")).distinct())
    named = named.join(per, "key", "left")
    if edges.isEmpty():
        named = named.withColumn("component_id", F.col("least_id"))
    else:
        # sets whose links are all with their head appear in an edge, too: each linked set has a head or is one
        named = written(named.join(components(edges).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
        named = named.join(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "root")
    named = written(named.select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.where("n > 0").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(empty)


def op11_jaccard_product(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of all documents."""
    return joined(table(spark, sf_dir, "documents"))


SQL = f"""with recursive d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select k, doc_id, case when len(w) = 0 then [] when len(w) < {SHINGLE} then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) end as g from d),
    e as (select k, len(g) as n, unnest(g) as g from s), p as (select a.k as u, b.k as v from e a join e b using (g) where a.k <> b.k group by a.k, b.k, a.n, b.n having 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
    r as (select k, k as m from s union select r.k, p.v from r join p on p.u = r.m)
    select s.doc_id, len(g) as n_shingles, c.component_id, coalesce(l.n, 0) as n_links from s join (select r.k, min(t.doc_id) as component_id from r join s t on t.k = r.m group by r.k) c using (k) left join (select u as k, count(*) as n from p group by u) l using (k)"""
