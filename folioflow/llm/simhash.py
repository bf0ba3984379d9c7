"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance 2 or less have a bit string within one bit of
both. Each distinct fingerprint therefore emits itself and its 64 one-bit variants;
a shuffle on the variants brings together every linked pair. All members of one
variant's ball are within two bits of each other, so each is linked to the ball's
least member alone (checked by its Hamming distance), which keeps components whole
without all pairs of a group. A ball holds at most 65 distinct fingerprints, whatever
the number of documents, because equal fingerprints are merged before the shuffle.

Texts of a given similarity differ in more bits than a ball of 64-bit variants can reach.
``similar`` therefore hashes balls of several short fingerprints of a text's words and word pairs, drops pairs
whose fingerprints of all tables together are as far apart as those of unrelated texts
(``APART``; at a similarity of 0.8 some 7 % of the bits differ, of unrelated texts half),
and then verifies the others: the shared part of both texts' sets of word shingles, all of
them. A fingerprint's texts are compared to one of them, and the (at most ``TABLE_BITS + 1``)
fingerprints of a ball to one of these, chosen anew by a hash in every table and ball, so
a large group isn't expanded into pairs. Where that leaves texts of one ball in different
groups, these texts are compared by the blocked product of their sets of shingles (:mod:`folioflow.llm.jaccard`), which finds
all links among them without listing pairs, so no link of a ball is lost. Unrelated texts meet in a ball by chance, and the more texts there are, the more
of them do: their number grows with the square of the number of texts. So a text goes to the product only where it may be linked. In a ball with at most ``FEW``
texts outside its largest group, these are held against the ball's other groups by a bound that no linked pair passes: the bits in which the parities of two hashed sets differ
are at most as many as the shingles that only one of them has. The texts of any other ball are all compared.

Null and blank texts have fingerprint zero and are linked like any other. Repeated
rows share a fingerprint. A null ``doc_id`` is ignored as a component's least id; a
component with no other id has a null ``component_id``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm import jaccard
from folioflow.llm.common import discard, own, small_batches, table, written
from folioflow.llm.components import components

BITS = 64
RADIUS = 2
TABLES, TABLE_BITS, KEPT_WORDS = 5, 32, 1 << 16
#: Share of differing bits of all tables beyond which a pair of texts isn't read.
APART = 0.1875
#: Texts outside a ball's largest group up to which they are paired with the ball's others, to see whether they may be linked.
FEW = 8
#: Sets of shingles of up to this many hashes in all (1 MB) are broadcast to the pairs; larger ones are joined by shuffles, as a broadcast is held several times by the driver.
BROADCAST_HASHES = 1 << 17
#: The keys of up to this many texts (16 bytes each) are broadcast to find them; for more, all texts are shuffled.
BROADCAST_KEYS = 1 << 20
_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def simhash64(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[:n].tolist()
    ends = ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = slice(at, at + (1 << 15))
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[part], ends[part])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int):
    def run(batches):
        for b in batches:
            fps = np.array([simhash64(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(2)], ["doc_id", "fp", "text_key"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, text_key: the signed 64-bit fingerprint of each row of ``docs``, and a hash of its text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key"))
    return ids.mapInArrow(_fingerprint_batches(shingle), "doc_id long, fp long, text_key long")


def text_key():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def ball_edges(fps: DataFrame) -> DataFrame:
    """u, v with u > v: links between the distinct fingerprints ``fps(fp)`` that hold every component together."""
    variants = fps.select("fp", F.explode(F.expr(f"array_append(transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)), fp)")).alias("variant"))
    near = variants.select("fp", F.expr("min(fp) over (partition by variant)").alias("least"))
    return near.where(f"fp > least and bit_count(fp ^ least) <= {RADIUS}").select(F.col("fp").alias("u"), F.col("least").alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, text_key, root, component_id for each row of ``docs``; root: the group's least fingerprint."""
    small_batches(docs.sparkSession)
    rows = written(fingerprints(docs, shingle))
    least = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    edges = written(ball_edges(least.select("fp")))
    if edges.isEmpty():
        of = least.select("fp", F.col("fp").alias("root"), F.col("least_id").alias("component_id"))
    else:
        labels = components(edges)
        whole = written(labels.join(least, labels.node == least.fp).groupBy("root").agg(F.min("least_id").alias("component_id")))
        named = written(labels.join(whole, "root").select("node", "root", "component_id"))
        of = least.join(named, least.fp == named.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), F.expr("if(node is null, least_id, component_id)").alias("component_id"))
    return rows.join(written(of), "fp").select("doc_id", "fp", "text_key", "root", "component_id")


_BYTES = TABLES * TABLE_BITS // 8
_digests: dict[bytes, bytes] = {}


def _digest(gram: bytes) -> bytes:
    """A hashed bit for each bit of all tables' fingerprints."""
    return (xxhash.xxh3_128_digest(gram, 0) + xxhash.xxh3_128_digest(gram, 1))[:_BYTES]


def _word_digest(word: bytes) -> bytes:
    """As ``_digest``; those of short words are kept, up to a bound."""
    if (d := _digests.get(word)) is None:
        d = _digest(word)
        if len(word) <= 32:
            if len(_digests) >= KEPT_WORDS:
                _digests.clear()
            _digests[word] = d
    return d


def _bits_set(digests: list[bytes]) -> np.ndarray:
    """How many of the digests have each bit set."""
    count = np.zeros(8 * _BYTES, np.int64)
    for at in range(0, len(digests), 1 << 14):
        h = np.frombuffer(b"".join(digests[at : at + (1 << 14)]), np.uint8)
        count += np.unpackbits(h.reshape(-1, _BYTES), axis=1).sum(0, dtype=np.int64)
    return count


def table_fingerprints(text: str | None) -> list[int]:
    return sketch(text)[0]


def sketch(text: str | None, shingle: int = 5) -> tuple[list[int], np.ndarray]:
    """The text's fingerprints and the distinct hashes of its shingles, both from the words' digests.

    A fingerprint of ``TABLE_BITS`` bits for each of ``TABLES``, from the distinct words of a text, counted twice, and its distinct word pairs.

    Words alone would put texts of the same few words together, whatever their order; pairs alone would part texts of many small edits.
    """
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return [0] * TABLES, np.empty(0, np.uint64)
    single, pairs = {w: _word_digest(w) for w in set(words)}, {a + b" " + b for a, b in zip(words, words[1:])}
    count = 2 * _bits_set(list(single.values())) + _bits_set(list(map(_digest, pairs)))
    bits = (count * 2 > 2 * len(single) + len(pairs)).reshape(TABLES, TABLE_BITS)
    hashes = np.frombuffer(b"".join([single[w][:8] for w in words]), "<u8")
    return (bits @ (1 << np.arange(TABLE_BITS))).tolist(), jaccard.shingles_of(hashes, shingle)


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles; that of the whole text where it has fewer words; none for no words."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64, len(grams)).view(np.int64)


def parities(grams: np.ndarray) -> np.ndarray:
    """A bit for each of 64 buckets, or twice as many up to the number of shingles: whether an odd number of the set's shingles is in it."""
    size = 64 << max(0, (len(grams) - 1).bit_length() - 6)
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def _sketch_batches(shingle: int):
    """Adds the fingerprints, the number of shingles and their parities of the text, which is the last column, to the first two columns."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists, n, bits = [], [], []
                for t in part.column(2):
                    of, grams = sketch(t.as_py(), shingle)
                    lists.append(of)
                    n.append(len(grams))
                    bits.append(parities(grams))
                made = [pa.array(lists, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *made], ["doc_id", "text_key", "list", "n", "bits"])
        # later stages run in the same processes
        _digests.clear()

    return run


def _list_batches(of, keys: int):
    """Adds a list of longs, ``of`` the text that is the last column, to the first ``keys`` columns."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists = pa.array([of(t.as_py()) for t in part.column(keys)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:keys], lists], [*part.schema.names[:keys], "list"])

    return run


def text_seats(texts: DataFrame) -> DataFrame:
    """text_key, seat for ``texts(text_key, list)``: each fingerprint in ``list`` with its table's number above it."""
    return texts.select("text_key", F.posexplode("list").alias("t", "fp")).select("text_key", F.expr("shiftleft(cast(t as long), 40) | fp").alias("seat"))


def _in_balls(seats: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ball: each row of ``seats`` in all balls of its seat."""
    return seats.select(*keep, F.explode(F.expr(f"array_append(transform(sequence(0, {TABLE_BITS - 1}), i -> seat ^ shiftleft(1L, i)), seat)")).alias("ball"))


def crowded(seats: DataFrame) -> DataFrame:
    """ball, seat: the balls that seats of more than one fingerprint are in, with these seats; of two balls of the same two seats, one."""
    balls = _in_balls(seats.select("seat").distinct(), "seat")
    whole = Window.partitionBy("ball")
    ends = balls.select("ball", "seat", F.min("seat").over(whole).alias("low"), F.max("seat").over(whole).alias("high"), F.count("*").over(whole).alias("n"))
    # two seats share two balls; where one holds no others, the lesser is enough, or the one that does
    return ends.where("low < high and (n > 2 or ball < low ^ high ^ ball)").select("ball", "seat")


def candidate_links(seats: DataFrame, crowd: DataFrame) -> DataFrame:
    """u, v with u > v: the texts of ``seats(text_key, seat)`` with the heads of their seats, and these with the heads of their balls in ``crowd``."""
    heads = written(seats.groupBy("seat").agg(F.min_by("text_key", F.xxhash64("text_key", "seat")).alias("head"), F.count("*").alias("n")))
    within = seats.join(heads.where("n > 1").select("seat", "head"), "seat").select(F.col("text_key").alias("a"), F.col("head").alias("b"))
    top = F.first("head").over(Window.partitionBy("ball").orderBy(F.xxhash64("head", "ball"), "head"))
    between = crowd.join(heads.select("seat", "head"), "seat").select(F.col("head").alias("a"), top.alias("b"))
    return within.union(between).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def mixed_texts(seats: DataFrame, crowd: DataFrame, edges: DataFrame, may=None) -> DataFrame:
    """text_key: the texts in balls whose texts ``edges(u, v)`` leaves in different groups.

    With ``may``, a filter of pairs(u, v) that keeps all links: of balls with at most ``FEW`` texts outside their largest group, only the texts of pairs that it keeps.
    """
    if edges.isEmpty():
        rooted = seats.withColumn("root", F.col("text_key"))
    else:
        rooted = seats.join(components(edges), F.col("text_key") == F.col("node"), "left").select("text_key", "seat", F.coalesce("root", "text_key").alias("root"))
    rooted = written(rooted)
    # a seat that several texts have is a ball of its own; the ends of a ball's roots tell whether they differ
    ends = rooted.groupBy("seat", "root").agg(F.count("*").alias("n")).groupBy("seat")
    ends = written(ends.agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")))
    within = written(crowd.select("ball", "seat").union(ends.where("low < high").select(F.col("seat").alias("ball"), "seat")).distinct())
    per = within.join(ends, "seat").groupBy("ball", F.col("most.root").alias("root"))
    per = per.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("most.n").alias("most"))
    balls = per.groupBy("ball").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.max(F.struct("most", "root")).alias("most"))
    balls = written(within.join(balls.where("low < high").select("ball", F.col("most.root").alias("largest"), (F.col("n") - F.col("most.most")).alias("others")), "ball"))
    few = F.lit(False) if may is None else F.col("others") <= FEW
    texts = rooted.join(balls.where(~few).select("seat").distinct(), "seat", "left_semi").select("text_key").distinct()
    if may is None:
        return texts
    members = written(balls.where(few).select("ball", "seat", "largest").join(rooted, "seat").select("ball", "text_key", "root", "largest"))
    others = members.where("root <> largest").select("ball", F.col("text_key").alias("a"), F.col("root").alias("of_a"))
    pairs = others.join(members.select("ball", F.col("text_key").alias("b"), F.col("root").alias("of_b")), "ball").where("of_a <> of_b")
    pairs = written(may(written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())))
    return texts.union(pairs.select(F.col("u").alias("text_key"))).union(pairs.select(F.col("v").alias("text_key"))).distinct()


def may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(u, v)`` without those whose ``sketches(text_key, n, bits)`` rule out a Jaccard coefficient of ``percent`` hundredths."""
    of = lambda x: sketches.select(F.col("text_key").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    # the longer parities are folded to the shorter; further apart, sizes alone decide
    both = both.select("u", "v", (F.col("nu") + F.col("nv")).alias("n"), F.abs(F.col("nu") - F.col("nv")).alias("more"), F.expr("if(size(bu) > size(bv), bu, bv)").alias("x"), F.expr("if(size(bu) > size(bv), bv, bu)").alias("y"))
    bits = "aggregate({}, 0, (s, x) -> s + bit_count(x))".format
    apart = f"""case when size(x) = size(y) then {bits("zip_with(x, y, (p, q) -> p ^ q)")}
        when size(x) = 2 * size(y) then {bits("transform(y, (q, i) -> q ^ x[i] ^ x[i + size(y)])")} else 0 end"""
    return both.where(F.expr(f"{100 + percent} * greatest(more, {apart}) <= {100 - percent} * n")).select("u", "v")


def within_bits(pairs: DataFrame, lists: DataFrame, share: float) -> DataFrame:
    """The ``pairs(u, v)`` whose fingerprints of all tables in ``lists(text_key, list)`` together differ in at most ``share`` of their bits."""
    both = pairs.join(lists.select(F.col("text_key").alias("u"), F.col("list").alias("fu")), "u").join(lists.select(F.col("text_key").alias("v"), F.col("list").alias("fv")), "v")
    apart = "aggregate(zip_with(fu, fv, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return both.where(F.expr(f"{apart} <= {share * TABLE_BITS} * size(fu)")).select("u", "v")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose ``sets(text_key, list)`` have a Jaccard coefficient of ``similarity`` or more."""
    if (sets.agg(F.sum(F.size("list"))).first()[0] or 0) <= BROADCAST_HASHES:
        sets = F.broadcast(sets)
        pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = pairs.join(sets.select(F.col("text_key").alias("u"), F.col("list").alias("su")), "u").join(sets.select(F.col("text_key").alias("v"), F.col("list").alias("sv")), "v")
    shared = both.select("u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"), F.size(F.array_intersect("su", "sv")).alias("n"))
    return shared.where(F.expr(f"n >= {similarity} * (nu + nv - n)")).select("u", "v")


def all_links(seats: DataFrame, near, verify, compare, may=None) -> DataFrame:
    """u, v: verified links of texts that share a ball, which hold every group together.

    ``near`` and ``verify`` are filters of pairs(u, v): by all fingerprints of both texts, and by the texts; ``compare`` gives the links among texts(text_key); for ``may`` see ``mixed_texts``.
    """
    crowd = written(crowded(seats))
    first = written(verify(written(near(candidate_links(seats, crowd)))))
    mixed = written(mixed_texts(seats, crowd, first, may))
    return first if mixed.isEmpty() else written(first.union(compare(mixed)))


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, text_key, root, component_id for each row of ``docs``: groups of texts linked at ``similarity`` or more.

    Similarity is the Jaccard coefficient of the sets of ``shingle`` words. Equal texts are one; blank ones are alike.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    percent = round(100 * similarity)
    rows = written(texts.mapInArrow(_sketch_batches(shingle), "doc_id long, text_key long, list array<long>, n long, bits array<long>"))
    least = written(rows.groupBy("text_key").agg(F.min("doc_id").alias("least_id"), *(F.first(c).alias(c) for c in ("list", "n", "bits"))))
    seats = written(text_seats(least.select("text_key", "list")))

    def of(keys):
        """text_key and text of one row of each text in ``keys(text_key)``."""
        asked = written(least.join(keys, "text_key").select(F.col("least_id").alias("_id"), F.col("text_key").alias("_key")))
        # only these texts are moved: up to a number of them, their keys go to the texts
        few = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
        wanted = texts.join(few, (texts.text_key == F.col("_key")) & texts.doc_id.eqNullSafe(F.col("_id")), "left_semi")
        return wanted.select("doc_id", "text_key", "text")

    def verify(pairs):
        asked = pairs.select(F.col("u").alias("text_key")).union(pairs.select(F.col("v").alias("text_key"))).distinct()
        sets = of(asked).select("text_key", "text").mapInArrow(_list_batches(lambda t: shingle_hashes(t, shingle), 1), "text_key long, list array<long>")
        # written when rows of one text are one, so that a join with them can divide the many pairs of a head
        return verified(pairs, written(sets.groupBy("text_key").agg(F.first("list").alias("list"))), similarity)

    def compare(mixed):
        # read three times, so written once
        return jaccard.text_links(written(of(mixed).select("doc_id", "text")), shingle, percent)

    edges = all_links(seats, lambda pairs: within_bits(pairs, least, APART), verify, compare, lambda pairs: may_link(pairs, least, percent))
    ids = least.select("text_key", "least_id")
    if edges.isEmpty():
        return rows.select("doc_id", "text_key").join(ids.select("text_key", F.col("text_key").alias("root"), F.col("least_id").alias("component_id")), "text_key")
    of = ids.join(components(edges), F.col("text_key") == F.col("node"), "left").select("text_key", "least_id", F.coalesce("root", "text_key").alias("root"))
    of = written(of)
    whole = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(of.join(whole, "root").select("text_key", "root", "component_id"))
    return rows.select("doc_id", "text_key").join(named, "text_key")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document for each group of near-duplicates: that with the least id.

    Where several rows of the group have that id (or none has one), the least ``text_key`` decides; rows equal
    in id and text count as one document and one of them stays.
    """
    return _kept(docs, near_duplicates(docs, shingle))


def keep_one_similar(docs: DataFrame, **how) -> DataFrame:
    """As ``keep_one``, for the groups of ``similar``."""
    return _kept(docs, similar(docs, **how))


def _kept(docs: DataFrame, near: DataFrame) -> DataFrame:
    out = docs.select(own(docs), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key")).withColumn("row", F.xxhash64("doc_id", "key"))
    kept = near.where("doc_id <=> component_id").groupBy("root", "component_id").agg(F.min("text_key").alias("key"))
    kept = written(kept.select(F.xxhash64("component_id", "key").alias("row"), "key").distinct())
    out = out.join(kept, ["row", "key"], "left_semi")
    once = F.row_number().over(Window.partitionBy("row", "key").orderBy("row"))
    return out.withColumn("copy", once).where("copy = 1").select("own.*")


def op10_simhash_balls(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
