"""The Jaccard product, the resampling by tries and the collocations against brute-force versions, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from folioflow.llm import collocations, jaccard, resampling
from tests.llm.test_operators import ODD, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def edited_texts(n=260, seed=5):
    """Texts of 2 to 200 words, many of them edited copies of others, and groups that share common lines."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(r.choices(words, k=30))
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.55:
            w = r.choice(texts[-40:]).split(" ")
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.7:
            texts.append(line + " " + " ".join(r.choices(words, k=r.randrange(1, 8))))
        else:
            texts.append(" ".join(r.choices(words, k=r.choice([2, 3, 5, 20, 60, 200]))))
    return texts


# --- Jaccard product


def brute_sets(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_joined(rows, percent=85):
    """(doc_id, n_shingles, component_id, n_links) by comparing all pairs."""
    sets = [brute_sets(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            links[i], links[j] = links[i] + 1, links[j] + 1
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((rows[i][0], len(sets[i]), ids[find(i)], links[i]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize(("entries", "hot"), [(200, 1 << 20), (3000, 1), (1 << 20, 20)])
def test_jaccard_against_all_pairs(spark, entries, hot):
    rows = list(enumerate(edited_texts()))
    got = jaccard.joined(frame(spark, [(i, t, "en", "a", 0) for i, t in rows]).repartition(5), entries=entries, hot=hot)
    want = brute_joined(rows)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "n_links") == want
    assert sum(w[3] > 0 for w in want) > 60 and len({w[2] for w in want}) > 50


def test_jaccard_odd(spark):
    rows = [r[:2] for r in ODD if len(r[1] or "") < 1000]
    got = jaccard.joined(frame(spark, [r for r in ODD if len(r[1] or "") < 1000]))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "n_links") == brute_joined(rows)
    long = {r.doc_id: r for r in jaccard.joined(frame(spark)).collect()}
    assert long[7].component_id == long[8].component_id == 7 and long[7].n_links == 1
    assert jaccard.joined(frame(spark, [])).count() == 0
    assert jaccard.joined(frame(spark, [(None, None, None, None, None)] * 3)).collect() == [(None, 0, None, 0)] * 3


def test_jaccard_at_the_bound(spark):
    """Of 100 shingles, 91 shared gives 91 / 109 below, and 92 shared gives 92 / 108 at or above 85 %."""
    base = [f"a{i}" for i in range(103)]
    cases = {1: base, 2: base[:95] + [f"b{i}" for i in range(8)], 3: base[:94] + [f"c{i}" for i in range(9)]}
    rows = [(k, " ".join(w)) for k, w in cases.items()]
    got = rows_of(jaccard.joined(frame(spark, [(k, t, "en", "a", 0) for k, t in rows])), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == brute_joined(rows) and got[0][3] == 1


def test_jaccard_group_of_copies_and_edited_copies(spark):
    """Half of all rows are copies or edited copies of one text; their links are counted, not listed."""
    r = random.Random(2)
    base = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        if i % 2:
            w[r.randrange(len(w))] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"other text number {i} of its own") for i in range(100)]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    assert rows_of(jaccard.joined(docs, entries=4000), "doc_id", "n_shingles", "component_id", "n_links") == brute_joined(rows)


def test_prefixes_hold_every_linked_pair():
    for a in range(1, 80):
        for b in range(a, 80):
            shared = -(-85 * (a + b) // 185)  # the least overlap of a link
            if shared <= a:
                small, large, need = jaccard.prefixes(a)[1], jaccard.prefixes(b)[0], max(jaccard.prefixes(x)[2] for x in (a, b))
                # the fewest that two sorted sets can share at their starts: all that they don't share comes first
                assert min(small - (a - shared), large - (b - shared)) >= need


def test_shingle_sets():
    assert len(jaccard.shingle_set("a b c d a b c d a")) == 4 and len(jaccard.shingle_set(" A \t")) == 1 and not len(jaccard.shingle_set(None))
    assert (jaccard.shingle_set("Ab c") == jaccard.shingle_set("aB\nC")).all() and (jaccard.shingle_set("É x") != jaccard.shingle_set("é x")).all()


# --- resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute_drawn(rows, target):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text) with distinct ids."""
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for d, text in rows:
        w, f = features(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in map(bucket, f)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: len(fit) * 25 // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


NAMES = "doc_id", "n_features", "weight", "score", "rank"


def test_resampling_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["Tax", "law", "été", "x1", "court", "a-b", "fish", "日本"], k=r.randrange(0, 60)))) for i in range(300)]
    target = ["tax law court", "law of the court", None, ""]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows]).repartition(7)
    assert rows_of(resampling.resample(docs, benchmark), *NAMES) == brute_drawn(rows, target)


def test_tries_that_are_emptied_lose_nothing(spark, monkeypatch):
    docs = frame(spark, [(i, " ".join(f"w{(i * k) % 50}" for k in range(90)), "en", "a", 0) for i in range(60)])
    gain = [(i * 7919) % 2003 - 1000 for i in range(resampling.BUCKETS)]
    made = lambda: (rows_of(resampling.bucket_counts(docs), "bucket", "n"), rows_of(resampling.weighed(docs, gain), "doc_id", "weight"))
    whole = made()
    monkeypatch.setattr(resampling, "BATCH_WORDS", 100)
    monkeypatch.setattr(resampling, "KEPT_WORDS", 5)
    assert made() == whole


def test_trie_states_are_the_crc_of_the_run():
    texts = ["One two, THREE four", "", "one two", "é " + "x" * 200 + " y", "z"]
    found = [resampling.words(t) for t in texts]
    lexicon = resampling.Lexicon()
    word, doc = lexicon.numbers([w for f in found for w in f]), np.repeat(np.arange(len(texts)), [len(f) for f in found])
    flat = [w for f in found for w in f]
    for k, (state, node, place) in enumerate(resampling.trie(lexicon, word, doc, 4), 1):
        assert [int(state[n]) for n in node] == [zlib.crc32(b" ".join(flat[p : p + k])) for p in place]
        assert len(set(state.tolist())) == len(state) and len(place) == sum(max(0, len(f) - k + 1) for f in found)
    assert all(not len(place) for _, _, place in list(resampling.trie(lexicon, word[:0], doc[:0], 3)))


def test_resampling_odd(spark):
    target = spark.createDataFrame([(1, "word salad")], "item_id long, text string")
    got = resampling.resample(frame(spark), target).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r["rank"]} <= {7, 8} and all(r.weight == 0 for r in got if not r.n_features)
    assert resampling.resample(frame(spark, []), target).count() == 0
    without = resampling.resample(frame(spark), target.where("false")).collect()
    assert len(without) == len(ODD)


def test_repeated_rows_are_drawn_one_by_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(1, text, "en", "a", 0)] * 5000 + [(2, text, "en", "a", 0)] * 3 + [(3, "few words", "en", "a", 0)] * 4)
    got = resampling.resample(docs, docs.limit(1)).collect()
    assert len(got) == 5007 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 5003 * 25 // 100 + 1))
    assert all(r["rank"] is None for r in got if r.doc_id == 3)


# --- collocations


def brute_collocations(rows, least=10, top=2000, longest=3):
    per = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                per[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in per.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        held = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in held.items():
            score, k, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * c >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in held.items())
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out, key=repr)


PHRASE = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


def prose(n=150, seed=1):
    r = random.Random(seed)
    words = ["New", "york", "the", "the", "of", "É", "zebra", "a", "日本", "x_y"]
    made = [(r.choice(["en", "fr", None]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b", "  "]) for _ in range(r.randrange(0, 80)))) for _ in range(n)]
    return [*made, ("en", None), ("en", ""), (None, None), ("de", " . , ")]


@pytest.mark.parametrize(("longest", "words"), [(3, 1 << 20), (3, 0), (2, 1 << 20), (4, 1 << 20)])
def test_collocations_against_brute_force(spark, longest, words):
    rows = prose()
    docs = frame(spark, [(i, t, lang, "a", 0) for i, (lang, t) in enumerate(rows)]).repartition(5)
    got = rows_of(collocations.collocations(docs, most_words=longest, top=50, broadcast_words=words), *PHRASE)
    assert got == brute_collocations(rows, top=50, longest=longest) and len(got) > 60


def test_collocations_in_small_steps(spark, monkeypatch):
    """Counters and pointers that are sent early, and prefixes that go over many batches."""
    monkeypatch.setattr(collocations, "HELD_WORDS", 3)
    monkeypatch.setattr(collocations, "HELD_POINTERS", 40)
    rows = prose(80, 4)
    docs = frame(spark, [(i, t, lang, "a", 0) for i, (lang, t) in enumerate(rows)])
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows_of(collocations.collocations(docs), *PHRASE) == brute_collocations(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_collocation_scores_are_exact_beyond_64_bits(spark):
    every = spark.createDataFrame([("en", ["a"], 9_000_000_000_007, 1), ("en", ["b"], 9_000_000_000_011, 1), ("en", ["a", "b"], 8_999_999_999_999, 1)], "lang string, words array<string>, f long, n long")
    a, l, r = 8_999_999_999_999, 9_000_000_000_007, 9_000_000_000_011
    assert collocations.scored(every).first().score == 1_000_000 * a * a // (l * r)


def test_collocations_odd(spark):
    got = rows_of(collocations.collocations(frame(spark)), *PHRASE)
    assert got == brute_collocations([(r[2], r[1]) for r in ODD]) and [r[2] for r in got] == ["word salad"]
    assert collocations.collocations(frame(spark, [])).count() == 0
    text = "very same words " * 400
    one = collocations.collocations(frame(spark, [(1, text, "en", "a", 0)] * 30)).collect()
    assert rows_of(collocations.collocations(frame(spark, [(1, text, "en", "a", 0)] * 30)), *PHRASE) == brute_collocations([("en", text)] * 30) and one


def test_grow_keeps_only_projections_of_frequent_prefixes():
    columns = [np.array([1, 1, 1, 1, 2]), np.array([5, 5, 6, -1, 5]), np.array([7, 8, 7, -1, 7])]
    got = [(d, [c.tolist() for c in ids], s.tolist()) for d, ids, s in collocations.grow(columns, np.array([4, 6, 9, 50, 3]), 10)]
    assert got == [(2, [[1], [5]], [10])]
