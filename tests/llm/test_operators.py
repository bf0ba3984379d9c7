"""Each operator against a brute-force version on small tables, and on odd ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import common, hmm, licenses, linededup, media, mixing, pieces, queries, simhash, toxicity, urlfilter, winnowing
from tests.conftest import DATA
from tests.same import agrees

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = f"{DATA}/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
LONG = "word salad, " * 30_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, "one", None, None, 3), (None, "no id here", "en", "b", 9), (None, None, None, None, None),
    (5, "a\nb\nc\nd", "en", "a", 7), (6, "x\n\na\nb\nc\n", "en", "b", 9), (7, LONG, "en", "c", len(LONG)), (8, LONG, "en", "c", len(LONG)), (9, "é日本🙂 ▁ \x00\ttab", "fr", "b", 9), (10, " \n\t ", "en", "a", 4),
]
EXTRA = ["fp", "row", "key", "own", "score", "copy", "range", "gone", "word", "symbols"]


def frame(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit(1).alias(c) for c in EXTRA)) if extra else df


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def tokens(text):
    return WORDS.findall((text or "").encode().lower())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    agrees(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL)


# --- license digests ---


def test_licenses(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    full = licenses.KNOWN[0][1]
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + full.upper(), "", "", 0), (2, full.replace(".", " !").replace("license", "licence"), "", "", 0), (3, full + " and more", "", "", 0),
        (4, "text\nReleased under the MIT licence\nCC", "", "", 0), (5, "© 2001 B\nAll rights reserved.\n" + full, "", "", 0),
    ]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows), licenses.known_digests(spark)).collect()}
    assert mit and [got[i].license for i in range(1, 6)] == ["MIT", "MIT", None, None, "MIT"]
    assert got[4].notices == "MIT"


def test_long_licenses_are_known_by_their_digests(spark):
    import os

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    rows = []
    for i, name in enumerate(["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0"]):
        text = open(f"{folder}/{name}", encoding="utf-8").read()
        rows += [(2 * i, text.upper().replace(",", " ;"), "", "", 0), (2 * i + 1, text[:-900], "", "", 0)]
    got = {r.doc_id: r.license for r in licenses.scan(frame(spark, rows), licenses.known_digests(spark)).collect()}
    assert [got[2 * i] for i in range(5)] == ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"] and not any(got[2 * i + 1] for i in range(5))


def test_spellings_across_spaces_and_hyphens(spark):
    rows = [f"the {x}COPYRIGHT{y}OWNER took 5 per{y}cent of sub-licensed, non{z}commercial work at https://a.b" for x in ("", " ") for y in (" ", "\n", "  ", "-") for z in ("", "-", "\n")]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    assert df.select(licenses.digest(F.col("text")).alias("d")).distinct().count() == 1


def test_rewrapped_licenses_keep_their_digests(spark):
    import os
    import textwrap

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    notice = re.compile(licenses.COPYRIGHT)
    rows = []
    for name in sorted({os.path.realpath(f"{folder}/{x}") for x in os.listdir(folder)}):
        text = open(name, encoding="utf-8").read()
        rows.append((name, 0, text))
        for width in (60, 72, 80, 100):
            # a paragraph with a copyright notice stays as it is: a notice ends at its line's end
            parts = [p if notice.search(p.lower()) else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n")]
            rows.append((name, width, "\n\n".join(parts)))
    got = spark.createDataFrame(rows, "name string, width int, text string").select("name", licenses.digest(F.col("text")).alias("d")).distinct()
    assert got.count() == got.select("name").distinct().count() >= 13


def test_licenses_odd(spark, odd, none):
    known = licenses.known_digests(spark)
    got = licenses.scan(odd, known).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(ODD) and {r.digest for r in got if r.doc_id in (1, 2, 10)} == {empty}
    assert licenses.scan(none, known).count() == 0


# --- media ---


def test_media_contract(spark, odd, none):
    def run(df):
        return media.sniff(media.store(df)).mapInArrow(media._digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

    want = Counter()
    for i, t, *_ in ODD:
        data = (t or "").encode()
        payload = media.payload_of(data)
        assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == data.rstrip(b"\0")
        want[i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    got = run(odd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (3, 4)}) == 1
    assert run(none).count() == 0


def test_media_sniffing():
    find, x = media.automaton(), bytes(range(256))
    for kind, write in media.WRITERS.items():
        blob = b"BM RIFF .snd" + write(x) + b"\x89PNG\r\n\x1a\n" + write(x[:64])
        assert [(k, len(s)) for k, _, _, s in media.regions(blob, find)] == [(kind, 256), (kind, 64)]
        assert media.regions(write(x)[:-1], find) == []
    broken = bytearray(media.write_png(x))
    broken[40] ^= 1
    assert media.regions(bytes(broken), find) == []


def png(width, rows, color, filters, interlace=0):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = width.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, color, 0, 0, interlace])
    return media.MAGIC["image/png"] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(bytes([f]) + r for f, r in zip(filters, rows)))) + chunk(b"IEND", b"")


def test_media_of_any_conforming_file():
    import io
    import zipfile

    find, n4 = media.automaton(), lambda n: n.to_bytes(4, "little")
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a.txt", "text")
    wav = b"RIFF" + n4(44) + b"WAVEfmt " + n4(16) + bytes([1, 0, 2, 0]) + n4(8000) + n4(32000) + bytes([4, 0, 16, 0]) + b"data" + n4(8) + bytes(8)
    bmp = b"BM" + n4(54 + 24) + bytes(4) + n4(54) + n4(40) + n4(3) + n4(2) + bytes([1, 0, 24, 0]) + bytes(24) + bytes(24)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04JF\xff\xc0\x00\x04ab\xff\xda\x00\x04cd12\xff\x003\xff\xd04\xff\xd9"
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"\x21\xf9\x04abcd\x00" + b"\x2c" + bytes(9) + b"\x02\x02xy\x00\x3b"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
    mp3 = (b"\xff\xfb\x90\x00" + bytes(413)) * 3
    ogg = b"".join(b"OggS\x00" + bytes([f]) + bytes(20) + b"\x01\x03abc" for f in (2, 0, 4))
    webp = b"RIFF" + n4(16) + b"WEBPVP8L" + n4(4) + b"abcd"
    rgb = png(2, [bytes(range(6)), bytes(range(6, 12))], 2, [0, 4])
    for kind, blob in (
        ("application/zip", zipped.getvalue()), ("audio/wav", wav), ("image/bmp", bmp), ("image/jpeg", jpeg), ("image/gif", gif), ("application/pdf", pdf), ("audio/mpeg", mp3), ("audio/mpeg", b"ID3\x03\x00\x00\x00\x00\x00\x05abcde" + mp3),
        ("audio/ogg", ogg), ("image/webp", webp), ("image/png", rgb),
    ):
        for before, after in ((b"", b""), (b"GIF89a BM PK\x03\x04 .snd", b" tail")):
            assert media.regions(before + blob + after, find) == [(kind, len(before), len(blob), None)], kind
        assert media.regions(blob[:-1], find) == [], kind
    flac = b"fLaC\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8frames"
    assert media.regions(b"x" + flac, find) == [("audio/flac", 1, len(flac), None)] and media.regions(b"fLaC" + bytes(60), find) == []


def test_png_filters():
    rng = np.random.default_rng(3)
    want = rng.integers(0, 256, (6, 9), dtype=np.uint8)
    rows, filters = [], [0, 1, 2, 3, 4, 4]
    for k, f in enumerate(filters):
        x, up = want[k].astype(int), want[k - 1].astype(int) if k else np.zeros(9, int)
        left, corner = np.concatenate([[0], x[:-1]]), np.concatenate([[0], up[:-1]])
        near = left + up - corner
        paeth = [min((a, b, c), key=lambda v, p=p: abs(v - p)) for a, b, c, p in zip(left, up, corner, near)]
        rows.append((x - [0 * x, left, up, (left + up) // 2, np.array(paeth)][f]).astype(np.uint8).tobytes())
    assert media.regions(png(9, rows, 0, filters), media.automaton())[0][3] == want.tobytes()


def test_media_features_and_types_against_brute_force(spark, docs):
    rows = docs.limit(40).collect()
    frame_ = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in media.sniff(media.store(frame_)).mapInArrow(media._digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()}
    seen = set()
    for r in rows:
        data = (r.text or "").encode()
        x = list(media.payload_of(data))
        pick = zlib.crc32(data)
        kind, form = media.TYPES[pick % 4], (pick >> 8) % 3
        declared = media.OPAQUE if form == 2 else kind if form == 0 else media.TYPES[(pick + 1) % 4]
        blob = media.stored(r.text)[2]
        inside = f"{media.OPAQUE} holds {kind}@8+{len(blob) - 12}" if form == 2 else kind
        counts = Counter(x).values()
        mean, power = sum(x) / len(x), sum((v - 128) ** 2 for v in x) / len(x)
        entropy = -sum(c / len(x) * math.log2(c / len(x)) for c in counts)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))
        assert got[r.doc_id].feature == f"{declared} is {inside} mean={mean:.3f} rms={math.sqrt(power):.3f} crossings={crossings} entropy={entropy + 0.0:.4f}"
        assert got[r.doc_id].media_sha256 == hashlib.sha256(blob).hexdigest() and got[r.doc_id].media_bytes == len(blob)
        seen.add((kind, form))
    assert len(seen) > 8


# --- hidden Markov model ---


def test_forward_matches_enumeration():
    rng = np.random.default_rng(0)
    start, trans, emit = rng.dirichlet([1, 1]), rng.dirichlet([1, 1], 2), rng.dirichlet([1, 1, 1], 2).T
    seqs = [rng.integers(0, 3, n) for n in (1, 4, 2, 6)]

    def paths(s):
        total = 0.0
        for code in range(2 ** len(s)):
            z = [code >> t & 1 for t in range(len(s))]
            p = start[z[0]] * emit[s[0], z[0]]
            for a, b, o in zip(z, z[1:], s[1:]):
                p *= trans[a, b] * emit[o, b]
            total += p
        return math.log10(total)

    assert np.allclose(hmm.forward(hmm.Batch(seqs), start, trans, emit), [paths(s) for s in seqs])
    first, pairs, by = hmm.expected(hmm.Batch(seqs), start, trans, emit)
    assert np.isclose(first.sum(), 4) and np.isclose(pairs.sum(), sum(map(len, seqs)) - 4, rtol=1e-4) and np.allclose(by.sum(1), np.bincount(np.concatenate(seqs), minlength=3), rtol=1e-4)


def check_scores(rows, got):
    train = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            train.update([*tokens(t), None])
    n, v = sum(train.values()), len(train)
    want = sorted(((i is None, i or 0, len(tokens(t)) + 1, sum(train[w] > 0 for w in [*tokens(t), None]), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in [*tokens(t), None]), 6)) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_hmm_scores(spark, docs):
    held = common.crc_of_id() % 7 == 2
    got = hmm.score_texts(docs, held, top=500).collect()
    check_scores([(r.doc_id, r.text) for r in docs.collect()], got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_hmm_odd(spark, odd, none):
    held = common.crc_of_id() % 7 == 2
    check_scores(ODD, hmm.score_texts(odd, held).collect())
    assert hmm.score_texts(none, held).count() == 0
    assert all(r.n_known == 0 for r in hmm.score_texts(odd, F.lit(True)).collect())


def test_hmm_starts_from_distinct_texts_and_trains_until_settled(spark):
    rng = np.random.default_rng(5)
    texts = [np.where(np.arange(30) % 2, rng.integers(1, 10, 30), rng.integers(10, 20, 30)).astype("<u2").tobytes() for _ in range(50)]
    train = spark.createDataFrame([(t,) for t in [texts[0]] * 500 + texts], "symbols binary")
    assert {s.tobytes() for s in hmm.start_texts(train, 40)} <= set(texts) and len(hmm.start_texts(train, 40)) == 40
    share = np.full(20, 0.05)
    _, found = hmm.baum_welch(train, hmm.begin(2, share, 1), share, 0.002)
    gains = np.diff(found)
    assert len(found) > 2 and (gains[:-1] >= 0.002).all() and gains[-1] < 0.002


def test_hmm_emissions_sum_to_one():
    emit = hmm.begin(3, np.full(20, 0.05), 1)[2]
    assert np.allclose(emit.sum(0), 1)


def test_hmm_score_against_brute_force(spark):
    """The score of a text is its words' share of their classes times the sum over all paths of states, by a plain forward recursion."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice("the of a cat dog runs sleeps rare1 rare2 odd".split()) for _ in range(rng.randrange(0, 12))) for _ in range(40)] + ["unseen words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 7 == 2
    how = {"states": 3, "top": 6, "classes": 4}
    seen = {}
    train = hmm.baum_welch

    def watched(*a):
        seen["model"] = train(*a)
        return seen["model"]

    hmm.baum_welch = watched
    try:
        got = {r.doc_id: r.score for r in hmm.score_texts(docs, held, **how).collect()}
    finally:
        hmm.baum_welch = train
    start, trans, emit = seen["model"][0]
    words = Counter(w for i, t in enumerate(texts) if i % 7 != 2 for w in t.split())
    left, least = 6, math.inf
    for c in sorted(set(words.values()), reverse=True):
        n = sum(v == c for v in words.values())
        if n > left:
            break
        left, least = left - n, c
    frequent = sorted((w for w in words if words[w] >= least), key=lambda w: (-words[w], w))
    place = lambda w: zlib.crc32(w.encode()[-3:]) % 4
    rest = Counter()
    for w, c in words.items():
        if w not in frequent:
            rest[place(w)] += c + 1
    for i, t in enumerate(texts):
        logp, p = 0.0, np.array(start)
        for k, w in enumerate([*t.split(), None]):
            if k:
                p = p @ trans
            symbol = 0 if w is None else 1 + frequent.index(w) if w in frequent else 1 + len(frequent) + place(w)
            p = p * emit[symbol]
            if w is not None and w not in frequent:
                logp += math.log10((words[w] + 1) / (rest[place(w)] + 1))
        assert math.isclose(got[i], logp + math.log10(p.sum()), rel_tol=1e-6, abs_tol=1e-6), t


# --- line windows ---


def brute_lines(rows):
    seen, out = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for a in range(len(full) - 2):
            w, p0, p2 = tuple(lines[k].strip(" \t\r") for k in full[a : a + 3]), full[a], full[a + 2]
            if w not in seen:
                seen[w] = (i, p2)
            else:
                gone.update(range(seen[w][1] + 1 if seen[w][0] == i and p0 <= seen[w][1] else p0, p2 + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_windows(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    got = linededup.dedup_lines(frame(spark, [(i, t, "en", "a", len(t)) for i, t in rows])).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows)
    assert all(r.n_chars == len(r.text) and r.score == 1 for r in got)


def test_line_windows_odd(spark, odd, none):
    got = linededup.dedup_lines(odd).collect()
    assert len(got) == len(ODD) and {r.text for r in got if r.doc_id == 6} == {"x\n\n"} and {r.text for r in got if r.doc_id == 1} == {None}
    assert linededup.dedup_lines(none).count() == 0


# --- toxicity ---


def test_toxicity_learns(spark):
    docs, marks = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    got = toxicity.score(docs, marks).where("held_out").join(marks, "doc_id").collect()
    hit = sum(r.score >= 0.5 and r.toxic == 1 for r in got)
    assert hit / sum(r.toxic for r in got) > 0.8 and hit / sum(r.score >= 0.5 for r in got) > 0.9


def test_toxicity_odd(spark, odd, none):
    some = [(1, 1, 1), (2, 1, 0), (3, 0, 1), (4, 1, 0), (5, 1, None), (None, 1, 1), (8, 1, 0), (9, 1, 1), (9, 1, 0)]
    got = toxicity.score(odd, labels(spark, some)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert {r.score for r in toxicity.score(odd, labels(spark)).collect()} == {0.0}
    assert toxicity.score(none, labels(spark, some)).count() == 0
    kept = toxicity.keep_clean(odd, labels(spark))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_toxicity_forward_and_gradient_against_brute_force():
    rng = np.random.default_rng(2)
    m = toxicity.Model()
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 2, 7, 30)]

    def logit(t):
        one, two = toxicity.rows_of(t) if len(t) else (np.zeros(1, int), np.zeros(1, int))
        x = np.concatenate([np.concatenate([m.e[0][one], m.e[1][two]], 1), np.zeros((2, 2 * toxicity.HALF), np.float32)])
        out = float(m.b)
        for k, (w, c) in enumerate(zip(m.w, m.c)):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(x[p + j] @ w[j][:, f]) for j in range(len(w))) + float(c[f]) for p in range(max(1, len(t))))
                out += max(best, 0.0) * float(m.v[k * toxicity.FILTERS + f])
        return out

    assert np.allclose(m.logits(texts), [logit(t) for t in texts], atol=1e-5)
    assert np.allclose(m.logits(texts, most=3), m.logits(texts), atol=1e-6)
    # a fit lowers the loss that it descends
    y = np.array([0, 1, 0, 1, 1], np.float32)
    loss = lambda model: float(np.mean(np.log1p(np.exp(-np.where(y > 0, 1, -1) * model.logits(texts)))))
    assert loss(toxicity.fit(texts, y, epochs=20)) < 0.2 * loss(m)


def test_toxicity_is_a_function_of_the_text(spark):
    rows = [(i, f"text {i % 4} " + "idiot " * (i % 2), "en", "s", 1) for i in range(200)]
    marks = labels(spark, [(i, 1, i % 2) for i in range(200)])
    got = toxicity.score(frame(spark, rows), marks).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id % 4].add(r.score)
    assert all(len(x) == 1 for x in by.values()) and all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_toxicity_reads_all_labelled_rows(spark, monkeypatch):
    # a word of toxic texts is in so few of them that a sample misses some words
    rows = [(i, f"say mark{i // 24}x now" if i % 2 else f"say plain{i // 24}x now", "en", "s", 1) for i in range(12_000)]
    left = [zlib.crc32(str(i).encode()) % 5 for i in range(12_000)]
    seen = {}
    for name in ("set_log_odds", "calibrate"):
        monkeypatch.setattr(toxicity, name, lambda model, *a, name=name, f=getattr(toxicity, name): (seen.__setitem__(name, a), f(model, *a)))
    got = toxicity.score(frame(spark, rows + rows[:50]), labels(spark, [(i, 1, i % 2) for i in range(12_000)])).where("held_out").collect()
    df, n = seen["set_log_odds"]
    assert n.tolist() == [sum(k > 1 and i % 2 == y for i, k in enumerate(left)) for y in (0, 1)]
    say = toxicity.rows_of(toxicity.hashes("say", {}))
    assert all(df[k, say[k][0]].tolist() == n.tolist() for k in range(2))
    assert seen["calibrate"][0][:, 2:].sum(0).tolist() == [sum(k == 1 and i % 2 == y for i, k in enumerate(left)) for y in (0, 1)]
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got) > 0.99 * len(got)


def test_toxicity_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TEXTS", 40)
    docs, marks = frame(spark, [(i, f"word{i % 7} other{i % 11}", "en", "s", 1) for i in range(400)]), labels(spark, [(i, 1, int(i % 7 == 3)) for i in range(400)])
    one, two = (toxicity.train(d, marks) for d in (docs.coalesce(1), docs.repartition(5)))
    assert all((a == b).all() for a, b in zip([one.e, one.thresholds, *one.small()], [two.e, two.thresholds, *two.small()]))


# --- mixing ---


def brute_targets(sizes, cap=3):
    weight, out, free, left = [i % 3 + 1 for i in range(len(sizes))], [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > cap * sizes[i]]
        for i in over or free:
            out[i] = float(cap * sizes[i]) if over else left * weight[i] / total
        free -= set(over or free)
        left -= sum(out[i] for i in over)
    return out


def test_targets_are_reshared(spark):
    rng = random.Random(4)
    for sizes in ([10, 1000, 1000], [0, 0], [5], [rng.randrange(0, 2000) for _ in range(40)], [1, 1, 100_000, 2, 3, 70]):
        per = spark.createDataFrame([(f"s{i:02d}" if i + 1 < len(sizes) else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(per).collect()}
        assert all(math.isclose(got[f"s{i:02d}" if i + 1 < len(sizes) else None], t, rel_tol=1e-9, abs_tol=1e-9) for i, t in enumerate(brute_targets(sizes)))
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).count() == 0


def test_last_residuals_keep_their_probability(spark):
    docs = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 30, "b")], "doc_id long, text string, source string")
    copies = [{r.doc_id: r.copies for r in mixing.mix(docs, seed=s).collect()} for s in range(6)]
    assert len({tuple(sorted(c.items())) for c in copies}) > 1 and {c[1] for c in copies} <= {1, 2} and {c[2] for c in copies} <= {0, 1}


def test_duel_keeps_the_mass():
    rng = random.Random(1)
    for _ in range(2000):
        p, q, s, t = rng.uniform(0.01, 0.99), rng.uniform(0.01, 0.99), rng.randrange(1, 50), rng.randrange(1, 50)
        a, b = mixing.duel(p, s, q, t, rng.random())
        assert math.isclose(a * s + b * t, p * s + q * t, abs_tol=1e-9) and (a in (0, 1) or b in (0, 1)) and -1e-9 <= min(a, b) and max(a, b) <= 1 + 1e-9


def test_duel_is_fair():
    n = 40_000
    mean = sum(mixing.duel(0.3, 7, 0.6, 11, (k + 0.5) / n)[0] for k in range(n)) / n
    assert abs(mean - 0.3) < 1e-3


def test_mix(spark, docs):
    rows = docs.select("*").unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("source", F.lit("src0")))
    got = mixing.mix(rows, block=16, fan_in=3).collect()
    assert len(got) == rows.count() and all(0 <= r.copies <= 3 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for group in by.values():
        assert abs(sum(r.size * r.copies for r in group) - group[0].target) <= max(r.size for r in group)
    again = mixing.mix(rows.repartition(7), block=16, fan_in=3).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    taken = mixing.take(rows, block=16, fan_in=3)
    assert Counter(r.doc_id for r in taken.select("doc_id").collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_odd(spark, odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and all(r.size * r.copies <= 3 * r.size for r in got)
    assert mixing.take(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0


# --- winnowing ---


def brute_winnow(text):
    h = [zlib.crc32(w) % winnowing.PRIME for w in WORDS.findall((text or "").encode())]
    grams = []
    for i in range(max(1, len(h) - winnowing.K + 1) if h else 0):
        a = 0
        for x in h[i : i + winnowing.K]:
            a = (a * winnowing.BASE + x) % winnowing.PRIME
        grams.append(a)
    out = []
    for i in range(max(1, len(grams) - winnowing.W + 1) if grams else 0):
        w = grams[i : i + winnowing.W]
        j = i + max(k for k, x in enumerate(w) if x == min(w))
        if (grams[j], j) not in out[-1:]:
            out.append((grams[j], j))
    return out


def test_winnowing(spark, docs, tmp_path):
    rows = docs.limit(60).collect()
    rows = [(r.doc_id * 3, r.text) for r in rows] + [(1, None), (2, ""), (4, "a b"), (5, "a " * 300)]
    spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in winnowing.op7_winnowing(spark, str(tmp_path)).collect()}
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    text = lambda f: " ".join(f"{h:x}@{p}" for h, p in f)

    def near(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, e, n = map(brute_winnow, (t, edited, after))
        r = got[i]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint, r.edited_sha256) == (len(t), text(a), text(e), hashlib.sha256(edited.encode()).hexdigest())
        assert math.isclose(r.near_edited, near(a, e)) and math.isclose(r.near_next, near(a, n))


def test_next_rows_over_many_ranges(spark):
    ids = random.Random(2).sample(range(10**9), 300) + list(range(50))
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next.text for r in winnowing.with_next(rows, per_range=7).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: str(b) for a, b in zip(down, down[1:] + down[:1])}


def test_next_rows_without_ids_are_dealt_by_their_texts(spark):
    rows = spark.createDataFrame([(None, f"t{i}") for i in range(200)] + [(i, f"u{i}") for i in range(30)], "doc_id long, text string").cache()
    ids = rows.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("hash"))
    at, _ = winnowing._range_of(ids, 7)
    assert max(r["count"] for r in ids.select(at.alias("at")).groupBy("at").count().collect()) < 40
    after = {r.text: r.next.text for r in winnowing.with_next(rows, per_range=7).collect()}
    seen, t = [], "u29"
    for _ in after:
        seen.append(t)
        t = after[t]
    assert t == "u29" and len(set(seen)) == 230 and seen[:30] == [f"u{i}" for i in reversed(range(30))]


def test_winnowing_odd(spark, none, tmp_path):
    for name, rows in (("odd", ODD), ("none", [])):
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert winnowing.op7_winnowing(spark, f"{tmp_path}/{name}").count() == len(rows)


# --- urls ---


def test_url_rules(spark):
    cases = {
        "http://A.ORG/x": ("a.org", "/x", "org/", "allow"), "https://b.example.org/es/1?q": ("b.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/19#t": ("example.org", "/en/19", "example.org/en/1", "block"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"), "http://x.com/de/a": ("x.com", "/de/a", "com/de/", "block"), "http://xcom/de/a": ("xcom", "/de/a", None, None), "http://a.org": ("a.org", "", None, None),
        "no scheme.org/": ("", "", None, None), None: ("", "", None, None), "http://a.org?b://c.com/de/": ("a.org", "", None, None),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(None, "http://a.org/"), (0, "http://A.ORG/x")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = cases.get(r.url, cases.get(r.url or None, ("a.org", "/", "org/", "allow")))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- pieces ---


def test_pieces_equal_the_library_without_dropout(docs):
    from sentencepiece import SentencePieceProcessor

    library, ours = SentencePieceProcessor(model_file=pieces.MODEL), pieces.Encoder(dropout=0.0)
    for r in docs.limit(50).collect():
        assert ours.encode(r.text).tolist() == library.encode(r.text)


def test_pieces_are_lossless_and_varied(docs):
    e, texts = pieces.Encoder(dropout=0.3), [t for _, t, *_ in ODD] + ["▁", "a ▁b", "  x", "\n\n", "\x00", "x" * 500]
    for t in texts:
        assert e.decode(e.encode(t)) == (t or "")
    for k, chunk in enumerate([" encoding", "unbelievable", " ▁é🙂xyz", "aaaaaaaaaaaa"]):
        assert e.cut(chunk, k) == e.cut_long(chunk, k)
    assert len({tuple(e.cut(" unbelievably", v)) for v in range(4)}) > 1
    assert e.encode("same text").tolist() == pieces.Encoder(dropout=0.3).encode("same text").tolist()


def brute_cut(e, chunk, key):
    """All candidates of a chunk, best score and then leftmost first, found anew before each merge; a skipped one is never taken again."""
    parts = [pieces.SPACE if c == " " else pieces.LITERAL if c == pieces.SPACE else c for c in chunk]
    at, came, skips, dead = list(range(len(parts))), 0, [], set()
    following = e.gap(key, 0)
    while True:
        open_ = [(e.rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in e.rank and (at[i], a, b) not in dead]
        if not open_:
            break
        _, i = min(open_)
        came += 1
        if came > following:
            skips.append(following)
            following += 1 + e.gap(key, len(skips))
            dead.add((at[i], parts[i], parts[i + 1]))
            continue
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del at[i + 1]
    out = []
    for x in parts:
        out.extend([e.rank[x][1]] if x in e.rank else [e.byte[b] for b in (pieces.SPACE if x == pieces.LITERAL else x).encode()])
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_pieces_with_dropout_against_brute_force(docs, dropout):
    e, seen = pieces.Encoder(dropout=dropout), 0
    for r in docs.limit(25).collect():
        text = (r.text or "")[:1500] + " naïve ▁ 日本🙂"
        chunks = pieces._CHUNKS.findall(" " + text)
        keys = e.keys(text, len(chunks)).tolist()
        want = [brute_cut(e, c, k) for c, k in zip(chunks, keys)]
        assert want == [e.cut(c, k) for c, k in zip(chunks, keys)] == [e.cut_long(c, k) for c, k in zip(chunks, keys)]
        assert e.encode(text).tolist() == [i for ids in want for i in ids]
        seen += len(chunks)
    assert seen > 2000


def test_pieces_go_through_their_agendas_together():
    rng = random.Random(8)
    for dropout in (0.0, 0.1, 0.5, 1.0):
        e = pieces.Encoder(dropout=dropout)
        chunks = ["".join(rng.choice(" aeinrstl\u00e9\u65e5\U0001f642\u2581x") for _ in range(rng.randrange(1, pieces.SHORT + 1))) for _ in range(300)] + [" the", "\n\n", "a"]
        keys = np.array([rng.randrange(2**64) for _ in chunks], np.uint64)
        first = e.gaps(keys, 0) if e.drops else np.full(len(chunks), pieces.NEVER)
        for c, k, f, got in zip(chunks, keys.tolist(), first.tolist(), e.agendas(chunks, keys, first, 1)):
            ids, came, skipped = e.agenda(c, k, f)
            assert np.frombuffer(got[0], np.int32).tolist() == ids and got[1] == (-1 if len(skipped) > 1 else came)
        # a text's company doesn't matter
        texts = [" ".join(rng.choice(["the", "unbelievable", "x" * 70, "\u65e5\u672c", "of", "reads"]) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, ""]
        alone = pieces.Encoder(dropout=dropout)
        assert [i.tolist() for i in e.encode_all(texts)] == [alone.encode(t).tolist() for t in texts]


def test_pieces_vary_each_occurrence_of_a_word():
    e, word = pieces.Encoder(), " unbelievably"
    texts = [f"text {i}:" + word * 40 for i in range(100)]
    whole, cuts, came, skipped = e.agenda(word, 0, pieces.NEVER)[0], set(), 0, 0
    for t in texts:
        chunks = pieces._CHUNKS.findall(" " + t)
        keys = e.keys(t, len(chunks)).tolist()
        # the memo changes nothing
        assert e.encode(t).tolist() == [i for c, k in zip(chunks, keys) for i in e.cut(c, k)]
        for k in keys[-40:]:
            ids, n, gone = e.agenda(word, k, e.gap(k, 0))
            cuts.add(tuple(ids))
            came, skipped = came + n, skipped + len(gone)
    assert tuple(whole) in cuts and len(cuts) > 20
    assert abs(skipped / came - 0.1) < 0.01


def test_pieces_memo_is_small_and_changes_nothing(monkeypatch):
    import tracemalloc

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aeinrstl\u00e9\u65e5\u2581", k=rng.randrange(1, 12))) for _ in range(200)) + " the" * 20 for _ in range(100)]
    want = [i.tolist() for i in pieces.Encoder().encode_all(texts)]
    assert [i.tolist() for i in pieces.Encoder(memo_rows=64).encode_all(texts)] == want
    # where all hashes of a length are equal, characters decide
    if hasattr(pieces, "PLACES"):
        with monkeypatch.context() as m:
            m.setattr(pieces, "PLACES", np.zeros_like(pieces.PLACES))
            assert [i.tolist() for i in pieces.Encoder().encode_all(texts[:20])] == want[:20]
    e = pieces.Encoder()
    tracemalloc.start()
    try:
        e.encode_all([" ".join(f"{k:x}" for k in range(at, at + 5000)) for at in range(1 << 24, (1 << 24) + 300_000, 5000)])
        assert tracemalloc.get_traced_memory()[0] < 48 << 20
    finally:
        tracemalloc.stop()


def test_pieces_odd(spark, odd, none):
    got = pieces.encode(odd).collect()
    assert len(got) == len(ODD) and all(r.lossless and r.n_tokens == len(r.tokens) for r in got)
    assert pieces.encode(none).count() == 0


# --- SimHash ---


def brute_simhash(text):
    w = tokens(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, docs):
    rows = docs.collect()
    fps = [brute_simhash(r.text) for r in rows]
    assert [simhash.simhash64(r.text) for r in rows] == fps
    groups, least = brute_components(fps), {}
    for r, g in zip(rows, groups):
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: (f, least[g]) for r, f, g in zip(rows, fps, groups)}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(least.values())


def test_chains_of_fingerprints_are_one_component(spark):
    rng = random.Random(4)
    fps = [0]
    for _ in range(80):
        fps.append(fps[-1] ^ sum(1 << b for b in rng.sample(range(64), 2)))
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in [*fps, *(rng.getrandbits(64) for _ in range(40))]})
    roots = brute_components([x % 2**64 for x in fps])
    labels_ = dict(simhash.components(simhash.ball_edges(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect())
    for a in range(len(fps)):
        for b in range(a):
            assert (roots[a] == roots[b]) == (labels_.get(fps[a], fps[a]) == labels_.get(fps[b], fps[b]))


def test_simhash_query(spark, docs):
    path = "/root/testdata/sf0.001"
    want = {r.doc_id: (f"{r.fp % 2**64:016x}", r.component_id) for r in simhash.near_duplicates(spark.read.parquet(f"{path}/documents.parquet")).collect()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash_balls(spark, path).collect()} == want != {}


def test_simhash_odd(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2, 10)} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0 for r in kept.collect())) == sorted({0 if r.component_id is None else r.component_id for r in got})
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_similar_groups_against_brute_force(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (8, 40, 90, 200, 400):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2):
                near = list(base)
                for _ in range(edits * max(1, n // 90)):
                    near[rng.randrange(n)] = rng.choice(vocabulary)
                texts.append(" ".join(near))
    texts += [texts[0], texts[0].upper(), "", " ", None, "one two", "one  two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert set(got) == set(range(len(texts)))
    # no text joins one that it isn't linked to, and nearly all links are found
    assert all(find(i) == find(got[i]) for i in got)
    linked = [i for i in got if find(i) != i]
    assert len(linked) > 40 and sum(got[i] == find(i) for i in linked) >= 0.9 * len(linked)
    assert {r.doc_id for r in simhash.keep_one_similar(docs).collect()} == set(got.values())


def test_similar_finds_the_edited_texts_of_a_corpus(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text).tolist()) for r in rows.collect()}
    holders = defaultdict(list)
    for i, grams in sets.items():
        for g in grams:
            holders[g].append(i)
    together = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    linked = [(a, b) for a, b in together if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = {r.doc_id: r.component_id for r in simhash.similar(rows).collect()}
    assert linked and sum(group[a] == group[b] for a, b in linked) >= 0.9 * len(linked)
    assert all(group[a] == group[b] for a in sets for b in sets if a < b and sets[a] == sets[b])


def test_similar_handles_nulls_repeats_and_empty_tables(spark):
    odd = spark.createDataFrame([(None, None, 1), (None, "", 2), (1, "a b c", 3), (1, "a b c", 3), (1, "d e f", 4)], "doc_id long, text string, root long")
    kept = simhash.keep_one_similar(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "a b c"), (1, "d e f")]
    none = odd.where("false")
    assert simhash.similar(none).count() == 0 and simhash.keep_one_similar(none).count() == 0


def test_similar_links_texts_that_are_no_heads(spark):
    # two pairs of like texts in one seat, two in the seats of one ball: no head is in more than one pair
    sets = {k: list(range(100 * (k // 2), 100 * (k // 2) + 20)) for k in range(8)}
    texts = spark.createDataFrame([(k, [7 if k < 4 else 1 << 20 | k % 2]) for k in sets], "text_key long, list array<long>")
    seats = simhash.text_seats(texts)
    lists = spark.createDataFrame(list(sets.items()), "text_key long, list array<long>")
    asked = []

    def compare(mixed):
        asked.extend(r.text_key for r in mixed.collect())
        pairs = mixed.select(F.col("text_key").alias("u")).join(mixed.select(F.col("text_key").alias("v")), F.col("u") > F.col("v"))
        return simhash.verified(pairs, lists, 0.8)

    links = simhash.all_links(seats, lambda pairs: pairs, lambda pairs: simhash.verified(pairs, lists, 0.8), compare)
    assert {(r.u, r.v) for r in links.collect()} == {(1, 0), (3, 2), (5, 4), (7, 6)} and sorted(asked) == list(range(8))


def test_texts_that_meet_by_chance_are_not_compared(spark):
    """Of pairs of texts that share a seat, only those that may be linked are asked for, in seats with and without a large group."""
    r = random.Random(6)
    texts = {}
    for k in range(0, 200, 2):
        w = [f"w{r.randrange(5000)}" for _ in range(r.choice([1, 6, 60, 130, 300]))]
        texts[k], texts[k + 1] = " ".join(w), " ".join([*w[:-1], "end"]) if k % 20 == 0 else " ".join(r.choices(w, k=len(w) + 1))
    sets = {k: set(simhash.jaccard.shingle_set(t, 5).tolist()) for k, t in texts.items()}
    linked = {(k + 1, k) for k in range(0, 200, 2) if 100 * len(sets[k] & sets[k + 1]) >= 80 * len(sets[k] | sets[k + 1])}
    sketches = spark.createDataFrame([(k, len(sets[k]), simhash.parities(np.array(sorted(sets[k]), np.uint64)).tolist()) for k in texts], "text_key long, n long, bits array<long>")
    every = spark.createDataFrame([(a, b) for a in texts for b in texts if a > b], "u long, v long")
    kept = {(x.u, x.v) for x in simhash.may_link(every, sketches, 80).collect()}
    true = {(a, b) for a in texts for b in texts if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked <= true <= kept and 0 < len(linked) < 20 and len(kept) < len(true) + 40
    # two texts a seat, and one seat of a large group with another text
    own = [r.getrandbits(32) for _ in range(100)]
    seats = spark.createDataFrame([(k, own[k // 2]) for k in texts] + [(1000 + i, 5) for i in range(30)] + [(0, 5)], "text_key long, seat long")
    edges = spark.createDataFrame([(1000 + i, 1000) for i in range(1, 30)], "u long, v long")
    crowd = simhash.crowded(seats)
    asked, whole = [], {x.text_key for x in simhash.mixed_texts(seats, crowd, edges).collect()}

    def may(pairs):
        asked.extend((x.u, x.v) for x in pairs.collect())
        return pairs.where("v < 1000 and u < 1000").join(every, ["u", "v"]).transform(lambda p: simhash.may_link(p, sketches, 80))

    got = {x.text_key for x in simhash.mixed_texts(seats, crowd, edges, may).collect()}
    assert {(k + 1, k) for k in range(0, 200, 2)} | {(1000 + i, 0) for i in range(30)} <= set(asked) and len(whole) == 230
    assert {k for pair in linked for k in pair} <= got and len(got) < 60


def test_similar_compares_a_crowd_below_the_similarity(spark):
    """Many texts that are alike, but not enough, share balls; the few that are enough alike are still found."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for at in r.sample(range(60), 4):
            w[at] = f"e{i}-{at}"
        rows.append((i, " ".join(w)))
    # a copy with one word changed at the end of every tenth text
    rows += [(1000 + i, t.rsplit(" ", 1)[0] + " end") for i, t in rows[::10]]
    docs = frame(spark, [(i, t, "en", "a", 0) for i, t in rows])
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    want = {}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                want[j] = min(want.get(j, j), i)
    got = {x.doc_id: x.component_id for x in simhash.similar(docs).collect()}
    assert len(want) >= 12 and all(got[j] <= i for j, i in want.items()) and sum(got[j] == j for j in got if j not in want) == len(got) - len(want)


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(200)]
    edited = [w if i not in (60, 140) else "other" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "something else"), (4, " ".join(words))], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {1, 2, 3}
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3]
