"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Symbols. The words of highest count in the training texts have a symbol each (at most
``top``; all words of a count are in or none); every other word, seen or not, is one of
``classes`` symbols by its last three bytes, times the add-one share of the word within
its class. The class share doesn't depend on the hidden state, so the likelihood of a
text is the forward likelihood of its symbols times the shares of its rare words, exactly.
The states' tables have a proven bound and are broadcast; counts of rare words are
joined by a shuffle, and as no rare word is among the most frequent, no key of that join
is hot.

Training. The states start from a few iterations on a bounded sample of distinct texts
(``sample``); then each Baum-Welch pass runs the scaled forward-backward recursion on
every training text, sums the expected counts in each partition, then across partitions,
and re-estimates. Passes go on until one finds the likelihood less than ``settled`` (log10
a token) above the last one's. Word counts cover all training texts.

Texts are tokenised once, to a table in the shared folder: symbols, and the rare words.
Null texts are empty: their one token is the end. Without training rows all counts are
zero and the model is uniform. Each row is scored on its own, repeated rows alike.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import ascii_lower, crc_of_id, table, words, written

_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
END = 0


# --- the recursions, over many sequences at a time ---


class Batch:
    """Sequences side by side, longest first: ``flat`` holds all first symbols, then all second ones, and so on.

    At step t the symbols are ``flat[off[t] : off[t] + active[t]]``; the sequences not yet over are a prefix.
    """

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.array([len(s) for s in seqs])
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        self.active = len(lens) - np.cumsum(np.bincount(lens, minlength=lens[0] + 1))[: lens[0]]
        self.off = np.concatenate([[0], np.cumsum(self.active)])
        step = np.arange(self.off[-1], dtype=np.int32) - np.repeat((np.cumsum(lens) - lens).astype(np.int32), lens)
        self.flat = np.empty(self.off[-1], seqs[0].dtype)
        self.flat[self.off[step] + np.repeat(np.arange(len(lens), dtype=np.int32), lens)] = np.concatenate([seqs[i] for i in self.order])

    def steps(self):
        return zip(self.off.tolist(), self.active.tolist())


def forward(b: Batch, start, trans, emit) -> np.ndarray:
    """log10 likelihood of each sequence, in the order given; ``emit`` is symbols x states."""
    e, scale, one, a = np.take(emit, b.flat, axis=0), np.empty(len(b.flat)), np.ones(len(start)), None
    for o, n in b.steps():
        a = (start if a is None else a[:n] @ trans) * e[o : o + n]
        c = np.matmul(a, one, out=scale[o : o + n])
        a /= c[:, None]
    sequence = np.arange(len(b.flat)) - np.repeat(b.off[:-1], b.active)
    out = np.empty(len(b.order))
    out[b.order] = np.bincount(sequence, np.log10(scale), len(out))
    return out


def expected(b: Batch, start, trans, emit):
    """Expected counts of first states, of transitions, and of states by symbol (symbols x states)."""
    return expected_and_likelihood(b, start, trans, emit)[:3]


def expected_and_likelihood(b: Batch, start, trans, emit):
    """As ``expected``, and the log10 likelihood of all sequences; in single precision, sums in double."""
    start, trans, emit = (np.asarray(x, np.float32) for x in (start, trans, emit))
    k = len(start)
    e, alpha, scale, one = np.take(emit, b.flat, axis=0), np.empty((len(b.flat), k), np.float32), np.empty(len(b.flat), np.float32), np.ones(k, np.float32)
    before = None
    for o, n in b.steps():
        a = alpha[o : o + n]
        if before is None:
            a[:] = start
        else:
            np.matmul(alpha[before : before + n], trans, out=a)
        a *= e[o : o + n]
        a /= np.matmul(a, one, out=scale[o : o + n])[:, None]
        before = o
    e /= scale[:, None]
    pairs, back, after = np.zeros((k, k)), np.ascontiguousarray(trans.T), None
    for o, n in reversed(list(b.steps())):
        if after is not None:
            # of the sequences that go on; beta of the others is 1
            at, m = after
            w, a = e[at : at + m], alpha[o : o + m]
            if beta is not None:
                w[: len(beta)] *= beta
            pairs += a.T @ w
            beta = w @ back
            a *= beta  # now the posterior
        else:
            beta = None
        after = o, n
    by = np.zeros(len(emit) * k)
    for at in range(0, len(b.flat), 1 << 18):
        cell = b.flat[at : at + (1 << 18), None].astype(np.int64) * k + np.arange(k)
        by += np.bincount(cell.ravel(), alpha[at : at + (1 << 18)].ravel(), len(by))
    return alpha[: b.active[0]].sum(0, dtype=float), pairs * trans, by.reshape(-1, k), float(np.log10(scale).sum(dtype=float))


def batches_of(seqs, most: int = 1_000_000):
    """Positions of ``seqs`` in batches of about ``most`` symbols, longest first, so that long texts run side by side."""
    held, n = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])):
        held.append(i)
        n += len(seqs[i])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def reestimate(first, pairs, by_symbol, share, prior: float = 50.0):
    """New start, transition and emission tables; ``share``: each symbol's share of the corpus, for smoothing."""
    start = (first + 1) / (first + 1).sum()
    trans = (pairs + 1) / (pairs + 1).sum(1, keepdims=True)
    emit = (by_symbol + prior * share[:, None]) / (by_symbol.sum(0) + prior)
    return start, trans, emit


def begin(states: int, share: np.ndarray, seed: int):
    rng = np.random.default_rng(seed)
    trans = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(trans, 0.8 if states > 1 else 1.0)
    emit = share[:, None] * rng.gamma(2.0, size=(len(share), states))
    return np.full(states, 1 / states), trans, emit / emit.sum(0)


# --- symbols ---


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def _symbols(vocab, classes: int):
    def run(batches):
        symbol = {w: i for i, w in enumerate(vocab.value) if i != END}
        base, of_suffix = len(vocab.value), {}
        row = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0
        for batch in batches:
            out = []
            for doc, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = _WORDS.findall((text.as_py() or "").encode("utf-8", "surrogatepass").lower())
                ids = list(map(symbol.get, found))
                rare = []
                for i, s in enumerate(ids):
                    if s is None:
                        rare.append(w := found[i])
                        if (s := of_suffix.get(w[-3:])) is None:
                            s = of_suffix[w[-3:]] = base + class_of(w, classes)
                        ids[i] = s
                ids.append(END)
                out.append((row, doc, held, len(ids), np.array(ids, "<u2").tobytes(), rare))
                row += 1
            for at in range(0, len(out), 500):
                cols = list(zip(*out[at : at + 500]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.list_(pa.binary()))],
                    ["row", "doc_id", "held_out", "n_tokens", "symbols", "rare"],
                )

    return run


def _expect(model):
    def run(batches):
        start, trans, emit = model.value
        k = len(start)
        first, pairs, by, likelihood, n = np.zeros(k), np.zeros((k, k)), np.zeros_like(emit), np.zeros((1, k)), np.zeros((1, k))
        for b in batches:
            seqs = [np.frombuffer(s.as_buffer(), "<u2") for s in b.column(0)]
            for part in batches_of(seqs):
                f, p, s, got = expected_and_likelihood(Batch([seqs[i] for i in part]), start, trans, emit)
                likelihood[0, 0] += got
                n[0, 0] += sum(len(seqs[i]) for i in part)
                first += f
                pairs += p
                by += s
        seen = np.flatnonzero(by.any(1))
        rows = np.concatenate([by[seen], first[None], pairs, likelihood, n])
        keys = np.concatenate([seen, [-1], -2 - np.arange(k + 2)])
        for at in range(0, len(keys), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 20_000], pa.int32()), *(pa.array(rows[at : at + 20_000, j].copy()) for j in range(k))], ["symbol", *(f"s{j}" for j in range(k))])

    return run


def start_texts(train: DataFrame, sample: int) -> list[np.ndarray]:
    """The symbols of ``sample`` distinct texts of ``train(symbols)``, those with the least hashes."""
    keyed = train.select("symbols", F.xxhash64("symbols").alias("key"))
    keys = [r.key for r in keyed.select("key").distinct().orderBy("key").limit(sample).collect()]
    some = keyed.where(F.col("key").isin(keys)).groupBy("key").agg(F.first("symbols").alias("symbols")).orderBy("key").collect()
    return [np.frombuffer(r.symbols, "<u2") for r in some]


def baum_welch(train: DataFrame, model, share: np.ndarray, settled: float):
    """The model after passes over all of ``train(symbols)`` until the likelihood settles, and the log10 likelihood a token that each pass found."""
    sc, k, found = train.sparkSession.sparkContext, len(model[0]), []
    names = [f"s{j}" for j in range(k)]
    while len(found) < 2 or found[-1] - found[-2] >= settled:
        sent = sc.broadcast(model)
        got = train.mapInArrow(_expect(sent), "symbol int, " + ", ".join(f"{n} double" for n in names))
        got = got.groupBy("symbol").agg(*(F.sum(n).alias(n) for n in names)).toPandas().set_index("symbol").sort_index()
        sent.unpersist()
        by = np.zeros((len(share), k))
        known = got[got.index >= 0]
        by[known.index] = known.to_numpy()
        model = reestimate(got.loc[-1].to_numpy(), got.loc[[-2 - j for j in range(k)]].to_numpy(), by, share)
        found.append(got.loc[-2 - k, "s0"] / got.loc[-3 - k, "s0"])
    return model, found


def _score(model, tables):
    def run(batches):
        start, trans, emit = model.value
        base, share = tables.value  # by symbol: log10(c + 1) of a word of its own; log10 of its class's denominator
        for b in batches:
            seqs = [np.frombuffer(s.as_buffer(), "<u2") for s in b.column(3)]
            logp = np.empty(len(seqs))
            for held in batches_of(seqs):
                logp[held] = forward(Batch([seqs[i] for i in held]), start, trans, emit)
            own = np.array([base[s].sum() for s in seqs])
            minus = np.array([share[s].sum() for s in seqs])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), pa.array(own), pa.array(logp - minus)], ["row", "doc_id", "held_out", "n_tokens", "own", "logp"])

    return run


def score_texts(docs: DataFrame, held_out, states: int = 8, top: int = 48_000, classes: int = 512, sample: int = 300, warm: int = 10, settled: float = 0.002, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    ``held_out``: a column over ``docs``; rows where it is false train. ``top + classes`` is under 65,536.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    train = rows.where("not held_out")
    counts = train.select(F.explode(words(ascii_lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    counts = written(counts.select(F.col("word").cast("binary").alias("word"), "c"))
    n_train = train.count()
    histogram = sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    n_words, n_types = sum(c * n for c, n in histogram), sum(n for _, n in histogram)
    least, own = math.inf, 0
    for c, n in histogram:
        if own + n > top:
            break
        least, own = c, own + n
    frequent = counts.where(F.col("c") >= (least if own else 1 << 62)).orderBy(F.desc("c"), "word").collect()
    vocab = [b"", *(bytes(r.word) for r in frequent)]
    of_class = F.crc32(F.expr("substring(word, -3, 3)")) % classes
    rest = {r.k: (r.c, r.v) for r in counts.where(F.col("c") < (least if own else 1 << 62)).groupBy(of_class.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    n_tokens, n_distinct = n_words + n_train, n_types + (n_train > 0)
    mass = np.array([n_train, *(r.c for r in frequent), *(rest.get(k, (0, 0))[0] for k in range(classes))], float)
    share = (mass + 1) / (mass + 1).sum()
    minus = np.zeros(len(share))
    minus[len(vocab) :] = [math.log10(sum(rest.get(k, (0, 0))) + 1) for k in range(classes)]
    base = np.log10(mass + 1)
    base[len(vocab) :] = 0

    tokens = written(rows.mapInArrow(_symbols(sc.broadcast(vocab), classes), "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, rare array<binary>"))
    train = tokens.where("not held_out").select("symbols")
    model = begin(states, share, seed)
    if some := start_texts(train, sample):
        some = Batch(some)
        for _ in range(warm):
            model = reestimate(*expected(some, *model), share)
        model, _ = baum_welch(train, model, share, settled)
    scored = tokens.select("row", "doc_id", "held_out", "symbols", "n_tokens").mapInArrow(
        _score(sc.broadcast(model), sc.broadcast((base, minus))), "row long, doc_id long, held_out boolean, n_tokens long, own double, logp double"
    )
    rare = tokens.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy(F.col("row").alias("rare_row")).agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"), F.count("*").alias("n_rare"), F.count("c").alias("rare_known"))
    out = scored.join(rare, scored.row == rare.rare_row, "left").na.fill(0, ["rare_log", "n_rare", "rare_known"])
    known = F.col("n_tokens") - F.col("n_rare") + F.col("rare_known") - (0 if n_train else 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("own") + F.col("rare_log") - F.col("n_tokens") * math.log10(n_tokens + n_distinct + 1)).alias("base_score"), (F.col("logp") + F.col("rare_log")).alias("score"),
    )


def op3_hmm(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32 of doc_id is not 2 modulo 7."""
    return score_texts(table(spark, sf_dir, "documents"), crc_of_id() % 7 == 2)
