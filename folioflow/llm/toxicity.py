"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is two rows of hashed tables side by side. Filters of widths 1, 2 and 3
slide over all words of a text; each filter's largest value goes through a rectifier into
a logistic output. The first dimension of a table starts as the standardised log-odds of
its words in the training texts; the rest is learned by Adagrad, where only the winning
window of each filter gets a gradient.

Thresholds are calibrated by language, on training texts that the fit doesn't see. The
language is read from the text's own function words; a language with few toxic texts takes
the threshold of all. A text's score is the logistic of its distance from its language's
threshold, so 0.5 always is the decision.

All labelled training rows are read, one row of each id and text: those that calibrate give
every count that thresholds come from, the others every count of the log-odds, and all of them
are fitted. They are dealt into blocks of about ``TEXTS`` texts by a hash of the id. In each
round every block goes on from the model of the round before, by itself, and what the blocks
changed is averaged, for a table's row over the blocks that touched it; so a round's work is
shared by all tasks, and what comes to the driver is as large as the model. Sums are of whole
numbers, so that the model doesn't depend on how blocks are dealt to tasks.

Every text is scored whole, in one pass without a shuffle. Null and empty texts are scored as no
words. Labels of null are ignored; of several labels of an id the largest counts. Without labelled
training rows of both kinds all scores are 0.
"""

from __future__ import annotations

import copy
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import crc_of_id, discard, own, small_batches, table, written

BITS, HALF, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 12
ROWS = 1 << BITS
#: Texts of a block, about; a block of more words than ``WORDS`` is cut.
TEXTS, WORDS, ROUNDS = 1024, 1 << 21, 6
#: What is averaged is summed in whole multiples of 1 / ``UNIT``; logits are counted by multiples of 1 / ``GRID``.
UNIT, GRID = 1 << 32, 1 << 10
#: Sums of a table's rows are shuffled in ranges of so many rows.
RANGE = 1 << 12
#: Labels of up to this many texts (16 bytes each) are broadcast to find them; for more, all texts are shuffled.
BROADCAST_LABELS = 1 << 20
_WORDS = re.compile(r"[^\W_]+")
# Frequent function words of each language.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine zu den von mit für auf dem des im sich als auch",
    "en": "the of and to in is that it was for on are with as be this have at by not",
    "es": "el los las que y en un una por con no se del para es lo como más su al",
    "fr": "le les et des un une du dans est pour que qui sur pas par au avec ce il sont",
}


def hashes(text: str | None, memo: dict) -> np.ndarray:
    """The hash of each word of a text, lower-cased."""
    found = _WORDS.findall((text or "").lower())
    out = list(map(memo.get, found))
    for i, h in enumerate(out):
        if h is None:
            w = found[i]
            if (h := memo.get(w)) is None:
                if len(memo) > 200_000:
                    memo.clear()
                h = memo[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"), 3)
            out[i] = h
    return np.array(out, np.uint32)


def rows_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two tables; row 0 is no word."""
    one = (h & h.dtype.type(ROWS - 1)).astype(np.int64)
    two = ((h >> h.dtype.type(32 - BITS)) & h.dtype.type(ROWS - 1)).astype(np.int64)
    return np.maximum(one, 1), np.maximum(two, 1)


def language_table() -> np.ndarray:
    """For each row of the first table, 0 or 1 + the number of the language whose function word it is."""
    out = np.zeros(ROWS, np.int8)
    for i, lang in enumerate(FUNCTION_WORDS):
        out[rows_of(hashes(FUNCTION_WORDS[lang], {}))[0]] = i + 1
    return out


class Model:
    """The classifier: tables ``e`` (2 x ROWS x HALF), filters ``w`` of each width, biases ``c``, output ``v``, ``b``."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.05, (2, ROWS, HALF)).astype(np.float32)
        self.e[:, 0] = 0
        self.w = [rng.normal(0, 0.3, (k, 2 * HALF, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.c = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v, self.b = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32)
        # Adagrad's sums of squares
        self.ge, self.gw, self.gc = np.full((2, ROWS), 1e-4, np.float32), [np.full_like(w, 1e-4) for w in self.w], [np.full_like(c, 1e-4) for c in self.c]
        self.gv, self.gb = np.full_like(self.v, 1e-4), np.full(1, 1e-4, np.float32)
        self.thresholds = np.zeros(1 + len(FUNCTION_WORDS))
        self.languages = language_table()

    def small(self) -> list[np.ndarray]:
        """All parameters but the tables, and their sums of squares."""
        return [*self.w, *self.c, self.v, self.b, *self.gw, *self.gc, self.gv, self.gb]

    def copy(self) -> Model:
        return copy.deepcopy(self)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.small()])

    def table_rows(self) -> np.ndarray:
        """Each row of both tables with its sum of squares."""
        return np.concatenate([self.e, self.ge[:, :, None]], 2).reshape(2 * ROWS, HALF + 1)

    def move(self, rows: np.ndarray, by: np.ndarray, small_by: np.ndarray) -> None:
        """Adds to rows of both tables (``table_rows``) and to the other parameters (``flat``)."""
        self.e.reshape(2 * ROWS, HALF)[rows] += by[:, :HALF].astype(np.float32)
        self.ge.reshape(2 * ROWS)[rows] += by[:, HALF].astype(np.float32)
        at = 0
        for x in self.small():
            x += small_by[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def laid_out(self, texts: list[np.ndarray]):
        """Rows of the words of all texts, each followed by two rows of no word; where each text starts, and ends."""
        lens = np.array([max(1, len(t)) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lens + 2)[:-1]])
        one = np.zeros(int((lens + 2).sum()), np.int64)
        two = one.copy()
        for s, t in zip(starts, texts):
            if len(t):
                one[s : s + len(t)], two[s : s + len(t)] = rows_of(t)
        return one, two, starts, starts + lens

    def responses(self, one, two):
        """The filters' values at each position, for each width."""
        x = np.concatenate([self.e[0][one], self.e[1][two]], 1)
        out = []
        for w, c in zip(self.w, self.c):
            z = x @ w[0]
            for j in range(1, len(w)):
                z[:-j] += x[j:] @ w[j]
            out.append(z + c)
        return x, out

    def settle(self) -> None:
        """Rounds the parameters, so that a text's sums are exact, and the same in whatever order and company they are made."""
        self.e = (np.rint(np.clip(self.e, -16, 16) * 2**10) / 2**10).astype(np.float32)
        self.w = [(np.rint(np.clip(w, -4, 4) * 2**8) / 2**8).astype(np.float32) for w in self.w]
        self.c = [(np.rint(c * 2**18) / 2**18).astype(np.float32) for c in self.c]
        self.v, self.b = ((np.rint(x * 2**12) / 2**12).astype(np.float32) for x in (self.v, self.b))

    def logits(self, texts: list[np.ndarray], most: int = 60_000) -> np.ndarray:
        """The output for each text, a few texts of about ``most`` words at a time."""
        out, held, n = [], [], 0
        for i, t in enumerate(texts):
            held.append(t)
            n += len(t)
            if n > most or i + 1 == len(texts):
                out.append(self._logits(held))
                held, n = [], 0
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def _logits(self, texts: list[np.ndarray]) -> np.ndarray:
        one, two, starts, ends = self.laid_out(texts)
        _, z = self.responses(one, two)
        at = np.stack([starts, ends], 1).ravel()
        pooled = np.concatenate([np.maximum.reduceat(x, at, axis=0)[::2] for x in z], 1)
        return np.maximum(pooled, 0).astype(float) @ self.v.astype(float) + self.b

    def language(self, texts: list[np.ndarray]) -> np.ndarray:
        n = len(self.thresholds)
        counts = np.array([np.bincount(self.languages[rows_of(t)[0]], minlength=n) if len(t) else np.zeros(n, int) for t in texts]).reshape(-1, n)
        counts[:, 0] = 0
        return counts.argmax(1)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - self.thresholds[self.language(texts)], -30, 30)))


def set_log_odds(model: Model, df: np.ndarray, n: np.ndarray) -> None:
    """Starts the tables' first dimension with the words' standardised log-odds; ``df``: of each table, row and label the number of texts, ``n``: of all."""
    for k in range(2):
        a, b = df[k].T + 0.5, n[:, None] - df[k].T + 0.5
        z = (np.log(a[1] / b[1]) - np.log(a[0] / b[0])) / np.sqrt((1 / a + 1 / b).sum(0))
        model.e[k, 1:, 0] = np.clip(z, -3, 8)[1:] / 4


def text_counts(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each table, row and label the number of texts."""
    df = np.zeros((2, ROWS, 2), np.int64)
    for t, label in zip(texts, y):
        for k, rows in enumerate(rows_of(t)):
            df[k, np.unique(rows), int(label)] += 1
    return df


def descend(m: Model, texts: list[np.ndarray], y: np.ndarray, epochs: int, rng: np.random.Generator, batch: int = 32, rate: float = 0.05) -> None:
    """Passes of Adagrad over the texts."""
    ge, gw, gc, gv = m.ge, m.gw, m.gc, m.gv
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            one, two, starts, ends = m.laid_out([texts[i] for i in part])
            x, z = m.responses(one, two)
            best = [np.stack([s + q[s:e].argmax(0) for s, e in zip(starts, ends)]) for q in z]
            pooled = np.concatenate([np.take_along_axis(q, p, 0) for q, p in zip(z, best)], 1)
            hidden = np.maximum(pooled, 0)
            err = (1 / (1 + np.exp(-np.clip(hidden @ m.v + m.b, -30, 30))) - y[part]) / len(part)
            back = err[:, None] * m.v * (pooled > 0)
            dv, db = err @ hidden, err.sum()
            gv += dv**2
            m.gb += db**2
            m.v -= rate * dv / np.sqrt(gv)
            m.b -= rate * db / np.sqrt(m.gb)
            rows, grads = [[], []], []
            for k, (w, p) in enumerate(zip(m.w, best)):
                d = back[:, k * FILTERS : (k + 1) * FILTERS]
                dw = np.empty_like(w)
                for j in range(len(w)):
                    dw[j] = np.einsum("nfe,nf->ef", x[p + j], d)
                    rows[0].append(one[p + j].ravel())
                    rows[1].append(two[p + j].ravel())
                    grads.append((d[:, :, None] * w[j].T[None]).reshape(-1, 2 * HALF))
                dc = d.sum(0)
                gw[k] += dw**2
                gc[k] += dc**2
                w -= rate * dw / np.sqrt(gw[k])
                m.c[k] -= rate * dc / np.sqrt(gc[k])
            grads = np.concatenate(grads)
            for k in range(2):
                r, where = np.unique(np.concatenate(rows[k]), return_inverse=True)
                de = np.zeros((len(r), HALF), np.float32)
                np.add.at(de, where, grads[:, k * HALF : (k + 1) * HALF])
                ge[k, r] += (de**2).mean(1)
                m.e[k, r] -= rate * de / np.sqrt(ge[k, r])[:, None]
            m.e[:, 0] = 0


def passes(n: int) -> tuple[int, int]:
    """Rounds, and passes over each block in a round, for ``n`` training texts."""
    return ROUNDS, max(1, min(10, 20_000 // (ROUNDS * max(1, n))))


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int | None = None, seed: int = 5) -> Model:
    """The model of a single block."""
    m = Model(seed)
    set_log_odds(m, text_counts(texts, y), np.array([(y == 0).sum(), (y == 1).sum()]))
    rounds, each = passes(len(texts))
    descend(m, texts, y, epochs or rounds * each, np.random.default_rng(seed))
    return m


def best_threshold(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The midpoint between neighbouring logits with the highest weighted F1."""
    order = np.argsort(-logits, kind="stable")
    s, t, w = logits[order], y[order], weight[order]
    hit, wrong, all_ = np.cumsum(w * t), np.cumsum(w * (1 - t)), (w * t).sum()
    f1 = 2 * hit / (hit + wrong + all_)
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(np.argmax(f1))
    return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - 1)


def calibrate(model: Model, counts: np.ndarray, least: int = 25) -> None:
    """Sets the thresholds from rows of language, logit (times ``GRID``), and numbers of clean and of toxic texts.

    A language with fewer than ``least`` toxic texts takes the threshold of all.
    """
    lang, at, n = counts[:, 0], counts[:, 1] / GRID, counts[:, 2:]
    if not n[:, 1].sum():
        return

    def best(own):
        return best_threshold(np.repeat(at[own], 2), np.tile([0.0, 1.0], own.sum()), n[own].ravel().astype(float))

    model.thresholds[:] = best(lang >= 0)
    for i in range(len(model.thresholds)):
        if (n[lang == i].sum(0) >= least).all():
            model.thresholds[i] = best(lang == i)


def _hash_batches(batches):
    memo: dict = {}
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([hashes(t.as_py(), memo).tobytes() for t in b.columns[-1]], pa.binary())], [*b.schema.names[:-1], "words"])


def _packed(batches):
    """A block for each fold and shard of sorted rows, or more where its words are many; equal rows count once."""
    names = ["fold", "shard", "y", "ends", "words"]
    key, before, y, words, n = None, None, [], [], 0

    def block():
        ends = np.cumsum([len(w) for w in words]) // 4
        return pa.RecordBatch.from_pylist([dict(zip(names, [*key, bytes(y), ends.astype(np.int64).tobytes(), b"".join(words)]))], BLOCK)

    for b in batches:
        for fold, shard, doc_id, toxic, w in zip(*(b.column(k).to_pylist() for k in ("fold", "shard", "doc_id", "toxic", "words"))):
            if (row := (doc_id, w)) == before:
                continue
            if key != (fold, shard) or n > 4 * WORDS:
                if key:
                    yield block()
                key, y, words, n = (fold, shard), [], [], 0
            y.append(toxic)
            words.append(w)
            before, n = row, n + len(w)
    if key:
        yield block()


BLOCK = pa.schema([("fold", pa.int32()), ("shard", pa.int64()), ("y", pa.binary()), ("ends", pa.binary()), ("words", pa.binary())])


def blocks_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled training rows in blocks: fold (1 calibrates), shard, labels, and hashes of the words with their ends."""
    part = crc_of_id() % 5
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("part", part).where("part <> 0").withColumn("fold", F.expr("int(part = 1)")).drop("part")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = texts.select("doc_id").join(known.select("doc_id"), "doc_id").count()
    few = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // TEXTS) or 1)).alias("shard")
    hashed = texts.join(few, "doc_id").select("fold", shard, "doc_id", "toxic", "text").mapInArrow(_hash_batches, "fold int, shard long, doc_id long, toxic int, words binary")
    tasks = max(1, min(n // 512, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = hashed.repartition(tasks, "fold", "shard").sortWithinPartitions("fold", "shard", "doc_id", "words")
    return dealt.mapInArrow(_packed, "fold int, shard long, y binary, ends binary, words binary")


def _unpacked(batches):
    """Shard, texts and labels of each block."""
    for b in batches:
        for i in range(b.num_rows):
            words = np.frombuffer(b.column("words")[i].as_buffer(), np.uint32)
            texts = np.split(words, np.frombuffer(b.column("ends")[i].as_py(), np.int64)[:-1])
            yield b.column("shard")[i].as_py(), texts, np.frombuffer(b.column("y")[i].as_py(), np.uint8).astype(np.float32)


def _ranges(whole: np.ndarray, touched: np.ndarray, other: np.ndarray, n: int):
    """Ranges of sums of a table's rows: the range's number, which of the rows, by how many blocks, and the sums; range -1 holds other sums."""
    rows = np.flatnonzero(touched)
    cuts = np.searchsorted(rows, np.arange(RANGE, len(touched) + RANGE, RANGE))
    out = [(k, r.astype(np.int32).tobytes(), touched[r].tobytes(), whole[r].tobytes()) for k, r in enumerate(np.split(rows, cuts[:-1])) if len(r)]
    out.append((-1, b"", np.array([n], np.int32).tobytes(), other.tobytes()))
    for at in range(0, len(out), 8):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 8]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["range", "rows", "blocks", "sums"])


def _total(width: int):
    """The sums of all tasks, range by range."""

    def run(batches):
        held: dict = {}
        for b in batches:
            for k, rows, n, sums in zip(*(b.column(i).to_pylist() for i in range(4))):
                n, sums = np.frombuffer(n, np.int32), np.frombuffer(sums, np.int64)
                if k < 0:
                    had = held.get(k, (np.zeros(1, np.int32), np.zeros(len(sums), np.int64)))
                    held[k] = (had[0] + n, had[1] + sums)
                    continue
                if k not in held:
                    held[k] = (np.zeros(RANGE, np.int32), np.zeros((RANGE, width), np.int64))
                r = np.frombuffer(rows, np.int32) - k * RANGE
                held[k][0][r] += n
                held[k][1][r] += sums.reshape(-1, width)
        for k, (n, sums) in held.items():
            r = np.flatnonzero(n) if k >= 0 else slice(None)
            rows = (r + k * RANGE).astype(np.int32).tobytes() if k >= 0 else b""
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in (rows, n[r].tobytes(), sums[r].tobytes()))], ["range", "rows", "blocks", "sums"])

    return run


def _summed(blocks: DataFrame, work, width: int, mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their sums, other sums of ``work`` over all blocks; with ``mean`` divided by the numbers of blocks that gave any.

    ``work`` adds a block's whole numbers to arrays of 2 * ROWS x ``width`` and of 2 * ROWS, and returns its other numbers.
    """

    def task(batches):
        whole, touched, other, n = np.zeros((2 * ROWS, width), np.int64), np.zeros(2 * ROWS, np.int32), 0, 0
        for shard, texts, y in _unpacked(batches):
            other, n = other + work(shard, texts, y, whole, touched), n + 1
        if n:
            yield from _ranges(whole, touched, other, n)

    schema = "range int, rows binary, blocks binary, sums binary"
    got = blocks.mapInArrow(task, schema).repartition("range").mapInArrow(_total(width), schema).toArrow().sort_by("range")
    rows, sums, small = [], [], None
    for k, r, n, s in zip(*(got[c] for c in got.column_names)):
        n, s = np.frombuffer(n.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.int64)
        if k.as_py() < 0:
            small = s / n / UNIT if mean else s
            continue
        rows.append(np.frombuffer(r.as_buffer(), np.int32))
        sums.append((s.reshape(-1, width) / n[:, None] / UNIT).astype(np.float32) if mean else s.reshape(-1, width))
    return np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate(sums or [np.zeros((0, width))]), small


def _counting(shard, texts, y, whole, touched):
    df = text_counts(texts, y).reshape(2 * ROWS, 2)
    whole += df
    touched += df.any(1)
    return np.array([(y == 0).sum(), (y == 1).sum()], np.int64)


def _descending(model, round_: int, epochs: int, seed: int):
    def work(shard, texts, y, whole, touched):
        m = model.value.copy()
        rows, small = m.table_rows(), m.flat()
        descend(m, texts, y, epochs, np.random.default_rng([seed, round_, shard]))
        by = m.table_rows() - rows
        moved = np.flatnonzero(by.any(1))
        whole[moved] += np.rint(by[moved].astype(float) * UNIT).astype(np.int64)
        touched[moved] += 1
        return np.rint((m.flat() - small).astype(float) * UNIT).astype(np.int64)

    return work


def _logit_counts(model):
    def run(batches):
        for _, texts, y in _unpacked(batches):
            at = np.rint(np.clip(model.value.logits(texts), -30, 30) * GRID).astype(np.int64)
            rows, n = np.unique(np.stack([model.value.language(texts), at, y.astype(np.int64)], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows.T), pa.array(n)], ["lang", "at", "toxic", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model | None:
    """A model from all labelled rows whose crc32 of doc_id is not 0 modulo 5; of these 1 calibrates."""
    sc = docs.sparkSession.sparkContext
    blocks = written(blocks_of(docs, labels))
    fitted = blocks.where("fold = 0")
    rows, df, n = _summed(fitted, _counting, 2, mean=False)
    if n is None or not n.all():
        discard(blocks)
        return None
    model, counts = Model(seed), np.zeros((2 * ROWS, 2), np.int64)
    counts[rows] = df
    set_log_odds(model, counts.reshape(2, ROWS, 2), n)
    rounds, epochs = passes(int(n.sum()))
    for k in range(rounds):
        sent = sc.broadcast(model)
        model.move(*_summed(fitted, _descending(sent, k, epochs, seed), HALF + 1, mean=True))
        sent.destroy()
    model.settle()
    sent = sc.broadcast(model)
    found = blocks.where("fold = 1").mapInArrow(_logit_counts(sent), "lang long, at long, toxic long, n long")
    found = found.groupBy("lang", "at").agg(F.expr("sum(if(toxic = 0, n, 0))").alias("clean"), F.expr("sum(if(toxic = 1, n, 0))").alias("toxic")).toArrow()
    sent.destroy()
    calibrate(model, np.stack([c.to_numpy() for c in found.columns], 1))
    discard(blocks)
    return model


def _score(model, columns: int):
    def run(batches):
        memo: dict = {}
        for b in batches:
            out = np.zeros(b.num_rows)
            held, n, first = [], 0, 0
            for i, t in enumerate(b.column(columns)):
                held.append(hashes(t.as_py(), memo))
                n += len(held[-1])
                if n > 60_000 or i + 1 == b.num_rows:
                    if model.value is not None:
                        out[first : i + 1] = model.value.scores(held)
                    held, n, first = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:columns], pa.array(out)], [*b.schema.names[:columns], "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score for each row of ``docs``; the score is a function of the text alone."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id() % 5 == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model, 2), "doc_id long, held_out boolean, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that score under 0.5."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    carried = docs.select(own(docs), F.col("text").cast("string").alias("text"))
    schema = carried.select("own", F.lit(0.0).alias("score")).schema
    return carried.mapInArrow(_score(model, 1), schema).where("score < 0.5").select("own.*")


def op5_text_cnn(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", F.expr("int(score >= 0.5)"))
