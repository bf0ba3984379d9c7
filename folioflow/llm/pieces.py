"""SentencePiece encoding by byte-pair merges with seeded merge-dropout, and decoding.

The pieces and their scores are read from a trained model file; nothing is trained. An agenda
holds the candidate merges of neighbouring symbols; the best score, then the leftmost, comes
first. Each candidate that comes is skipped with probability ``dropout``, by a hash of the
seed, the whole text, the chunk's number and how many skips came before in the chunk: the
hash gives the number of candidates up to the next skip. So equal texts have equal
segmentations anywhere and at any time, and each occurrence of a word has its own skips.
Characters without a piece become bytes, and a literal U+2581
becomes bytes too, so every text decodes to itself.

No piece has a space after another character, so merges never cross from a word into the
next one's spaces: a text is cut there (and at line ends, which have no piece) into chunks
without changing the result. A chunk's segmentation depends on nothing but the chunk and which
of its candidates are skipped, so short chunks are kept by these in a bounded memo. Those that it
lacks go through their agendas together, a candidate of each at a time, in arrays.

Null texts are encoded as the empty text, which has no tokens. One row at a time, without a
shuffle. The model's path is a parameter and must be there on every executor.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import small_batches, table

MODEL = os.environ.get("FOLIOFLOW_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE, LITERAL = "▁", "￿▁"
#: Odd multipliers that spread a chunk's number and a skip's over 64 bits.
MIX, MASK = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD), 2**64 - 1
NO_PIECE, NEVER, LONG, SHORT, KEPT_SKIPS = 0xFFFF, 1 << 62, 64, 32, 2
#: Texts of about so many characters are encoded together; chunks go through their agendas together by lengths.
TOGETHER, LENGTHS, NONE = 400_000, (4, 6, 8, 10, 12, 16, 24, SHORT), np.int32(2**31 - 1)
#: Multipliers by a character's place in its chunk, for hashes of chunks.
PLACES = np.random.default_rng(1).integers(0, 2**63, SHORT + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What ``_encode_all`` cuts texts into.
_CHUNKS = re.compile(r" *[^ \n]+| +|\n+")


def pair_tables(pairs: dict[int, int], bits: int = 20) -> list[tuple]:
    """Multipliers and hash tables of keys and values; a table has the keys that had no place in those before."""
    keys, values, out = np.fromiter(pairs, np.uint32, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)), []
    while len(keys) or not out:
        by = np.uint32((MIX[len(out) % 3] >> 32) + 2 * len(out) & 0xFFFFFFFF | 1)
        at = keys * by >> np.uint32(32 - bits)
        # no pair has two NO_PIECE
        k, v = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, NONE, np.int32)
        k[at], v[at] = keys, values
        out.append((by, k, v, np.uint32(32 - bits)))
        rest = k[at] != keys
        keys, values, bits = keys[rest], values[rest], 17
    return out


class Encoder:
    def __init__(self, path: str = MODEL, dropout: float = 0.1, seed: int = 1, memo_rows: int = 600_000):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.seed = seed
        #: Ascending shares of 2**64: a hash below n of them stands for n candidates that aren't skipped before one that is.
        self.drops, ahead = 1 - dropout < 1, np.empty(0, np.uint64)
        if self.drops and dropout < 1:
            ahead = (2.0**64 * (1 - dropout) ** np.arange(int(-64 * np.log(2) / np.log1p(-dropout)), 0, -1)).astype(np.uint64)
        self.ahead, self.ahead_list = ahead, ahead.tolist()
        self.rank, self.byte, self.bytes_of = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.rank[piece] = (-sp.get_score(i), i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank):
            raise ValueError("a piece spans words or lines")
        ids = {p: i for p, (_, i) in self.rank.items()}
        self.of_char = {(" " if p == SPACE else p): i for p, i in ids.items() if len(p) == 1}
        order = {p: n for n, p in enumerate(sorted(self.rank, key=lambda p: self.rank[p][0]))}
        #: Two pieces, to the order of the piece that they make, and that piece. Scores are distinct, or equal by their pieces' order of id.
        if len(self.bytes_of) >= NO_PIECE:
            raise ValueError("the model has too many pieces")
        self.pairs = {ids[p[:k]] << 16 | ids[p[k:]]: order[p] << 16 | i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.char_ids = np.full(0x110000, NO_PIECE, np.uint32)
        for c, i in self.of_char.items():
            self.char_ids[ord(c)] = i
        if len(order) >= 1 << 15:
            raise ValueError("the model has too many pieces")
        self.tables = pair_tables(self.pairs)
        self.piece_n = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.piece_at, self.piece_bytes = np.cumsum(self.piece_n) - self.piece_n, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.memo_rows = memo_rows
        self.forget()

    def forget(self) -> None:
        """Begins a new memo."""
        self.memo = Memo(self.memo_rows)

    def gaps(self, keys: np.ndarray, skip) -> np.ndarray:
        """For each key, the number of candidates that aren't skipped between a chunk's skips ``skip - 1`` and ``skip`` (one for all, or each key's)."""
        x = keys + (np.asarray(skip, np.uint64)[None] + np.uint64(1)).ravel() * np.uint64(MIX[1])
        x = (x ^ x >> np.uint64(33)) * np.uint64(MIX[2])
        x = (x ^ x >> np.uint64(33)) * np.uint64(MIX[0])
        return len(self.ahead) - np.searchsorted(self.ahead, x ^ x >> np.uint64(33), "right")

    def gap(self, key: int, skip: int) -> int:
        """``gaps`` of one key."""
        x = key + (skip + 1) * MIX[1] & MASK
        x = (x ^ x >> 33) * MIX[2] & MASK
        x = (x ^ x >> 33) * MIX[0] & MASK
        return len(self.ahead_list) - bisect_right(self.ahead_list, x ^ x >> 33)

    def cut(self, chunk: str, key: int) -> list[int]:
        """Ids of one chunk with the skips of ``key``."""
        return self.agenda(chunk, key, self.gap(key, 0) if self.drops else NEVER)[0]

    def agenda(self, chunk: str, key: int, skip: int) -> tuple[list[int], int, list[int]]:
        """Ids of one chunk, how many candidates came, and which were skipped; the first to be skipped is ``skip``.

        A short chunk's agenda is a list: its least entry, leftmost among equals, comes next.
        """
        if len(chunk) > LONG:
            return self.heap(chunk, key, skip)
        ids, merged = list(map(self.of_char.get, chunk)), self.pairs.get
        if None in ids:
            ids = [NO_PIECE if i is None else i for i in ids]
        place = list(range(len(ids) + 1))
        agenda = [merged(a << 16 | b, NEVER) for a, b in zip(ids, ids[1:])]
        came, skipped = 0, []
        while agenda:
            if (best := min(agenda)) == NEVER:
                break
            i = agenda.index(best)
            came += 1
            if came > skip:
                agenda[i] = NEVER
                skipped.append(skip)
                skip += 1 + self.gap(key, len(skipped))
                continue
            ids[i] = made = best & 0xFFFF
            del ids[i + 1], place[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = merged(made << 16 | ids[i + 1], NEVER)
            if i:
                agenda[i - 1] = merged(ids[i - 1] << 16 | made, NEVER)
        if NO_PIECE in ids:
            ids = [x for i, at in zip(ids, place) for x in ([i] if i != NO_PIECE else [self.byte[b] for b in chunk[at].encode("utf-8", "surrogatepass")])]
        return ids, came, skipped

    def cut_long(self, chunk: str, key: int) -> list[int]:
        """As ``cut``, by a heap."""
        return self.heap(chunk, key, self.gap(key, 0) if self.drops else NEVER)[0]

    def heap(self, chunk: str, key: int, skip: int) -> tuple[list[int], int, list[int]]:
        """As ``agenda``, by a heap, for chunks of any length."""
        s: list = [SPACE if c == " " else LITERAL if c == SPACE else c for c in chunk]
        n, rank = len(s), self.rank
        before, after, agenda = list(range(-1, n - 1)), list(range(1, n + 1)), []
        for i in range(n - 1):
            if (r := rank.get(s[i] + s[i + 1])) is not None:
                agenda.append((r[0], i, i + 1, s[i] + s[i + 1]))
        heapq.heapify(agenda)
        came, skipped = 0, []
        while agenda:
            _, i, j, merged = heapq.heappop(agenda)
            if s[i] is None or s[j] is None or after[i] != j or s[i] + s[j] != merged:
                continue
            came += 1
            if came > skip:
                skipped.append(skip)
                skip += 1 + self.gap(key, len(skipped))
                continue
            s[i], s[j] = merged, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(merged + s[k])) is not None:
                    heapq.heappush(agenda, (r[0], i, k, merged + s[k]))
            if (h := before[i]) >= 0 and (r := rank.get(s[h] + merged)) is not None:
                heapq.heappush(agenda, (r[0], h, i, s[h] + merged))
        out = []
        for x in s:
            if x is not None:
                if (r := rank.get(x)) is not None:
                    out.append(r[1])
                else:
                    out.extend(self.byte[b] for b in (SPACE if x == LITERAL else x).encode("utf-8", "surrogatepass"))
        return out, came, skipped

    def keys(self, text: str, n: int) -> np.ndarray:
        """The keys of a text's ``n`` chunks."""
        at = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed)
        return np.uint64(at) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(MIX[0])

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``pairs`` of arrays of pieces; NONE for no pair."""
        key, out = left << np.uint32(16) | right, None
        for by, k, v, shift in self.tables:
            at = key * by >> shift
            out = np.where(k.take(at) == key, v.take(at), NONE if out is None else out)
        return out

    def agendas(self, chunks: list[str], keys: np.ndarray, first: np.ndarray, kept: int) -> list[tuple]:
        """For each of many chunks of up to SHORT characters what ``agenda`` gives: its ids as bytes, and how many candidates came (-1: it had more than ``kept`` skips)."""
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        tokens, at, n, came = self.settled(codes("".join(chunks)), np.cumsum(lens) - lens, lens, keys, first, np.full(len(chunks), kept))
        return [(tokens[a : a + k].tobytes(), c) for a, k, c in zip(at.tolist(), n.tolist(), came.tolist())]

    def settled(self, text: np.ndarray, starts: np.ndarray, lens: np.ndarray, keys: np.ndarray, first: np.ndarray, kept: np.ndarray) -> tuple:
        """``agendas`` of chunks of ``text``: ids of all, where each chunk's begin, how many it has, and how many candidates came."""
        begins, n, came = np.zeros((3, len(lens)), np.int64)
        tokens, done = [np.empty(0, np.int32)], 0
        kind = np.searchsorted(LENGTHS, lens)
        for k in np.unique(kind):
            for at in np.array_split(w := np.flatnonzero(kind == k), -(-len(w) // 8192)):
                ids, n[at], came[at] = self._settled(text, starts[at], lens[at], LENGTHS[k] + 2, keys[at], first[at], kept[at])
                begins[at] = done + np.cumsum(n[at]) - n[at]
                tokens.append(ids)
                done += len(ids)
        return np.concatenate(tokens), begins, n, came

    def _settled(self, text, starts, lens, width, keys, first, kept):
        n, none = len(lens), np.uint32(NO_PIECE)
        # a row has a cell without a piece at either end
        inside = np.arange(width) - 1
        inside = (inside >= 0) & (inside < lens[:, None])
        chars = np.zeros((n, width), np.uint32)
        chars[inside] = text[ranges(starts, lens)]
        ids = np.where(inside, self.char_ids[chars], none)
        best_of = np.full((n, width), NONE)
        best_of[:, :-1] = self.merged(ids[:, :-1], ids[:, 1:])
        agenda, ids, alive = best_of.ravel(), ids.ravel(), inside.ravel()
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        came, skips, rows = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        skip = first.copy()
        while len(rows):
            p = rows * width + best_of.take(rows, 0).argmin(1)
            best = agenda[p]
            if not (more := best != NONE).all():
                rows, p, best = rows[more], p[more], best[more]
            came[rows] += 1
            if (drop := came[rows] > skip[rows]).any():
                agenda[p[drop]] = NONE
                d = rows[drop]
                skips[d] += 1
                skip[d] += 1 + self.gaps(keys[d], skips[d])
                p, best = p[~drop], best[~drop]
            j, h = after[p], before[p]
            k = after[j]
            ids[p] = made = (best & 0xFFFF).astype(np.uint32)
            alive[j], agenda[j] = False, NONE
            after[p], before[k] = k, p
            agenda[p], agenda[h] = self.merged(made, ids[k]), self.merged(ids[h], made)
        # closed by no candidates where more skips came than are kept
        came[skips > kept] = -1
        whole, count = ids[alive].astype(np.int32), alive.reshape(n, width).sum(1)
        if len(odd := np.flatnonzero(whole == NO_PIECE)):
            # characters without a piece become bytes
            at, left = np.flatnonzero(alive)[odd], chars.ravel()[alive][odd]
            size = 1 + (left >= 0x80) + (left >= 0x800) + (left >= 0x10000)
            np.add.at(count, at // width, size - 1)
            many = np.ones(len(whole), np.int64)
            many[odd] = size
            place, whole = (np.cumsum(many) - many)[odd], np.repeat(whole, many)
            for c in np.unique(left):
                for i, x in enumerate(chr(c).encode("utf-8", "surrogatepass")):
                    whole[place[left == c] + i] = self.byte[x]
        return whole, count, came

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, texts of about ``TOGETHER`` characters at a time."""
        out, held, n = [], [], 0
        for i, t in enumerate(texts):
            held.append(t)
            n += len(t or "")
            if n >= TOGETHER or i + 1 == len(texts):
                out += self._encode_all(held)
                held, n = [], 0
        return out

    def _encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        text = codes("".join([" " + t for t in texts if t]))
        sizes = np.fromiter([len(t) + 1 if t else 0 for t in texts], np.int64, len(texts))
        # a chunk begins with a text, or where spaces, line ends and others change, but for others after spaces
        kind = np.where(text == 10, np.uint8(2), text != 32)
        begins = np.ones(len(text), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] != 1) | (kind[:-1] != 0))
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        lens, n_chunks = np.diff(starts, append=len(text)), np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
        keys = np.concatenate([np.empty(0, np.uint64), *(self.keys(t, n) for t, n in zip(texts, n_chunks.tolist()) if t)])
        at = self.gaps(keys, 0) if self.drops else np.full(len(starts), NEVER)
        place = np.arange(len(text)) - np.repeat(starts, lens)
        hashes = np.add.reduceat((text + np.uint64(1)) * PLACES[np.minimum(place, SHORT)], starts) if len(starts) else np.empty(0, np.uint64)
        row = self.memo.rows(text, starts, lens, hashes, np.zeros(len(starts), np.int64))
        # of each chunk's ids where they begin, behind those of the memo if they are new, and how many; of its candidates how many came
        begin, n, came = self.memo.begin[row], self.memo.n[row].astype(np.int64), self.memo.came[row].astype(np.int64)
        new, put, used = [], [], self.memo.used[1]

        def settle(of, which, first, kept, skips, keep):
            """``settled`` of the chunks ``which`` for those in ``of``, a row of indices for each; to be kept if nothing was skipped that isn't kept."""
            nonlocal used
            ids, b, k, c = self.settled(text, starts[which], lens[which], keys[which], first, kept)
            begin[of[0]], n[of[0]], came[of[0]] = (b + used)[of[1]], k[of[1]], c[of[1]]
            keep &= c >= 0
            put.append([x[keep] for x in (which, skips, b + used, k, c)])
            new.append(ids)
            used += len(ids)

        late = row < 0
        for i in np.flatnonzero(late & (lens > SHORT)).tolist():
            # with all skips of its key
            ids = self.cut(text[starts[i] : starts[i] + lens[i]].tobytes().decode("utf-32-le", "surrogatepass"), int(keys[i]))
            begin[i], n[i], came[i] = used, len(ids), 0
            new.append(np.array(ids, np.int32))
            used += len(ids)
        if len(late := np.flatnonzero(late & (lens <= SHORT))):
            _, first, which, times = np.unique(hashes[late], return_index=True, return_inverse=True, return_counts=True)
            # of other characters by the same hash
            other = np.flatnonzero(~same(text, starts[late], lens[late], text, starts[late[first]][which], lens[late[first]][which]))
            which[other] = len(first) + np.arange(len(other))
            first, times = late[np.concatenate([first, other])], np.concatenate([times, np.ones(len(other), np.int64)])
            # a chunk that comes once here takes its own skips, and is kept where it has none
            none = np.zeros(len(first), np.int64)
            settle((late, which), first, np.where(times == 1, at[first], NEVER), none, none, np.ones(len(first), bool))
        # those with another skip before their last candidate go on to what is kept for it
        open_ = np.flatnonzero(at < came)
        first = at = at[open_]
        skips, rest = np.zeros(len(open_), np.int64), []
        for level in range(1, KEPT_SKIPS + 2):
            if not len(open_):
                break
            skips = skips * 4096 + at + 1
            row = self.memo.rows(text, starts[open_], lens[open_], hashes[open_], skips) if level <= KEPT_SKIPS else np.full(len(open_), -1)
            late = row < 0
            rest.append([open_[late], first[late], np.full(late.sum(), level), skips[late]])
            open_, first, skips, at, row = (x[~late] for x in (open_, first, skips, at, row))
            begin[open_], n[open_] = self.memo.begin[row], self.memo.n[row]
            at = at + 1 + self.gaps(keys[open_], level)
            more = at < self.memo.came[row]
            open_, first, skips, at = (x[more] for x in (open_, first, skips, at))
        if rest:
            which, first, level, skips = map(np.concatenate, zip(*rest))
            settle((which, np.arange(len(which))), which, first, level, skips, level <= KEPT_SKIPS)
        ids = np.concatenate([self.memo.ids[: self.memo.used[1]], *new])[ranges(begin, n)]
        if put:
            which, skips, b, k, c = map(np.concatenate, zip(*put))
            self.memo.keep(text, starts[which], lens[which], hashes[which], skips, np.concatenate(new), b - self.memo.used[1], k, c)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(n_chunks)][:-1] if len(texts) else []
        return np.split(ids, ends) if len(texts) else []

    def decoded_all(self, parts: list) -> list[bytes]:
        """The UTF-8 bytes of the texts that were encoded."""
        ids = np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int64)
        n = self.piece_n[ids]
        whole = self.piece_bytes[ranges(self.piece_at[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, parts)])].tolist()
        return [whole[a + 1 : b] for a, b in zip(ends, ends[1:])]

    def decoded(self, ids) -> bytes:
        """``decoded_all`` of one text."""
        return self.decoded_all([np.asarray(ids, np.int32)])[0]

    def decode(self, ids) -> str:
        return self.decoded(ids).decode("utf-8", "surrogatepass")


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one after another."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lens, lens)


def same(a: np.ndarray, a_starts: np.ndarray, a_lens: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_lens: np.ndarray) -> np.ndarray:
    """Whether each part of ``a`` equals that of ``b``; none is empty."""
    out = a_lens == b_lens
    at = np.flatnonzero(out)
    if len(at):
        n = a_lens[at]
        out[at] = np.logical_and.reduceat(a[ranges(a_starts[at], n)] == b[ranges(b_starts[at], n)], np.cumsum(n) - n)
    return out


class Memo:
    """What came of chunks with given skips, in arrays: a row for each, found by its hash and told by its characters and skips.

    When it is full, the older half of its rows goes.
    """

    def __init__(self, rows: int):
        self.size, self.shift = rows, np.uint64(64 - max(10, (2 * rows).bit_length()))
        self.slot = np.full(1 << 64 - int(self.shift), -1, np.int32)
        # a row more, for those that aren't there
        self.hash, self.skips = np.zeros(rows + 1, np.uint64), np.full(rows + 1, -1, np.int32)
        self.at, self.begin = np.zeros(rows + 1, np.int64), np.zeros(rows + 1, np.int64)
        self.len, self.n, self.came = np.zeros(rows + 1, np.int16), np.zeros(rows + 1, np.int16), np.zeros(rows + 1, np.int16)
        self.chars, self.ids = np.empty(8 * rows, np.uint32), np.empty(4 * rows, np.int32)
        #: Characters, ids and rows so far.
        self.used = [0, 0, 0]

    def slots(self, hashes: np.ndarray, skips: np.ndarray) -> np.ndarray:
        x = (hashes + skips.astype(np.uint64) * np.uint64(MIX[1])) * np.uint64(MIX[0])
        return (x ^ x >> np.uint64(32)) * np.uint64(MIX[2]) >> self.shift

    def rows(self, text: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """The rows of chunks of ``text``, -1 where there is none."""
        row = self.slot[self.slots(hashes, skips)]
        at = np.flatnonzero((self.skips[row] == skips) & (self.len[row] == lens))
        row_at = row[at]
        out = np.full(len(row), -1, np.int64)
        good = same(text, starts[at], lens[at], self.chars, self.at[row_at], lens[at])
        out[at[good]] = row_at[good]
        return out

    def keep(self, text: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashes: np.ndarray, skips: np.ndarray, ids: np.ndarray, begin: np.ndarray, n: np.ndarray, came: np.ndarray) -> None:
        """Adds rows, one for each slot."""
        _, one = np.unique(self.slots(hashes, skips), return_index=True)
        for part in np.array_split(one, 1 + len(one) * 8 // self.size):
            c, k = int(lens[part].sum()), int(n[part].sum())
            if max(c - len(self.chars) // 2, k - len(self.ids) // 2, len(part) - self.size // 2) > 0:
                continue
            while self.used[0] + c > len(self.chars) or self.used[1] + k > len(self.ids) or self.used[2] + len(part) > self.size:
                self.halve()
            chars_used, ids_used, used = self.used
            to = slice(used, used + len(part))
            self.chars[chars_used : chars_used + c] = text[ranges(starts[part], lens[part])]
            self.ids[ids_used : ids_used + k] = ids[ranges(begin[part], n[part])]
            self.at[to], self.begin[to] = chars_used + np.cumsum(lens[part]) - lens[part], ids_used + np.cumsum(n[part]) - n[part]
            self.hash[to], self.skips[to], self.len[to], self.n[to], self.came[to] = hashes[part], skips[part], lens[part], n[part], came[part]
            self.slot[self.slots(hashes[part], skips[part])] = np.arange(used, used + len(part))
            self.used = [chars_used + c, ids_used + k, used + len(part)]

    def halve(self) -> None:
        """The newer half of the rows moves to the front."""
        used, half = self.used[2], (self.used[2] + 1) // 2
        chars_at, ids_at = (int(x[half]) if half < used else end for x, end in ((self.at, self.used[0]), (self.begin, self.used[1])))
        for x, a, b in ((self.chars, chars_at, self.used[0]), (self.ids, ids_at, self.used[1]), *((x, half, used) for x in (self.hash, self.skips, self.at, self.begin, self.len, self.n, self.came))):
            x[: b - a] = x[a:b].copy()
        self.used = [self.used[0] - chars_at, self.used[1] - ids_at, used - half]
        self.at[: used - half] -= chars_at
        self.begin[: used - half] -= ids_at
        self.slot[:] = -1
        self.slot[self.slots(self.hash[: used - half], self.skips[: used - half].astype(np.int64))] = np.arange(used - half)


_held: dict = {}


def encoder(**how) -> Encoder:
    """The encoder of this process for these parameters; its tables outlive a task."""
    key = tuple(sorted(how.items()))
    if key not in _held:
        _held.clear()
        _held[key] = Encoder(**how)
    return _held[key]


def _encode(how: dict, columns: int):
    def run(batches):
        enc = encoder(**how)
        try:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    texts = [t or "" for t in part.column(columns).to_pylist()]
                    ids, whole, sha = enc.encode_all(texts), [], []
                    for text, back in zip(texts, enc.decoded_all(ids)):
                        whole.append(back == text.encode("utf-8", "surrogatepass"))
                        sha.append(hashlib.sha256(back).hexdigest())
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:columns], pa.array([len(i) for i in ids], pa.int64()), lists, pa.array(sha), pa.array(whole)],
                        [*part.schema.names[:columns], "n_tokens", "tokens", "decoded_sha256", "lossless"],
                    )
        finally:
            # a worker that waits, or goes on with something else, holds no memo
            enc.forget()
            pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), **how) -> DataFrame:
    """``keep``, n_tokens, tokens, and of the text decoded from the tokens its SHA-256 and whether it equals the text."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_encode(how, len(keep)), f"{kept}, n_tokens long, tokens array<int>, decoded_sha256 string, lossless boolean")


def op9_merge_dropout(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens, decoded_sha256, lossless of all documents."""
    return encode(table(spark, sf_dir, "documents"))
