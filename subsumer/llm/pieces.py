"""SentencePiece encoding with seeded merge-dropout, and decoding.

Pieces are merged from an agenda, best score first and leftmost first among equals, as a model of the merge type
does; each candidate that comes up is skipped if a keyed hash says so. The hash's key is the seed, the document's id
and copy, the place of the word in it, the merge and its place in the word: reruns agree, and every occurrence of a
word draws for itself. Dropout 0 is the model's own encoding.

The words of many texts go through the agenda together, a column of arrays each. The distinct ones are merged without
dropout first, and the candidates that come up are noted: an occurrence that skips none of them has those pieces.
The others are merged again with their own draws. Nothing is kept from one batch to the next.

Decoding gives every text back byte for byte: characters without a piece, and the white space mark itself where
a text holds it, are written as byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_of

#: The mark that pieces have for a space; the types of pieces in a model file.
MARK = "▁"
NORMAL, BYTE = 1, 6
#: Lengths of words whose columns are merged together, with the space before them; longer words go one by one.
LENGTHS = (4, 6, 8, 10, 13, 17, 24, 40, 63)
#: Words, and cells of a group's columns, that are merged at a time.
WORDS, CELLS = 100_000, 1 << 19
#: A slot of a column, in the low bits of an agenda's entries; no entry.
SLOT_BITS, NOTHING = 6, np.int32(2**31 - 1)
_RUNS = re.compile(" +[^ \n]*|\n[^ \n]*")
_CODECS: dict[tuple, Codec] = {}
#: Odd factors of the hash: of places of words and copies, and of the seed.
_STEP, _SEED = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M1, _M2, _ALL = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1


def _mix(h: int) -> int:
    h = ((h ^ (h >> 30)) * _M1) & _ALL
    h = ((h ^ (h >> 27)) * _M2) & _ALL
    return h ^ (h >> 31)


def _mixed(h: np.ndarray) -> np.ndarray:
    """_mix() of each of an array, which is overwritten."""
    for shift, factor in ((30, _M1), (27, _M2)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Pairs:
    """The piece that two neighbouring symbols make, by a hash table with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int], symbols: int) -> None:
        self.symbols = symbols
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.pieces = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        for (a, b), piece in pairs.items():
            key = a * symbols + b
            at = ((key * _STEP) & _ALL) >> (64 - bits)
            while self.keys[at] >= 0:
                at = (at + 1) & self.last
            self.keys[at], self.pieces[at] = key, piece

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        key = np.minimum(a, self.symbols - 1).astype(np.int64) * self.symbols + np.minimum(b, self.symbols - 1)
        at = ((key.view(np.uint64) * np.uint64(_STEP)) >> self.shift).astype(np.intp)
        own = self.keys[at]
        out = np.where(own == key, self.pieces[at], np.int32(-1))
        on = np.flatnonzero((own != key) & (own >= 0))
        while len(on):
            at_on = at[on] = (at[on] + 1) & self.last
            own = self.keys[at_on]
            hit = own == key[on]
            out[on[hit]] = self.pieces[at_on[hit]]
            on = on[~hit & (own >= 0)]
        return out


@dataclass(frozen=True)
class Dropout:
    """model: a SentencePiece model file of the merge type with byte fallback, the same path on all machines."""

    model: str
    dropout: float = 0.1
    seed: int = 5


class Codec:
    def __init__(self, settings: Dropout) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(settings.model, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model must be of the merge type, with byte fallback")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("pieces that go on behind a space aren't supported")
        # the agenda's order: by score, best first
        order = {s: r for r, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.rank = {p.piece: order[p.score] for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b"" for p in proto.pieces]
        self.limit = int(settings.dropout * (1 << 32))
        self.seed = zlib.crc32(str(settings.seed).encode())
        # symbols: the pieces, then other characters of pieces, then one that is no symbol, then all code points
        chars = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.chars = np.array([ord(c) for c in chars], np.int32)
        self.none = len(proto.pieces) + len(chars)
        symbol = self.ids | {c: len(proto.pieces) + i for i, c in enumerate(chars)}
        self.pairs = _Pairs({(symbol[p[:i]], symbol[p[i:]]): self.ids[p] for p in self.ids for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol}, self.none + 1)
        self.ranks = np.array([order[p.score] << SLOT_BITS for p in proto.pieces], np.int32)
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + np.int32(self.none + 1)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        # a space is the mark; the mark itself and line feeds are bytes
        self.symbol_of[ord(" ")] = symbol.get(MARK, self.none + 1 + ord(MARK))
        for c in (ord(MARK), ord("\n")):
            self.symbol_of[c] = self.none + 1 + c
        self.id_of_byte = np.array([self.byte_ids[b] for b in range(256)], np.int32)

    @classmethod
    def at(cls, settings: Dropout) -> Codec:
        key = (settings.model, settings.dropout, settings.seed)
        if key not in _CODECS:
            _CODECS[key] = cls(settings)
        return _CODECS[key]

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]

    def segment(self, symbols: list[str | None], at: int, skip: Callable[[int], bool]) -> list[int]:
        """The pieces' ids of a run of characters that starts at a place of its word; a symbol that isn't a piece becomes bytes. skip: of each candidate's code (its merge and the two ends of its left symbol), in the agenda's order."""
        n, rank, ids = len(symbols), self.rank, self.ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(rank[p], i, i + 1, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or len(a) + len(b) != len(piece):
                continue
            if skip((ids[piece] << 42 ^ (at + left) << 21 ^ (at + right)) & _ALL):
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
                if (p := piece + symbols[nxt]) in rank:
                    heapq.heappush(agenda, (rank[p], left, nxt, p))
            if (prv := before[left]) >= 0 and (p := symbols[prv] + piece) in rank:
                heapq.heappush(agenda, (rank[p], prv, left, p))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if (i := ids.get(s)) is not None:
                out.append(i)
            else:
                for char in s:
                    out += self._fallback(char)
        return out

    def word(self, word: str, key: int) -> bytes:
        """The ids of a word whose draws are keyed by key, by an agenda of its own.

        word: a line feed and what stands behind it up to a space, or spaces and what stands behind; else with one space put before.
        """
        limit = self.limit
        skip = (lambda code: _mix((key + code) & _ALL) >> 32 < limit) if limit else lambda code: False
        if word[:1] == "\n":
            head, rest, at = self._fallback("\n"), word[1:], 1
        else:
            head, rest, at = [], word if word[:1] == " " else " " + word, 0
        # the mark itself, where a text holds it, must stay apart from marks for spaces
        for i, part in enumerate(rest.split(MARK)):
            if i:
                head += self._fallback(MARK)
                at += 1
            if part:
                head += self.segment(list(part.replace(" ", MARK)), at, skip)
                at += len(part)
        return np.array(head, "<u4").tobytes()

    def _merge(self, symbols: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of columns of symbols (none below a word's end and in the last row) when their agendas are empty.

        With keys (a draw's for each column) candidates are skipped; without, the codes of all candidates come
        back too, column by column in the agenda's order, and how many each column has.
        """
        rows, n = symbols.shape
        last = rows - 1
        slots = np.arange(rows, dtype=np.int32)[:, None]
        out, where = symbols.copy(), np.arange(n)
        s = symbols.copy()
        piece = np.full((rows, n), -1, np.int32)
        piece[:-1] = self.pairs(s[:-1].ravel(), s[1:].ravel()).reshape(-1, n)
        agenda = np.where(piece >= 0, self.ranks[piece] + slots, NOTHING)
        after, before = np.repeat(slots + 1, n, axis=1), np.repeat(slots - 1, n, axis=1)
        before[0] = last
        noted: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            least = agenda.min(axis=0)
            on = np.flatnonzero(least != NOTHING)
            if not len(on):
                break
            if 2 * len(on) < n:
                out[:, where] = s
                s, piece, agenda, after, before = (np.ascontiguousarray(x[:, on]) for x in (s, piece, agenda, after, before))
                where, least, n = where[on], least[on], len(on)
                on = np.arange(n)
            left = (least[on] & ((1 << SLOT_BITS) - 1)).astype(np.intp)
            at = left * n + on
            right = after.ravel()[at].astype(np.intp)
            merged = piece.ravel()[at]
            agenda.ravel()[at] = NOTHING
            code = (merged.astype(np.uint64) << np.uint64(42)) ^ (left.astype(np.uint64) << np.uint64(21)) ^ right.astype(np.uint64)
            if keys is None:
                noted.append((where[on], code))
            else:
                taken = (_mixed(code + keys[where[on]]) >> np.uint64(32)) >= self.limit
                on, left, right, at, merged = on[taken], left[taken], right[taken], at[taken], merged[taken]
            at_right = right * n + on
            nxt, prv = after.ravel()[at_right].astype(np.intp), before.ravel()[at].astype(np.intp)
            s.ravel()[at], s.ravel()[at_right] = merged, self.none
            agenda.ravel()[at_right] = NOTHING
            after.ravel()[at], before.ravel()[nxt * n + on] = nxt, left
            for first, a, b in ((left, merged, s.ravel()[nxt * n + on]), (prv, s.ravel()[prv * n + on], merged)):
                new = self.pairs(a, b)
                place = first * n + on
                piece.ravel()[place] = new
                agenda.ravel()[place] = np.where(new >= 0, self.ranks[new] + first.astype(np.int32), NOTHING)
        out[:, where] = s
        counts = np.zeros(symbols.shape[1], np.intp)
        for columns, _ in noted:
            counts[columns] += 1
        begin = np.cumsum(counts) - counts
        codes = np.empty(int(counts.sum()), np.uint64)
        for step, (columns, code) in enumerate(noted):
            codes[begin[columns] + step] = code
        return out, codes, counts

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of columns of symbols, one column behind the other, and how many each has."""
        rows = symbols.T
        there = rows != self.none
        found, counts = rows[there], there.sum(axis=1)
        n_pieces = self.none - len(self.chars)
        if len(self.chars):
            other = (found >= n_pieces) & (found < self.none)
            found[other] = self.chars[found[other] - n_pieces] + self.none + 1
        odd = found > self.none
        if odd.any():
            point = np.where(odd, found - (self.none + 1), 0)
            point[(point >= 0xD800) & (point < 0xE000)] = ord("?")
            width = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
            of_column = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(of_column, width, len(counts)).astype(np.intp)
            rest = np.repeat(np.cumsum(width), width) - 1 - np.arange(int(width.sum()))  # bytes that follow of the same character
            point, width, odd, found = (np.repeat(x, width) for x in (point, width, odd, found))
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.int32)[width]
            byte = np.where(rest == width - 1, lead | point >> (6 * rest), 0x80 | (point >> (6 * rest)) & 0x3F)
            found = np.where(odd, self.id_of_byte[byte & 0xFF], found)
        return found, counts

    def _words(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and keys, as word() gives them, one word behind the other, and how many each has."""
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        own = np.fromiter(map(number.__getitem__, words), np.intp, len(words))
        sizes = np.fromiter(map(len, number), np.intp, len(number))
        points = np.frombuffer("".join(number).encode("utf-32-le", "surrogatepass"), "<u4")
        begin = np.cumsum(sizes) - sizes
        first = points[begin]
        put = ((first != 32) & (first != 10)).astype(np.intp)
        group = np.searchsorted(LENGTHS, sizes + put)

        pool, used = [], 0
        start, count = np.zeros(len(words), np.intp), np.zeros(len(words), np.intp)

        def keep(ids: np.ndarray, counts: np.ndarray, to: np.ndarray, of: np.ndarray | slice) -> None:
            nonlocal used
            start[to], count[to] = (used + np.cumsum(counts) - counts)[of], counts[of]
            pool.append(ids)
            used += len(ids)

        place = np.zeros(len(number), np.intp)
        in_order = np.argsort(group[own], kind="stable")
        of_group = np.searchsorted(group[own][in_order], np.arange(len(LENGTHS) + 2))
        for g, length in enumerate(LENGTHS):
            mine, theirs = np.flatnonzero(group == g), in_order[of_group[g] : of_group[g + 1]]
            step = CELLS // (length + 1)
            for a in range(0, len(mine), step):
                some = mine[a : a + step]
                symbols = np.full((length + 1, len(some)), self.none, np.int32)
                symbols[0, put[some] > 0] = self.symbol_of[32]
                columns = np.repeat(np.arange(len(some)), sizes[some])
                symbols[_ranges(put[some], sizes[some]), columns] = self.symbol_of[points[_ranges(begin[some], sizes[some])]]
                merged, codes, n_codes = self._merge(symbols, None)
                ids, counts = self._ids(merged)
                place[:] = -1
                place[some] = np.arange(len(some))
                occurring = theirs if len(some) == len(mine) else theirs[place[own[theirs]] >= 0]
                at = place[own[occurring]]
                keep(ids, counts, occurring, at)
                if not self.limit:
                    continue
                code_start = np.cumsum(n_codes) - n_codes
                for b in range(0, len(occurring), step):
                    drawn, col = occurring[b : b + step], at[b : b + step]
                    n = n_codes[col]
                    h = _mixed(codes[_ranges(code_start[col], n)] + np.repeat(keys[drawn], n))
                    skips = np.zeros(len(drawn), bool)
                    skips[np.repeat(np.arange(len(drawn)), n)[(h >> np.uint64(32)) < self.limit]] = True
                    if skips.any():
                        again = drawn[skips]
                        keep(*self._ids(self._merge(symbols[:, col[skips]], keys[again])[0]), again, slice(None))
        for i in in_order[of_group[len(LENGTHS)] :].tolist():
            ids = np.frombuffer(self.word(words[i], int(keys[i])), "<u4").astype(np.int32)
            keep(ids, np.array([len(ids)]), np.array([i]), slice(None))
        found = np.concatenate(pool) if pool else np.zeros(0, np.int32)
        return found[_ranges(start, count)], count

    @staticmethod
    def split(text: str) -> list[str]:
        spaced = text.replace("\n", " \n")
        if "  " in spaced or spaced[0] == " " or spaced[-1] == " ":
            return _RUNS.findall(" " + text)
        return spaced.split(" ")

    def keys_of(self, n: int, key: int, copy: int = 0) -> np.ndarray:
        """What the draws of a text's n words are keyed by, of its key and copy."""
        text_key = _mix((_mix((key + self.seed * _SEED) & _ALL) + copy * _STEP) & _ALL)
        return _mixed(np.arange(n, dtype=np.uint64) * np.uint64(_STEP) + np.uint64(text_key))

    def encode_all(self, texts: list[str], keys: list[int], copies: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text behind the other, and how many each has."""
        split = [self.split(t) if t else [] for t in texts]
        sizes = np.array([len(x) for x in split], np.intp)
        words = [w for x in split for w in x]
        own = [self.keys_of(len(x), int(k), int(c)) for x, k, c in zip(split, keys, copies, strict=True)]
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.intp)
        parts = [self._words(words[at : at + WORDS], k) for at, k in _slices(np.concatenate(own), WORDS)]
        of_text = np.repeat(np.arange(len(texts)), sizes)
        counts = np.bincount(of_text, np.concatenate([n for _, n in parts]), len(texts)).astype(np.intp)
        return np.concatenate([ids for ids, _ in parts]), counts

    def encode(self, texts: list[str], keys: list[int], copies: list[int] | None = None) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian. keys, copies: what a text's draws are keyed by."""
        out: list[bytes] = []
        for at, stop in _batches(texts):
            ids, counts = self.encode_all(texts[at:stop], keys[at:stop], copies[at:stop] if copies else [0] * (stop - at))
            out += [x.astype("<i4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the text; the space that encoding puts before a text goes."""
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:]


def _slices(x: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(x), size):
        yield at, x[at : at + size]


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about 6 * WORDS characters, or of one longer text."""
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > 6 * WORDS:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def encoded(settings: Dropout, doc_id: Column, text: Column) -> Column:
    """The ids of each whole text, array<int>. Null and empty texts have none; a null doc_id counts as 0."""

    @F.pandas_udf("array<int>")
    def encode(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, "<i4") for x in Codec.at(settings).encode(texts.tolist(), ids.tolist())])

    return encode(F.coalesce(doc_id.cast("long"), F.lit(0)), text_of(text))


def encoded_rows(settings: Dropout, docs: DataFrame, copy: Column | None = None, *, with_text: bool = False) -> DataFrame:
    """(doc_id, source, ids) of docs, as encoded() gives them, some hundred texts at a time: a task holds no more ids than theirs.

    copy: the number of a document's copy, from 0; copies draw for themselves. with_text: the text (empty for null) comes last.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(settings)
        for batch in batches:
            texts, keys, copies = (batch.column(c).to_pylist() for c in ("text", "key", "copy"))
            for at, stop in _batches(texts):
                ids, counts = codec.encode_all(texts[at:stop], keys[at:stop], copies[at:stop])
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                part = batch.slice(at, stop - at)
                out = {"doc_id": part["doc_id"], "source": part["source"], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))}
                yield pa.RecordBatch.from_pydict(out | {"text": part["text"]} if with_text else out)

    bounded_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), text_of("text").alias("text"), F.coalesce(doc_id, F.lit(0)).alias("key"), (F.lit(0) if copy is None else copy).cast("long").alias("copy"))
    return rows.mapInArrow(encode, "doc_id long, source string, ids array<int>" + ", text string" * with_text)


def decoded(settings: Dropout, ids: Column) -> Column:
    """The text of each array of ids; null stays null."""

    @F.pandas_udf("string")
    def decode(arrays: pd.Series) -> pd.Series:
        codec = Codec.at(settings)
        return pd.Series([None if a is None else codec.decode(np.asarray(a)).decode("utf-8", "replace") for a in arrays])

    return decode(ids)


def round_trips(settings: Dropout, docs: DataFrame) -> DataFrame:
    """(doc_id, ids, n_pieces, ids_crc32, lossless) of docs: the ids of encoded_rows(), and whether decoded() gives the text back."""

    @F.pandas_udf("long")
    def digest(arrays: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.asarray(a, "<i4").tobytes()) for a in arrays])

    rows = encoded_rows(settings, docs, with_text=True)
    lossless = decoded(settings, F.col("ids")) == F.col("text")
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), digest("ids").alias("ids_crc32"), lossless.alias("lossless"))
