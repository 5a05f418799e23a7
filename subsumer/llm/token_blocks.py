"""Token ids of documents in files of patched frame-of-reference blocks.

A file is a row of frames, each of whole documents in ascending doc_id order, each ended by a line feed:

    magic "PFB1" | documents u32 | blocks u32 | tokens u64 | size of all that follows u64
    doc_ids i64 each | flags u8 each (1: the id is null) | lengths u32 each
    block starts u32 each, in bytes from the first block
    blocks: minimum u32 | width u8 | exceptions u8 | packed offsets | positions u8 each | full offsets u32 each
    crc32 of the frame up to here u32

A block has 128 ids (the last is filled up with its minimum). The minimum is subtracted; the width is the
smallest of WIDTHS that holds the PERCENTILE of the offsets; larger offsets are exceptions, whose packed place is 0.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, partitions_for, running_sum, small_join, table, text_of

MAGIC, BLOCK, PERCENTILE = b"PFB1", 128, 0.9
#: The widths in bits; 4 offsets fill whole bytes up to 16 bits, 2 above.
WIDTHS = np.array([0, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32])
HEAD = struct.Struct("<4sIIQQ")
#: Ids after which a frame is closed.
FRAME_IDS = 1 << 20
#: Frames of a file at most.
FILE_FRAMES = 16
#: Words and parts of words whose ids a Python worker keeps; texts that are cut, and words that the library gets, at once.
CACHE, TEXTS, TOGETHER = 600_000, 1000, 64


# --- blocks ---------------------------------------------------------------------------------------------------


def _packed(offsets: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 offsets below 2**width as rows of 16 * width bytes."""
    if not width:
        return np.zeros((len(offsets), 0), np.uint8)
    each = 4 if width <= 16 else 2
    lanes = offsets.astype(np.uint64).reshape(len(offsets), BLOCK // each, each)
    word = lanes[:, :, 0].copy()
    for i in range(1, each):
        word |= lanes[:, :, i] << np.uint64(i * width)
    size = each * width // 8
    return np.ascontiguousarray(word.astype("<u8").view(np.uint8).reshape(len(offsets), BLOCK // each, 8)[:, :, :size]).reshape(len(offsets), -1)


def _unpacked(rows: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(rows), BLOCK), np.uint32)
    each = 4 if width <= 16 else 2
    size = each * width // 8
    wide = np.zeros((len(rows), BLOCK // each, 8), np.uint8)
    wide[:, :, :size] = rows.reshape(len(rows), BLOCK // each, size)
    word = wide.view("<u8").reshape(len(rows), BLOCK // each)
    out = np.empty((len(rows), BLOCK // each, each), np.uint32)
    for i in range(each):
        out[:, :, i] = (word >> np.uint64(i * width)) & np.uint64((1 << width) - 1)
    return out.reshape(len(rows), BLOCK)


def _exceptions(starts: np.ndarray, widths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the place and the full offset of each exception stand, block by block."""
    ends = np.cumsum(counts)
    nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    first = np.repeat(starts + 6 + 16 * widths, counts)
    return first + nth, first + np.repeat(counts, counts) + 4 * nth


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts and the bytes of all blocks."""
    n = -(-len(ids) // BLOCK)
    values = np.empty(n * BLOCK, np.uint32)
    values[: len(ids)] = ids
    values = values.reshape(n, BLOCK)
    if len(ids) % BLOCK:
        values[-1, len(ids) % BLOCK :] = ids[len(ids) // BLOCK * BLOCK :].min()
    low = values.min(axis=1)
    offsets = values - low[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    bits = np.ceil(np.log2(np.partition(offsets, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(int)
    widths = WIDTHS[np.searchsorted(WIDTHS, bits)]
    out_of = offsets >= (np.uint64(1) << widths.astype(np.uint64))[:, None]
    counts = out_of.sum(axis=1)
    sizes = 6 + 16 * widths + 5 * counts
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else np.zeros(0, int)
    body = np.zeros(int(sizes.sum()), np.uint8)
    head = np.empty((n, 6), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4], head[:, 5] = widths, counts
    body[starts[:, None] + np.arange(6)] = head
    kept = np.where(out_of, 0, offsets)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if width:
            body[starts[rows][:, None] + 6 + np.arange(16 * width)] = _packed(kept[rows], int(width))
    rows, places = np.nonzero(out_of)
    at, full = _exceptions(starts, widths, counts)
    body[at] = places
    body[full[:, None] + np.arange(4)] = offsets[rows, places].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts.astype("<u4"), body.tobytes()


def decode_blocks(starts: np.ndarray, body: bytes, n_ids: int) -> np.ndarray:
    data, n = np.frombuffer(body, np.uint8), len(starts)
    starts = starts.astype(np.int64)
    head = data[starts[:, None] + np.arange(6)]
    low, widths, counts = np.ascontiguousarray(head[:, :4]).view("<u4").ravel(), head[:, 4].astype(int), head[:, 5].astype(int)
    out = np.empty((n, BLOCK), np.uint32)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        out[rows] = _unpacked(data[starts[rows][:, None] + 6 + np.arange(16 * width)], int(width))
    at, full = _exceptions(starts, widths, counts)
    out[np.repeat(np.arange(n), counts), data[at]] = np.ascontiguousarray(data[full[:, None] + np.arange(4)]).view("<u4").ravel()
    return (out + low[:, None]).reshape(-1)[:n_ids]


def read_range(starts: np.ndarray, body: bytes, first: int, last: int) -> np.ndarray:
    """Ids first to last - 1 of a frame: only the blocks that hold them are decoded."""
    if first >= last:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, -(-last // BLOCK)
    ids = decode_blocks(starts[a:b] - starts[a], body[int(starts[a]) : int(starts[b]) if b < len(starts) else len(body)], (b - a) * BLOCK)
    return ids[first - a * BLOCK : last - a * BLOCK]


# --- frames ---------------------------------------------------------------------------------------------------


def frame(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    starts, body = encode_blocks(ids)
    rest = b"".join(
        (
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            bytes(x is None for x in doc_ids),
            np.array(lengths, "<u4").tobytes(),
            starts.tobytes(),
            body,
        )
    )
    whole = HEAD.pack(MAGIC, len(doc_ids), len(starts), len(ids), len(rest) + 4) + rest
    return whole + struct.pack("<I", zlib.crc32(whole))


@dataclass
class Frame:
    doc_ids: list[int | None]
    lengths: np.ndarray
    starts: np.ndarray
    body: bytes
    n_ids: int

    def ids(self) -> np.ndarray:
        return decode_blocks(self.starts, self.body, self.n_ids)


def frames_in(content: bytes) -> Iterator[Frame]:
    view, at = memoryview(content), 0
    while at < len(content):
        magic, docs, blocks, n_ids, size = HEAD.unpack_from(content, at)
        end = at + HEAD.size + size
        if magic != MAGIC or len(content) < end or zlib.crc32(view[at : end - 4]) != struct.unpack_from("<I", content, end - 4)[0]:
            raise ValueError(f"no whole frame at byte {at}")
        p = at + HEAD.size
        doc_ids = np.frombuffer(content, "<i8", docs, p)
        null = np.frombuffer(content, np.uint8, docs, p + 8 * docs)
        lengths = np.frombuffer(content, "<u4", docs, p + 9 * docs)
        starts = np.frombuffer(content, "<u4", blocks, p + 13 * docs)
        yield Frame([None if z else int(x) for x, z in zip(doc_ids, null, strict=True)], lengths, starts, bytes(view[p + 13 * docs + 4 * blocks : end - 4]), n_ids)
        at = end + 1  # the line feed


# --- tokens ---------------------------------------------------------------------------------------------------

#: A file's normal forms and its pre-tokenizer's pattern, and words that the pattern cuts between Latin letters and
#: ASCII marks behind them. The marks never compose with letters, these letters stay letters in every normal form and in lower
#: case, and neither the apostrophe of the first alternatives nor the first character of an added token is among the marks.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS_AND_MARKS = "^(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!\"#$%&()*+,\\-./:;=>?@\\[\\\\\\]^_`{|}~]*)$"
_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """The ids of whole texts from a tokenizers file for which ASCII white space ends all tokens and is none itself.

    Texts are cut at ASCII white space and nowhere else: no normal form joins it with what stands beside it, so the library
    gives the words of a text the ids that it gives the text. A file for which that doesn't hold is refused. What is encoded
    is kept until there is too much; then what the latest texts hold stays. If the file has the NORMAL forms and the PATTERN
    and marks the ends of tokens, words of LETTERS_AND_MARKS are put together from those two, of which the letters are in lower
    case: what the normal forms and the pattern would leave as it is goes to the library without those steps.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        for a, space, b in product("aé1.", " \t\n\r\v\f", "aé1.\u0301"):
            if self._ids(a + space + b) != self._ids(a) + self._ids(b):
                raise ValueError(f"{file}: tokens go on behind white space")
        self.known: dict[str, bytes] = {}
        self.latest: dict[str, bytes] = {}
        config = json.loads(self.library.to_str())
        steps, suffix = config["pre_tokenizer"].get("pretokenizers") or [config["pre_tokenizer"]], config["model"].get("end_of_word_suffix")
        normal = (config["normalizer"] or {}).get("normalizers")
        self.cuts = bool(suffix) and steps[0].get("pattern") == {"Regex": PATTERN} and normal == NORMAL and all("<" in t["content"] for t in config["added_tokens"])
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        if self.cuts:
            self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
            steps = [{"type": "WhitespaceSplit"}, *steps[1:]]
            self.of_pieces = Tokenizer.from_str(json.dumps(config | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}}))

    @classmethod
    def at(cls, file: str) -> WordTokenizer:
        if file not in _TOKENIZERS:
            _TOKENIZERS[file] = cls(file)
        return _TOKENIZERS[file]

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, missing: list[str], pieces: bool) -> None:
        """Encodes many in one text. pieces: each has one token's end, which is the last of its ids; else the ids' places in the text tell their words."""
        groups = [missing[at : at + TOGETHER] for at in range(0, len(missing), TOGETHER)]
        encode = self.of_pieces.encode_batch_fast if pieces else self.library.encode_batch
        all_ids, all_ends, n = [], [], 0
        for group, e in zip(groups, encode([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1 if pieces else np.searchsorted([x for x, _ in e.offsets], np.cumsum([len(w) + 1 for w in group]))
            if len(ends) != len(group) or ends[-1] != len(ids):
                raise ValueError(f"{len(ends)} ends of tokens in {len(group)} words")
            all_ids.append(ids)
            all_ends.append(ends + n)
            n += len(ids)
        raw, ends = np.concatenate(all_ids).tobytes(), (4 * np.concatenate(all_ends)).tolist()
        self.known.update(zip(missing, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _kept(self, words: pa.Array, pieces: bool) -> pa.Array:
        """The ids of different words, from what is kept if they are there."""
        keys = words.to_numpy(zero_copy_only=False).tolist()
        self.known[""] = b""
        ids = list(map(self.known.get, keys))
        if missing := [w for w, own in zip(keys, ids, strict=True) if own is None]:
            self._learn(missing, pieces)
            ids = list(map(self.known.__getitem__, keys))
        self.latest.update(zip(keys, ids, strict=True))
        return pa.array(ids, pa.large_binary())

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of different words, four bytes each, little-endian."""
        if not self.cuts:
            return self._kept(words, False)
        cut = pc.extract_regex(words, LETTERS_AND_MARKS)
        letters, marks = pc.utf8_lower(pc.struct_field(cut, "letters")).dictionary_encode(), pc.struct_field(cut, "marks").dictionary_encode()
        both = [self._kept(x.dictionary, True).take(x.indices) for x in (letters, marks)]
        joint = pc.binary_join_element_wise(*both, pa.scalar(b"", pa.large_binary()))
        return pc.replace_with_mask(joint, cut.is_null(), self._kept(words.filter(cut.is_null()), False))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text behind the other, and how many each has; no text is null."""
        if len(self.known) > CACHE:
            self.known = self.latest
        self.latest = {}
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        _, places, raw = ids.buffers()
        places = np.frombuffer(places, np.int64, len(ids) + 1, 8 * ids.offset) if len(ids) else np.zeros(1, np.int64)
        bounds = places[np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))] // 4
        return np.frombuffer(raw or b"", "<u4", bounds[-1] - bounds[0], 4 * bounds[0]), np.diff(bounds)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, little-endian."""
        out: list[bytes] = []
        for at in range(0, len(texts), TEXTS):
            ids, lengths = self.encode_column(pa.array(texts[at : at + TEXTS], pa.string()))
            out += [x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        return out


# --- Spark ----------------------------------------------------------------------------------------------------


def in_ranges(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, ...) in partitions by ascending ranges of doc_id, null first, each sorted by all columns.

    The bounds are quantiles of doc_id alone, so that texts are read once; repartitionByRange would read them for its sample.
    Equal ids share a partition, rows with a null id too.
    """
    n = partitions_for(docs)
    least = docs.select(F.percentile_approx(F.col("doc_id").cast("double"), [i / n for i in range(1, n)], 100 * n)).head()[0]
    bounds = sorted(set(least or [0.0]))
    place = Bucketizer(splits=[-np.inf, *bounds, np.inf], inputCol="_at", outputCol="_range")
    placed = place.transform(docs.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-np.inf))))
    return placed.repartitionById(len(bounds) + 1, F.col("_range").cast("int")).select(*docs.columns).sortWithinPartitions(*docs.columns)


def write_ids(docs: DataFrame, path: str, *, tokenizer: str, end_id: int) -> None:
    """Writes the ids of docs (doc_id, text) under path: tokenizer's ids of the whole text, then end_id, for each row.

    Files and the frames in them are in ascending doc_id order (null first; repeated ids by text). Null and empty texts
    have the end id alone; repeated rows are written as often as they are; an empty table gives no frames. A frame ends behind
    the document that fills it, so a text of any length is in one. Other columns are ignored. The text source writes each frame as a line, so its commits keep failed attempts out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer.at(tokenizer)
        doc_ids, lengths, parts, held = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                ids, n = encoder.encode_column(some["text"])
                doc_ids += some["doc_id"].to_pylist()
                lengths += (n + 1).tolist()
                parts.append(np.insert(ids, np.cumsum(n), end_id))
                held += len(parts[-1])
                if held >= FRAME_IDS:
                    yield pa.record_batch({"value": pa.array([frame(doc_ids, lengths, np.concatenate(parts))], pa.binary())})
                    doc_ids, lengths, parts, held = [], [], [], 0
        if doc_ids:
            yield pa.record_batch({"value": pa.array([frame(doc_ids, lengths, np.concatenate(parts))], pa.binary())})

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    in_ranges(source).mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_FRAMES).text(path)


def read_ids(spark: SparkSession, path: str, *, digest_only: bool = False) -> DataFrame:
    """A row (file, doc_id, start_in_file, n_tokens, ids_crc32, ids) for each document in the files under path.

    digest_only leaves ids null. Documents come back as often as they were written; a null id stays null; a folder
    without frames gives no rows.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                start = 0
                for f in frames_in(content):
                    raw, at, rows = f.ids().astype("<u4").tobytes(), 0, []
                    for doc_id, n in zip(f.doc_ids, f.lengths.tolist(), strict=True):
                        own = raw[4 * at : 4 * (at + n)]
                        rows.append((file, doc_id, start + at, n, zlib.crc32(own), None if digest_only else np.frombuffer(own, "<u4").astype(np.int64)))
                        at += n
                    start += at
                    yield pd.DataFrame(rows, columns=["file", "doc_id", "start_in_file", "n_tokens", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(unpack, "file string, doc_id long, start_in_file long, n_tokens long, ids_crc32 long, ids array<long>")


def with_starts(read: DataFrame) -> DataFrame:
    """read_ids() with `start`: the ids of all documents before, over all files in the order in which they were written.

    That order is by the numbers of the task and of its file in the file's name. Files grow with the data: their bases are
    a distributed prefix sum, joined back by broadcast only if they were counted to be few.
    """
    read = table(read, "read-ids")

    def number(pattern: str) -> Column:
        return F.regexp_extract("file", pattern, 1).try_cast("long")

    sizes = read.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("task", number("part-(\\d+)-[^/]*$")).withColumn("nth", number("-c(\\d+)[^/]*$"))
    bases = running_sum(sizes, ["task", "nth", "file"], "n", "base").select("file", "base")
    return small_join(read, bases, ["file"]).withColumn("start", F.col("base") + F.col("start_in_file"))
