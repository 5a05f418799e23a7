"""Top-level elements of XML documents, cut from file splits: a scan for depth, a composition along each file, a scan that cuts.

A file is read as pieces that end at a ">", in splits. Where a split starts, neither the depth of the tree nor whether the text is inside a comment,
a CDATA section, an instruction, a document type or a quoted value is known. The first scan finds for every such start what the split makes of it:
the state at its end, its net depth and its least one. Composed along a file (a row a split), these say where each split starts; files
of one split need neither. The second scan cuts. What a split holds of an element that others began or end is put together by element.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import written

TEXT, COMMENT, CDATA, PI, DOCTYPE, SUBSET, DOUBLE, SINGLE = range(8)
#: What ends a state at a ">", less the ">".
_END = {COMMENT: "--", CDATA: "]]", PI: "?"}
#: Splits up to which their counted starts are broadcast.
BROADCAST_SPLITS = 20_000


def _in_tag(state: int, piece: str, at: int) -> int:
    """The state behind a piece of a tag from `at`: TEXT if the ">" behind it ends the tag, else the quotes that it is in."""
    while True:
        if state == TEXT:
            double, single = piece.find('"', at), piece.find("'", at)
            if double < 0 and single < 0:
                return TEXT
            state, at = (DOUBLE, double + 1) if single < 0 or 0 <= double < single else (SINGLE, single + 1)
        at = piece.find('"' if state == DOUBLE else "'", at)
        if at < 0:
            return state
        state, at = TEXT, at + 1


def step(state: int, piece: str) -> tuple[int, int, int]:
    """(state, change of depth, place of an element's start or -1) behind a piece and its ">". A start tag counts from its "<", so an open one is a depth already."""
    if state == TEXT:
        at = piece.find("<")
        if at < 0:
            return TEXT, 0, -1
        kind = piece[at + 1 : at + 2]
        if kind == "/":
            return TEXT, -1, -1
        if kind == "?":
            return (TEXT if piece.endswith("?") and len(piece) > at + 2 else PI), 0, -1
        if kind == "!":
            if piece.startswith("<!--", at):
                return (TEXT if piece.endswith("--") and len(piece) >= at + 6 else COMMENT), 0, -1
            if piece.startswith("<![CDATA[", at):
                return (TEXT if piece.endswith("]]") and len(piece) >= at + 11 else CDATA), 0, -1
            if "[" not in piece[at:]:
                return TEXT, 0, -1
            return (TEXT if piece.rstrip().endswith("]") else SUBSET), 0, -1
        state = _in_tag(TEXT, piece, at)
        return state, 0 if state == TEXT and piece.endswith("/") else 1, at
    if state in _END:
        return (TEXT if piece.endswith(_END[state]) else state), 0, -1
    if state in (DOUBLE, SINGLE):
        state = _in_tag(state, piece, 0)
        return state, -1 if state == TEXT and piece.endswith("/") else 0, -1
    if state == DOCTYPE:
        return (SUBSET if "[" in piece else TEXT), 0, -1
    return (TEXT if piece.rstrip().endswith("]") else SUBSET), 0, -1


class _Ways:
    """What a split makes of every state that it may start in; states that meet go on together."""

    def __init__(self, starts: range) -> None:
        # state now: [net, least, most, {start: (net, least, most) when it joined}]
        self.now = {s: [0, 0, 0, {s: (0, 0, 0)}] for s in starts}

    @staticmethod
    def _whole(way: list) -> dict[int, tuple[int, int, int]]:
        net, least, most, starts = way
        return {s: (n + net, min(a, n + least), max(b, n + most)) for s, (n, a, b) in starts.items()}

    def add(self, piece: str) -> None:
        moved: dict[int, list] = {}
        for state, way in self.now.items():
            end, change, _ = step(state, piece)
            way[0] += change
            way[1], way[2] = min(way[1], way[0]), max(way[2], way[0])
            moved[end] = [0, 0, 0, self._whole(moved[end]) | self._whole(way)] if end in moved else way
        self.now = moved

    def rows(self) -> list[tuple[int, ...]]:
        return [(s, end, *w) for end, way in self.now.items() for s, w in self._whole(way).items()]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, whole, value): pieces in order within a split, the split's start, and whether it is the whole file."""
    rows = spark.read.option("lineSep", ">").text(path)
    m = "_metadata."
    return rows.select(F.col(m + "file_path").alias("file"), F.col(m + "file_block_start").alias("start"), (F.col(m + "file_block_length") >= F.col(m + "file_size")).alias("whole"), "value")


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each way through each split."""
    key, ways = None, None

    def out() -> pd.DataFrame:
        return pd.DataFrame([(*key, *w) for w in ways.rows()], columns=["file", "start", "s", "e", "net", "least", "most"])

    for batch in batches:
        for f, start, value in zip(batch["file"], batch["start"], batch["value"], strict=True):
            if key != (f, start):
                if key:
                    yield out()
                key, ways = (f, start), _Ways(range(8) if start else range(1))
            ways.add(value)
    if key:
        yield out()


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """Where each split of a file starts: state, depth (-1 behind the root), and the start of the split that began the element open there."""
    out, state, depth, owner = [], TEXT, 0, -1
    for start, ways in rows.groupby("start", sort=True):
        out.append((rows["file"].iloc[0], start, state, depth, owner))
        if depth < 0:
            continue
        way = ways[ways["s"] == state].iloc[0]
        if depth + way["least"] <= 1:
            owner = start
        opened = depth + way["most"] > 0
        depth, state = depth + way["net"], way["e"]
        if opened and not depth:  # the root is closed
            depth, state = -1, TEXT
    if depth > 0 or state != TEXT:
        raise ValueError("an XML document ends before its root does")
    return pd.DataFrame(out, columns=["file", "start", "state", "depth", "owner"])


CUT = "file string, owner long, start long, seq long, part boolean, xml string"


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements at depth 1 (seq: their number in the split), what the split holds of others (part), and what is before them in the file (owner is -1)."""
    key, state, depth, owner, seq, held, before, whole = None, TEXT, 0, -1, 0, [], [], True

    def ended() -> list[tuple]:
        if key and whole and (depth > 0 or state != TEXT):
            raise ValueError("an XML document ends before its root does")
        rest = [(key[0], owner, key[1], -1, True, "".join(held))] if held else []
        return rest + ([(key[0], -1, key[1], -1, True, "".join(before))] if before else [])

    for batch in batches:
        out: list[tuple] = []
        for f, start, one, s, d, o, value in zip(*(batch[c] for c in ("file", "start", "whole", "state", "depth", "owner", "value")), strict=True):
            if key != (f, start):
                out += ended()
                key, state, depth, owner, seq, held, before, whole = (f, start), s, d, o, 0, [], [], one
                mine = depth <= 1
            if depth < 0:
                continue
            was, own = state, depth
            state, change, at = step(state, value)
            depth += change
            if own == 0 or own == 1 and was in (DOUBLE, SINGLE):  # up to the end of the root's tag
                before.append(value + ">")
                if own and not depth or not own and at >= 0 and not change:
                    depth, before = -1, []  # an empty root
                continue
            if own == 1:
                if depth == 0:
                    depth = -1
                elif at >= 0:
                    mine, owner, held = True, start, [value[at:] + ">"]
            else:
                held.append(value + ">")
            if held and depth == 1:
                out.append((f, owner, start, seq if mine else -1, not mine, "".join(held)))
                seq, mine, held = seq + 1, True, []
        yield pd.DataFrame(out, columns=["file", "owner", "start", "seq", "part", "xml"])
    yield pd.DataFrame(ended(), columns=["file", "owner", "start", "seq", "part", "xml"])


def top_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, owner, seq, xml, prolog) of each element right below a document's root: its place, its text, and all that is before the first one, up to the root's tag.
    file is the path, so places are in the order of the files' names.

    Files may be larger than a split, with any line ends or none; a ">" may stand wherever XML lets it. Elements of any size: what a
    task holds is an element at most. A document that ends within its root raises an error.
    """
    pieces = _pieces(spark, path)
    ways = written(pieces.where(~F.col("whole")).mapInPandas(_ends, "file string, start long, s int, e int, net int, least int, most int"), "ways")
    if ways.head(1):
        starts = written(ways.groupBy("file").applyInPandas(_composed, "file string, start long, state int, depth int, owner long"), "starts")
        few = starts.count() <= BROADCAST_SPLITS
        placed = pieces.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(starts) if few else starts, ["file", "start"], "left")
        if not few:
            placed = placed.repartition("file", "start").sortWithinPartitions("file", "start", "_at")
    else:
        placed = pieces.withColumns({"state": F.lit(None).cast("int"), "depth": F.lit(None).cast("int"), "owner": F.lit(None).cast("long")})
    columns = [F.coalesce("state", F.lit(TEXT)).alias("state"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("owner", F.lit(-1)).alias("owner")]
    cut = written(placed.select("file", "start", "whole", *columns, "value").mapInPandas(_cut, CUT), "elements")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "xml"))), lambda x: x["xml"]), "")
    parts = cut.where("part").groupBy("file", "owner").agg(joined.alias("xml"))
    prolog = parts.where("owner = -1").select("file", F.col("xml").alias("prolog"))
    elements = cut.where(~F.col("part")).select("file", "owner", "seq", "xml").union(parts.where("owner >= 0").select("file", "owner", F.lit(1 << 62).alias("seq"), "xml"))
    return elements.join(prolog, "file")
