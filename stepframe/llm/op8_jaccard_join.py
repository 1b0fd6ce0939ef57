"""Jaccard join of n-gram sets as a blocked sparse matrix product, and the classes that its links form.

Rows of the matrix are distinct sets (documents with equal sets are one row), columns are shingles, dealt into blocks by
hash. Of each set only the columns that a match can't avoid go into the product: with a threshold of 3/4, two sets that match
share one of the first n - ceil(3n/4) + 1 columns of each in any common order. The order puts columns with high counts
over all documents last (counts in 2^SKETCH_BITS buckets, a bounded array), so common passages count only in documents that hold
little else. The order decides the cost alone, never the result. Columns that only one row holds go.

The product is taken in two passes, whose cost in a group of near copies grows with its rows and not with its pairs:

1. Each column adds to the overlaps of its rows with a hub, the most connected row of another class (at first each row is a class).
   Each row is checked against the ``BEST`` hubs of highest overlap on their whole sets, and the links merge classes; this
   is repeated with new hubs as long as many links are found.
2. All rows of a column that are still in different classes are paired, tile by tile of about ``TILE`` rows. A pair is
   kept only where sizes allow a match (4 min >= 3 max) and where what is left of both sets from that column on is enough for
   the overlap that a match needs, 3/7 of the summed sizes; overlaps are accumulated over the columns and held against that
   bound again. What stays is checked on whole sets. Pairs inside a class are not needed, so no link between classes is lost.

A column is a task's work up to ``HOT`` rows; where the counts allow more, such columns are counted and salted. The entries of a
block of columns stay together in one stored row, so a pass over them shuffles nothing but what a block says of its rows; entries that
no other entry of their column can match go at once.

Links to classes are components by star contraction.

Documents without words are empty: linked with nothing, not even each other. Null texts are empty; documents without an id are in no class. Repeated rows are rows of
their own; an empty table gives no rows; extra columns are not read. Hashes have 64 bits; sets count as equal when
size, sum and exclusive-or of their hashes agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepframe.llm.components import components
from stepframe.llm.shared import byte_slices, discard, lean, lean_cogroup, lean_group, ship, stored
from stepframe.llm.shingles import mixed, sets

SKETCH_BITS = 20
SKETCH_PARTS = 64
BLOCK_ENTRIES = 500_000
#: Rows of a column that a block takes; wider columns (the LISTED widest at most) are salted over several.
HOT = 1 << 16
LISTED = 1 << 20
#: Rows of a column on each side of a product of tiles.
TILE = 1024
#: Hubs that a row is checked against in a round; rounds end when fewer than one row in GAIN finds a link.
BEST = 3
GAIN = 50
ROUNDS = 8
#: Ids (8 bytes each) up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def _slices(batches, column: int):
    for part in byte_slices(batches, column):
        yield part, list(sets(part.column(column)))


def _bucket(columns: np.ndarray) -> np.ndarray:
    return (columns >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def column_counts(docs: DataFrame) -> np.ndarray:
    """In how many documents the shingles of each bucket occur: a bounded array over all documents."""
    size, width = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_PARTS

    def run(batches):
        total = np.zeros(size, np.int64)
        for _, found in _slices(batches, 0):
            total += np.bincount(_bucket(np.concatenate(found)), minlength=size)
        if total.any():
            packed = [zlib.compress(total[k * width : (k + 1) * width].astype("<u4").tobytes(), 1) for k in range(SKETCH_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array(packed, pa.binary())], ["part", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), "<u4").astype(np.int64) for x in pdf["n"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)]})

    out = np.zeros(size, np.uint32)
    sums = docs.select("text").mapInArrow(lean(run), "part int, n binary").groupBy("part").applyInPandas(lean_group(add), "part int, n binary")
    for r in sums.toLocalIterator():
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(zlib.decompress(r.n), "<u4")
    return out


def fingerprint(s: np.ndarray) -> int:
    """64-bit key of a set."""
    x = np.array([s.sum(dtype=np.uint64) if len(s) else 0, np.bitwise_xor.reduce(s) if len(s) else 0, len(s)], np.uint64)
    return int(mixed(mixed(mixed(x[:1]) ^ x[1:2]) + x[2:3]).view(np.int64)[0])


def prefix_length(n: np.ndarray | int):
    return n - (3 * n + 3) // 4 + 1


class Order:
    """The common order of the columns, by count, and the rows of hot columns."""

    def __init__(self, counts: np.ndarray, columns: np.ndarray, n: np.ndarray):
        turn = np.argsort(columns)
        self.counts, self.columns, self.n = counts, columns[turn], n[turn].astype(np.int64)

    def hot(self, columns: np.ndarray) -> np.ndarray:
        """Rows of hot columns, 0 for others."""
        if not len(self.columns):
            return np.zeros(len(columns), np.int64)
        at = np.minimum(np.searchsorted(self.columns, columns), len(self.columns) - 1)
        return np.where(self.columns[at] == columns, self.n[at], 0)

    def prefixes(self, found: list[np.ndarray]) -> list[np.ndarray]:
        """The columns of each set that count, in order."""
        place = self.counts[_bucket(np.concatenate(found))]
        out, at = [], 0
        for s in found:
            k = len(s)
            out.append(s[np.argsort(place[at : at + k], kind="stable")[: prefix_length(k)]] if k else s)
            at += k
        return out


def hot_columns(rows: DataFrame, counts: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the incidence with more than HOT rows, and how many. Only buckets that hold as many can have one; each task
    adds up its own part first, so such a column costs a number for each batch."""
    if counts.max(initial=0) <= HOT:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    may = rows.sparkSession.sparkContext.broadcast(np.packbits(counts > HOT))

    def run(batches):
        full = np.unpackbits(may.value).astype(bool)
        for b in batches:
            columns, n = np.unique(np.frombuffer(b"".join(x for x in b.column(0).to_pylist() if x), np.uint64), return_counts=True)
            columns, n = columns[k := full[_bucket(columns)]], n[k]
            if len(columns):
                block = (columns % np.uint64(blocks)).astype(np.int64)
                turn = np.argsort(block, kind="stable")
                used, cuts = np.unique(block[turn], return_index=True)
                pieces = [turn[i:j] for i, j in zip(cuts.tolist(), [*cuts.tolist(), len(turn)][1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([columns[x].tobytes() for x in pieces], pa.binary()), pa.array([n[x].astype("<u4").tobytes() for x in pieces], pa.binary())], ["block", "columns", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        columns, at = np.unique(np.frombuffer(b"".join(pdf["columns"]), np.uint64), return_inverse=True)
        total = np.bincount(at, np.frombuffer(b"".join(pdf["n"]), "<u4")).astype(np.int64)
        return pd.DataFrame({"column": columns[total > HOT].view(np.int64), "n": total[total > HOT]})

    counted = rows.select("columns").mapInArrow(lean(run), "block long, columns binary, n binary").groupBy("block").applyInPandas(lean_group(add), "column long, n long")
    found = counted.orderBy(F.desc("n"), "column").limit(LISTED).collect()  # 16 bytes each
    return np.array([r.column for r in found], np.int64).view(np.uint64), np.array([r.n for r in found], np.int64)


def incidence(docs: DataFrame, order) -> DataFrame:
    """doc_id, n, fp and the columns that count (binary, in order) of each document."""

    def run(batches):
        for b, found in _slices(batches, 1):
            held = order.value.prefixes(found)
            n, fp = [len(s) for s in found], [fingerprint(s) for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array([c.tobytes() for c in held], pa.binary())], ["doc_id", "n", "fp", "columns"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, fp long, columns binary")


_CELL = "block long, salt long, fps binary, ns binary, at binary, left binary, columns binary"


def in_blocks(rows: DataFrame, order, blocks: int) -> DataFrame:
    """The entries of each batch of distinct rows by block of columns; rows of a hot column are salted."""

    def run(batches):
        for b in batches:
            once = {fp: (n, c) for fp, n, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if n}
            out = []
            if once:
                fps, ns = np.array(list(once), np.int64), np.array([n for n, _ in once.values()], np.int64)
                columns = np.frombuffer(b"".join(c for _, c in once.values()), np.uint64)
                held = np.array([len(c) // 8 for _, c in once.values()], np.int64)
                at = np.repeat(np.arange(len(fps)), held)
                left = ns[at] - (np.arange(len(at)) - np.repeat(np.cumsum(held) - held, held))  # of the set, from this column on
                block = (columns % np.uint64(blocks)).astype(np.int64)
                salts = -(-order.value.hot(columns) // HOT)
                salt = np.where(salts > 1, 1 + (fps[at] & (2**62 - 1)) % np.maximum(salts, 1), 0)
                turn = np.lexsort((salt, block))
                cuts = np.flatnonzero(np.concatenate([[True], (block[turn][1:] != block[turn][:-1]) | (salt[turn][1:] != salt[turn][:-1])]))
                for i, j in zip(cuts.tolist(), [*cuts.tolist()[1:], len(turn)], strict=True):
                    own = turn[i:j]
                    used, local = np.unique(at[own], return_inverse=True)
                    out.append((block[own[0]], salt[own[0]], fps[used].tobytes(), ns[used].tobytes(), local.astype(np.int32).tobytes(), left[own].astype(np.int32).tobytes(), columns[own].tobytes()))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
            cols = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["block", "salt", "fps", "ns", "at", "left", "columns"])

    return rows.where("doc_id IS NOT NULL").select("fp", "n", "columns").mapInArrow(lean(run), _CELL)


#: A block of shared columns in one row: distinct rows with size, degree and label; distinct columns and how many entries each has; for each entry its row and what is left of it.
_BLOCK = "block long, salt long, fps binary, ns binary, degrees binary, labels binary, columns binary, held binary, at binary, left binary"


class Block:
    """The entries of a block of columns, sorted by column, as arrays."""

    def __init__(self, block, salt, fps, ns, degrees, labels, columns, at, left):
        self.block, self.salt, self.fps, self.ns, self.degrees, self.labels, self.columns, self.at, self.left = block, salt, fps, ns, degrees, labels, columns, at, left

    @classmethod
    def of(cls, r) -> Block:
        held = np.frombuffer(r.held, np.int32)
        own = [np.frombuffer(x, np.int64) for x in (r.fps, r.ns, r.degrees, r.labels)]
        return cls(r.block, r.salt, *own, np.repeat(np.frombuffer(r.columns, np.uint64), held), *(np.frombuffer(x, np.int32).astype(np.int64) for x in (r.at, r.left)))

    def row(self) -> tuple:
        columns, held = np.unique(self.columns, return_counts=True)
        rows = [x.tobytes() for x in (self.fps, self.ns, self.degrees, self.labels)]
        return (self.block, self.salt, *rows, columns.tobytes(), *(x.astype(np.int32).tobytes() for x in (held, self.at, self.left)))

    def kept(self, keep: np.ndarray) -> Block:
        used, at = np.unique(self.at[keep], return_inverse=True)
        return Block(self.block, self.salt, self.fps[used], self.ns[used], self.degrees[used], self.labels[used], self.columns[keep], at, self.left[keep])

    def opened(self) -> Block:
        """The entries of columns that hold several classes and that can still match another entry of their column: sizes allow
        a match, and so does what the entry's own row still holds. Only the smallest partner that sizes allow needs a look. A pair
        that can match keeps both its entries, so no link is lost. Salted columns are spread over blocks and stay whole."""
        if self.salt or not len(self.at):
            return self
        starts = np.flatnonzero(np.concatenate([[True], self.columns[1:] != self.columns[:-1]]))
        held = np.diff([*starts, len(self.at)])
        label = self.labels[self.at]
        several = np.maximum.reduceat(label, starts) != np.minimum.reduceat(label, starts)
        column, n = np.repeat(np.arange(len(starts)), held), self.ns[self.at]
        turn = np.lexsort((n, column))
        key = column[turn] * (1 << 36) + n[turn]
        own, size = np.arange(len(turn)), n[turn]
        y = np.searchsorted(key, column[turn] * (1 << 36) + (3 * size + 3) // 4)
        y = np.where(y == own, own + 1, y)
        inside = y < len(turn)
        y = np.minimum(y, len(turn) - 1)
        other = size[y]
        may = inside & (column[turn][y] == column[turn]) & (4 * size >= 3 * other) & (7 * self.left[turn] >= 3 * (size + other))
        keep = np.empty(len(turn), bool)
        keep[turn] = may
        return self.kept(keep & several[column])

    def met(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and the hubs of other classes that they meet, and in how many columns."""
        if not len(self.at):
            return (np.empty(0, np.int64),) * 3
        turn = np.lexsort((self.fps[self.at], self.degrees[self.at], self.columns))
        columns, at, left = self.columns[turn], self.at[turn], self.left[turn]
        last = np.flatnonzero(np.concatenate([columns[1:] != columns[:-1], [True]]))
        held = np.diff([-1, *last])
        column, label = np.repeat(np.arange(len(last)), held), self.labels[at]
        other = label != np.repeat(label[last], held)
        second = np.full(len(last), -1)
        np.maximum.at(second, column[other], np.flatnonzero(other))
        y = np.where(other, last[column], second[column])
        x = np.flatnonzero(y >= 0)
        y = y[x]
        n, m = self.ns[at[x]], self.ns[at[y]]
        may = (7 * np.minimum(n, m) >= 3 * (n + m)) & (7 * np.minimum(left[x], left[y]) >= 3 * (n + m))
        pair, c = np.unique(at[x][may] * len(self.fps) + at[y][may], return_counts=True)
        return self.fps[pair // len(self.fps)], self.fps[pair % len(self.fps)], c

    def entries(self) -> pd.DataFrame:
        return pd.DataFrame({"column": self.columns.view(np.int64), "fp": self.fps[self.at], "n": self.ns[self.at], "left": self.left, "degree": self.degrees[self.at], "label": self.labels[self.at]})


def _rows(blocks: list[Block]) -> pd.DataFrame:
    return pd.DataFrame([b.row() for b in blocks if len(b.at)], columns=["block", "salt", "fps", "ns", "degrees", "labels", "columns", "held", "at", "left"])


def shared_columns(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct entries of a block of columns without those of columns that one row holds."""
    fps = [np.frombuffer(x, np.int64) for x in pdf["fps"]]
    start = np.concatenate([[0], np.cumsum([len(x) for x in fps])])
    entry = np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) + s for x, s in zip(pdf["at"], start, strict=False)])
    columns = np.frombuffer(b"".join(pdf["columns"]), np.uint64)
    left = np.frombuffer(b"".join(pdf["left"]), np.int32).astype(np.int64)
    names, first, row = np.unique(np.concatenate(fps), return_index=True, return_inverse=True)
    sizes = np.frombuffer(b"".join(pdf["ns"]), np.int64)[first]
    row = row[entry]
    turn = np.lexsort((row, columns))
    columns, row, left = columns[turn], row[turn], left[turn]
    new = np.concatenate([[True], (columns[1:] != columns[:-1]) | (row[1:] != row[:-1])])
    block = Block(int(pdf["block"].iloc[0]), int(pdf["salt"].iloc[0]), names, sizes, np.zeros_like(names), names, columns, row, left)
    return _rows([block.kept(new).opened()])


def _renewed(blocks: DataFrame, told: DataFrame, what: str) -> DataFrame:
    """``blocks`` with ``what`` of their rows as ``told`` (block, salt, fp, value) says, open entries only."""

    def renew(cells: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out, fps = [], told["fp"].to_numpy(np.int64)
        turn = np.argsort(fps)
        fps, values = fps[turn], told["value"].to_numpy(np.int64)[turn]
        for r in cells.itertuples(index=False):
            b = Block.of(r)
            if len(fps):
                at = np.minimum(np.searchsorted(fps, b.fps), len(fps) - 1)
                setattr(b, what, np.where(fps[at] == b.fps, values[at], getattr(b, what)))
            out.append(b.opened())
        return _rows(out)

    return blocks.groupBy("block", "salt").cogroup(told.groupBy("block", "salt")).applyInPandas(lean_cogroup(renew), _BLOCK)


def rows_of(blocks: DataFrame) -> DataFrame:
    """block, salt, fp and the number of entries of each row of each block."""

    def run(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                b = Block.of(r)
                yield pd.DataFrame({"block": b.block, "salt": b.salt, "fp": b.fps, "c": np.bincount(b.at, minlength=len(b.fps))})

    return blocks.mapInPandas(lean(run), "block long, salt long, fp long, c long")


def with_degrees(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the number of entries of each row over all blocks (a row has at most one number for each block)."""
    told = rows_of(blocks).withColumn("value", F.sum("c").over(W.partitionBy("fp")))
    return _renewed(blocks, told.select("block", "salt", "fp", "value"), "degrees")


def with_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """``blocks`` with the classes of their rows, open entries only."""
    known = _small_side(labels.select(F.col("node").alias("fp"), F.col("label").alias("value")), labels.count())
    return _renewed(blocks, rows_of(blocks).join(known, "fp").select("block", "salt", "fp", "value"), "labels")


def met_in(blocks: DataFrame) -> DataFrame:
    """a, b, c: rows, the hubs that they meet in a block, and in how many columns."""

    def run(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame(dict(zip("abc", Block.of(r).met(), strict=True)))

    return blocks.mapInPandas(lean(run), "a long, b long, c long")


def entries_of(blocks: DataFrame) -> DataFrame:
    def run(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                yield Block.of(r).entries()

    return blocks.mapInPandas(lean(run), "column long, fp long, n long, left long, degree long, label long")


#: Sizes allow a match (4 min >= 3 max is 7 min >= 3 sum), and so does what both sets still hold.
_MAY = "7 * least(x.n, y.n) >= 3 * (x.n + y.n) AND 7 * least(x.left, y.left) >= 3 * (x.n + y.n)"


def open_entries(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The entries of salted columns that hold several classes, with the row's label and the two most connected rows of different classes."""
    marked = entries.select("column", "fp", "n", "left", "degree", "label")
    if labels is not None:
        known = _small_side(labels.withColumnRenamed("node", "fp"), labels.count())
        marked = marked.drop("label").join(known, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    hub = F.max(F.struct("degree", "fp", "n", "left", "label"))  # partial maxima: one row a column is shuffled
    one = marked.join(marked.groupBy("column").agg(hub.alias("h1")), "column")
    two = one.where(F.col("label") != F.col("h1.label")).groupBy("column").agg(hub.alias("h2"))  # dealt by column already
    return one.join(two, "column")


def met_salted(opened: DataFrame) -> DataFrame:
    """a, b, c: rows of salted columns, the hubs that they meet, and in how many columns."""
    x = F.struct("fp", "n", "left").alias("x")
    met = opened.select(x, F.when(F.col("label") != F.col("h1.label"), F.col("h1")).otherwise(F.col("h2")).alias("y")).where(_MAY)
    return met.groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).agg(F.count(F.lit(1)).alias("c"))


def with_hubs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows and hubs of other classes, the BEST of each row by overlap."""
    overlaps = met.repartition("a").groupBy("a", "b").agg(F.sum("c").alias("c"))
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("c"), "b"))
    found = overlaps.withColumn("rank", rank).where(F.col("rank") <= BEST)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def between_classes(opened: DataFrame) -> DataFrame:
    """All pairs (a, b) of rows of different classes that share an open column and can still match, tile by tile."""
    tiles = opened.groupBy("column").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tiled = opened.join(tiles, "column").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    keep = ["column", "lo", "hi", "fp", "n", "left", "label"]
    x = tiled.withColumn("lo", F.col("tile")).withColumn("hi", F.explode(F.expr("sequence(tile, tiles - 1)"))).select(*keep).alias("x")
    y = tiled.withColumn("hi", F.col("tile")).withColumn("lo", F.explode(F.expr("sequence(0, tile)"))).select(*keep).alias("y")
    same = F.expr(f"x.column = y.column AND x.lo = y.lo AND x.hi = y.hi AND x.label <> y.label AND (x.lo < x.hi OR x.fp < y.fp) AND {_MAY}")
    met = x.join(y, same).select(F.expr("least(x.fp, y.fp)").alias("a"), F.expr("greatest(x.fp, y.fp)").alias("b"), F.expr("x.n + y.n").alias("both"), F.expr("least(x.left, y.left)").alias("left"))
    # c columns are shared; the last leaves at most min(left) - 1 more
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("left").alias("left"), F.first("both").alias("both")).where("7 * (c - 1 + left) >= 3 * both").select("a", "b")


def _small_side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. The low 16 bits of all hashes go first: equal hashes have equal bits, so
    they bound the overlap from above and no match is lost; whole sets are moved for the pairs that are left."""
    return compared(compared(pairs, docs, classes, np.uint16), docs, classes, np.uint64)


def compared(pairs: DataFrame, docs: DataFrame, classes: DataFrame, kind: type) -> DataFrame:
    """The pairs (a, b) that reach the threshold by their sets' hashes, cut to ``kind``."""
    nodes = stored(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(classes, "fp").select("fp", F.col("least").alias("doc_id")), "to-check")
    texts = docs.select("doc_id", "text").join(_small_side(nodes, nodes.count()), "doc_id")

    def run(batches):
        for b, found in _slices(batches, 1):
            keep = [i for i, (s, fp) in enumerate(zip(found, b.column(0).to_pylist(), strict=True)) if fingerprint(s) == fp]  # not another row of that id
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i].astype(kind).tobytes() for i in keep], pa.binary())], ["fp", "held"])

    held = stored(texts.select("fp", "text").mapInArrow(lean(run), "fp long, held binary").dropDuplicates(["fp"]), "sets")

    def compare(batches):
        for b in batches:
            a = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)
                both = len(np.intersect1d(s, t, assume_unique=True)) if kind is np.uint64 else min(int(np.isin(s, t).sum()), int(np.isin(t, s).sum()))
                if 100 * both >= 75 * (len(s) + len(t) - both):
                    a.append(i)
            keep = pa.array(a, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    left, right = held.select(F.col("fp").alias("a"), F.col("held").alias("sa")), held.select(F.col("fp").alias("b"), F.col("held").alias("sb"))
    found = stored(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lean(compare), "a long, b long"), "matches")
    discard(held)
    discard(nodes)
    return found


def _replaced(cells: DataFrame, by: DataFrame) -> DataFrame:
    out = stored(by, "blocks")
    discard(cells)
    return out


def join_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = column_counts(docs)
    blocks = max(64, int(counts.sum(dtype=np.int64)) // (4 * BLOCK_ENTRIES))
    none = np.empty(0, np.uint64)
    order = spark.sparkContext.broadcast(Order(counts, none, none))  # 4 bytes x 2^SKETCH_BITS
    rows = stored(incidence(docs, order), "incidence")
    classes = stored(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "set-classes")
    hot = hot_columns(rows, counts, blocks)
    if len(hot[0]):
        order = spark.sparkContext.broadcast(Order(counts, *hot))  # and 16 bytes x LISTED at most
    cells = stored(in_blocks(rows, order, blocks).groupBy("block", "salt").applyInPandas(lean_group(shared_columns), _BLOCK), "blocks")
    cells = _replaced(cells, with_degrees(cells))
    n_rows = classes.count()
    salted = stored(open_entries(entries_of(cells.where("salt > 0")), None), "open-columns") if len(hot[0]) else None
    if salted is not None:
        cells = _replaced(cells, cells.where("salt = 0"))

    checked = links = labels = None
    for _ in range(ROUNDS):
        met = met_in(cells)
        more = with_hubs(met if salted is None else met.unionByName(met_salted(salted)))
        more = stored(more if checked is None else more.join(checked, ["a", "b"], "left_anti"), "candidates")
        found = verified(more, docs, classes)
        checked = more if checked is None else checked.unionByName(more)
        links = found if links is None else links.unionByName(found)
        labels = stored(components(links), "labels")
        cells = _replaced(cells, with_labels(cells, labels))
        salted = salted if salted is None else stored(open_entries(salted, labels), "open-columns")
        if GAIN * found.count() <= n_rows:
            break
    entries = entries_of(cells)
    if salted is not None:
        entries = entries.unionByName(salted.select(*entries.columns))
    more = stored(between_classes(entries).join(checked, ["a", "b"], "left_anti"), "candidates")
    if more.limit(1).count():
        links = links.unionByName(verified(more, docs, classes))
        labels = stored(components(links), "labels")

    linked = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    found = stored(linked.join(least, "label").select("fp", "component_id"), "class-components")
    found = _small_side(found, found.count())
    out = rows.select("doc_id", "n", "fp").join(found, "fp", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(own, "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with the document of the least id of each class; rows equal in id and text stay once."""
    found = stored(join_classes(docs, key, text), "classes")
    if found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates([key, text])
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    gone = _small_side(gone.withColumnRenamed("doc_id", "__copy_id"), gone.count())
    return docs.join(gone, docs[key].cast("long") == gone["__copy_id"], "left_anti")
