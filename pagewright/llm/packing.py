"""Best-fit packing with bound-certified repacking.

Documents are encoded, ended by one id and cut into pieces of at most the sequence's length; a
piece of the whole length is a sequence of its own. The other pieces are dealt over partitions of
about ``TARGET`` pieces, ``LEAST_PARTS`` at least, each packed by best-fit decreasing. Lower bounds
from dual feasible functions (the identity, the threshold family and the rounding family) certify
each partition's bin count, the last one's too. A partition whose count is over its bound gives up
its worst-filled bins, a certified one only its single worst bin; what is given up is dealt anew
over as many partitions as its number needs, three quarters of those before at most, and best-fit
decreasing runs again. Rounds end when one partition held all that was left, or when the next one's
partitions would hold more than ``MOST`` times ``TARGET`` pieces each, which is where bounds are
weak and rounds give up much: then the partitions keep what they packed.

Defined cases: a null text is empty (its one piece is the end id); repeated or null ids are packed
as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import word_bpe
from pagewright.llm.shared import small_batches, stored, text_of

LENGTH = 2048
END = 0
TARGET = 100_000
LEAST_PARTS = 4
MOST = 4
FIELDS = ("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", "moves")


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """No packing has fewer bins: the largest bound of three families of dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=length + 1)[: length + 1].astype(np.int64)
    x = np.arange(length + 1, dtype=np.int64)
    weight = np.cumsum(count * x)
    number = np.cumsum(count)
    half = length // 2
    t = np.arange(0, half + 1)
    below = np.where(t > 0, weight[np.maximum(t - 1, 0)], 0)
    middle = weight[length - t] - below
    large = number[length] - number[length - t]
    best = int((-(-(middle + large * length) // length)).max())
    for k in range(1, 33):
        exact = ((k + 1) * x) % length == 0
        scaled = np.where(exact, k * x, (k + 1) * x // length * length)  # times k
        best = max(best, -(-int((count * scaled).sum()) // (k * length)))
    return best


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: each item's bin and offset, each bin's free room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[int] = []
    at: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                rooms ^= 1 << room
        else:
            room, b = length, len(free)
            free.append(length)
        bins[i], offsets[i] = b, length - room
        free[b] = room = room - size
        if not at[room]:
            rooms |= 1 << room
        at[room].append(b)
    return bins, offsets, free


def released(free: list[int], bound: int) -> set[int]:
    """The bins whose items move on: none if all are full."""
    gap = len(free) - bound
    worst = sorted((b for b, room in enumerate(free) if room), key=lambda b: (-free[b], b))
    return set(worst[: 4 * gap + 1])


def _cut(path: str, length: int, batches):
    encode_all = word_bpe.table(path).encode_all
    end = END.to_bytes(4, "little")
    for b in batches:
        ids, rows = b.column("id").to_pylist(), ([], [], [], [], [])
        for doc, data in zip(ids, encode_all(b.column("text").to_pylist())):
            data += end
            for k, start in enumerate(range(0, len(data) // 4, length)):
                part = data[4 * start : 4 * (start + length)]
                for into, value in zip(rows, (doc, k, start, len(part) // 4, zlib.crc32(part))):
                    into.append(value)
        kinds = (b.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, kinds)], names=list(FIELDS[:5]))


def _pack(length: int, round_no: int, batches):
    """Packs each part that this task was dealt; a part is never spread over tasks."""
    parts: dict[int, list] = {}
    for b in batches:
        part = b.column("part").to_numpy()
        rows = b.drop_columns(["part"])
        for p in np.unique(part).tolist():
            parts.setdefault(p, []).append(rows.filter(pa.array(part == p)))
    for p, own in parts.items():
        rows = pa.Table.from_batches(own).combine_chunks()
        order = rows.sort_by([("rid", "ascending")])
        sizes = order.column("length").to_numpy().astype(np.int64)
        bins, offsets, free = best_fit(sizes, length)
        bound = lower_bound(sizes, length)
        moving = np.zeros(len(free), bool)
        moving[list(released(free, bound))] = True
        names = (round_no << 56) + (p << 24) + bins
        certified = np.full(len(bins), len(free) == bound)
        out = [*(order.column(n) for n in FIELDS[:5]), pa.array(names), pa.array(offsets), pa.array(certified), pa.array(moving[bins]), order.column("rid")]
        yield from pa.Table.from_arrays(out, names=[*FIELDS, "rid"]).to_batches(max_chunksize=20_000)


def best_fit_packing(df: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, certified (whether no
    packing of the partition that the piece was packed in last has fewer sequences)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    cut = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(
        functools.partial(_cut, tokenizer, length), f"id {kind}, piece int, start long, length long, ids_crc32 long"
    )
    pieces = stored(cut.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    alone = {"sequence_id": -1 - F.col("rid"), "offset": F.lit(0).cast("long"), "certified": F.lit(True)}
    done = pieces.where(F.col("length") == length).withColumns(alone).select(*FIELDS[:8])
    rest = pieces.where(F.col("length") < length)
    left = rest.count()
    parts, round_no = max(LEAST_PARTS, -(-left // target)), 0
    shape = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, certified boolean, moves boolean, rid long"
    while left:
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(round_no)), F.lit(parts)).cast("long")).repartition(parts, "part")
        packed = stored(dealt.mapInArrow(functools.partial(_pack, length, round_no), shape), "packed")
        moving = packed.where("moves")
        left = moving.count()
        fewer = min(-(-left // target), max(1, parts * 3 // 4))
        if parts == 1 or left > MOST * target * fewer:
            return done.unionByName(packed.select(*FIELDS[:8])).withColumnRenamed("id", id_col)
        done = done.unionByName(packed.where("not moves").select(*FIELDS[:8]))
        rest = moving.drop(*FIELDS[5:])
        parts, round_no = fewer, round_no + 1
    return done.withColumnRenamed("id", id_col)
