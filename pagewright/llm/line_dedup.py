"""Line dedup by content-defined line chunks.

Every line begins a window of ``LEAST_LINES`` lines. A window that occurred before, by document and
place, is removed, so any run of two or more lines that stands earlier goes whole, and the first
occurrence of each line stays. A digest names candidates; before a window goes, its bytes are
compared with those of the first. A window does not repeat one that it overlaps, and lines without
a word make no window.

Chunks describe a text: a rolling hash over the last ``ROLL`` line hashes ends one where it falls on
one of ``EVERY`` values, so an inserted or missing line shifts no later boundary. A chunk counts as
removed when all of its lines are.

Only digests and places shuffle at first. Documents meet their candidate windows in one shuffled
hash join, which reads out the candidates' bytes, and their removals in another; neither sorts
texts. A window that a third of all documents share is many rows of one digest: they are counted by
partial sums, and the joins on the digest are plain, so that adaptive execution may split them.

Defined cases: null texts are empty; lines end at line feeds; rows that repeat id and text are one
document and each get its result; a null id comes after all others; empty tables and other columns
pass.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import small_batches, stored, text_of

ROLL = 2
EVERY = 3
LEAST_LINES = 2
_MASK = (1 << 64) - 1


def chunks(text: str, every: int = EVERY) -> list[list[str]]:
    """The lines of a text in chunks; line feeds go between lines and between chunks."""
    out: list[list[str]] = [[]]
    rolling: list[int] = []
    for line in text.split("\n"):
        rolling = [*rolling, xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))][-ROLL:]
        out[-1].append(line)
        mark = 0
        for h in rolling:
            mark = (mark * 0x9E3779B97F4A7C15 + h) & _MASK
        if len(rolling) == ROLL and (mark >> 17) % every == 0 and len(out[-1]) >= LEAST_LINES:
            out.append([])
    if len(out) > 1 and not out[-1]:
        out.pop()
    return out


def windows(text: str) -> list[tuple[int, bytes]]:
    """The first line and the bytes of each window that has a word."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    parts = (lines[k : k + LEAST_LINES] for k in range(len(lines) - LEAST_LINES + 1))
    return [(k, b"\n".join(part)) for k, part in enumerate(parts) if any(line.strip() for line in part)]


def _digests(batches):
    for b in batches:
        digests, rows, numbers = [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            for k, data in windows(text):
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                rows.append(i)
                numbers.append(k)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), b.column("id").take(take), b.column("h").take(take), pa.array(numbers, pa.int32())], names=["digest", "id", "h", "k"])


def _bytes(batches):
    """The candidates' bytes."""
    for b in batches:
        digests, rows, numbers, first, data = [], [], [], [], []
        for i, (text, wanted) in enumerate(zip(b.column("text").to_pylist(), b.column("wanted").to_pylist())):
            own = text.split("\n")
            for w in wanted:
                digests.append(w["digest"])
                rows.append(i)
                numbers.append(w["k"])
                first.append(w["first"])
                data.append("\n".join(own[w["k"] : w["k"] + LEAST_LINES]))
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), b.column("id").take(take), b.column("h").take(take), pa.array(numbers, pa.int32()), pa.array(first, pa.bool_()), pa.array(data, pa.string())],
            names=["digest", "id", "h", "k", "first", "data"],
        )


def _rest(batches):
    for b in batches:
        rows = []
        for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
            own, lines = chunks(text), text.split("\n")
            gone = {k + i for k in gone or () for i in range(LEAST_LINES)}
            kept = [line for k, line in enumerate(lines) if k not in gone]
            ends = list(itertools.accumulate(map(len, own)))
            whole = sum(gone.issuperset(range(z - len(c), z)) for c, z in zip(own, ends)) if gone else 0
            rows.append((len(lines), len(own), whole, len(lines) - len(kept), "\n".join(kept)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))],
            names=["id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "text"],
        )


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, text (what is left)."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    found = stored(docs.mapInArrow(_digests, f"digest binary, id {kind}, h long, k int"), "windows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "k")
    again = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("win")).where(F.col("n") > 1).drop("n")
    again = stored(again, "again")  # a plain join side: a digest of many rows may be split
    overlaps = F.col("id").eqNullSafe(F.col("win.id")) & (F.col("h") == F.col("win.h")) & (F.col("k") > F.col("win.k")) & (F.col("k") < F.col("win.k") + LEAST_LINES)
    candidates = found.join(again, "digest").where(~overlaps).select("id", "h", F.struct("digest", "k", (place == F.col("win")).alias("first")).alias("w"))
    wanted = candidates.groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(F.collect_set("w").alias("wanted"))

    def same(a: str, b: str):
        return F.col("id").eqNullSafe(F.col(a)) & (F.col("h") == F.col(b))

    shape = f"digest binary, id {kind}, h long, k int, first boolean, data string"
    data = stored(docs.join(wanted.hint("shuffle_hash"), same("wid", "wh")).select("id", "h", "text", "wanted").mapInArrow(_bytes, shape), "bytes")
    kept = stored(data.where("first").groupBy("digest").agg(F.min("data").alias("kept")), "kept")
    gone = (
        data.where("not first").join(kept, "digest").where(F.col("data") == F.col("kept"))
        .groupBy(F.col("id").alias("gid"), F.col("h").alias("gh")).agg(F.collect_set("k").alias("gone"))
    )
    rest = docs.join(gone.hint("shuffle_hash"), same("gid", "gh"), "left").select("id", "text", "gone")
    out = rest.mapInArrow(_rest, f"id {kind}, n_lines long, n_chunks long, n_removed_chunks long, n_removed_lines long, text string")
    return out.select(F.col("id").alias(id_col), "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.col("text").alias(text_col))
