"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprint: 64 bits, the majority of the bits of the shingles' XXH64 (4 words, seed 42).
Covering: each bit position gets a vector of radius + 1 bits, structured so that all non-zero
vectors are used almost equally often; table v (non-zero) keeps the positions whose vector has an
odd inner product with v. The vectors of any ``radius`` differing positions span a proper
subspace, so some v is orthogonal to all of them, and the pair agrees on that table's whole mask:
every pair within the radius collides in some of the 2^(radius+1) - 1 tables.

Only distinct fingerprints enter the tables. A bucket is linked by a search that shrinks: each
member found is compared once with those not yet found, and one link is written for each member,
never all pairs. Buckets are counted, and one of more than ``BUCKET`` members is dealt out as pairs of
blocks, so that no task gets it whole and no pair is missed.

Defined cases: null texts and texts without words have fingerprint zero; fewer than four words are
one shingle; repeated ids each get a row; null ids are no component's smallest unless alone.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.components import connected_components
from pagewright.llm.membership import split
from pagewright.llm.shared import fresh, small_batches, stored, text_of

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
BUCKET = 8192


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned; a bit is 1 if it is set in over half the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1])).tolist()
        ends = (ends - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask for each non-zero vector; each position's vector is taken in turn."""
    size = 2 ** (radius + 1)
    own = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (own[i] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprints(batches):
    for b in batches:
        prints = [_signed(fingerprint(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(prints, pa.int64())], names=["id", "h", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, fp): the fingerprint as a signed LONG; h: a hash of the text, to tell rows apart."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(_fingerprints, f"id {kind}, h long, fp long")


def link_bucket(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(root, member) links that join the members of a bucket as all its pairs within the radius would."""
    left = np.unique(prints.view(np.uint64))
    links = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                links.extend((int(root), int(f)) for f in found)
    return links


def _link(radius: int, batches):
    """Rows come sorted by bucket; the last one of a batch may go on in the next."""
    tables, keys, prints = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def linked(t, k, p, last):
        cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        bounds = [0, *cut.tolist(), len(t)]
        rest = len(t) if last else bounds[-2]
        links = []
        for a, z in zip(bounds, bounds[1:]):
            if z <= rest and z - a > 1:
                links += link_bucket(p[a:z], radius)
        out = pa.array([_signed(x) for x, _ in links], pa.int64()), pa.array([_signed(y) for _, y in links], pa.int64())
        return pa.RecordBatch.from_arrays(list(out), names=["a", "b"]), rest

    for batch in batches:
        t, k, p = (np.concatenate((old, batch.column(n).to_numpy(zero_copy_only=False))) for old, n in ((tables, "t"), (keys, "k"), (prints, "fp")))
        if len(t):
            out, rest = linked(t, k, p, False)
            tables, keys, prints = t[rest:], k[rest:], p[rest:]
            yield out
    if len(tables):
        yield linked(tables, keys, prints, True)[0]


def spread_large(rows: DataFrame, item: str, bucket: int = BUCKET) -> DataFrame:
    """Rows (t, k, item) of buckets (t, k). A bucket of more than ``bucket`` rows is replaced by the
    pairs of its blocks: any two of its items share at least one bucket of the result. Large buckets
    are found by counting all of them (partial counts are summed, so a large one is no large task)."""
    large = stored(rows.groupBy("t", "k").count().where(F.col("count") > bucket), "large-buckets")
    blocks = F.ceil(F.col("count") / (bucket // 2)).cast("long")
    # the large buckets are at most the rows by ``bucket``: a plain join, which is a broadcast where they are few
    marked = rows.join(large, ["t", "k"], "left").withColumn("n", F.coalesce(blocks, F.lit(1).cast("long")))
    dealt = marked.withColumn("b", F.pmod(F.xxhash64(item), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pair = F.when(F.col("n") == 1, F.col("t")).otherwise(F.xxhash64("t", F.least("b", "other"), F.greatest("b", "other")))
    return dealt.select(pair.alias("t"), "k", item)


def links_between(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) whose closure is that of all pairs within the radius."""
    masks = covering_masks(radius)
    rows = nodes.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)))).alias("x")
    ).select("fp", "x.t", "x.k")
    placed = spread_large(rows, "fp", bucket).repartition("t", "k").sortWithinPartitions("t", "k")
    return placed.mapInArrow(functools.partial(_link, radius), "a long, b long").distinct()


def with_components(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``prints`` (with id, h, fp) and the smallest (id, h) of each row's component as ``least``."""
    nodes = stored(prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")), "nodes")
    found = connected_components(links_between(nodes.select("fp"), radius, bucket))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("least")), "least")  # a plain join side
    return prints.join(rooted.join(least, "root").select("fp", "least"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """A row for each document: id, fingerprint (16 lowercase hex digits), component_id."""
    prints = stored(fingerprints(df, id_col, text_col), "prints")
    return with_components(prints, radius, bucket).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id")
    )


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The input's columns; of each component the row with the smallest id stays.

    Rows that are surely not dropped stay where they are and never shuffle (see ``membership``)."""
    prints = stored(fingerprints(df, id_col, text_col), "prints")
    groups = with_components(prints, radius, bucket).groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"))
    stays = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h"))
    dropped = stored(groups.where(~stays | (F.col("n") > 1)).select("id", "h", stays.alias("stays"), F.xxhash64("id", "h").alias("row_key")), "dropped")
    text_hash, row_key, gone_id, gone_hash = fresh(df, "text_hash", "row_key", "gone_id", "gone_hash")
    keyed = df.withColumn(text_hash, F.xxhash64(text_of(text_col)))
    maybe, clean = split(keyed, F.xxhash64(F.col(id_col), F.col(text_hash)), dropped.select(F.col("row_key").alias(row_key)))
    gone = dropped.select(F.col("id").alias(gone_id), F.col("h").alias(gone_hash), "stays")
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(text_hash) == F.col(gone_hash))
    out = clean.unionByName(maybe.join(gone.hint("shuffle_hash"), same, "left_anti"))
    again = gone.where("stays").drop("stays")
    if not again.isEmpty():
        out = out.unionByName(maybe.join(again.hint("shuffle_hash"), same, "left_semi").dropDuplicates([id_col, text_hash]))
    return out.drop(text_hash)
