"""Substring dedup: paragraph MinHash banding.

Paragraphs are of two kinds. A text is cut into short ones at content-defined words: a word starts a
paragraph if the hash of the three words from it on is the smallest within ``REACH`` words on either
side (of equal hashes the first counts; where words recur within reach, every ``RUN`` words from the
start of that on). These cuts depend on the words around them only, so a
passage is cut alike wherever it stands, also in the middle of a line. And each line of ``PASSAGE``
words or more is a paragraph, long enough to be found with some of its words changed.

1. Paragraphs of ``LEAST`` words or more get a 64-bit identity and ``BANDS`` x ``ROWS`` MinHash
   values over 5-word shingles. For similarity s a pair collides in some band with probability
   1 - (1 - s^ROWS)^BANDS: 0.983 at 0.8, 0.999 at 0.9, and 1 for equal paragraphs.
2. Bands are dealt by their key, in arrays, into buckets that grow in number with the input; keys with
   two or more different paragraphs are kept. Equal paragraphs count once (repeats are dropped before
   the shuffle as far as a task sees them); which ones stand in two places is found on the way.
3. Colliding paragraphs are verified by exact Jaccard similarity (0.8 or more) on their shingles (as
   64-bit hashes), by a search that shrinks and writes one link for each member, never all pairs; a bucket of
   many different paragraphs is dealt out as pairs of blocks.
4. Connected components of the links are the clusters. Each cluster's first paragraph, by document
   and place, stays, and so does what overlaps it. The others are extended word by word while the
   words before and after equal those around the first one; joined spans of ``PASSAGE`` words or more
   are cut out. Only where the same paragraph adjoins both is there nothing to extend: it is a repeat
   of its own. Words are read ``AROUND`` at a time, and more of them while all are equal.

Words are ``[^\\x20\\x09-\\x0D]+`` and compared after lower-casing A-Z. Bitmaps of fixed size (see
``membership``) keep rows without a partner out of the later shuffles, and exact joins decide; texts
without a removal never shuffle.

Defined cases: null texts are empty and stay null when kept; texts of fewer than ``LEAST`` words
have no paragraph; rows that repeat id and text are one document and each get its result; a null id
comes after all others; empty tables and other columns, whatever their names, pass.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.components import connected_components
from pagewright.llm.membership import bitmap, maybe, split
from pagewright.llm.shared import delete, fresh, small_batches, stored, text_of, written
from pagewright.llm.simhash_dedup import spread_large

REACH = 5
LEAST = 6
SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 4, 2
PASSAGE = 50
AROUND = 32
MORE = 32
RUN = 64
STEP = 0x5851F42D
BUCKET = 1024
SET_MOST = 512
SEEN_ROWS = 300_000
SLICE = 1 << 19
FLUSH = 1 << 19
LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 16
WORD = re.compile(r"[^\x20\x09-\x0d]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PERMUTE = [(np.uint64(xxhash.xxh64_intdigest(b"a%d" % i) | 1), np.uint64(xxhash.xxh64_intdigest(b"b%d" % i))) for i in range(BANDS * ROWS)]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, kept as far as a batch needs them."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_M1, _INVERSE)):
            row = np.full(n, x, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range, a hash that depends on its values and their order."""
    power, back = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:-1], dtype=np.uint64, out=total[1:])
    return _mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places are cut short."""
    out = x.copy()
    for k in range(1, n):
        out[: len(x) - k] = out[: len(x) - k] * _M1 + x[k:]
    return _mixed(out)


class Paragraphs:
    """The paragraphs of a batch of texts, in arrays: first the short ones, then the long lines.
    ``doc``: the text's place in the batch; ``a`` and ``z``: its words, from and to, within the text."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        self.data = b" ".join(raw) + b" "
        byte = np.frombuffer(self.data, np.uint8)
        space = _SPACE[byte]
        self.starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        self.ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        n = len(self.starts)
        begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
        places = np.searchsorted(self.starts, begin)
        self.first, self.counts = places[:-1], np.diff(places)
        self.hash = x = _sums(_BYTE[byte], self.starts, self.ends)
        own = np.repeat(np.arange(len(texts)), self.counts)
        place = np.arange(n) - self.first[own] if n else np.empty(0, np.int64)
        left = self.counts[own] - place if n else place
        cut, again = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            g = np.where(left >= 3, _grams(x, 3), np.uint64(2**64 - 1))
            cut = left >= 3
            for k in range(1, REACH + 1):
                if k < n:
                    # the smallest within reach, among words of the same text
                    together = own[k:] == own[:-k]
                    cut[k:] &= ~together | (g[k:] < g[:-k])
                    cut[:-k] &= ~together | (g[:-k] <= g[k:])
                    again[k:] |= together & (g[k:] == g[:-k]) & (left[k:] >= 3)
            begins = np.flatnonzero(again & ~np.concatenate(([False], again[:-1])))
            if len(begins):  # in a run of a few words over and over, from its start on
                where = np.flatnonzero(again)
                cut[where] |= (where - begins[np.searchsorted(begins, where, side="right") - 1]) % RUN == 0
            cut |= place == 0
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        ends = np.minimum(ends, self.first[own[starts]] + self.counts[own[starts]]) if len(starts) else ends
        keep = ends - starts >= LEAST
        lines = self._long_lines(byte, own, starts[keep], ends[keep])
        self.start, self.end = (np.concatenate((short[keep], long)) for short, long in zip((starts, ends), lines))
        self.n_short = int(keep.sum())
        #: Whether the paragraph may be similar to one of other words: with three shingles at most it is
        #: not, since one shingle more or less is a quarter, unless words recur within three places.
        recurs = np.cumsum(np.concatenate(([0], again))) if n else np.zeros(1, np.int64)
        self.alike = (self.end - self.start >= SHINGLE + 3) | (recurs[self.end] > recurs[self.start])
        self.doc = own[self.start]
        self.a, self.z = self.start - self.first[self.doc], self.end - self.first[self.doc]

    def _long_lines(self, byte: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines of ``PASSAGE`` words or more that are no short paragraph."""
        line = np.cumsum(byte == 10)[self.starts]
        first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (own[1:] != own[:-1])))) if len(own) else np.empty(0, np.int64)
        last = np.append(first[1:], len(own))[: len(first)]
        long = last - first >= PASSAGE
        first, last = first[long], last[long]
        if len(starts) and len(first):
            at = np.minimum(np.searchsorted(starts, first), len(starts) - 1)
            new = (starts[at] != first) | (ends[at] != last)
            first, last = first[new], last[new]
        return first, last

    def identity(self) -> np.ndarray:
        """64 bits that depend on all words and their order."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        return _sums(self.hash, self.start, self.end)

    def bands(self) -> list[np.ndarray]:
        """For each band, the paragraphs' keys."""
        if not len(self.start):
            return [np.empty(0, np.uint64)] * BANDS
        grams = self.grams
        spans = np.column_stack((self.start, self.end - SHINGLE + 1)).ravel()
        least = [np.minimum.reduceat(_mixed(grams * a + b), spans)[::2] for a, b in _PERMUTE]
        return [functools.reduce(lambda k, v: _mixed(k * _M1 + v), least[i * ROWS : (i + 1) * ROWS]) for i in range(BANDS)]

    def shingles(self, i: int) -> bytes:
        """64-bit hashes of a paragraph's different shingles."""
        return np.unique(self.grams[self.start[i] : self.end[i] - SHINGLE + 1]).tobytes()

    @functools.cached_property
    def grams(self) -> np.ndarray:
        return _grams(self.hash, SHINGLE)

    def around(self, doc: int, place: int, side: int, limit: int) -> bytes:
        """32-bit hashes of up to ``limit`` words before (side 0, nearest first) or from a place on."""
        low = self.first[doc]
        at, high = low + place, low + self.counts[doc]
        return (self.short[at : min(high, at + limit)] if side else self.short[max(low, at - limit) : at][::-1]).tobytes()

    @functools.cached_property
    def short(self) -> np.ndarray:
        return (self.hash >> np.uint64(32)).astype("<u4")


def slices(batches, limit: int = SLICE):
    """The batches in parts of about ``limit`` bytes of text, one row at least: the arrays of a part
    take many times its bytes."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield b.slice(start, end - start)
            start = end


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class _Dealt:
    """Keys and identities on their way to their buckets, as arrays: a row for each bucket and flush."""

    names = ("bucket", "keys", "units", "same")

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.units, self.same, self.n = np.uint64(buckets), [], [], [], 0

    def add(self, keys: list[np.ndarray], units: np.ndarray, same: np.ndarray) -> None:
        self.keys += keys
        self.units += [units] * len(keys)
        self.same.append(same)
        self.n += len(keys) * len(units) + len(same)

    def _parts(self, by: np.ndarray, *columns: np.ndarray) -> list[list[bytes]]:
        """Each column's bytes by bucket."""
        bucket = ((by >> np.uint64(32)) % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=int(self.buckets))).tolist()
        return [[c[order[a:z]].tobytes() for a, z in zip([0, *ends], ends)] for c in columns]

    def flush(self) -> pa.RecordBatch:
        keys, units, same = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (self.keys, self.units, self.same))
        parts = [*self._parts(keys, keys, units), *self._parts(same, same)]
        self.keys, self.units, self.same, self.n = [], [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(range(int(self.buckets)), pa.int32()), *(pa.array(p, pa.binary()) for p in parts)], names=list(self.names))


def _deal(buckets: int, batches):
    """The identities of all paragraphs, and the keys of those that may be similar to another; twice and
    once at most, as far as this task has seen them lately."""
    seen: dict[int, int] = {}
    dealt = _Dealt(buckets)
    for b in slices(batches):
        p = Paragraphs(b.column("text").to_pylist())
        units, where, counts = np.unique(p.identity(), return_index=True, return_counts=True)
        before = np.array([seen.get(x, 0) for x in units.tolist()], np.int64)
        times = np.minimum(2 - before, counts)
        new = (before == 0) & p.alike[where]
        dealt.add([_mixed(keys[where[new]] + np.uint64(i)) for i, keys in enumerate(p.bands())], units[new], np.repeat(units, times))
        if len(seen) > SEEN_ROWS:
            seen.clear()
        seen.update(zip(units.tolist(), (before + times).tolist()))
        if dealt.n > FLUSH:
            yield dealt.flush()
    if dealt.n:
        yield dealt.flush()


def _met(batches):
    """Rows sorted by bucket: the keys that two or more different paragraphs have, with each of these
    once; and, without a key, the paragraphs that stand in two or more places."""

    def found(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        keys, units, same = (np.frombuffer(b"".join(column), np.uint64) for column in zip(*rows))
        order = np.lexsort((units, keys))
        keys, units = keys[order], units[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (units[1:] != units[:-1]))) if len(keys) else np.empty(0, bool)
        keys, units = keys[new], units[new]
        next_one = keys[1:] == keys[:-1]
        several = np.concatenate(([False], next_one)) | np.concatenate((next_one, [False])) if len(keys) else new
        again, counts = np.unique(same, return_counts=True)
        again = again[counts > 1]
        key = pa.array(np.concatenate((keys[several], again)).view(np.int64), mask=np.repeat([False, True], [int(several.sum()), len(again)]))
        return pa.RecordBatch.from_arrays([key, _long(np.concatenate((units[several], again)))], names=["k", "u"])

    bucket, rows = None, []
    for b in batches:
        for now, *row in zip(*(b.column(n).to_pylist() for n in _Dealt.names)):
            if now != bucket and rows:
                yield found(rows)
                rows = []
            bucket = now
            rows.append(row)
    if rows:
        yield found(rows)


def _members(colliding, repeated, batches):
    """Paragraphs that may have a partner: the shingles of those that may collide (not again, where this
    task has given them lately), the word next to them on either side, and the paragraph that adjoins
    them there, if one does."""
    seen: set[int] = set()
    for b in slices(batches):
        p = Paragraphs(b.column("text").to_pylist())
        u = p.identity()
        met = maybe(colliding.value, u)
        at = np.flatnonzero(met | maybe(repeated.value, u))
        if not len(at):
            continue
        joined = (p.doc[:-1] == p.doc[1:]) & (p.end[:-1] == p.start[1:])
        own = u.view(np.int64)
        # none at the ends of a text; nor for long lines: the short paragraphs beside them are extended
        no_word = tuple(end | (at >= p.n_short) for end in (p.a[at] == 0, p.z[at] == p.counts[p.doc[at]]))
        words = (p.short[p.start[at] - 1], p.short[np.minimum(p.end[at], len(p.short) - 1)])
        no_unit = (~np.concatenate(([False], joined))[at], ~np.concatenate((joined, [False]))[at])
        units = (np.roll(own, 1)[at], np.roll(own, -1)[at])
        rows = pa.array(p.doc[at])
        shingles_of = [None if not m or x in seen or seen.add(x) else p.shingles(i) for i, m, x in zip(at.tolist(), met[at].tolist(), u[at].tolist())]
        if len(seen) > SEEN_ROWS:
            seen.clear()
        yield pa.RecordBatch.from_arrays(
            [
                _long(u[at]), b.column("id").take(rows), b.column("h").take(rows), pa.array(p.a[at].astype(np.int32)), pa.array(p.z[at].astype(np.int32)),
                pa.array(shingles_of, pa.binary()),
                *(pa.array(w.view(np.int32), mask=n) for w, n in zip(words, no_word)), *(pa.array(x, mask=n) for x, n in zip(units, no_unit)),
            ],
            names=["u", "id", "h", "a", "z", "shingles", "word0", "word1", "unit0", "unit1"],
        )


def _key(h, place, side):
    """The same 64 bits for numpy arrays and for columns (a place has 31 bits)."""
    number = (place * 2 + side) * STEP
    return h ^ number if isinstance(h, np.ndarray) else h.bitwiseXOR(number)


def _around(places, limit: int, anywhere: bool, batches):
    """Hashes of the words on one side of places that may be wanted: of paragraphs' ends, or of any word."""
    seen: set[int] = set()
    for b in slices(batches):
        h, p = b.column("h").to_numpy(zero_copy_only=False), Paragraphs(b.column("text").to_pylist())
        out: list[list] = [[], [], [], []]
        for side in (0, 1):
            if anywhere:
                doc = np.repeat(np.arange(b.num_rows), p.counts)
                place = np.arange(len(doc)) - p.first[doc]
            else:
                doc, place = p.doc, (p.z if side else p.a)
            keys = _key(h[doc], place.astype(np.int64), side)
            for i in np.flatnonzero(maybe(places.value, keys.view(np.uint64))).tolist():
                if (key := int(keys[i])) not in seen:
                    seen.add(key)
                    for into, value in zip(out, (int(h[doc[i]]), int(place[i]), side, p.around(doc[i], place[i], side, limit))):
                        into.append(value)
        if len(seen) > SEEN_ROWS:
            seen.clear()
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["h", "place", "side", "near"])


def shingles(text: str, n: int = SHINGLE) -> frozenset[int]:
    """64-bit hashes of the runs of n words; of all words, if they are fewer."""
    words = text.split()
    return frozenset(map(hash, zip(*(words[i:] for i in range(n))))) if len(words) >= n else frozenset([hash(tuple(words))])


def common(x, y) -> int:
    """How many shingles are in both, for sets or sorted arrays."""
    if isinstance(x, frozenset) and isinstance(y, frozenset):
        return len(x & y)
    x, y = (np.sort(np.fromiter(v, np.uint64, len(v))) if isinstance(v, frozenset) else v for v in (x, y))
    return len(np.intersect1d(x, y, assume_unique=True))


def similar(x, y, least: float = SIMILAR) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = common(x, y)
    return both >= least * (len(x) + len(y) - both)


def link_similar(units: list[int], texts: list, least: float = SIMILAR) -> list[tuple[int, int]]:
    """(root, member) links that join a bucket's paragraphs as all its similar pairs would. ``texts``:
    the paragraphs, or their shingles' hashes as bytes, sorted."""

    def held(t):
        """A set, which is faster; for long lines the array, which takes a tenth of the memory."""
        own = np.frombuffer(t, np.uint64)
        return frozenset(own.tolist()) if len(own) <= SET_MOST else own

    left = [(u, shingles(t) if isinstance(t, str) else held(t)) for u, t in sorted(dict(zip(units, texts)).items())]
    links = []
    while len(left) > 1:
        (root, own), left = left[0], left[1:]
        front = [own]
        while front and left:
            here = front.pop()
            near = [similar(here, s, least) for _, s in left]
            links += ((root, u) for (u, _), yes in zip(left, near) if yes)
            front += (s for (_, s), yes in zip(left, near) if yes)
            left = [x for x, yes in zip(left, near) if not yes]
    return links


def _verified(batches):
    """Rows sorted by bucket."""
    now, units, texts = None, [], []
    for b in batches:
        links = []
        for t, k, u, own in zip(*(b.column(n).to_pylist() for n in ("t", "k", "u", "shingles"))):
            if (t, k) != now:
                links += link_similar(units, texts)
                now, units, texts = (t, k), [], []
            units.append(u)
            texts.append(own)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])
    links = link_similar(units, texts)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])


def _common(x: bytes, y: bytes) -> int:
    """Words that two lists of 32-bit hashes begin with alike."""
    n = min(len(x), len(y)) // 4
    if not n:
        return 0
    same = np.frombuffer(x, "<u4", n) == np.frombuffer(y, "<u4", n)
    return n if same.all() else int(np.argmin(same))


def _extended(batches):
    """Each edge with the number of words that are equal from it on."""
    for b in batches:
        equal = [_common(x, y) for x, y in zip(b.column("near").to_pylist(), b.column("first_near").to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.drop_columns(["near", "first_near"]).columns, pa.array(equal, pa.int32())], names=[*b.schema.names[:-2], "n"])


def _extensions(docs: DataFrame, later: DataFrame, kind: str, around: int) -> DataFrame:
    """(id, h, a, z, keep_id): the words next to later paragraphs that equal those next to the first."""

    def side(k: int, end: str) -> DataFrame:
        # the next word is the same, and not by a paragraph that repeats as a whole
        wanted = (F.col(f"word{k}") == F.col(f"first.word{k}")) & ~F.coalesce(F.col(f"unit{k}") == F.col(f"first.unit{k}"), F.lit(False))
        return later.where(wanted).select("id", "h", F.col(end).alias("place"), F.col("first.place.h").alias("fh"), F.col(f"first.{end}").alias("fplace"), F.lit(k).alias("side"), "keep_id")

    edges = stored(side(0, "a").unionByName(side(1, "z")).distinct(), "edges")
    found, limit = None, around
    while True:
        both = edges.select("h", "place", "side").unionByName(edges.select(F.col("fh").alias("h"), F.col("fplace").alias("place"), "side"))
        places = bitmap(both.select(_key(F.col("h"), F.col("place").cast("long"), F.col("side")).alias("k")), "k")
        texts, _ = split(docs.select("h", "text"), F.col("h"), both.select("h"))
        near = texts.mapInArrow(functools.partial(_around, places, limit, found is not None), "h long, place int, side int, near binary")
        near, path = written(near, "near")
        near, once = written(near.groupBy("h", "place", "side").agg(F.min("near").alias("near")), "near-once")  # a plain join side: a place that many rows meet may be split
        first = near.select(F.col("h").alias("fh"), F.col("place").alias("fplace"), "side", F.col("near").alias("first_near"))
        met = edges.join(near, ["h", "place", "side"]).join(first, ["fh", "fplace", "side"]).select("id", "h", "place", "fh", "fplace", "side", "keep_id", "near", "first_near")
        done = stored(met.mapInArrow(_extended, f"id {kind}, h long, place int, fh long, fplace int, side int, keep_id {kind}, n int"), "extended")
        for done_with in (path, once):
            delete(docs.sparkSession, done_with)
        back = F.col("side") == 0
        here = done.where("n > 0").select("id", "h", F.when(back, F.col("place") - F.col("n")).otherwise(F.col("place")).alias("a"), F.when(back, F.col("place")).otherwise(F.col("place") + F.col("n")).alias("z"), "keep_id")
        found = here if found is None else found.unionByName(here)
        edges, step = done.where(F.col("n") == limit), F.when(back, -F.col("n")).otherwise(F.col("n"))
        if edges.isEmpty():
            return found
        edges, limit = edges.withColumns({"place": F.col("place") + step, "fplace": F.col("fplace") + step}).drop("n"), limit * MORE


def _once(colliding: DataFrame) -> DataFrame:
    """Without keys that bring together the same paragraphs as another key does (two paragraphs that
    are near collide in most bands). Sets are compared by size and 128 bits of hash."""
    marks = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("u")), F.bit_xor(F.xxhash64("u", F.lit(1))))
    sets = colliding.groupBy("k").agg(*(m.alias(f"m{i}") for i, m in enumerate(marks)))
    keys = stored(sets.groupBy("m0", "m1", "m2").agg(F.min("k").alias("k")).select("k"), "keys")  # a plain join side
    return stored(colliding.join(keys, "k", "left_semi"), "once")


def removals(docs: DataFrame, bucket: int = BUCKET, around: int = AROUND) -> DataFrame:
    """(id, h, spans): for each document with repeated paragraphs, the words (a, z) that repeat and
    the id of the document that keeps them. ``docs``: id, h, text."""
    kind = docs.schema["id"].dataType.simpleString()
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h", "a")
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 4 * docs.rdd.getNumPartitions()))
    dealt = docs.select("text").mapInArrow(functools.partial(_deal, buckets), "bucket int, keys binary, units binary, same binary")
    met, met_path = written(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "k long, u long"), "met")
    colliding, repeated = met.where(F.col("k").isNotNull()), met.where(F.col("k").isNull()).select("u")
    maps = bitmap(colliding, "u"), bitmap(repeated, "u")
    shape = f"u long, id {kind}, h long, a int, z int, shingles binary, word0 int, word1 int, unit0 long, unit1 long"
    members, members_path = written(docs.mapInArrow(functools.partial(_members, *maps), shape), "members")
    texts = members.where(F.col("shingles").isNotNull()).groupBy("u").agg(F.first("shingles").alias("shingles")).join(colliding.select("u").distinct(), "u", "left_semi")
    buckets = spread_large(_once(colliding).select(F.lit(0).cast("long").alias("t"), "k", "u"), "u", bucket).join(texts, "u")
    links = buckets.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_verified, "a long, b long").distinct()
    clusters = connected_components(links).select(F.col("node").alias("u"), F.col("root").alias("c"))
    placed, placed_path = written(members.drop("shingles").join(clusters, "u", "left").withColumn("c", F.coalesce("c", "u")), "placed")
    row = F.struct(place.alias("place"), "a", "z", "word0", "word1", "unit0", "unit1")
    first = placed.groupBy("c").agg(F.min_by(row, place).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    first = stored(first, "first")  # a plain join side: a cluster of many rows may be split
    same = F.col("id").eqNullSafe(F.col("first.place.id")) & (F.col("h") == F.col("first.place.h"))
    stays = same & (F.col("a") < F.col("first.z")) & (F.col("z") > F.col("first.a"))
    later = stored(placed.join(first, "c").where(~stays).withColumn("keep_id", F.col("first.place.id")).drop("u", "c"), "later")
    for done_with in (met_path, members_path, placed_path):
        delete(docs.sparkSession, done_with)
    spans = later.select("id", "h", "a", "z", "keep_id").unionByName(_extensions(docs, later, kind, around))
    return spans.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("a", "z", "keep_id"))).alias("spans"))


def cut_out(text: str, spans: list[tuple[int, int, object]], passage: int = PASSAGE) -> tuple[str, list[tuple[int, int]], list]:
    """The text without its long repeated passages; the word spans cut; who keeps them."""
    joined: list[list] = []
    for a, z, keeper in spans:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], z)
            joined[-1][2].add(keeper)
        else:
            joined.append([a, z, {keeper}])
    long = [x for x in joined if x[1] - x[0] >= passage]
    if not long:
        return text, [], []
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, z, _ in long:
        out.append(text[at : starts[a]])
        at = starts[z]
    out.append(text[at:])
    keepers = sorted(set().union(*(x[2] for x in long)), key=lambda k: (k is None, k))
    return "".join(out).rstrip() if at == len(text) else "".join(out), [(a, z) for a, z, _ in long], keepers


def _cut(names: tuple[str, ...], passage: int, batches):
    text, spans, id_col, cuts, kept_by = names
    for b in batches:
        out = [cut_out(t or "", [(s["a"], s["z"], s["keep_id"]) for s in found or ()], passage) for t, found in zip(b.column(text).to_pylist(), b.column(spans).to_pylist())]
        span = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
        new = {
            text: pa.array([was if not o[1] else o[0] for was, o in zip(b.column(text).to_pylist(), out)], pa.string()),
            cuts: pa.array([[{"a": a, "z": z} for a, z in o[1]] for o in out], span),
            kept_by: pa.array([o[2] for o in out], pa.list_(b.schema.field(id_col).type)),
        }
        columns = [n for n in b.schema.names if n != spans]
        yield pa.RecordBatch.from_arrays([*(new.get(n, b.column(n)) for n in columns), new[cuts], new[kept_by]], names=[*columns, cuts, kept_by])


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, bucket: int = BUCKET) -> tuple[DataFrame, str, str]:
    """The input's rows and columns with repeated passages cut from the text, and the names of two more
    columns: the word spans cut, and the ids of the documents that keep the passages.

    Only documents that may have a removal cross to Python; the others stay where they are."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    found = stored(removals(docs, bucket).withColumn("doc", F.xxhash64("id", "h")), "removals")
    text_hash, spans, gone_id, gone_hash, cuts, kept_by = fresh(df, "text_hash", "spans_", "gone_id", "gone_hash", "cuts", "kept_by")
    keyed = df.withColumn(text_hash, F.xxhash64(text_of(text_col)))
    maybe_cut, clean = split(keyed, F.xxhash64(F.col(id_col), F.col(text_hash)), found.select(F.col("doc").alias(fresh(keyed, "doc")[0])))
    gone = found.select(F.col("id").alias(gone_id), F.col("h").alias(gone_hash), F.col("spans").alias(spans))
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(text_hash) == F.col(gone_hash))
    ready = maybe_cut.join(gone.hint("shuffle_hash"), same, "left").select(*(f"`{c}`" for c in df.columns), spans)
    kind = df.schema[id_col].dataType.simpleString()
    kinds = ("array<struct<a:int,z:int>>", f"array<{kind}>")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{cuts}` {kinds[0]}, `{kept_by}` {kinds[1]}"
    cut = ready.mapInArrow(functools.partial(_cut, (text_col, spans, id_col, cuts, kept_by), passage), shape)
    plain = clean.drop(text_hash).withColumns({n: F.array().cast(k) for n, k in zip((cuts, kept_by), kinds)})
    return plain.unionByName(cut), cuts, kept_by


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, n_removed_words, spans (words from a to z), kept_by (ids), text."""
    out, cuts, kept_by = without_passages(df.select(id_col, text_col), id_col, text_col, **options)
    removed = F.aggregate(cuts, F.lit(0).cast("long"), lambda n, s: n + s["z"] - s["a"])
    return out.select(id_col, removed.alias("n_removed_words"), F.col(cuts).alias("spans"), F.col(kept_by).alias("kept_by"), text_col)


def keep_rest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's columns with the texts' rest; a document that was nothing but passages goes."""
    out, cuts, kept_by = without_passages(df, id_col, text_col, **options)
    return out.where((F.size(cuts) == 0) | (F.length(F.btrim(F.col(text_col), F.lit(" \t\n\r"))) > 0)).drop(cuts, kept_by)
