"""SentencePiece encoding and decoding with a distinct-chunk table.

When no piece holds the white-space mark after another character, no merge crosses the start of a
run of marks, so a text is the concatenation of its marked words (a run of marks and what follows
up to the next mark), each segmented by itself.

1. Texts are read in slices, bounded by bytes and by different words. A slice numbers its distinct
   marked words as they come; a text becomes the numbers of its words, by position. The words are dealt into
   buckets by their hash, and each (slice, bucket) is one compressed row: however often a word
   stands in a slice, and however many texts have it, it is one entry.
2. Buckets meet in one task each: every distinct marked word is segmented there once, by the library,
   and its ids and decoded text go back to the slices that have it.
3. Slices meet their texts' numbers again, and ids, digits and decoded texts are joined by position.

A bucket holds the different words of a share of all words, a slice what its bounds allow, so no
task's memory depends on how frequent a word is or on the number of texts.

Defined cases: null is empty and gives the end id alone; texts without a space, very long ones
included, are one chunk; empty tables, null or repeated ids and other columns pass.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import small_batches, stored, text_of

MARK = "▁"
SLICE_WORDS = 1_000_000
SLICE_BYTES = 64 << 20
LEAST_BUCKETS, MOST_BUCKETS = 16, 8192
AT_ONCE = 20_000
ORDER, TEXTS = 2**31 - 2, 2**31 - 1  # the buckets of a slice's order of words and of its texts, after all others


class Pieces:
    """The library's model and what holds for its marked words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a white-space mark")
        probe = "  a  b"
        if m.decode(m.encode(probe)) != probe or m.encode("a", out_type=str) != [MARK + "a"]:
            raise ValueError("this model does not keep white space as it is")
        self.end = m.eos_id()
        self.lone = m.piece_to_id(MARK)
        self.first = m.encode("a")
        self.shown = len(m.decode(self.first).encode())

    def segment(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids, as little-endian unsigned 32-bit bytes, and the decoded text of each word."""
        ids = self.model.encode(words, num_threads=1)
        if "" in words:  # one mark at the end of a text
            ids[words.index("")] = [self.lone]
        decoded = self.model.decode([self.first + i for i in ids], num_threads=1)
        return [(np.array(i, "<u4").tobytes(), d.encode()[self.shown :]) for i, d in zip(ids, decoded)]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def marked_words(text: str) -> list[str]:
    """The marked words of a whole text, each without its first mark; further marks are spaces."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    words, spaces = [], 0
    for p in parts:
        if p:
            words.append(" " * spaces + p)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        words.append(" " * (spaces - 1))
    return words


def packed(*parts: bytes) -> bytes:
    """Byte strings as one compressed one."""
    sizes = np.array([len(p) for p in parts], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(bytes([len(parts)]) + sizes + b"".join(parts))


def unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = raw[0]
    ends = np.cumsum(np.frombuffer(raw, "<u8", n, 1)).astype(np.int64) + 1 + 8 * n
    starts = [1 + 8 * n, *ends[:-1].tolist()]
    return [raw[a:z] for a, z in zip(starts, ends.tolist())]


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, their lowest bytes first, then the next ones: most of the others are zero."""
    n = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([n]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :n].T.tobytes()


def numbers_of(data: bytes) -> np.ndarray:
    own = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((own.shape[1], 4), np.uint8)
    out[:, : data[0]] = own.T
    return out.view("<u4").ravel()


def _listed(strings: list[bytes]) -> tuple[bytes, bytes]:
    return planes(np.array([len(s) for s in strings], np.uint32)), b"".join(strings)


def _strings(sizes: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(numbers_of(sizes), dtype=np.int64).tolist()
    return [data[a:z] for a, z in zip([0, *ends], ends)]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Slice:
    """Texts and the numbers of their marked words."""

    def __init__(self, with_texts: bool = True):
        self.numbers, self.chunks, self.size, self.with_texts = _Numbers(), [], 0, with_texts

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        number = self.numbers.__getitem__
        found = []
        for text in texts:
            words = marked_words(text)
            own = np.fromiter(map(number, words), np.uint32, len(words))
            self.size += len(text)
            if self.with_texts:
                found.append(own)
        if self.with_texts:
            self.chunks.append((ids, found))

    @property
    def name(self) -> int:
        """A digest of its words in their order: slices of the same words are one to each other."""
        return xxhash.xxh64_intdigest("\0".join(self.numbers).encode()) - (1 << 63)

    def words(self, buckets: int, kind: pa.DataType) -> pa.RecordBatch:
        """A row for each bucket, with its words in binary order, and one that tells their places."""
        words = [w.encode() for w in self.numbers]
        dealt: dict[int, list[tuple[bytes, int]]] = {}
        for n, w in enumerate(words):
            dealt.setdefault(zlib.crc32(w) % buckets, []).append((w, n))
        present = sorted(dealt)
        listed = [sorted(dealt[b]) for b in present]
        place = np.empty(len(words), np.uint32)
        place[[n for part in listed for _, n in part]] = np.arange(len(words), dtype=np.uint32)
        data = [packed(*_listed([w for w, _ in part])) for part in listed]
        return self._batch(self.name, [*present, ORDER], [None] * (len(data) + 1), [*data, packed(planes(place))], kind)

    def texts(self, kind: pa.DataType):
        name = self.name
        for ids, found in self.chunks:
            sizes = np.array([len(f) for f in found], np.uint32)
            flat = np.concatenate(found) if found else np.empty(0, np.uint32)
            yield self._batch(name, [TEXTS], [ids.to_pylist()], [packed(planes(sizes), planes(flat))], kind)

    @staticmethod
    def _batch(name: int, buckets: list[int], ids: list, data: list[bytes], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([name] * len(data), pa.int64()), pa.array(buckets, pa.int32()), pa.array(ids, pa.list_(kind)), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "bucket", "ids", "data"])


def _slices(buckets: int, slice_words: int, want: str, batches):
    """The rows of each slice's words, of its texts, or both."""
    now, kind = None, None

    def rows():
        if "words" in want:
            yield now.words(buckets, kind)
        yield from now.texts(kind)

    for b in batches:
        kind = b.schema.field("id").type
        now = now or Slice("texts" in want)
        now.add(b.column("id"), b.column("text").to_pylist())
        if len(now.numbers) > slice_words or now.size > SLICE_BYTES:
            yield from rows()
            now = None
    if now is not None:
        yield from rows()


def _segmented(path: str, batches):
    """Rows sorted by bucket: the ids and decoded texts of each one's words."""
    model, bucket, known = pieces(path), None, {}
    for b in batches:
        out = []
        for now, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()):
            if now == ORDER:
                out.append(data)
                continue
            if now != bucket:
                bucket, known = now, {}
            words = _strings(*unpacked(data))
            new = [w for w in words if w not in known]
            for k in range(0, len(new), AT_ONCE):
                part = new[k : k + AT_ONCE]
                known.update(zip(part, model.segment([w.decode() for w in part])))
            found = [known[w] for w in words]
            ids = np.frombuffer(b"".join([ids for ids, _ in found]), "<u4")
            counts = np.array([len(ids) // 4 for ids, _ in found], np.uint32)
            out.append(packed(planes(counts), planes(ids), *_listed([decoded for _, decoded in found])))
        yield pa.RecordBatch.from_arrays([b.column("slice"), b.column("bucket"), pa.nulls(b.num_rows, b.schema.field("ids").type), pa.array(out, pa.binary())], names=["slice", "bucket", "ids", "data"])


class Encoded:
    """The words of one slice, by number: how many ids, their digits or the ids, the decoded bytes."""

    def __init__(self, digests: bool):
        self.digests, self.parts = digests, ([], [], [])
        self.counts, self.ids, self.decoded, self.bucket = np.empty(0, np.int64), [], [], -1

    def add(self, bucket: int, data: bytes) -> None:
        """One bucket's words, or their order; a slice of the same words gives the same again."""
        if bucket == self.bucket:
            return
        self.bucket = bucket
        if bucket == ORDER:
            place = numbers_of(unpacked(data)[0]).tolist()
            counts, ids, decoded = self.parts
            self.counts = np.array(counts, np.int64)[place] if place else self.counts
            self.ids, self.decoded = [ids[i] for i in place], [decoded[i] for i in place]
            return
        sizes, ids, lengths, decoded = unpacked(data)
        counts, ids = numbers_of(sizes), numbers_of(ids)
        ends = np.cumsum(counts, dtype=np.int64).tolist()
        if self.digests:
            said = list(map(str, ids.tolist()))
            own = [" ".join(said[a:z]).encode() for a, z in zip([0, *ends], ends)]
        else:
            own = [ids[a:z].tobytes() for a, z in zip([0, *ends], ends)]
        for into, new in zip(self.parts, (counts.tolist(), own, _strings(lengths, decoded))):
            into += new


def _joined(end: int, digests: bool, batches):
    """Rows sorted by slice and bucket: each slice's words, their order, then its texts."""
    now, words = None, Encoded(digests)
    last = str(end).encode()
    for b in batches:
        for name, bucket, ids, data in zip(*(b.column(c) for c in ("slice", "bucket", "ids", "data"))):
            if name.as_py() != now:
                now, words = name.as_py(), Encoded(digests)
            if bucket.as_py() != TEXTS:
                words.add(bucket.as_py(), data.as_py())
                continue
            if words.bucket != ORDER:
                raise ValueError("the input's rows came in another order when it was read again; leave reread out")
            sizes, flat = map(numbers_of, unpacked(data.as_py()))
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            n, encoded, decoded = [], [], []
            for a, z in zip([0, *ends], ends):
                place = flat[a:z]
                n.append(int(words.counts[place].sum()) + 1)
                place = place.tolist()
                back = b"".join([words.decoded[i] for i in place])[1:]  # the first mark is no space
                own = [words.ids[i] for i in place]
                if digests:
                    encoded.append(hashlib.sha256(b" ".join([*own, last])).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                else:
                    encoded.append([*np.frombuffer(b"".join(own), "<u4").tolist(), end])
                    decoded.append(back.decode())
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(n, pa.int64()), pa.array(encoded, kinds[0]), pa.array(decoded, kinds[1])], names=["id", "n_tokens", "ids", "decoded"])


def piece_codec(
    df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, reread: bool = False, buckets: int | None = None, slice_words: int = SLICE_WORDS
) -> DataFrame:
    """Per document: id, n_tokens, ids, decoded; with ``digests`` the SHA-256 of the ids' digits
    (joined by a space) and of the decoded text instead, made where the ids are. ``buckets``: how many
    the words are dealt into, four for each partition of the input if it is not given.

    Slices are written to the shared folder, since words and texts are needed apart. ``reread`` spares
    that for a table that gives the same rows in the same order when it is read again, as files do; where
    it does not, texts find no slice of their words, and the query fails."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 4 * rows.rdd.getNumPartitions()))
    shape = f"slice long, bucket int, ids array<{kind}>, data binary"

    def slices(want: str) -> DataFrame:
        return rows.mapInArrow(functools.partial(_slices, buckets, slice_words, want), shape)

    if reread:
        apart, texts = slices("words"), slices("texts")
    else:
        both = stored(slices("words, texts"), "slices")
        apart, texts = both.where(F.col("bucket") < TEXTS), both.where(F.col("bucket") == TEXTS)
    # ORDER is a bucket of its own, which nothing is segmented in
    dealt = apart.repartition("bucket", F.when(F.col("bucket") == ORDER, F.col("slice"))).sortWithinPartitions("bucket")
    met = dealt.mapInArrow(functools.partial(_segmented, model), shape).unionByName(texts)
    out = f"id {kind}, n_tokens long, ids {'string' if digests else 'array<int>'}, decoded string"
    joined = met.repartition("slice").sortWithinPartitions("slice", "bucket").mapInArrow(functools.partial(_joined, pieces(model).end, digests), out)
    return joined.withColumnRenamed("id", id_col)
