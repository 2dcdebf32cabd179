"""A distinct-chunk table over a ``tokenizers`` file whose pre-tokenizer drops white space.

No token of such a tokenizer spans a space or a line feed, nor does its normaliser look across
one, so a text is encoded chunk by chunk, and a chunk is the concatenation of its pre-tokens. A
chunk that the worker's table lacks is cut into pre-tokens and each of them is segmented once by
the file's own BPE model; ids are joined back by position. Where normalisation is more than
lower-casing (a chunk outside Latin-1, or with a special token's string) the library gets the chunk
whole and as it stands. The table is bounded: when it is full it becomes the older table, which is
asked before a chunk is segmented again, and the one before that is dropped.

A file of any other make is encoded by the library, text by text.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TABLE_ROWS = 250_000
CHUNK_CHARS = 64
#: The make of file that is cut here, and its pattern over lower-case Latin-1.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Latin-1 without white space: NFC changes none of it, nor what it lower-cases to.
LATIN = re.compile(r"[!-~¡-¬®-ÿ]+")
#: A comma or full stop between a letter or digit and white space is a pre-token of its own.
STOP = re.compile(r"([,.])(?=[ \n]|\Z)(?<=[0-9a-zß-öø-ÿ].)")
#: One that is not.
JOINED = re.compile(r"[,.](?:(?<![0-9a-zß-öø-ÿ].)|(?=[^ \n]))")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + n for n, b in enumerate(other)}


LETTERS = _byte_letters()


@functools.lru_cache(maxsize=8)
def drops_space(path: str) -> bool:
    """Whether the file is of the make that is cut into chunks; no count then depends on white space."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, norm, pre = file["model"], file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    bars = all("<|" in t["content"] for t in file.get("added_tokens", []))
    return model["type"] == "BPE" and plain and bars and norm.get("normalizers") == NORMALIZERS and pre.get("pretokenizers") == PRE_TOKENIZERS


class ChunkTable(dict):
    """chunk -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuts = drops_space(path)
        self.segment = self.library.model.tokenize
        last = max(self.library.get_vocab().values())
        self.data = [i.to_bytes(4, "little") for i in range(last + 1)]
        self.older: dict[str, bytes] = {}
        self[""] = b""

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.learn(chunk)
        if len(chunk) <= CHUNK_CHARS:
            self[chunk] = ids
        return ids

    def learn(self, chunk: str) -> bytes:
        piece = chunk.lower()
        if not (chunk.isascii() and chunk.isalpha()):
            if "<|" in chunk or not LATIN.fullmatch(chunk):
                return self.whole([chunk])[0]
            pieces = PIECES.findall(piece)
            if len(pieces) > 1:
                return b"".join([self[p] for p in pieces])
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(LETTERS)
        return b"".join([self.data[t.id] for t in self.segment(piece)])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str]:
        """Chunks of a text. Where it changes no token (in Latin-1), in lower case and with commas and
        full stops as chunks of their own, which leaves fewer different ones."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                text = text.lower()
                text = STOP.sub(r" \1", text) if JOINED.search(text) else text.replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ").split(" ")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text."""
        if not self.cuts:
            return self.whole(texts)
        if len(self) > TABLE_ROWS:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        ids = self.__getitem__
        return [b"".join(map(ids, self.split(t))) for t in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) // 4 for ids in self.encode_all(texts)]


@functools.lru_cache(maxsize=2)
def table(path: str) -> ChunkTable:
    """One table for each worker process and file."""
    return ChunkTable(path)
