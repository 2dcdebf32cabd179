"""Quality rules, token counts, exact dedup, line dedup, piece codec against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm import exact_dedup, heavy, line_dedup, piece_codec, quality_rules, token_counts

WORD = re.compile("[^\x20\x09-\x0d]+")
JSON, MODEL = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "piece_bpe_32k.model"))


def key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


def stats(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    twice = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)


def test_quality_rules(spark, hard, empty, pairs):
    more = spark.createDataFrame([(1, "a b c d e " * 30), (2, "#a %b |c <d> " * 9), (3, "x y z w v q x y z w v r s t u")], "doc_id long, text string")
    for df, rows in ((hard, pairs), (more, [tuple(r) for r in more.collect()])):
        out = quality_rules.quality_rules(df).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted(((r.doc_id, *(r[n] for n in names)) for r in out), key=key) == sorted(((i, *stats(t)) for i, t in rows), key=key)
        for r in out:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(empty).count() == 0
    kept = quality_rules.keep_quality(hard)
    assert kept.columns == hard.columns and kept.count() == quality_rules.quality_rules(hard).where("kept").count()


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = "The committee met on the first day of the month and agreed that the work should go on as it was planned by the board. " * 1
    junk = ["buy ### now %%% cheap $$$ offer *** click &&& here ### " * 1 + "win $$$ big *** prize ###", "again and again and more " * 20]
    df = spark.createDataFrame([(0, clean), *((i + 1, t) for i, t in enumerate(junk))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(df).collect()} == {0: True, 1: False, 2: False}


@pytest.mark.parametrize("path", [JSON, MODEL])
def test_token_counts(hard, empty, pairs, path, tmp_path):
    if path == JSON:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    expected = sorted(((i, len((t or "").encode()), count(t or "")) for i, t in pairs), key=key)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second run finds all in the cache
        assert sorted(map(tuple, token_counts.token_counts(hard, path, cache).collect()), key=key) == expected
    rows = hard.sparkSession.read.parquet(cache).count()
    assert rows == hard.sparkSession.read.parquet(cache).select("digest").distinct().count() + 2  # two rows repeat id and text
    assert token_counts.token_counts(empty, path).count() == 0


def test_word_table_is_exact():
    from pagewright.llm import word_bpe

    library = Tokenizer.from_file(JSON)
    texts = ["Don't <|endoftext|> x<|STARTOFTEXT|>y İx ΑΣ'S it'll we'RE 3²½ ªº µ ÀÉ÷× !!'s ,, a,b. c.\td, . e", "日本 é x\x85y\xa0z", "", " ", "a.. b ,c \x00\x7f", "A,\nB."]
    table = word_bpe.ChunkTable(JSON)
    assert [memoryview(x).cast("I").tolist() for x in table.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


MARKS = "abcXYZ éÉßµªº²½JHTWYΑΙΣςσİı'stremvl.,!?-_#\n\t\r中0９<|>ÿĀﬁ\x00\x7f\x85\x1c" + "\u00a0\u00ad\u3000\u0301\u0304\u0308\u030a\u030c\u0331\u0345\U0001d400"


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.text(MARKS, max_size=40), st.text(max_size=20), st.lists(st.sampled_from(["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Ι\u0308\u0301", "it's", "a.b", "x,", ", ", "<|endoftext|>", " "]), max_size=12).map("".join)), min_size=1, max_size=4))
def test_ids_are_the_library_s(texts):
    from pagewright.llm import word_bpe

    table, library = word_bpe.table(JSON), Tokenizer.from_file(JSON)
    assert table.cuts
    assert [memoryview(x).cast("I").tolist() for x in table.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_older_table_is_asked_first(monkeypatch):
    from pagewright.llm import word_bpe

    monkeypatch.setattr(word_bpe, "TABLE_ROWS", 20)
    library, table = Tokenizer.from_file(JSON), word_bpe.ChunkTable(JSON)
    for k in range(40):
        texts = [f"often w{k} x{k * k}, {'y' * k}. often"]
        assert [memoryview(x).cast("I").tolist() for x in table.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(table) <= 20 + 20 and len(table.older) <= 40


def test_other_tokenizers_go_to_the_library(spark, hard, pairs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = [(300, "Hello  world\n\nfoo bar "), (301, " \t lead and trail \n")]
    df = hard.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    expected = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*pairs, *more]), key=key)
    assert sorted(map(tuple, token_counts.token_counts(df, path).collect()), key=key) == expected


def same_texts(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), t or "")].append(i)
    return groups


@pytest.mark.parametrize("share", [1 / 1024, 0.05, 1.0])
def test_exact_dedup(hard, empty, pairs, share):
    out = exact_dedup.exact_dedup(hard, min_share=share).collect()
    expected = []
    for t, ids in same_texts(pairs).items():
        keep = max((i for i in ids if i is not None), default=None)
        expected += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=key) == sorted(expected, key=key)
    assert sum(r.kept for r in out) == len(same_texts(pairs)) and all(r.keep_id == r.doc_id for r in out if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first_copies(hard, min_share=share)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in out if r.kept)


def test_heavy_hitters_are_named(spark):
    df = spark.range(20_000).selectExpr("if(id % 3 = 0, 7, id) AS k").repartition(9)
    named = {r.k: r.estimate for r in heavy.frequent(df, "k", tracked=64, top=8).collect()}
    assert named[7] >= 6666 and len(named) <= 8
    assert heavy.frequent(df.where("false"), "k").count() == 0


def test_line_dedup(hard, empty, pairs):
    seen, left = set(), {}
    for i, t in sorted(set(pairs), key=lambda p: (p[0] is None, p[0] or 0)):
        kept = []
        for lines in line_dedup.chunks(t or ""):
            text = "\n".join(lines)
            if len(lines) < 2 or text not in seen:
                kept += lines
                seen.add(text)
        left[i, t] = "\n".join(kept)
    expected = [(i, left[i, t]) for i, t in pairs]
    out = line_dedup.line_dedup(hard)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(expected, key=key)
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_chunks_resist_shifts(spark):
    lines = [f"line number {i * i % 97} {i}" for i in range(60)]
    a, b = "\n".join(lines), "\n".join(["new", *lines[:30], "inserted", *lines[31:]])
    shared = {tuple(c) for c in line_dedup.chunks(a)} & {tuple(c) for c in line_dedup.chunks(b)}
    assert sum(map(len, shared)) > 40
    out = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert out[1].text == a and out[2].n_removed_lines > 40 and "inserted" in out[2].text


def test_piece_codec(hard, empty, pairs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    more = ["  a  b", " ", "  ", "a ", "\n\t", "▁▁a▁ b", "é́ 日本語 ＡＢ", "a\x00b", "<s> </s>", "   x   y   "]
    df = hard.select("doc_id", "text").unionByName(hard.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = [*pairs, *((100 + i, t) for i, t in enumerate(more))]
    expected = []
    for i, t in rows:
        ids = model.encode(t or "", add_eos=True)
        expected.append((i, len(ids), ids, model.decode(ids)))
    assert sorted(map(tuple, piece_codec.piece_codec(df, MODEL).collect()), key=key) == sorted(expected, key=key)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    short = [(i, n, digest(" ".join(map(str, ids))), digest(back)) for i, n, ids, back in expected]
    assert sorted(map(tuple, piece_codec.piece_codec(df, MODEL, digests=True).collect()), key=key) == sorted(short, key=key)
    assert piece_codec.piece_codec(empty, MODEL).count() == 0


def test_words_are_segmented_once(monkeypatch):
    """All slices' rows of one bucket go through one table; a slice keeps its own order of words."""
    import pyarrow as pa

    real, seen = piece_codec.pieces(MODEL), []

    class Spy:
        def segment(self, words):
            seen.extend(words)
            return real.segment(words)

    monkeypatch.setattr(piece_codec, "pieces", lambda path: Spy())
    texts = [["the cat  sat the", "▁▁ the end "], ["the end of the cat", "", "a" * 70_000]]
    slices = []
    for part in texts:
        one = piece_codec.Slice()
        one.add(pa.array(range(len(part))), part)
        slices.append([one.words(1, pa.int64()), *one.texts(pa.int64())])
    words = pa.Table.from_batches([s[0].slice(0, 1) for s in slices]).combine_chunks().to_batches()
    assert sum(b.num_rows for b in words) == 2
    found = list(piece_codec._segmented(MODEL, words))
    distinct = {w for part in texts for t in part for w in piece_codec.marked_words(t)}
    assert len(seen) == len(set(seen)) == len(distinct)
    data = [r for b in found for r in b.column("data").to_pylist()]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k, part in enumerate(texts):
        rows = [(k, 0, None, data[k]), *((k, *r) for s in (slices[k][0].slice(1), slices[k][1]) for r in zip(*(s.column(c).to_pylist() for c in ("bucket", "ids", "data"))))]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        own = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["slice", "bucket", "ids", "data"])
        rows = pa.Table.from_batches(piece_codec._joined(real.end, False, [own])).to_pylist()
        assert [(r["ids"], r["decoded"]) for r in rows] == [(model.encode(t, add_eos=True), model.decode(model.encode(t))) for t in part]


@pytest.mark.parametrize(("buckets", "slice_words"), [(1, 1), (5, 10), (300, 250_000)])
def test_slices_and_buckets_change_nothing(spark, hard, pairs, buckets, slice_words):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = piece_codec.piece_codec(hard, MODEL, buckets=buckets, slice_words=slice_words).collect()
    assert sorted(((r.doc_id, r.ids) for r in out), key=key) == sorted(((i, model.encode(t or "", add_eos=True)) for i, t in pairs), key=key)


def test_reading_the_input_twice(spark, hard, pairs, tmp_path):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    hard.select("doc_id", "text").write.parquet(f"{tmp_path}/docs")
    files = spark.read.parquet(f"{tmp_path}/docs")
    out = piece_codec.piece_codec(files, MODEL, reread=True, slice_words=500).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in out), key=key) == sorted(((i, model.encode(t or "", add_eos=True), model.decode(model.encode(t or ""))) for i, t in pairs), key=key)
    import pyarrow as pa

    one = piece_codec.Slice()
    one.add(pa.array([1]), ["a b"])
    with pytest.raises(ValueError, match="another order"):
        list(piece_codec._joined(2, False, one.texts(pa.int64())))


def test_packed_parts_round_trip():
    for parts in ([], [b""], [b"", b"a" * 100_000, b"\x00\xff"], [b"x"] * 9):
        assert piece_codec.unpacked(piece_codec.packed(*parts)) == parts
    for numbers in ([], [0], [255, 256, 0], [1 << 31, 7], [65_535] * 5):
        assert piece_codec.numbers_of(piece_codec.planes(np.array(numbers, np.uint32))).tolist() == numbers


def test_cache_has_a_part_for_each_tokenizer(spark, hard, pairs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    by_json, by_model = (token_counts.token_counts(hard, p, cache).collect() for p in (JSON, MODEL))
    assert len(spark.read.parquet(cache).select("tokenizer").distinct().collect()) == 2
    assert sorted(map(tuple, by_model), key=key) == sorted(map(tuple, token_counts.token_counts(hard, MODEL, cache).collect()), key=key)
    assert sorted(map(tuple, by_json), key=key) == sorted(map(tuple, token_counts.token_counts(hard, JSON).collect()), key=key)
