"""SimHash near-dedup, substring dedup, packing, components against plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pagewright.llm import components, membership, packing, simhash_dedup, substring_dedup

JSON = public_tokenizers.path("word_bpe_49k.json")


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_masks_cover():
    rng = random.Random(1)
    masks = simhash_dedup.covering_masks()
    assert len(masks) == 31
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(differ & m == 0 for m in masks)


@pytest.mark.parametrize("bucket", [8, 8192])
def test_near_duplicates(spark, hard, empty, pairs, bucket):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    base = [word() for _ in range(400)]
    more = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(400)] = word()
        more.append((1000 + i, " ".join(own)))
    df = hard.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [*pairs, *more]
    prints = [plain_fingerprint(t or "") for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(range(len(rows)), linked)
    least = defaultdict(list)
    for i, r in root.items():
        least[r].append(rows[i][0])
    expected = sorted(((rows[i][0] is None, rows[i][0] or 0, f"{prints[i]:016x}", min((d for d in least[root[i]] if d is not None), default=None)) for i in root), key=str)
    out = simhash_dedup.near_duplicates(df, bucket=bucket).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in out), key=str) == expected
    kept = simhash_dedup.keep_one_of_each(df, bucket=bucket)
    assert kept.columns == df.columns and kept.count() == len(least)
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_bucket_links_lose_nothing():
    rng = np.random.default_rng(5)
    center = rng.integers(0, 1 << 63, 3)
    prints = np.unique(np.concatenate([c ^ (1 << rng.integers(0, 63, 80)) ^ (1 << rng.integers(0, 63, 80)) for c in center]).astype(np.int64))
    links = simhash_dedup.link_bucket(prints, 4)
    nodes = [int(x) for x in prints.view(np.uint64)]
    pairs = [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4]
    assert len(links) < len(nodes) and roots(nodes, links) == roots(nodes, pairs)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(300, 300 + i) for i in range(1, 150)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(5, 5), (None, 3)]
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    expected = roots({x for e in real for x in e}, real)
    assert {r.node: r.root for r in out.collect()} == expected and out.count() == len(expected)


def planted(seed=7, n=40):
    """Documents of random words; each passage of over 50 words stands in two of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", ".", ","])
    passages, rows = [], []
    for p in range(n):
        passages.append([word() for _ in range(rng.randrange(52, 75))])
        for k in range(2):
            own = [word() for _ in range(rng.randrange(20, 200))]
            at = rng.randrange(len(own))
            rows.append((100 * k + p, " ".join([*own[:at], *passages[p], *own[at:]])))
    return passages, rows


def test_substring_dedup(spark, hard, empty):
    passages, rows = planted()
    clean = [(1000 + i, " ".join(f"w{i}x{j}" for j in range(150))) for i in range(20)] + [(2000 + i, f"own words of {i} here. Licensed under the same short licence, version two.") for i in range(9)]
    df = spark.createDataFrame([*rows, *clean], "doc_id long, text string").repartition(5)
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    caught = sum(out[100 + p].n_removed_words >= len(w) - 8 and out[100 + p].kept_by == [p] for p, w in enumerate(passages))
    assert caught >= 0.95 * len(passages)
    assert all(out[p].n_removed_words == 0 for p in range(len(passages))), "the first copy stays"
    assert all(out[i].text == t for i, t in clean)
    again = hard.select("doc_id", "text")
    whole = {(r.doc_id, r.text) for r in substring_dedup.substring_dedup(again).collect()}
    assert substring_dedup.substring_dedup(again).count() == hard.count() and (17, "x" * 50_000) in whole
    kept = substring_dedup.keep_rest(hard)
    assert kept.columns == hard.columns and kept.where("doc_id = 13 and text is null or doc_id = 14 and text = ''").count() == 2
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("bucket", [4, 2048])
def test_similar_paragraphs_link(spark, bucket):
    """Against all pairs: what the bands bring together is joined if and only if it is similar."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(40):
        own = list(base)
        own[rng.choice([0, 1, 38, 39])] = f"x{rng.randrange(9)}"
        texts.append(" ".join(own))
    texts = sorted(set(texts))
    sets = [substring_dedup.shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if substring_dedup.similar(sets[i], sets[j])]
    links = substring_dedup.link_similar(list(range(len(texts))), texts)
    assert roots(range(len(texts)), links) == roots(range(len(texts)), pairs)
    rows = spark.createDataFrame([(0, 5, u) for u in range(len(texts))], "t long, k long, u long")
    spread = simhash_dedup.spread_large(rows, "u", bucket).collect()
    met = defaultdict(set)
    for r in spread:
        met[r.t, r.k].add(r.u)
    assert all(any({i, j} <= m for m in met.values()) for i in range(len(texts)) for j in range(i))


def test_paragraphs_resist_shifts():
    passages, _ = planted(11, 3)
    text = " ".join(passages[0] + passages[1] + passages[2])
    for lead in ("", "some other words before it. ", "x "):
        p = substring_dedup.Paragraphs(["zero", lead + text])
        assert np.all(p.doc == 1) and len(p.identity()) == len(p.start)
    a, b = substring_dedup.Paragraphs([text]), substring_dedup.Paragraphs(["one two three four five six", "lead in " + text + " tail"])
    assert len(set(a.identity().tolist()) & set(b.identity().tolist())) >= len(a.start) - 2
    assert substring_dedup.Paragraphs([]).bands()[0].size == 0 and substring_dedup.Paragraphs(["", "a"]).identity().size == 0


def test_membership(spark):
    keys = spark.range(1000).selectExpr("xxhash64(id) AS k")
    bits = membership.bitmap(keys, "k").value
    inside = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    assert membership.maybe(bits, inside).all()
    assert membership.maybe(bits, np.random.default_rng(1).integers(0, 1 << 63, 10_000).astype(np.uint64)).sum() < 5


@pytest.mark.parametrize("target", [3, 100_000])
def test_packing(hard, empty, pairs, target):
    library = Tokenizer.from_file(JSON)
    rows = packing.best_fit_packing(hard, JSON, length=64, target=target).collect()
    expected = []
    for i, t in pairs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:5])
    assert sorted((tuple(r[:5]) for r in rows), key=order) == sorted(expected, key=order)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    sizes = np.array([r.length for r in rows])
    assert packing.lower_bound(sizes, 64) <= len(sequences) <= packing.lower_bound(sizes, 64) + 1
    assert packing.best_fit_packing(empty, JSON).count() == 0


def test_bounds_and_fit():
    rng = np.random.default_rng(8)
    for _ in range(60):
        sizes = rng.integers(1, 64, rng.integers(1, 60))
        bins, offsets, free = packing.best_fit(sizes, 64)
        assert packing.lower_bound(sizes, 64) <= len(free)
        used = np.bincount(bins, sizes, len(free))
        assert (used <= 64).all() and (64 - used == free).all()
    assert packing.lower_bound(np.full(10, 33), 64) == 10 and packing.lower_bound(np.full(9, 22), 64) == 5 and packing.lower_bound(np.array([], int)) == 0


def test_slices_hold_all_rows():
    import pyarrow as pa

    texts = ["a" * n for n in (3, 50, 0, 7, 7, 7, 200, 1)]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = [x.column("text").to_pylist() for x in substring_dedup.slices([b, b.slice(0, 0)], 20)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= 20 for p in parts)
