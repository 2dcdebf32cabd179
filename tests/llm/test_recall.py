"""What substring dedup removes, against all pairs of documents."""

import random

import numpy as np

from pagewright.llm import substring_dedup as S

LEAST = 50


def runs(rows, least=LEAST):
    """For each document the words that are in a run of ``least`` that stands in an earlier document."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        words = text.lower().split()
        must = np.zeros(len(words), bool)
        for p in range(len(words) - least + 1):
            if seen.setdefault(" ".join(words[p : p + least]), i) != i:
                must[p : p + least] = True
        out[i] = must
    return out


def corpus(seed=41, n=30):
    """Passages of 50 to 90 words inside lines of other words, each in two documents; the first one has
    an exact and an edited copy; some passages are one word over and over."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9)))
    new = lambda a, z: [word() for _ in range(rng.randrange(a, z))]
    rows = []
    for p in range(n):
        passage = [f"over{p}"] * 130 if p % 10 == 9 else new(50, 91)
        for k in (0, 100):
            lines = [new(5, 40), [*new(0, 20), *passage, *new(0, 20)], new(5, 40)]
            rows.append((k + p, "\n".join(map(" ".join, lines))))
        first = rows[-2][1]
        rows += [(200 + p, first), (300 + p, first.replace(" ", " edited ", 1))]
    rows += [(1000 + p, "\n".join(" ".join(new(30, 80)) for _ in range(4))) for p in range(n)]
    return rows


def cut(df):
    return {r.doc_id: r for r in S.substring_dedup(df).collect()}


def test_runs_of_fifty_words(spark):
    rows = corpus()
    out, must = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), runs(rows)
    found = total = 0
    for i, wanted in must.items():
        got = np.zeros(len(wanted), bool)
        for s in out[i].spans:
            got[s.a : s.z] = True
        found, total = found + int((wanted & got).sum()), total + int(wanted.sum())
        assert i < 1000 or not got.any(), "clean documents stay as they are"
    assert total > 5000 and found >= 0.99 * total


def test_edited_lines(spark):
    """Lines of 50 words or more with some words changed are near their first copy and go whole."""
    rng = random.Random(43)
    rows, near = [], 0
    for p in range(40):
        words = [f"w{p}x{k}" for k in range(rng.randrange(60, 400))]
        rows.append((p, "own start\n" + " ".join(words)))
        for at in range(rng.randrange(20, 40), len(words), 55):
            words[at] = "other"
        line = " ".join(words)
        rows.append((100 + p, f"another start of {p}\n{line}"))
        near += S.similar(S.shingles(rows[-2][1].split("\n")[1]), S.shingles(line))
    out = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    gone = sum(out[100 + p].text.split() == f"another start of {p}".split() for p in range(40))
    assert near >= 30 and gone >= 0.95 * near and all(not out[p].spans for p in range(40))


def test_a_text_is_no_copy_of_its_own_line(spark):
    """A line and the short paragraphs in it overlap; where no other document has them, nothing goes."""
    rng = random.Random(44)
    rows = [(p, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for p, n in enumerate([50, 51, 60, 100, 400])]
    rows += [(10, "same " * 60), (11, "alone " * 49), (12, "a b c " * 17)]
    out = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(not out[i].spans and out[i].text == t for i, t in rows if i != 10)


def test_paragraphs_of_monotonous_text():
    for around in (["x", "y", "z"], ["one"], []):
        p = S.Paragraphs([" ".join([*around, *["the"] * 300, "end"]), " ".join(["the"] * 300)])
        assert len(set(p.identity()[p.doc == 0].tolist()) & set(p.identity()[p.doc == 1].tolist())) >= 1


def test_paragraphs_without_bands_are_like_no_other():
    """Over words of few kinds, where shingles recur all the time: all pairs of short paragraphs."""
    rng = random.Random(47)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(6, 10))) for _ in range(1500)]
    texts += [" ".join((["a", "b", "c"][: rng.randrange(1, 4)] * 5)[: rng.randrange(6, 10)]) for _ in range(200)]
    own = sorted(set(texts))
    alike = []
    for t in own:
        p = S.Paragraphs([t])
        whole = np.flatnonzero((p.a == 0) & (p.z == len(t.split())))
        alike.append(not len(whole) or bool(p.alike[whole[0]]))
    sets = [S.shingles(t) for t in own]
    assert not all(alike) and any(alike)
    for i, mine in enumerate(sets):
        if not alike[i]:
            assert not any(j != i and S.similar(mine, other) for j, other in enumerate(sets)), own[i]


def test_sets_and_arrays_compare_alike():
    rng = random.Random(48)
    for _ in range(200):
        n = rng.randrange(400, 700)
        x, y = (np.array(sorted(rng.sample(range(2**63, 2**63 + 1000), k)), np.uint64) for k in (n, rng.randrange(n - 60, n + 60)))
        sets = [frozenset(v.tolist()) for v in (x, y)]
        assert S.common(x, y) == S.common(sets[0], y) == S.common(x, sets[1]) == S.common(*sets)
        assert S.similar(x, y) == S.similar(*sets)
    lines = [" ".join(f"w{k}" for k in range(a, a + n)) for a, n in ((0, 500), (10, 500), (20, 520), (5000, 600), (5010, 600))]
    p = S.Paragraphs(lines)
    long = range(p.n_short, len(p.start))
    links = S.link_similar(list(long), [p.shingles(i) for i in long])
    assert links == S.link_similar(list(long), lines) and len(links) == 3
