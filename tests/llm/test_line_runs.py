"""Line dedup against a brute-force list of the runs of lines that stand earlier."""

import random

from pagewright.llm.line_dedup import line_dedup


def repeated(rows):
    """For each document, its lines that are in a run of two or more that stands earlier."""
    out, before = {}, []
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for a in range(len(lines) - 1):
            pair = lines[a : a + 2]
            if any(pair == x[b : b + 2] for x in before for b in range(len(x) - 1)) or any(pair == lines[b : b + 2] for b in range(a - 1)):
                gone |= {a, a + 1}
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        before.append(lines)
    return out


def test_short_blocks(spark):
    rng = random.Random(12)
    new = lambda n: [f"line {rng.randrange(1 << 40)}" for _ in range(n)]
    rows = []
    for i, size in enumerate([2, 2, 2, 3, 3, 4, 4, 6, 10, 20]):
        block = new(size)
        rows += [(i, "\n".join(new(3) + block + new(3))), (100 + i, "\n".join(new(2) + block + new(4)))]
    rows += [(50, "x\nx\nx"), (51, "y\ny\ny\ny\ny"), (52, "alone\n\n\nend"), (53, "other\n\n\nlast")]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    expected = repeated(rows)
    expected.update({52: rows[-2][1], 53: rows[-1][1]})  # lines without a word are no run
    assert {i: r.text for i, r in out.items()} == expected
    assert [out[100 + i].n_removed_lines for i in range(10)] == [2, 2, 2, 3, 3, 4, 4, 6, 10, 20]
    assert expected[50] == "x\nx\nx" and expected[51] == "y\ny"
