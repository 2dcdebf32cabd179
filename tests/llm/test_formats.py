"""Chat formatting, HTML extraction, the registered queries and the pipeline."""

import hashlib
import json
import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import chat_format as C
from pagewright.llm import html_extract as H
from pagewright.llm.html_extract import html_extract, main_text

TEXTS = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "\\", "\n", "<", "<<SYS>>", "a", "|>", "<s"]), max_size=8).map("".join))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXTS), TEXTS), max_size=5))
def test_round_trip(turns):
    text, spans = C.formatted(turns)
    assert C.read_back(text) == turns
    assert [C.unescape(text[a:z]) for a, z in spans] == [t for r, t in turns if r == "assistant"]
    inside = text
    for part in (C.OPEN, C.CLOSE.strip()):
        inside = inside.replace(part, "")
    assert not C.CONTROL.search(inside)


def test_layouts(spark):
    user, said = ("user", "q"), ("assistant", "a")
    records = {
        "messages": ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [user, said]),
        "conversations": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [user, said]),
        "prompt": ({"completion": "a", "prompt": "q"}, [user, said]),
        "instruction_input": ({"instruction": "q", "input": "", "output": "a"}, [user, said]),
        "system_instruction": ({"system": "s", "instruction": "q", "output": None}, [("system", "s"), user, ("assistant", "")]),
        "nested_prompt": ({"data": {"prompt": "q", "completion": "a"}}, [user, said]),
    }
    rows = [(k, json.dumps(r)) for k, (r, _) in records.items()] + [("none", json.dumps({"x": 1})), ("bad", "{"), ("null", None), ("list", "[1]"), ("no_turns", '{"messages": []}')]
    out = {r.key: r for r in C.chat_format(spark.createDataFrame(rows, "key string, record string"), "key", "record").collect()}
    for k, (_, turns) in records.items():
        assert out[k].mapping == k and [(t.role, t.text) for t in out[k].turns] == turns and C.read_back(out[k].formatted) == turns
    assert out["none"].problem and out["none"].formatted is None and out["bad"].problem and out["null"].problem and out["list"].problem
    assert out["no_turns"].formatted == ""


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (None, None, "user", "y"), (2, 0, "user", "é\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in C.digests_of(C.chat_format(C.message_records(df), "conv_id", "record"), "conv_id").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (out[1].n_turns, out[1].loss_chars, out[1].loss_sha256) == (3, 2, digest("bb"))
    assert out[1].turns_sha256 == digest("user\n\nassistant\nb\nassistant\nb\n") and out[None].turns_sha256 == digest("user\ny\n\nx\n")
    assert out[2].turns_sha256 == digest("user\né\n\n") and C.message_records(df.where("false")).count() == 0


def test_records_without_a_mapping_keep_a_row(spark):
    rows = [("a", json.dumps({"messages": [{"role": "human", "content": "q"}, {"role": "model", "content": "a"}]})), ("b", "{"), ("c", json.dumps({"x": 1})), ("d", None)]
    out = {r.key: r for r in C.digests_of(C.chat_format(spark.createDataFrame(rows, "key string, record string"), "key", "record"), "key").collect()}
    assert set(out) == {"a", "b", "c", "d"} and out["b"].n_turns is None and out["d"].turns_sha256 is None
    # messages keep the roles that they give
    assert out["a"].turns_sha256 == hashlib.sha256(b"human\nq\nmodel\na\n").hexdigest() and out["a"].loss_chars == 0
    assert C.chat_format(spark.createDataFrame([], "key string, record string"), "key", "record").count() == 0


def plain_chat(rows):
    """conv_id -> (turns, digest of turns, loss) by sorting and joining."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        out[conv] = (len(turns), digest(said), len(loss), digest(loss))
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_registered_chat_query(spark):
    """The query, conversation -7 included, against a plain version."""
    from pagewright.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", queries.INST), (-7, 1, "assistant", queries.INST)]
    out = queries.op5_chat_format(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == plain_chat(rows) and len(out) == len(plain_chat(rows))
    own = next(r for r in out if r.conv_id == -7)
    assert (own.n_turns, own.loss_chars) == (2, len(queries.INST))


LONG = "A long paragraph, with commas, that tells what happened in the town on that day, and why it mattered to all of them."
PAGES = {
    "article": (f"<body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div><article><h1>Title</h1><p>{LONG}<p><b>{LONG}<br>x</b></article><footer>&copy; us</footer></body>", f"Title {LONG} {LONG} x"),
    "div": (f"<div id=header>Top</div><div id=wrap><div class=sidebar><p>{LONG}</p></div><div class=story><p>{LONG}</p><p>Short &amp; sweet&nbsp;one.</p></div><div class=comments><p>{LONG}</p></div></div>", f"{LONG} Short & sweet one."),
    "siblings": (f"<main><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG}</p><p>{LONG}</p></section><aside>{LONG}</aside></main>", " ".join([LONG] * 4)),
    "forms": (f"<article><form><input><label>Name</label></form><p>{LONG}</p><script>if (a < b) x('<p>no</p>')</script><style>p{{}}</style><noscript>no</noscript></article>", LONG),
    "list": (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", f"{LONG} one two a b"),
    "inline": (f"<article><p>{LONG[:40]}<b>{LONG[40:]}</b></p></article>", LONG),
    "cut": (f"<article><p>{LONG}</p><p>{LONG} and</p><p cla", f"{LONG} {LONG} and"),
    "comment": (f"<article><!-- <p>no</p> --><p>{LONG}</p></article>", LONG),
    "plain": ("just text", "just text"),
    "blank": ("  ", ""), "empty": ("", ""), "null": (None, ""), "no_text": ("<html><body><p></p></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def plain_scores(root):
    """Points and link density by walking up from each block, element by element."""
    points, totals = {}, {}

    def own(node, link=False):
        for c in node.children:
            if isinstance(c, str):
                yield c, link
            elif c.tag in H.INLINE and not c.off:
                yield from own(c, link or c.tag == "a")

    def visit(node):
        if node.tag not in H.INLINE:
            texts = [(c, link) for c, link in own(node) if c.strip()]
            chars = sum(len(c) - c.count(" ") // 2 for c, _ in texts)
            linked = sum(len(c) - c.count(" ") // 2 for c, link in texts if link)
            if chars:
                commas = sum(c.count(",") for c, _ in own(node))
                gain = 1 + commas + min(chars / 100, 3) if node.tag in H.PARAGRAPHS and chars >= 25 else 0
                up = node.parent if node.tag in ("p", "pre", "td", "li") else node
                for share in (1, 0.5, 0.25):
                    if up is not None:
                        points[up] = points.get(up, 0) + gain * share
                        up = up.parent
                up = node
                while up is not None:
                    totals[up] = (totals.get(up, (0, 0))[0] + chars, totals.get(up, (0, 0))[1] + linked)
                    up = up.parent
        for c in node.children:
            if not isinstance(c, str) and not c.off:
                visit(c)

    visit(root)
    density = {n: z / max(c, 1) for n, (c, z) in totals.items()}
    named = lambda n: f"{n.marks.get('class', '')} {n.marks.get('id', '')}"
    return {n: (p + 25 * (n.tag in ("article", "main")) + 10 * bool(H.ON.search(named(n)))) * (1 - density.get(n, 0)) for n, p in points.items()}, density


def random_page(rng):
    """Well- and ill-formed markup at random."""
    words = lambda n: " ".join(rng.choice(["town", "river,", "day.", "the", "&amp;", "of"]) for _ in range(n))
    out = []
    for _ in range(rng.randrange(1, 40)):
        tag = rng.choice("div p section article b a li ul td tr table span nav h2 center i".split())
        mark = rng.choice(["", "", " class='story'", " class=ad", " id=x>", ' title="a > b"'])
        out.append(rng.choice([f"<{tag}{mark}>", f"<{tag}{mark}>", f"</{tag}>", words(rng.randrange(0, 30)), "<br>", f"<p>{words(30)}</p>"]))
    return "".join(out)


def test_scores_against_plain_ones():
    rng = random.Random(17)
    for _ in range(300):
        root = H.parse(random_page(rng))
        points, density = H.score(root)
        expected, dense = plain_scores(root)
        assert points.keys() == {id(n) for n in expected} and density.keys() == {id(n) for n in dense}
        assert all(abs(points[id(n)] - p) < 1e-9 for n, p in expected.items()) and all(abs(density[id(n)] - d) < 1e-9 for n, d in dense.items())


@pytest.mark.parametrize(
    "page",
    ["<p " + "a" * 100_000 + '"', '<p class="' + "a" * 100_000, "<div>" * 100_000 + "end", "<center>" * 50_000 + "</font></i>" * 50_000, "<center><tr>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000, "<p " + '="' * 50_000, "<li><b>" * 50_000, "<" * 100_000],
    ids=range(9),
)
def test_bad_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 5


def test_quotes_and_loose_text():
    assert main_text(f'<article><p class="x>one</p><p>{LONG}</p></article>') == f"one {LONG}", "a quote that is never closed"
    assert main_text(f"<article><p class=a don't=1>{LONG}</p><p>it's {LONG}</p></article>") == f"{LONG} it's {LONG}"
    assert main_text(f"<article><p title=\"a > b\">{LONG}</p></article>") == LONG
    inner = f"<div class=story><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(f"<div>A lead sentence.{inner}<b>Closing</b> words of the piece.</div>") == f"A lead sentence. {LONG} {LONG} Closing words of the piece."
    assert main_text(f"<div>lead{inner}<a href=x>more stories here</a></div>") == f"{LONG} {LONG}", "neither prose nor a sentence"


def test_html_extract(spark):
    df = spark.createDataFrame([(i, None, p, 1, "x") for i, (p, _) in enumerate(PAGES.values())], "page_id long, url string, html string, id int, text string")
    out = html_extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES.values())}
    assert html_extract(df.where("false")).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline(spark, tmp_path):
    """All stages against plain versions of each on what the stage before it kept."""
    import corpus_pipeline
    from pagewright.llm import quality_rules
    from tests.llm.test_group_operators import plain_fingerprint, planted, roots

    passages, rows = planted(21, 10)
    filler = " the of and to in a is that it was for on "
    rows = [(i, filler + t + filler) for i, t in rows]
    rows += [(500, rows[3][1]), (501, rows[4][1].upper()), (502, "too short"), (503, "### $$$ %%% " * 30)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good = {r.doc_id for r in quality_rules.quality_rules(df).where("kept").collect()}
    assert set(kept[0]) == good and not {502, 503} & good
    assert set(kept[1]) == good - {rows[3][0], rows[4][0]} | ({500, 501} & good)
    prints = {i: plain_fingerprint(t) for i, t in kept[1].items()}
    root = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert set(kept[2]) == set(root.values())
    text = "\n".join(kept[3].values())
    assert sum(text.count(" ".join(p)) > 1 for p in passages) == 0 and sum(" ".join(p) in text for p in passages) == len(passages)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(kept[3])


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_hard_and_empty_tables(spark, hard, tmp_path):
    """Nulls, repeats, very long texts and columns of clashing names; no rows at all."""
    import corpus_pipeline

    filler = " the of and to in a is that it was for on "
    good = [(50 + i, filler + " ".join(f"word{i * 100 + k}" for k in range(1, 40)), None, None, None) for i in range(4)]
    rows = spark.createDataFrame([*good, good[0], (None, good[1][1], None, "s", 3), (None, None, None, None, None)], DOCUMENTS)
    taken = ("text_hash", "row_key", "gone_id", "gone_hash", "gone_digest", "digest", "slot", "bits", "place", "spans_", "cuts", "kept_by", "doc", "quality", "__id", "__h", "__key", "id", "h")
    docs = rows.unionByName(hard.select("doc_id", "text", "lang", "source", "n_chars")).selectExpr("*", *(f"'x' AS `{c}`" for c in taken))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    ids = [r.doc_id for r in docs.collect()]
    assert ids.count(50) == 1 and {51, 52, 53} <= set(ids) and all(r.digest == "x" and r.cuts == "x" for r in docs.collect())
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_batches_are_bound_by_bytes(spark):
    from pagewright.llm.shared import ARROW_BYTES, small_batches

    small_batches(spark)
    df = spark.range(8).selectExpr("id", "repeat('x', 3000000) AS t").coalesce(1)
    sizes = [r.n for r in df.mapInArrow(_count_rows, "n long").collect()]
    assert sum(sizes) == 8 and max(sizes) * 3_000_000 <= 2 * ARROW_BYTES


def _count_rows(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])
