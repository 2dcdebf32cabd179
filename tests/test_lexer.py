"""The lexer against hand-derived cases, and against a writer by a round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.sources import lexer

CELL_TEXTS = [
    (r"\pard\plain\qc\f1\fs20 {Label", "Label"), (r"}\pard {B", "B"), (r"\b{Bold}", ""), (r"\fs20{10.5}", ".5"), (r"{\b Bold}", "Bold"),
    (r"\plain{\b Bold}", ""), (r"\super{a}b", ""), (r"a\'e9b", "ae9b"), (r"x\u8805?5", "x?5"), (r"a\~b", "ab"), (r"Week\~1", "Week1"), (r"a\line b", "ab"),
    ("a\\line\nb", "a\nb"), (r"{\*\bkmkstart x}T", "T"), (r"{\*\a {b} c}T", "T"), (r"{\*\a T", ""), (r"\{x\}", "x"), ("A{B{C}D}E", "ABCDE"), (r"\fs-20 x", "x"),
    ("", ""), (" \t\r\n", ""),
]


@pytest.mark.parametrize(("raw", "text"), CELL_TEXTS)
def test_cell_text(raw, text):
    assert lexer.cell_text(raw) == text


def test_decoded_escapes():
    assert lexer.cell_text(r"a\'e9b \u8805?x5", decode_escapes=True) == "aéb ≥5"
    assert lexer.unescape(r"\u-3913 x") == chr(65536 - 3913) + "x"


def test_twenty_passes_at_most():
    assert lexer.cell_text("{" * 30 + "x" + "}" * 30) == "x"


def test_merges():
    (row,) = lexer.parse_table(r"\trowd\clmgf\cellx1000\clmrg\cellx2500\cellx3700 A\cell x\cell B\cell\row")
    assert [c["text"] for c in row["cells"]] == ["A", "A", "B"]
    assert [c["colspan"] for c in row["cells"]] == [2, 0, 1]
    assert [c["width_twips"] for c in row["cells"]] == [1000, 1500, 1200]
    (row,) = lexer.parse_table(r"\trowd\clmrg\cellx1000\cellx2500 x\cell B\cell\row")
    assert [(c["text"], c["colspan"]) for c in row["cells"]] == [("", 1), ("B", 1)]


def test_overlapping_rows():
    rows = lexer.parse_table(r"\trowd\cellx10 A\cell \trowd\cellx20 \row")
    assert len(rows) == 2 and [c["text"] for c in rows[1]["cells"]] == [""]


def test_rows_without_cells_or_end():
    with pytest.raises(lexer.LexError) as e:
        lexer.parse_table(r"\trowd A\cell\row")
    assert e.value.stage == "parse_row"
    assert lexer.parse_table(r"x\row") == [] and lexer.parse_table(r"\trowd\cellx1 a\cell") == []


def test_headers_and_alignment():
    (row,) = lexer.parse_table(r"\trowd\cellx10\cellx20\qc\b A\cell\qr\b B\cell\row")
    assert row["is_header"] and [c["align"] for c in row["cells"]] == ["center", "right"]
    (row,) = lexer.parse_table(r"\trowd\cellx10\cellx20\b A\b0\cell\qj\b B\cell\row")
    assert not row["is_header"] and row["cells"][1]["align"] is None
    (row,) = lexer.parse_table(r"\trowd\trhdr\cellx10 A\cell\row")
    assert row["is_header"]


def test_pages_and_parameters():
    text = r"{\rtf1\sectd{\header\trowd\cellx9 parameter:  ALT \cell\row}\trowd\cellx9 a\cell\row\sect\sectd{\headerl x}\trowd\cellx9 b\cell\row}"
    pages = lexer.parse_report(text)
    assert [p["parameter"] for p in pages] == ["ALT", None]
    assert [[c["text"] for c in p["rows"][0]["cells"]] for p in pages] == [["a"], ["b"]]


def test_groups():
    assert lexer.extract_group(r"x{\header a{b}c}y", "header") == r"\header a{b}c"
    assert lexer.extract_group(r"x\header a", "header") is None and lexer.extract_group(r"{\header a", "header") is None
    assert lexer.remove_group(r"a{\footer x}b{\footer y}c\footer z{\footer w}", "footer") == r"abc\footer z{\footer w}"


WORDS = st.text(st.characters(blacklist_characters="\\{}", blacklist_categories=("Cs", "Cc", "Zs", "Zl", "Zp")), max_size=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(WORDS, min_size=1, max_size=5), min_size=1, max_size=6))
def test_round_trip(table):
    rows = "".join("\\trowd" + "".join(f"\\cellx{(i + 1) * 100}" for i in range(len(r))) + "".join(f"\\ql {c}\\cell" for c in r) + "\\row\n" for r in table)
    (page,) = lexer.parse_report("{\\rtf1\\sectd " + rows + "}")
    assert [[c["text"] for c in r["cells"]] for r in page["rows"]] == table
