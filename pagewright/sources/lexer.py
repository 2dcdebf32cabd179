"""From the text of an RTF report to pages, rows and cells.

All places are code points. Escapes in cell texts (``\\uN``, ``\\'xx``) are dropped with the other
control words unless ``decode_escapes`` is asked for; braces are matched without regard to
backslashes; groups are flattened innermost first, in at most ``PASSES`` passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

PASSES = 20
LOOK_BACK = 5
BLANK = " \t\r\n"
#: Groups that are no part of a page's body.
MARGINS = ("header", "footer", "headerf", "footerf", "headerl", "headerr", "footerl", "footerr")

_BRACE = re.compile(r"[{}]")
_SECTION = re.compile(r"\\sect(?![a-zA-Z])")
_ROW_START = re.compile(r"\\trowd(?![a-zA-Z])")
_ROW_END = re.compile(r"\\row(?![a-zA-Z])")
_CELL_END = re.compile(r"\\cell(?![a-zA-Z])")
_EDGE = re.compile(r"\\cellx([0-9]+)")
_HEADER = re.compile(r"\\trhdr(?![a-zA-Z])")
_FIRST = re.compile(r"\\clmgf(?![a-zA-Z])")
_CONTINUED = re.compile(r"\\clmrg(?![a-zA-Z])")
_BOLD = re.compile(r"\\b(?![a-zA-Z0-9])")
_BOLD_OFF = re.compile(r"\\b0(?![a-zA-Z])")
_ALIGN = tuple((re.compile(rf"\\{word}(?![a-zA-Z])"), name) for word, name in (("ql", "left"), ("qr", "right"), ("qc", "center")))
_INNERMOST = re.compile(r"\{((?:[^{}\\]|\\.)*+)\}", re.S)
_WORD = re.compile(r"\\[a-zA-Z]+-?[0-9]* ?")
_WORD_OR_SYMBOL = re.compile(r"\\[a-zA-Z]+-?[0-9]* ?|\\.", re.S)
_ESCAPE = re.compile(r"\\u(-?[0-9]+|-)\??.?|\\'([0-9a-fA-F]{2})", re.S)
_PARAMETER = re.compile(r"^Parameter:\s*(.+)$", re.I)


class LexError(ValueError):
    """A report that cannot be read; ``stage`` says where."""

    def __init__(self, stage: str, cause: str):
        super().__init__(cause)
        self.stage = stage


def closing(text: str, start: int) -> int | None:
    """The place of the brace that closes the one at ``start``."""
    depth = 0
    for m in _BRACE.finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return None


def group_span(text: str, tag: str) -> tuple[int, int] | None:
    """(open, close) of the first group that ``\\tag`` opens, with ``{`` a few characters before it."""
    m = re.search(rf"\\{tag}(?![a-zA-Z])", text)
    if m is None:
        return None
    if m.start() == 0:
        raise LexError("group", f"\\{tag} stands at the start of the text")
    start = text.rfind("{", max(0, m.start() - LOOK_BACK), m.start())
    end = closing(text, start) if start >= 0 else None
    return None if end is None else (start, end)


def extract_group(text: str, tag: str) -> str | None:
    span = group_span(text, tag)
    return None if span is None else text[span[0] + 1 : span[1]]


def remove_group(text: str, tag: str) -> str:
    """Without all groups of a tag; stops at the first one that is not braced or not balanced."""
    while (span := group_span(text, tag)) is not None:
        text = text[: span[0]] + text[span[1] + 1 :]
    return text


def unescape(text: str) -> str:
    """``\\uN`` with its replacement character, and ``\\'xx`` as Latin-1."""

    def char(m: re.Match) -> str:
        if m[2] is not None:
            return bytes.fromhex(m[2]).decode("latin-1")
        n = int(m[1]) if m[1] != "-" else 0
        code = (n + 65536 if n < 0 else n) & 0xFFFF
        return "\ufffd" if 0xD800 <= code < 0xE000 else chr(code)

    return _ESCAPE.sub(char, text)


def _without_destinations(text: str) -> str:
    """Without ``{\\*...}`` groups, nested ones included; an unclosed one runs to the end."""
    out, at = [], 0
    while (start := text.find("{\\*", at)) >= 0:
        out.append(text[at:start])
        end = closing(text, start)
        at = len(text) if end is None else end + 1
    out.append(text[at:])
    return "".join(out)


def cell_text(raw: str, decode_escapes: bool = False) -> str:
    """The plain text of a cell."""
    text = unescape(raw) if decode_escapes else raw
    if "{" in text:
        text = _without_destinations(text)
        for _ in range(PASSES):
            text, changed = _INNERMOST.subn(lambda m: _WORD.sub("", m[1]), text)
            if not changed:
                break
    text = _BRACE.sub("", _WORD_OR_SYMBOL.sub("", text))
    return (unescape(text) if "\\" in text else text).strip(BLANK)


def split_pages(text: str) -> list[str]:
    return [p for p in _SECTION.split(text) if "\\sectd" in p]


def parse_row(text: str, decode_escapes: bool = False) -> dict:
    """One table row: is_header and cells."""
    edges = list(_EDGE.finditer(text))
    if not edges:
        raise LexError("parse_row", "a row defines no cell")
    stops = [int(m[1]) for m in edges]
    widths = [b - a for a, b in zip([0, *stops], stops)]
    firsts = conts = [False] * len(edges)
    if "\\clm" in text:
        segments = [text[a:b] for a, b in zip([0, *(m.start() for m in edges)], (m.start() + 1 for m in edges))]
        firsts = [bool(_FIRST.search(s)) for s in segments]
        conts = [bool(_CONTINUED.search(s)) for s in segments]
    chunks = _CELL_END.split(text)
    chunks = chunks[:-1] if len(chunks) > 1 else chunks
    filled = [c for c in chunks if c.strip(BLANK)]
    header = bool(_HEADER.search(text)) or bool(filled) and all(_BOLD.search(c) and not _BOLD_OFF.search(c) for c in filled)
    cells = [
        {
            "text": cell_text(c, decode_escapes),
            "width_twips": widths[i] if i < len(widths) else 0,
            "align": next((name for pattern, name in _ALIGN if pattern.search(c)), None),
            "is_merge_first": i < len(widths) and firsts[i],
            "is_merge_cont": i < len(widths) and conts[i],
            "colspan": 1,
        }
        for i, c in enumerate(chunks)
    ]
    _merge(cells)
    return {"is_header": header, "cells": cells}


def _merge(cells: list[dict]) -> None:
    """Continuations repeat the text of the last merge start; spans are counted on its cell."""
    said, owner = "", None
    for c in cells:
        if c["is_merge_first"]:
            said, owner = c["text"], c
        elif c["is_merge_cont"]:
            if len(cells) > 1:
                c["text"] = said
            if owner is not None:
                owner["colspan"] += 1
                c["colspan"] = 0
        else:
            owner = None


def parse_table(text: str, decode_escapes: bool = False) -> list[dict]:
    """A row for each ``\\trowd``, up to the next ``\\row``; such ranges may overlap."""
    ends = [m.start() for m in _ROW_END.finditer(text)]
    rows, k = [], 0
    for m in _ROW_START.finditer(text):
        while k < len(ends) and ends[k] <= m.start():
            k += 1
        if k == len(ends):
            break
        rows.append(parse_row(text[m.start() : ends[k] + 4], decode_escapes))
    return rows


def parameter_of(rows: list[dict]) -> str | None:
    """The value of the lowest, leftmost ``Parameter: value`` cell of a page header."""
    for row in reversed(rows):
        for c in row["cells"]:
            if m := _PARAMETER.search(c["text"]):
                return m[1].strip(BLANK)
    return None


def parse_page(text: str, decode_escapes: bool = False) -> dict:
    """parameter and the body's rows, in order."""
    head = extract_group(text, "header")
    for tag in MARGINS:
        text = remove_group(text, tag)
    parameter = parameter_of(parse_table(head, decode_escapes)) if head is not None else None
    return {"parameter": parameter, "rows": parse_table(text, decode_escapes)}


def parse_pages(text: str, decode_escapes: bool = False) -> Iterator[dict]:
    return (parse_page(p, decode_escapes) for p in split_pages(text))


def parse_report(text: str, decode_escapes: bool = False) -> list[dict]:
    return list(parse_pages(text, decode_escapes))


def picture(text: str) -> str | None:
    """The first ``\\pict`` group with its braces, if it holds a PNG."""
    span = group_span(text, "pict")
    group = None if span is None else text[span[0] : span[1] + 1]
    return group if group is not None and re.search(r"\\pngblip(?![a-zA-Z])", group) else None
