"""Chat formatting by schema fingerprints.

A record is one JSON object. Its fingerprint is the SHA-256 of its sorted nested field paths (a
list is written ``[]``, values do not count), and selects a declarative mapping from the table
``MAPPINGS``: where the turns are, which fields hold role and text, how roles are renamed. The
canonical turns are then written with a template whose control strings are escaped reversibly
inside texts, with the spans of the assistant's texts as the loss mask.

Template (ChatML): ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Escape: a backslash is
doubled, and a backslash follows the first character of any control string (those of the template
and of other common templates); reading drops each backslash and keeps what follows it.

Defined cases: null texts, roles and lists are empty; a record without a mapping, or one that is no
JSON object, gives null turns and formatted text and the reason in ``problem``; turns are ordered
by turn, then role, then text, null first; rows that repeat a turn are turns of their own; rows
with a null conversation id are one conversation; empty tables and other columns pass.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import small_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates.
CONTROL = re.compile(r"<\|im_start\|>|<\|im_end\|>|<\|startoftext\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)

#: Names of the speakers in layouts that have their own; messages keep the roles that they give.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: name, an example whose field paths make the fingerprint, how to read the turns.
MAPPINGS = (
    ("messages", {"messages": [{"role": "", "content": ""}]}, {"list": "messages", "role": "role", "text": "content"}),
    ("conversations", {"conversations": [{"from": "", "value": ""}]}, {"list": "conversations", "role": "from", "text": "value", "roles": SPEAKERS}),
    ("prompt", {"prompt": "", "completion": ""}, {"fields": (("user", ("prompt",)), ("assistant", ("completion",)))}),
    ("prompt_response", {"prompt": "", "response": ""}, {"fields": (("user", ("prompt",)), ("assistant", ("response",)))}),
    ("instruction", {"instruction": "", "output": ""}, {"fields": (("user", ("instruction",)), ("assistant", ("output",)))}),
    ("instruction_input", {"instruction": "", "input": "", "output": ""}, {"fields": (("user", ("instruction", "input")), ("assistant", ("output",)))}),
    ("system_instruction", {"system": "", "instruction": "", "output": ""}, {"fields": (("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))}),
    ("question", {"question": "", "answer": ""}, {"fields": (("user", ("question",)), ("assistant", ("answer",)))}),
    ("nested_prompt", {"data": {"prompt": "", "completion": ""}}, {"under": "data", "fields": (("user", ("prompt",)), ("assistant", ("completion",)))}),
)


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value."""
    if isinstance(value, dict):
        return set().union({at} if at else set(), *(paths(v, f"{at}.{k}") for k, v in value.items()))
    if isinstance(value, list):
        return set().union({f"{at}[]"}, *(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(record) -> str:
    return hashlib.sha256("\n".join(sorted(paths(record))).encode()).hexdigest()


@functools.lru_cache(maxsize=1)
def _mappings() -> dict:
    table = {fingerprint(example): (name, how) for name, example, how in MAPPINGS}
    for name, example, how in MAPPINGS:
        if "list" in how:  # an empty list has no fields to show
            table[fingerprint({how["list"]: []})] = (name, how)
    return table


def _plain(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, how: dict) -> list[tuple[str, str]]:
    """Canonical (role, text) turns."""
    record = record[how["under"]] if "under" in how else record
    if "list" in how:
        rows = ((_plain(r.get(how["role"])), _plain(r.get(how["text"]))) for r in record[how["list"]])
        named = how.get("roles", {})
        return [(named.get(role, role), text) for role, text in rows]
    found = ((role, "\n\n".join(filter(None, (_plain(record[f]) for f in names)))) for role, names in how["fields"])
    return [(role, text) for role, text in found if text or role != "system"]


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def unescape_role(role: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text and the (start, end) spans, in code points, that the loss counts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def _format(batches):
    for b in batches:
        rows = []
        for raw in b.column("record").to_pylist():
            try:
                record = json.loads(raw) if raw else None
            except ValueError:
                record = None
            if not isinstance(record, dict):
                rows.append((None, None, "no JSON object", None, None, None))
                continue
            mark = fingerprint(record)
            name, how = _mappings().get(mark, (None, None))
            if how is None:
                rows.append((mark, None, "no mapping for these field paths", None, None, None))
                continue
            turns = turns_of(record, how)
            text, spans = formatted(turns)
            rows.append((mark, name, None, [{"role": r, "text": t} for r, t in turns], text, [{"start": s, "end": e} for s, e in spans]))
        turn, span = pa.struct([("role", pa.string()), ("text", pa.string())]), pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(turn), pa.string(), pa.list_(span))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column("id"), *columns], names=["id", "fingerprint", "mapping", "problem", "turns", "formatted", "loss_spans"])


def chat_format(df: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """Per record: id, fingerprint, mapping, problem, turns, formatted, loss_spans."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    shape = (
        f"id {kind}, fingerprint string, mapping string, problem string, turns array<struct<role:string,text:string>>, "
        "formatted string, loss_spans array<struct<start:long,end:long>>"
    )
    rows = df.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
    return rows.mapInArrow(_format, shape).withColumnRenamed("id", id_col)


def message_records(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, record): rows by turn become one messages record for each conversation. A conversation is
    one training text, so its turns meet in one task; it is the only thing that does."""
    message = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    grouped = df.groupBy(F.col(conv).alias("conv")).agg(F.sort_array(F.collect_list(message)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return grouped.select(F.col("conv").alias(conv), F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def _digests(batches):
    for b in batches:
        rows = []
        spans = b.column("loss_spans").to_pylist()
        for text, marks in zip(b.column("formatted").to_pylist(), spans):
            if text is None:
                rows.append((None,) * 5)
                continue
            turns, digest = read_back(text), hashlib.sha256()
            for role, said in turns:
                digest.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in marks)
            rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
            names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def digests_of(out: DataFrame, id_col: str) -> DataFrame:
    """Read back from the formatted texts and loss masks: counts and digests of turns and loss; nulls
    for a record that could not be formatted."""
    kind = out.schema[id_col].dataType.simpleString()
    rows = out.select(F.col(id_col).alias("id"), "formatted", "loss_spans")
    shape = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(_digests, shape).withColumnRenamed("id", id_col)
