"""Chat formatting with a grammar round trip.

Grammar, read strictly from left to right (a backslash makes the next character an ordinary one):

    conversation := "<s>" turn*
    turn := "[INST]" " " text " " "[/INST]"                      user
          | "[SYS]" " " text " " "[/SYS]"                        system
          | " " text "</s>"                                      assistant
          | "[ROLE=" text "]" " " text " " "[/ROLE]"             any other role

Each turn is rendered with its text as it is, parsed again, and compared with its source; while they differ, the
text is escaped more strongly. The mask is on the escaped text of assistant turns.

Defined results: null text and null role are the empty string; rows of a conversation are ordered by turn (nulls
first), then role, then text, and repeated rows are kept; a null conv_id is a conversation of its own; an empty
table gives no rows; other columns are ignored. A conversation is never held whole: its turns are rendered,
parsed and digested one after another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, partitions, work_dir

BOS = "<s>"
#: Control strings of the template. Fixed values.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE=", "[/ROLE]"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TOKEN = re.compile(r"\\(?s:.)|" + "|".join(map(re.escape, CONTROLS)))
_UNESCAPE = re.compile(r"\\((?s:.))")
_CLOSE = {"[INST]": "[/INST]", "[SYS]": "[/SYS]", "[ROLE=": "[/ROLE]"}


class GrammarError(ValueError):
    pass


def escaped(text: str, level: int) -> str:
    """0: as it is; 1: backslashes and the first character of control strings; 2: every character that could begin one."""
    if level == 0:
        return text
    text = text.replace("\\", "\\\\")
    if level == 1:
        return _CONTROL.sub(lambda m: "\\" + m[0], text)
    return re.sub(r"[<\[\]]", lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def _turn(role: str, text: str, role_level: int) -> tuple[str, str, str]:
    """What stands before the text, the text, what stands after it."""
    if role == "assistant":
        return " ", text, "</s>"
    if role == "user":
        return "[INST] ", text, " [/INST]"
    if role == "system":
        return "[SYS] ", text, " [/SYS]"
    return f"[ROLE={escaped(role, role_level)}] ", text, " [/ROLE]"


def parse(rendered: str, at: int = 0) -> list[tuple[str, str, int, int]]:
    """Turns from `at` on: role, text, and the span of the text in `rendered`."""
    turns = []

    def until(stop: str, begin: int) -> int:
        """Where the next control string stands, which has to be `stop`."""
        for m in _TOKEN.finditer(rendered, begin):
            if m[0][0] != "\\":
                if m[0] != stop:
                    raise GrammarError(f"{m[0]} instead of {stop}")
                return m.start()
        raise GrammarError(f"no {stop}")

    while at < len(rendered):
        for opening, closing in _CLOSE.items():
            if rendered.startswith(opening, at):
                begin, role = at + len(opening), {"[INST]": "user", "[SYS]": "system"}.get(opening)
                if role is None:
                    m = re.compile(r"((?:\\(?s:.)|[^\\\]])*)\]").match(rendered, begin)
                    if not m:
                        raise GrammarError("no end of the role")
                    role, begin = unescaped(m[1]), m.end()
                stop = until(closing, begin)
                if rendered[begin : begin + 1] != " " or stop < begin + 2 or rendered[stop - 1] != " ":
                    raise GrammarError("no space inside the marks")
                begin, end, at = begin + 1, stop - 1, stop + len(closing)
                break
        else:
            if rendered[at] != " ":
                raise GrammarError("no turn begins here")
            role, begin, end = "assistant", at + 1, until("</s>", at + 1)
            at = end + len("</s>")
        turns.append((role, unescaped(rendered[begin:end]), begin, end))
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its escaped text; parsing it gives the turn back."""
    for level in range(3):
        before, inner, after = _turn(role, escaped(text, level), max(level, 2 * (level > 0)))
        out = before + inner + after
        try:
            found = parse(out)
        except GrammarError:
            continue
        if [x[:2] for x in found] == [(role, text)] and found[0][2:] == (len(before), len(before) + len(inner)):
            return out, *found[0][2:]
    raise GrammarError(f"a turn of role {role!r} can't be rendered")


_RENDERED = "conv_id long, seq long, rendered string, mask_from long, mask_to long"
FORMATTED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, seq = object(), 0
    for b in batches:
        rows: list[tuple] = []
        for conv, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
            seq, last = (seq + 1 if conv == last else 0), conv
            out, begin, end = render_turn(role, text)
            before = BOS if seq == 0 else ""
            masked = role == "assistant"
            rows.append((conv, seq, before + out, begin + len(before) if masked else None, end + len(before) if masked else None))
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "seq", "rendered", "mask_from", "mask_to"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    open_, state = False, None
    for b in batches:
        done = []
        for conv, rendered, begin, end in zip(*(b.column(k).to_pylist() for k in ("conv_id", "rendered", "mask_from", "mask_to"))):
            if not open_ or conv != state[0]:
                if open_:
                    done.append(state)
                open_, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if not rendered.startswith(BOS):
                    raise GrammarError("a conversation begins otherwise")
                found = parse(rendered, len(BOS))
            else:
                found = parse(rendered)
            for role, text, _, _ in found:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if begin is not None:
                loss = unescaped(rendered[begin:end])
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
            state[5] += len(rendered)
        if done:
            yield _rows(done, names, types)
    if open_:
        yield _rows([state], names, types)


def _rows(done: list, names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*((s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in done))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def write_formatted(conversations: DataFrame, path: str) -> None:
    """Rows conv_id, seq, rendered, mask_from, mask_to: a conversation's text is its rows' joined by seq."""
    spark = conversations.sparkSession
    arrow_rows(spark)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered.select("conv_id", "role", "text").mapInArrow(_render, _RENDERED).write.option("compression", "zstd").parquet(path)


def read_formatted(spark: SparkSession, path: str) -> DataFrame:
    """Per conversation what its formatted text holds, parsed from the output."""
    rows = spark.read.schema(_RENDERED).parquet(path)
    return rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_digest, FORMATTED)


def format_chats(conversations: DataFrame) -> DataFrame:
    path = work_dir(conversations.sparkSession, "chat")
    write_formatted(conversations, path)
    return read_formatted(conversations.sparkSession, path)
