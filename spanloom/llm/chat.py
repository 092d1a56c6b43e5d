"""Chat formatting with a grammar round trip."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: Control strings of the template (fixed values).
OPEN, CLOSE, END, SYS, SYS_END = "[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>"
HEAD, TURN = "<|", "|>"
#: Where a text must not go on unescaped, overlaps included. A backslash escapes the character after it.
CONTROL = re.compile("(?=" + "|".join(map(re.escape, (OPEN, CLOSE, END, SYS, SYS_END, HEAD, TURN, "\\"))) + ")")


def escape(text: str) -> str:
    """Put a backslash before every control string; reversible by unescape()."""
    return CONTROL.sub(r"\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: Iterable[tuple[str, str]], escaped: Iterable[bool]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the stretches of it under the loss mask (assistant texts).

    A turn is <|role|>text</s>; user texts stand in [INST] text [/INST].
    """
    out, mask, at = [], [], 0
    for (role, text), esc in zip(turns, escaped, strict=True):
        body = escape(text) if esc else text
        lead = f"{HEAD}{escape(role) if esc else role}{TURN}" + (f"{OPEN} " if role == "user" else "")
        tail = (f" {CLOSE}" if role == "user" else "") + END
        if role == "assistant":
            mask.append((at + len(lead), at + len(lead) + len(body)))
        out.append(lead + body + tail)
        at += len(lead) + len(body) + len(tail)
    return "".join(out), mask


_PLAIN = re.compile(r"(?:\\.|(?!\[/?INST\]|</s>|<</?SYS>>|<\||\|>)[^\\])*+", re.S)


def parse(text: str) -> list[tuple[str, str]] | None:
    """Turns of a formatted conversation by the grammar; None where it doesn't hold. Deterministic:
    an unescaped control string ends a text, and no text holds one."""
    at, out = 0, []
    while at < len(text):
        if not text.startswith(HEAD, at):
            return None
        close = text.startswith(f"{HEAD}user{TURN}", at)
        m = _PLAIN.match(text, at + len(HEAD))
        if not text.startswith(TURN, m.end()):
            return None
        role, at = unescape(m[0]), m.end() + len(TURN)
        if close:
            if not text.startswith(f"{OPEN} ", at):
                return None
            at += len(OPEN) + 1
        m = _PLAIN.match(text, at)
        body, at = m[0], m.end()
        tail = f"{CLOSE}{END}" if close else END
        if not text.startswith(tail, at) or close and not body.endswith(" "):
            return None
        out.append((role, unescape(body[:-1] if close else body)))
        at += len(tail)
    return out


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Render, reparse and compare; turns that come back otherwise are escaped, until all are equal."""
    esc = [False] * len(turns)
    while True:
        text, mask = render(turns, esc)
        if parse(text) == turns:
            return text, mask
        # each turn alone shows whether it conflicts; if none does, the first unescaped one goes
        bad = [k for k, t in enumerate(turns) if not esc[k] and parse(render([t], [False])[0]) != [t]]
        for k in bad or [esc.index(False)]:
            esc[k] = True


def read_back(text: str, mask: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns and the text under the loss mask, from the formatted string alone."""
    turns = parse(text)
    if turns is None:
        raise ValueError("the formatted text doesn't parse")
    return turns, "".join(unescape(text[x:y]) if "\\" in text[x:y] else text[x:y] for x, y in mask)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask (array of start and end in code points), and read back
    from those: turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows go by turn (null last), ties by role, then text; repeated rows are turns of their own. Null text or role:
    empty. Null conv_id: a conversation of its own. A conversation is one string in the result, so one row holds it. Empty table: no
    rows. Other columns are ignored.
    """
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").isNull().alias("last"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    kept = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = kept.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "formatted", "loss_mask", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for own in b.column("turns"):
                given = [(t["role"], t["text"]) for t in own.as_py()]
                text, mask = format_turns(given)
                back, loss = read_back(text, mask)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest()
                values = (len(back), text, [{"start": x, "end": y} for x, y in mask], digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.string(), span, pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return kept.mapInArrow(run, f"conv_id {kind}, n_turns long, formatted string, loss_mask array<struct<start:bigint,end:bigint>>, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
