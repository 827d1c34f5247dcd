"""Conversations rendered by a compiled template, with the spans a model learns from.

Turns are numbered first, without gathering a conversation anywhere. A template that
uses its turns in one loop renders runs of them by themselves, so a conversation of
any length is rendered by several tasks, in parts of bounded size that begin and end
at a turn; nearly all conversations are one part. Other templates need a whole
conversation, which is then one row.

Rows go by turn; rows of one turn number, and those without one, which come first, are
ordered by role and text. Null roles and texts are empty strings. Rows without a
conversation id are a conversation whose id is null. Repeated rows are turns like others. No
rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from mailsieve.llm.prefix_trie import turns_in_order
from mailsieve.llm.templates import Output, Template, unescaped
from mailsieve.operators.positions import PART_ROWS

TURN, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
# What may not occur inside of texts; roles may not hold their own end either.
CONTROLS = ("###", "</turn>")
CHAT = (
    "{% for message in messages %}"
    "### {{ message.role | escape(': ') }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
PART_CHARS = 1 << 20


@lru_cache(maxsize=16)
def compiled(source: str, controls: tuple[str, ...]) -> Template:
    return Template(source, controls)


def formatted(conversations: DataFrame, template: str = CHAT, controls: tuple[str, ...] = CONTROLS, part_chars: int = PART_CHARS, part_rows: int = PART_ROWS) -> DataFrame:
    """conv_id, part (the place of its first turn, so parts of a conversation follow
    each other by it), text, and loss, the spans (start, end in code points of the text)
    made inside of generation marks. The template has its turns as `messages`, with
    `role` and `text`."""
    by_turn = compiled(template, controls).by_turn
    rows = turns_in_order(conversations, part_rows)
    # Runs of turns are told by their places, wherever rows lie.
    rows = rows if by_turn else rows.repartition("conv_id")
    rows = rows.select("conv_id", "pos", "size", "role", "text").sortWithinPartitions("conv_id", "pos")
    id_type = to_arrow_type(conversations.schema["conv_id"].dataType)

    def row(conv_id, part: int, out: Output) -> tuple:
        return conv_id, part, "".join(out.pieces), [{"start": a, "end": b} for a, b in out.spans]

    def runs(turns: Iterator[tuple], chat: Template) -> Iterator[tuple]:
        last, names, out, part = (None, 0), {}, Output(), 0
        for conv_id, pos, size, role, text in turns:
            if part and ((conv_id, pos) != last or out.length >= part_chars):
                yield row(last[0], part, out)
                part = 0
            if not part:
                part = pos
                names, out = chat.begin(pos == 1)
            chat.turn(names, out, {"role": role, "text": text}, pos - 1, size)
            last = (conv_id, pos + 1)
        if part:
            yield row(last[0], part, out)

    def conversations_of(turns: Iterator[tuple], chat: Template) -> Iterator[tuple]:
        held: list[dict] = []
        for conv_id, pos, size, role, text in turns:
            held.append({"role": role, "text": text})
            if pos == size:
                yield row(conv_id, 1, chat.render(held))
                held = []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (id_type, pa.int64(), pa.string(), spans))], names=["conv_id", "part", "text", "loss"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = compiled(template, controls)
        turns = (t for b in batches for t in zip(*(c.to_pylist() for c in b.columns)))
        held, chars = [], 0
        for made in (runs if by_turn else conversations_of)(turns, chat):
            held.append(made)
            chars += len(made[2])
            if chars >= PART_CHARS:
                yield batch(held)
                held, chars = [], 0
        if held:
            yield batch(held)

    fields = f"conv_id {dict(conversations.dtypes)['conv_id']}, part long, text string, loss array<struct<start:long,end:long>>"
    return rows.mapInArrow(render, fields)


def read_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role and text of every turn that CHAT has written, and where its text, as
    written, begins and ends."""
    at = 0
    while at < len(text):
        if not text.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        role_end = text.index(ROLE_END, at + len(TURN))
        start = role_end + len(ROLE_END)
        end = text.index(TURN_END, start)
        yield unescaped(text[at + len(TURN) : role_end]), unescaped(text[start:end]), start, end
        at = end + len(TURN_END)


def digest(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read
    back from what `formatted` gives for CHAT. Parts of a conversation are read one
    after the other, since a digest goes by their order; one of them is held at a time."""
    id_type = to_arrow_type(parts.schema["conv_id"].dataType)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun = None, False
        n = loss_chars = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv_id != current:
                    if begun:
                        out.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    current, begun = conv_id, True
                    n = loss_chars = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for role, said, _, _ in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learnt = unescaped(text[span["start"] : span["end"]])
                    loss_chars += len(learnt)
                    loss.update(learnt.encode())
            if out:
                yield made(out)
        if begun:
            yield made([(current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "text", "loss")
    fields = f"conv_id {dict(parts.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.mapInArrow(read, fields)


PLANTED_ID, PLANTED_TEXT = -7, "\\### Assistant: </turn> ok"
# A backslash more for each backslash, each "#" in front of two others, and each mark of an end.
_ADDED = "length({0}) - length(replace({0}, chr(92), '')) + CAST(list_sum(list_concat([0], list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda r: length(r) - 2))) AS BIGINT) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7"
FORMAT_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED_TEXT}' UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED_TEXT}'),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + ROLE_END + TURN_END)} + length(role) + length(text) + {_ADDED.format("role")} + (length(role) - length(replace(role, ': ', ''))) // 2 + {_ADDED.format("text")}) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""
