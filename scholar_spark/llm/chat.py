"""Operator 4: chat formatting by prefix-target expansion.

A turn is written ``<|role|>``, a line end, the text, ``<|end|>`` and a line end. In roles and texts a
backslash is doubled and ``<`` (in roles ``>`` too) gets a backslash before it, so no text holds a bare
``<`` and every marker can be told from its look-alike. Every assistant turn becomes an example of its
own: all turns before it as context, and only that reply under the loss. What follows the last reply, or
a conversation without one, becomes an example without loss, so that every turn can be read back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
#: A turn as it is written: role, text.
_TURN = re.compile(r"<\|((?:[^\\<>]|\\.)*)\|>\n((?:[^\\<]|\\.)*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its text begins and ends."""
    head = f"<|{escape(role).replace('>', chr(92) + '>')}|>\n"
    body = escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; the inverse of ``format_turn``."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end), from rows conv_id, turn, role, text.

    Offsets are code points; loss_start is null in an example without loss. Turns go by turn number, then
    role, then text, so ties and repeated rows have one order; null numbers come first. A null text or
    role is empty. Rows with a null conv_id make up a conversation. Rows come out in order of conv_id and
    example. One conversation's context is held at a time, never a table's.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id bigint, example bigint, formatted string, loss_start bigint, loss_end bigint"

    def run(batches):
        conv, context, size, example, pending = object(), [], 0, 0, False
        out, held = [], 0

        def tail():
            return (conv, example, "".join(context), None, None)

        for batch in batches:
            c, role = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                if c[i] != conv:
                    if pending:
                        out.append(tail())
                        held += size
                    conv, context, size, example, pending = c[i], [], 0, 0, False
                text, a, b = format_turn(role[i], batch.column(3)[i].as_py())
                context.append(text)
                if role[i] == TRAINED:
                    context = ["".join(context)]
                    out.append((conv, example, context[0], size + a, size + b))
                    held += size + len(text)
                    example += 1
                size += len(text)
                pending = role[i] != TRAINED
                if held > 4_000_000 or len(out) >= 4096:
                    yield _batch(out)
                    out, held = [], 0
        if pending:
            out.append(tail())
        if out:
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["conv_id", "example", "formatted", "loss_start", "loss_end"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, schema)


def digest_examples(examples: DataFrame) -> DataFrame:
    """What the query of operator 4 returns, read back from ``format_examples`` (whose order it relies on).

    The turns come from a conversation's last example; the loss text is that of all its examples in
    order. formatted_chars counts the code points of all examples.
    """

    def run(batches):
        conv, last, loss, chars, formatted, started = None, "", None, 0, 0, False
        out = []

        def done():
            turns = parse_turns(last)
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            return (conv, len(turns), digest.hexdigest(), chars, loss.hexdigest(), formatted)

        for batch in batches:
            for i in range(batch.num_rows):
                c, _, text, a, b = (batch.column(k)[i].as_py() for k in range(5))
                if not started or c != conv:
                    if started:
                        out.append(done())
                    conv, loss, chars, formatted, started = c, hashlib.sha256(), 0, 0, True
                last = text
                formatted += len(text)
                if a is not None:
                    said = unescape(text[a:b])
                    loss.update(said.encode())
                    chars += len(said)
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
        if started:
            out.append(done())
        if out:
            yield _batch(out)

    def _batch(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return examples.mapInArrow(run, schema)


SAMPLE_TEXT = "\\### Assistant: </turn> ok"


def chat_query(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, whose texts look like markers, formatted and read back."""
    extra = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", SAMPLE_TEXT), (-7, 1, "assistant", SAMPLE_TEXT)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return digest_examples(format_examples(rows.unionByName(extra)))


#: The same by SQL: lengths follow from the template (escapes add one code point each).
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    13 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g'))
      + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g')) AS size
  FROM t
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS prefix, max(k) OVER (PARTITION BY conv_id) AS last FROM n
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (role = 'assistant' OR k = last) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
