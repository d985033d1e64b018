"""Chat formatting with prefix-target expansion.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. A ``<|`` inside a
text or role, with any number of backslashes between the two characters, gets
one more backslash, so no control string can arise and taking one away restores
the text; in roles, backslashes and line feeds are written as ``\\\\`` and ``\\n``.

Every assistant turn is an example of its own: all turns before it are its
context and only its reply is under the loss mask. An example's text is the
conversation's formatted text up to ``end``, of which the code points from
``start`` to ``end`` are trained on. All examples are written out whole, so those
of a conversation of n turns take space in n squared: they are streamed, never
kept or shuffled. ``render`` writes chosen examples from references to their context.

The turns are dealt by conversation, sorted, and streamed: a task holds one
Arrow batch and, where it writes examples, the text of one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_MARK = re.compile(r"<(\\*)\|")
_MARKED = re.compile(r"<\\(\\*)\|")
_ESCAPE = re.compile(r"\\([\\n])")
#: Code points of examples that travel together.
_TOGETHER = 4 << 20


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start of its text, end of its text)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head, found, body = piece.removesuffix(f"{END}\n").partition("\n")
    if not found or not head.startswith(START) or not piece.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    return unescape_role(head.removeprefix(START)), unescape(body)


_PIECES = "conv_id long, position long, piece string, at long, start long, end long, target boolean"


def format_turns(turns: DataFrame) -> DataFrame:
    """One row for each turn, conversations together and in order: (conv_id,
    position, piece, at, start, end, target).

    ``piece`` is the formatted turn; ``at``, ``start`` and ``end`` are code points
    of the conversation's formatted text: where the piece begins, and where its
    text does and ends. Turns are ordered by turn (nulls first), ties by role and
    text. Null roles and texts are empty; a null conv_id is a conversation of its
    own. Repeated rows are turns like any other. Other columns are ignored; an
    empty table gives an empty table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, at = object(), 0, 0
        for b in batches:
            rows = []
            for c, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if c != conv:
                    conv, position, at = c, 0, 0
                piece, start, end = format_turn(role, text)
                rows.append((c, position, piece, at, at + start, at + end, role == TRAINED))
                position, at = position + 1, at + len(piece)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)],
                ["conv_id", "position", "piece", "at", "start", "end", "target"])

    source = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                          F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                          F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _PIECES)


def examples(pieces: DataFrame) -> DataFrame:
    """(conv_id, example, context_turns, start, end, piece, at, text): one row for each reply,
    in the order of ``pieces``, with the formatted turn that holds it and the example's whole
    ``text``: all turns before the reply and the reply.

    ``pieces``: as ``format_turns`` gives them, conversations together and in order."""
    names = [f"{n} {k}" for n, k in (("conv_id", "long"), ("example", "long"), ("context_turns", "long"), ("start", "long"),
                                     ("end", "long"), ("piece", "string"), ("at", "long"), ("text", "string"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, rows, held = object(), "", [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(),) * 5 + (pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              [n.split()[0] for n in names])

        for b in batches:
            for c, position, piece, at, start, end, target in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv:
                    conv, before = c, ""
                if target:
                    text = before + piece[:end - at]
                    rows.append((c, position, position, start, end, piece, at, text))
                    held += len(text)
                    if held > _TOGETHER:
                        yield batch()
                        rows, held = [], 0
                before += piece
        if rows:
            yield batch()

    order = [f.split()[0] for f in _PIECES.split(", ")]
    return pieces.select(*order).mapInArrow(run, ", ".join(names))


def render(chosen: DataFrame, pieces: DataFrame) -> DataFrame:
    """Examples with their whole ``text``, whose code points [start, end) are
    trained on. Takes the space of all contexts: choose the examples."""
    own = pieces.select("conv_id", "position", "piece").alias("p")
    rows = chosen.alias("x").join(own, F.expr("x.conv_id <=> p.conv_id and p.position <= x.example"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p.position", "p.piece"))), lambda s: s["piece"]), "")
    return (rows.groupBy("x.conv_id", "x.example", "x.context_turns", "x.start", "x.end").agg(text.alias("text"))
            .withColumn("text", F.expr("substring(text, 1, int(end))")))


def replies(pieces: DataFrame) -> DataFrame:
    """The examples, of which the code points [start, end) of ``text`` are trained on."""
    return examples(pieces)


def _by_conversation(rows: DataFrame, columns: list[str], add, names: list[str], kinds: list) -> DataFrame:
    """One row (conv_id, *names) for each run of rows of a conversation: its state,
    begun by ``add(None)``, after ``add(state, *columns)`` of every row."""
    names, kinds = ["conv_id", *names], [pa.int64(), *kinds]
    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def ended() -> tuple:
            return conv, *(x if isinstance(x, int) else x.hexdigest() for x in state)

        for b in batches:
            rows = []
            for c, *values in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        rows.append(ended())
                    conv, state = c, add(None)
                add(state, *values)
            if rows:
                yield batch(rows)
        if state is not None:
            yield batch([ended()])

    return rows.select("conv_id", *columns).mapInArrow(run, schema)


def _add_turn(state: list | None, piece: str = "") -> list | None:
    if state is None:
        return [0, hashlib.sha256(), 0]
    role, text = parse_turn(piece)
    state[0] += 1
    state[1].update(f"{role}\n{text}\n".encode())
    state[2] += len(piece)


def _add_reply(state: list | None, text: str = "", start: int = 0, end: int = 0) -> list | None:
    if state is None:
        return [0, hashlib.sha256()]
    reply = unescape(text[start:end])
    state[0] += len(reply)
    state[1].update(reply.encode())


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars),
    read back from the formatted turns of ``format_turns``, in its order, and from
    the whole texts of the examples, one for each reply, which come in that order too: the
    turns are dealt and read once, and only digests are joined.

    ``formatted_chars``: code points of the conversation's formatted text."""
    turns = _by_conversation(pieces, ["piece"], _add_turn, ["n_turns", "turns_sha256", "formatted_chars"],
                             [pa.int64(), pa.string(), pa.int64()]).alias("t")
    loss = _by_conversation(replies(pieces), ["text", "start", "end"], _add_reply, ["loss_chars", "loss_sha256"],
                            [pa.int64(), pa.string()]).alias("x")
    return turns.join(loss, F.expr("t.conv_id <=> x.conv_id"), "left").select(
        "t.conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0)).cast("long").alias("loss_chars"),
        F.coalesce("loss_sha256", F.lit(hashlib.sha256().hexdigest())).alias("loss_sha256"), "formatted_chars")
