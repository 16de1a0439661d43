"""Chat formatting: whole conversations in one template, token ids, and loss masks aligned by offsets.

Turns are marked by control strings, each a token of its own: `<s>` begins a conversation, `[SYS]` and
`[/SYS]` hold a system text, `[INST]` and `[/INST]` a user's; an assistant's text stands bare and ends
with `</s>`; any other role is `[ROLE]name[/ROLE]text[/TURN]`. Where a control string stands in a text, a backslash
goes behind its first character, and one more where there are some already, so that a text never
holds a control string and is got back exactly.

A conversation is rendered and encoded once. The sorted spans of its assistants' texts meet the
sorted offsets of its tokens by binary search: what is kept as the mask are ranges of tokens.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tracelake.llm.common import materialize, slices, small_batches, tidied

BEGIN, END = "<s>", "</s>"
SYSTEM, USER = ("[SYS]", "[/SYS]"), ("[INST]", "[/INST]")
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
MARKS = (BEGIN, END, *SYSTEM, *USER, *OTHER)
#: Characters of a conversation that are rendered and encoded together. A longer one is cut between turns, where a mark parts its tokens anyhow; a longer turn stays whole.
PART_CHARS = 4_000_000


class Template:
    """Rendering, parsing and escaping, with the control strings of the template and further ones (a vocabulary's own)."""

    def __init__(self, further: tuple[str, ...] = ()):
        strings = [*MARKS, *(s for s in further if s not in MARKS)]
        firsts = {s[0] for s in strings}
        # Then no control string can begin in a text and end in a mark, or stand within another, and an added backslash makes no new one.
        if any(len(s) < 2 or "\\" in s or firsts & set(s[1:]) for s in strings) or any(a != b and b.startswith(a) for a in strings for b in strings):
            raise ValueError("control strings must not overlap, begin one another or hold backslashes")
        self.strings = strings
        # Where a backslash goes: between the first character of a control string, or of one that is escaped already, and its rest.
        places = [(re.escape(c), "|".join(re.escape(s[1:]) for s in strings if s[0] == c)) for c in sorted(firsts)]
        self._bare, self._escaped = (re.compile("|".join(rf"(?<={c}){slashes}(?={rests})" for c, rests in places)) for slashes in (r"\\*", r"\\+"))
        self._marks = re.compile("(" + "|".join(re.escape(m) for m in MARKS) + ")")

    def escape(self, text: str) -> str:
        return self._bare.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][1:], text)

    def turn(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before a turn's text, the escaped text, and what follows it."""
        body = self.escape(text)
        if role == "assistant":
            return "", body, END
        if role in ("system", "user"):
            before, after = SYSTEM if role == "system" else USER
            return before, body, after
        return OTHER[0] + self.escape(role) + OTHER[1], body, OTHER[2]

    def turns(self, rendered: str) -> Iterator[tuple[str, str]]:
        """Roles and texts of a rendered conversation or a part of one; anything else raises ValueError."""
        pieces = self._marks.split(rendered)  # text, mark, text, ..., text
        closing = {SYSTEM[0]: ("system", SYSTEM[1]), USER[0]: ("user", USER[1])}
        at = 0
        while at + 1 < len(pieces):
            text, mark = pieces[at], pieces[at + 1]
            at += 2
            if mark == END:
                yield "assistant", self.unescape(text)
                continue
            if text:
                raise ValueError("text outside a turn")
            if mark == BEGIN:
                continue
            role = None
            if mark == OTHER[0] and at + 1 < len(pieces) and pieces[at + 1] == OTHER[1]:
                role, close = self.unescape(pieces[at]), OTHER[2]
                at += 2
            elif mark in closing:
                role, close = closing[mark]
            if role is None or at + 1 >= len(pieces) or pieces[at + 1] != close:
                raise ValueError("a turn is not closed")
            yield role, self.unescape(pieces[at])
            at += 2
        if pieces[at]:
            raise ValueError("text outside a turn")


class Encoder:
    """A byte-level vocabulary file whose own control strings are escaped in texts, with the template's as further tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.template = Template(tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets keep the space that a token begins with

    def encode(self, pieces: list[str], learnt: list[bool]) -> tuple[str, list[int], list[tuple[int, int]]]:
        """The text of all pieces, its ids, and the ranges of tokens that make up the learnt pieces."""
        ends = np.cumsum([len(p) for p in pieces])
        keep = np.array(learnt, bool)
        starts, ends = (ends - [len(p) for p in pieces])[keep], ends[keep]
        rendered = "".join(pieces)
        got = self.tokenizer.encode(rendered, add_special_tokens=False)
        offsets = np.array(got.offsets, np.int64).reshape(-1, 2)
        full = ends > starts
        starts, ends = starts[full], ends[full]
        # Tokens of one character's bytes share its offsets: the first that begins at or behind a span's start, the first that begins at or behind its end.
        first, last = np.searchsorted(offsets[:, 0], starts), np.searchsorted(offsets[:, 0], ends)
        if len(starts) and not ((offsets[first, 0] == starts).all() and (offsets[last - 1, 1] == ends).all()):
            raise ValueError("a token crosses the border of a turn")
        return rendered, got.ids, list(zip(first.tolist(), last.tolist()))

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@functools.cache
def _encoder(path: str) -> Encoder:
    """A worker's encoder for the vocabulary file, kept for later tasks."""
    return Encoder(path)


def _schema(conv: StructField) -> StructType:
    span = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])
    return StructType([
        StructField("conv_id", conv.dataType), StructField("part", IntegerType()), StructField("is_last", BooleanType()), StructField("n_turns", LongType()),
        StructField("rendered", StringType()), StructField("ids", ArrayType(IntegerType())), StructField("loss", ArrayType(span)),
    ])


def formatted(rows: DataFrame, vocabulary: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, is_last, n_turns, rendered, ids, loss (ranges of tokens, `last` exclusive) for each conversation of rows.

    Turns stand in order of turn, then role, then text, nulls first; repeated rows are repeated
    turns. A null text or role is empty; rows of a null conv_id are one conversation. Other columns
    are not read, so their names cannot clash; an empty table gives no rows. A conversation comes
    sorted to one task as a stream and is one row (part 0, is_last) up to about part_chars; a
    longer one goes on in further parts, so memory follows the longest turn, not the conversation.
    The marks have the ids behind the vocabulary's.
    """
    small_batches(rows.sparkSession)
    picked = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = _schema(picked.schema["conv_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, encoder = to_arrow_schema(out), _encoder(vocabulary)

        def batch_of(parts: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*parts)]
            columns[6] = [[{"first": a, "last": b} for a, b in spans] for spans in columns[6]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to)], schema=to)

        done: list[tuple] = []
        pieces: list[str] = []
        learnt: list[bool] = []
        now, began, part, turns, size, held = None, False, 0, 0, 0, 0

        def close(is_last: bool) -> None:
            done.append((now, part, is_last, turns, *encoder.encode(pieces, learnt)))

        for batch in batches:
            for piece in slices(batch):
                for key, name, said in zip(piece.column("conv_id").to_pylist(), piece.column("role").to_pylist(), piece.column("text").to_pylist()):
                    other = began and key != now
                    if began and (other or size >= part_chars):
                        close(other)
                        held += size
                        part, turns, size = (0 if other else part + 1), 0, 0
                        pieces, learnt = [], []
                        if held > 4_000_000:
                            yield batch_of(done)
                            done, held = [], 0
                    if not began or other:
                        now, began, pieces, learnt = key, True, [BEGIN], [False]
                    pieces += encoder.template.turn(name, said)
                    learnt += [False, name == "assistant", False]
                    turns += 1
                    size += len(said)
        if began:
            close(True)
            yield batch_of(done)

    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(tidied(run), out)


def read_back(parts: DataFrame, vocabulary: str) -> DataFrame:
    """What is stored, by conversation: conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn), loss_chars and loss_sha256 (the text under the mask), formatted_chars.

    All comes from ids and mask: ids are decoded and parsed, and masked ranges are decoded by
    themselves. Conversations of one part are read where they are; the parts of longer ones are
    brought together in order and digested as a stream. Stored text that differs from its ids raises.
    """
    out = StructType([parts.schema["conv_id"], *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, encoder = to_arrow_schema(out), _encoder(vocabulary)
        template = encoder.template
        for batch in batches:
            rows: list[tuple] = []
            for key, part, last, rendered, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "is_last", "rendered", "ids", "loss"))):
                if part == 0:
                    turns, loss_text, n_turns, n_loss, n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                text = encoder.decode(ids)
                if text != rendered:
                    raise ValueError("stored ids are not those of the stored text")
                n_chars += len(text)
                for role, said in template.turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for x in loss:
                    said = template.unescape(encoder.decode(ids[x["first"] : x["last"]]))
                    loss_text.update(said.encode())
                    n_loss += len(said)
                if last:
                    rows.append((key, n_turns, turns.hexdigest(), n_loss, loss_text.hexdigest(), n_chars))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), to)], schema=to)

    small_batches(parts.sparkSession)
    whole = (F.col("part") == 0) & F.col("is_last")
    read = tidied(run)
    one = parts.filter(whole).mapInArrow(read, out)
    return one.unionByName(parts.filter(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(read, out))


def digest(rows: DataFrame, vocabulary: str) -> DataFrame:
    """Formats rows, stores the result, and reads the stored table back."""
    return read_back(materialize(formatted(rows, vocabulary), "chat", "zstd"), vocabulary)
