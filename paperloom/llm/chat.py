"""Chat formatting: turns in a bracket template, typed parts as placeholders, a loss mask.

Turns are written ``[INST] text [/INST]`` (user), ``<s> text </s>`` (assistant),
``<<SYS>> text <</SYS>>`` (system), and ``<<ROLE:name>> text <</ROLE>>`` for any other role.
Inside a text every backslash is doubled and a backslash precedes each control string, so none
of them can occur there and unescaping restores the text.  A message's parts are flattened by a visitor:
texts are escaped, an image, audio or document part becomes ``<|kind:n|>`` with n counting the
conversation's attachments, whose reference and expanded token count are recorded.
The loss mask is the list of spans of the assistant's turns, in code points.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import count, groupby

from pyspark.sql import DataFrame, functions as F

from .shared import arrow_batches

#: Control strings of the template.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>", "<|image:", "<|audio:", "<|document:")
FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
_UNSAFE = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})." for c in CONTROLS), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_OPEN = re.compile(r"\[INST\] |<s> |<<SYS>> |<<ROLE:((?:\\.|(?!>> ).)*)>> ", re.S)
_STEP = re.compile(r"\\.|<\|(image|audio|document):(\d+)\|>|(\[/INST\]|</s>|<</SYS>>|<</ROLE>>)", re.S)

_HOLDER = re.compile(r"\\.|<\|(?:image|audio|document):\d+\|>", re.S)


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Attachment:
    """A part that isn't text: its kind, reference, and the tokens its placeholder expands to."""

    kind: str
    ref: str
    tokens: int


@dataclass
class Flattener:
    """Visits parts in order; ``tokens_of`` gives a kind's expansion by the part's size fields."""

    image_patch: int = 14
    audio_ms: int = 40
    page_tokens: int = 256
    attachments: list[Attachment] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        kind = part.get("type") or "text"
        return getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        w, h = (max(1, int(part.get(k) or 0)) for k in ("width", "height"))
        return self._attach("image", part, -(-w // self.image_patch) * -(-h // self.image_patch))

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, max(1, -(-int(part.get("duration_ms") or 0) // self.audio_ms)))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, self.page_tokens * max(1, int(part.get("pages") or 0)))

    def visit_unknown(self, part: dict) -> str:
        raise ValueError(f"a part of unknown type {part.get('type')!r}")

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append(Attachment(kind, part.get("ref") or "", tokens))
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def format_turns(turns: Iterable[tuple[str | None, list[dict]]]) -> tuple[str, list[tuple[int, int]], list[Attachment]]:
    """(formatted text, loss spans, attachments) of a conversation's (role, parts)."""
    out, at, spans, flat = [], 0, [], Flattener()
    for role, parts in turns:
        role = role or ""
        before, after = FRAMES.get(role) or (f"<<ROLE:{_role(role)}>> ", " <</ROLE>>")
        body = "".join(map(flat.visit, parts))
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans, flat.attachments


def _role(role: str) -> str:
    return escape(role).replace(">", "\\>")


def parse_turns(formatted: str) -> list[tuple[str, str, list[int]]]:
    """(role, text, attachment numbers) of each turn; ValueError unless all of it is turns."""
    turns, at = [], 0
    roles = {before: role for role, (before, _) in FRAMES.items()}
    while at < len(formatted):
        m = _OPEN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn starts at {at}")
        role = roles[m[0]] if m[0] in roles else unescape(m[1])
        end = FRAMES[role][1] if m[0] in roles else " <</ROLE>>"
        text, refs, start, here = [], [], m.end(), m.end()
        for s in _STEP.finditer(formatted, here):
            if s[1]:
                text.append(formatted[start : s.start()])
                refs.append(int(s[2]))
                start = s.end()
            elif s[3]:
                if s.start() - 1 < here or formatted[s.start() - 1 : s.end()] != end:
                    raise ValueError(f"a turn ends wrongly at {s.start()}")
                text.append(formatted[start : s.start() - 1])
                at = s.end()
                break
        else:
            raise ValueError(f"the turn at {at} has no end")
        turns.append((role, unescape("".join(text)), refs))
    return turns


FORMATTED = "conv_id {}, formatted string, loss_starts array<int>, loss_ends array<int>, attachments string, expanded_tokens bigint"


def format_conversations(messages: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One row per conversation of ``messages`` (conv_id, turn, role, text or parts).

    ``parts_col`` names a column of JSON lists of parts; without it, text is one text part (null:
    empty).  Rows are ordered by turn, nulls first, then role and text, so ties and repeated rows
    have one order.  A row without a conv_id belongs to no other: it is a conversation of one turn.
    Rows are sorted within partitions and streamed: one conversation is held at a time, not a group
    of them.  Other columns aren't read.
    """
    kind = messages.schema["conv_id"].dataType.simpleString()
    content = F.col(parts_col) if parts_col else F.coalesce("text", F.lit(""))
    slim = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", content.alias("content"))
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "content"))  # spreads what has no conversation
    rows = slim.withColumn("apart", apart).repartition("conv_id", "apart").sortWithinPartitions("conv_id", "turn", "role", "content")

    def run(batches):
        import pyarrow as pa

        def parts(content):
            if not parts_col:
                return [{"type": "text", "text": content}]
            found = json.loads(content) if content else []
            return found if isinstance(found, list) else [found]

        def read():
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "content")))

        def made() -> Iterator[tuple]:
            alone = count()
            for (conv, _), turns in groupby(read(), key=lambda r: (r[0], next(alone) if r[0] is None else None)):
                text, spans, held = format_turns((role, parts(content)) for _, role, content in turns)
                listed = json.dumps([a.__dict__ for a in held])
                yield conv, text, [a for a, _ in spans], [b for _, b in spans], listed, sum(a.tokens for a in held)

        schema = pa.schema([
            ("conv_id", conv_type), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())),
            ("attachments", pa.string()), ("expanded_tokens", pa.int64()),
        ])
        yield from arrow_batches(made(), schema, weight=lambda r: len(r[1]))

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(messages.schema["conv_id"].dataType)
    return rows.mapInArrow(run, FORMATTED.format(kind))


READ = "conv_id {}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and masks hold, parsed: counts and digests per conversation."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                for conv, text, starts, ends in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
                    turns = parse_turns(text)
                    whole = "".join(f"{role}\n{body}\n" for role, body, _ in turns)
                    loss = "".join(unescape(_HOLDER.sub(lambda m: m[0] if m[0][0] == "\\" else "", text[a:b])) for a, b in zip(starts, ends))
                    yield conv, len(turns), _sha(whole), len(loss), _sha(loss), len(text)

        yield from arrow_batches(rows(), pa.schema([("conv_id", conv_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(formatted.schema["conv_id"].dataType)
    return formatted.mapInArrow(run, READ.format(kind))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
