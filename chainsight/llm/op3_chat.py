"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

``canonical_turns`` reads records (JSON text) of unlike layouts. The nested field paths of a record, with
``[]`` for list items, are hashed; the fingerprint selects a mapping, a declaration of where roles and texts
are. ``render`` writes each turn with markers and escapes control strings in its text; ``read_back``
parses the rendered turns again. Every step is a row at a time or a sorted stream, so a conversation
of any length is never held whole.

A mapping names the paths it needs and may leave further fields aside: a record is taken by the mapping of its whole fingerprint, or else by
the one of the most needed paths among those whose paths it holds. Literal ``.``, ``[`` and ``\\`` in keys are escaped in paths, so a key
never reads as nesting.

Defined cases: null text is empty; null role is written as the empty role; rows of one turn number are
ordered by role, then text, and repeated rows are turns of their own; null conv_id is one conversation;
a record that no mapping fits gets one turn of role ``unmapped`` holding the record, so nothing is lost;
a record that isn't JSON or is nested too deeply likewise; half a surrogate pair, which no UTF-8 text can hold, becomes U+FFFD. An empty
table gives no turns.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------- fingerprints and mappings

def _key(k: str) -> str:
    """A key as a path step: what could read as nesting is escaped."""
    return k.replace("\\", "\\\\").replace(".", "\\.").replace("[", "\\[")


def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; list items share one path."""
    if isinstance(value, dict):
        out = set()
        for k, v in value.items():
            step = f"{prefix}.{_key(k)}" if prefix else _key(k)
            out |= paths(v, step) or {step}
        return out
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix} if prefix else set()


def fingerprint(field_paths) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _layout(fields, **mapping):
    return fingerprint(fields), {"needs": frozenset(fields), **mapping}


def mapping_of(field_paths: set[str], mappings: dict) -> dict | None:
    """The mapping of the paths' fingerprint, or of the most needed paths among those that the record holds (ties: the
    first one declared); a list of turns goes before single fields."""
    found = mappings.get(fingerprint(field_paths))
    if found is not None:
        return found
    fits = [m for m in mappings.values() if m.get("needs") and m["needs"] <= field_paths]
    return max(fits, key=lambda m: ("list" in m, len(m["needs"])), default=None)


#: fingerprint -> mapping. ``list``: where the turns are, with ``role`` and ``text`` in each; ``pairs``:
#: (role, field) in order, where an empty or missing field makes no turn unless it is all there is; ``join``: fields put after another's text.
MAPPINGS = dict([
    _layout(["conv_id", "turn", "role", "text"], pairs=[("$role", "text")]),
    _layout(["messages[].role", "messages[].content"], list="messages", role="role", text="content"),
    _layout(["conversations[].from", "conversations[].value"], list="conversations", role="from", text="value"),
    _layout(["turns[].speaker", "turns[].text"], list="turns", role="speaker", text="text"),
    _layout(["prompt", "completion"], pairs=[("user", "prompt"), ("assistant", "completion")]),
    _layout(["prompt", "response"], pairs=[("user", "prompt"), ("assistant", "response")]),
    _layout(["system", "prompt", "response"], pairs=[("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    _layout(["instruction", "output"], pairs=[("user", "instruction"), ("assistant", "output")]),
    _layout(["instruction", "input", "output"], pairs=[("user", "instruction"), ("assistant", "output")], join={"instruction": "input"}),
    _layout(["question", "answer"], pairs=[("user", "question"), ("assistant", "answer")]),
])
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)


def turns_of(record: str | None, mappings=None) -> tuple[str, list[tuple[str, str]]]:
    """(fingerprint, canonical turns) of one record."""
    try:
        value = json.loads(record) if record is not None else None
        if not isinstance(value, dict):
            return "", [("unmapped", record or "")]
        held = paths(value)
        mark, m = fingerprint(held), mapping_of(held, mappings or MAPPINGS)
        return mark, [(_whole(r), _whole(t)) for r, t in _mapped(value, m)] if m else [("unmapped", record)]
    except (ValueError, RecursionError):
        return "", [("unmapped", record or "")]


def _whole(text: str) -> str:
    """Halves of surrogate pairs replaced: no UTF-8 text can hold them."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _mapped(value: dict, m: dict) -> list[tuple[str, str]]:
    if "list" in m:
        turns = [t if isinstance(t, dict) else {m["text"]: t} for t in value[m["list"]]]
        return [(ROLES.get(_text(t.get(m["role"])), _text(t.get(m["role"]))), _text(t.get(m["text"]))) for t in turns]
    out = []
    for role, field in m["pairs"]:
        text = _text(value.get(field))
        if (more := _text(value.get(m.get("join", {}).get(field)))):
            text = f"{text}\n\n{more}"
        if role.startswith("$"):
            out.append((_text(value.get(role[1:])), text))
        elif text or role != "system":
            out.append((role, text))
    return out


def _canonical(it, mappings):
    for batch in it:
        at, marks, subs, roles, texts = [], [], [], [], []
        for i, record in enumerate(batch.column(2).to_pylist()):
            mark, turns = turns_of(record, mappings)
            for j, (role, text) in enumerate(turns):
                at.append(i)
                marks.append(mark)
                subs.append(j)
                roles.append(role)
                texts.append(text)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(subs, pa.int64()), pa.array(marks, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], names=["conv_id", "turn", "part", "fingerprint", "role", "text"])


def canonical_turns(records: DataFrame, mappings=None) -> DataFrame:
    """``records`` (conv_id, turn, record: JSON text) to rows (conv_id, turn, part, fingerprint, role, text)."""
    src = records.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("record").cast("string"))
    return src.mapInArrow(lambda it: _canonical(it, mappings), "conv_id long, turn long, part long, fingerprint string, role string, text string")


# ---------------------------------------------------------------- template

# The tails of control strings of common chat templates; each starts with < or [.
CONTROL = ["|im_start|>", "|im_end|>", "|endoftext|>", "s>", "/s>", "SYS>", "/SYS>", "INST]", "/INST]"]
_TAIL = "|".join(map(re.escape, CONTROL))
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAIL})")
_ESCAPED = re.compile(rf"([<\[])(\\*)\\({_TAIL})")
START, END = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """One backslash more after the first character of anything that reads as a control string."""
    return _PLAIN.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of the loss mask in it); only an assistant's text is under the mask."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    at = len(head) if role == "assistant" else 0
    return head + body + END, at, at + len(body) if role == "assistant" else 0


def parse_turn(rendered: str) -> tuple[str, str]:
    m = _TURN.fullmatch(rendered)
    return unescape_role(m[1]), unescape(m[2])


def _render(it):
    for batch in it:
        rows = [render_turn(r or "", t or "") for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        cols = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["conv_id", "turn", "part", "formatted", "loss_start", "loss_end"])


def render(turns: DataFrame) -> DataFrame:
    """Canonical turns to (conv_id, turn, part, formatted, loss_start, loss_end); a conversation's text is its
    turns' ``formatted`` in the order of ``turn``, ``part``, role, text."""
    return turns.select("conv_id", "turn", "part", "role", "text").mapInArrow(_render, "conv_id long, turn long, part long, formatted string, loss_start long, loss_end long")


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted, start, end):
        role, text = parse_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.sha.update(f"{role}\n{text}\n".encode())
        if end > start or role == "assistant":
            masked = unescape(formatted[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self):
        return self.conv, self.turns, self.sha.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(it):
    now, types = None, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def batch_of(rows):
        cols = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    for batch in it:
        done = []
        for conv, formatted, start, end in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")]):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(formatted, start, end)
        yield batch_of(done)
    if now is not None:
        yield batch_of([now.row()])


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests per conversation, from the rendered turns: a sorted stream that holds one turn at a time.
    A hash over a whole conversation needs its turns one after the other, so one task per conversation.
    Turns of equal number are in the order of their own role and text, not of the escaped ones."""
    plain = F.regexp_replace("formatted", rf"([<\[])(\\*)\\({_TAIL})", "$1$2$3")
    sorted_turns = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", F.substring_index(plain, "\n", 1), plain)
    return sorted_turns.mapInArrow(_read_back, DIGEST)


def records_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as JSON records of the layout conv_id, turn, role, text."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return conversations.select(cols[0], cols[1], F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    return render(canonical_turns(records_of(conversations)))
