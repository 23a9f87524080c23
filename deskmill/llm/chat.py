"""Chat formatting with a compiled template.

The template language is small and closed: text, ``{{ expression }}``, ``{% for m in
messages %}``, ``{% if %} / {% elif %} / {% else %}`` and ``{% generation %}``, which marks
what a model learns to write. Expressions know names, ``.attributes`` of messages and of
``loop``, string and number literals, ``== !=``, ``and or not``, ``~`` (join) and the filters
``escape``, ``trim``, ``upper``, ``lower``. There are no calls, subscripts or Python names, so
a template can reach nothing but the conversation.

A template is parsed into a syntax tree, its constant parts are folded, and the rest
becomes nested Python closures. These write pieces to a sink, marked as generated or
not, one message at a time; so a conversation of any length is never held as a whole.

``escape`` makes control strings inside texts harmless and is undone exactly by
:func:`unescape`: a backslash is doubled, and one is put behind the first character of
every control string. What follows a backslash therefore stands for itself.

Null texts and roles are empty. Turns with equal numbers are ordered by role and text;
null turns come first. Rows without a conversation id form one conversation. An empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of common chat formats, and those of the template below.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"

TEMPLATE = (
    "{% for m in messages %}"
    "<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>\n"
    "{% endfor %}"
)

# Characters of one output row, about.
CHUNK = 200_000

# The first character of a control string that follows here, also of overlapping ones.
_CONTROL = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\g<0>\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class TemplateError(ValueError):
    """The template is not well formed."""


# -- syntax tree ---------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_LEXEMES = re.compile(
    r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.()~]))"
)
FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}
_STRING_ESCAPES = {"n": "\n", "t": "\t"}


def _lex(source: str) -> list[tuple[str, object]]:
    found: list[tuple[str, object]] = []
    at = 0
    source = source.strip()
    while at < len(source):
        m = _LEXEMES.match(source, at)
        if not m:
            raise TemplateError(f"not understood: {source[at:]!r}")
        at = m.end()
        quoted, number, name, mark = m.groups()
        if quoted is not None:
            body = re.sub(r"\\(.)", lambda x: _STRING_ESCAPES.get(x[1], x[1]), quoted[1:-1])
            found.append(("const", body))
        elif number is not None:
            found.append(("const", int(number)))
        else:
            found.append(("name", name) if name else ("mark", mark))
    return found


class _Expression:
    """Recursive descent over the lexemes of one expression."""

    def __init__(self, source: str):
        self.source, self.left = source, _lex(source)
        self.tree = self.either()
        if self.left:
            raise TemplateError(f"left over in {source!r}: {self.left}")

    def take(self, *values: str) -> str | None:
        if self.left and self.left[0][0] != "const" and self.left[0][1] in values:
            return self.left.pop(0)[1]
        return None

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        while op := self.take("==", "!="):
            tree = (op, tree, self.joined())
        return tree

    def joined(self):
        tree = self.filtered()
        while self.take("~"):
            tree = ("~", tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.left.pop(0) if self.left else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no such filter in {self.source!r}: {name}")
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        if not self.left:
            raise TemplateError(f"incomplete: {self.source!r}")
        kind, value = self.left.pop(0)
        if kind == "const":
            return ("const", value)
        if value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f"no closing bracket: {self.source!r}")
            return tree
        if kind != "name":
            raise TemplateError(f"unexpected {value!r} in {self.source!r}")
        if value in ("true", "false"):
            return ("const", value == "true")
        tree = ("name", value)
        while self.take("."):
            kind, value = self.left.pop(0) if self.left else ("", "")
            if kind != "name" or str(value).startswith("_"):
                raise TemplateError(f"bad attribute in {self.source!r}")
            tree = ("attr", tree, value)
        return tree


def parse(template: str) -> list:
    """The syntax tree: a list of ``text``, ``put``, ``for``, ``if`` and ``generation`` nodes."""
    steps: list[tuple[str, str]] = []
    at = 0
    for m in _PARTS.finditer(template):
        steps.append(("text", template[at : m.start()]))
        if m[1] is not None:
            steps.append(("put", m[1]))
        elif m[2] is not None:
            steps.append(("tag", m[2].strip()))
        at = m.end()
    steps.append(("text", template[at:]))
    steps.reverse()
    tree, stop = _body(steps, ())
    assert stop is None
    return tree


def _body(steps: list[tuple[str, str]], stops: tuple[str, ...]) -> tuple[list, str | None]:
    body: list = []
    while steps:
        kind, value = steps.pop()
        if kind == "text":
            if value:
                body.append(("text", value))
            continue
        if kind == "put":
            body.append(("put", _Expression(value).tree))
            continue
        word, _, rest = value.partition(" ")
        if word in stops:
            return body, value
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
            if not m:
                raise TemplateError(f"only messages can be walked through: {value!r}")
            inner, _ = _body(steps, ("endfor",))
            body.append(("for", m[1], inner))
        elif word == "if":
            body.append(_branches(rest, steps))
        elif word == "generation":
            inner, _ = _body(steps, ("endgeneration",))
            body.append(("generation", inner))
        else:
            raise TemplateError(f"unknown tag: {value!r}")
    if stops:
        raise TemplateError(f"missing {' or '.join(stops)}")
    return body, None


def _branches(condition: str, steps: list[tuple[str, str]]) -> tuple:
    then, stop = _body(steps, ("elif", "else", "endif"))
    word, _, rest = stop.partition(" ")
    if word == "elif":
        other = [_branches(rest, steps)]
    elif word == "else":
        other, _ = _body(steps, ("endif",))
    else:
        other = []
    return ("if", _Expression(condition).tree, then, other)


# -- constant folding ------------------------------------------------------------

_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: _shown(a) + _shown(b),
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _shown(value) -> str:
    return "" if value is None else str(value)


def fold_expression(tree: tuple) -> tuple:
    """Replace whatever depends on literals alone by its value."""
    kind = tree[0]
    if kind == "not":
        inner = fold_expression(tree[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold_expression(tree[2])
        if inner[0] == "const":
            return ("const", FILTERS[tree[1]](_shown(inner[1])))
        return ("filter", tree[1], inner)
    if kind in _BINARY:
        a, b = fold_expression(tree[1]), fold_expression(tree[2])
        if a[0] == b[0] == "const":
            return ("const", _BINARY[kind](a[1], b[1]))
        if kind in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    return tree


def fold(tree: list) -> list:
    """Fold expressions, drop branches that are never taken, and join adjacent texts."""
    out: list = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in tree:
        if node[0] == "put":
            value = fold_expression(node[1])
            add(("text", _shown(value[1])) if value[0] == "const" else ("put", value))
        elif node[0] == "if":
            test = fold_expression(node[1])
            if test[0] == "const":
                for inner in fold(node[2] if test[1] else node[3]):
                    add(inner)
            else:
                add(("if", test, fold(node[2]), fold(node[3])))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2])))
        elif node[0] == "generation":
            if inner := fold(node[1]):
                add(("generation", inner))
        else:
            add(node)
    return out


# -- closures --------------------------------------------------------------------

Sink = Callable[[str, bool], None]
# What is written: pieces of text, each with whether it is generated.
Pieces = Iterator[tuple[str, bool]]


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        constant = tree[1]
        return lambda scope: constant
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "attr":
        owner, name = _value(tree[1]), tree[2]
        return lambda scope: (owner(scope) or {}).get(name)
    if kind == "not":
        inner = _value(tree[1])
        return lambda scope: not inner(scope)
    if kind == "filter":
        apply, inner = FILTERS[tree[1]], _value(tree[2])
        return lambda scope: apply(_shown(inner(scope)))
    a, b = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    apply = _BINARY[kind]
    return lambda scope: apply(a(scope), b(scope))


def _writer(tree: list) -> Callable[[dict, bool], Pieces]:
    steps = [_step(node) for node in tree]
    if len(steps) == 1:
        return steps[0]

    def write(scope: dict, generated: bool) -> Pieces:
        for step in steps:
            yield from step(scope, generated)

    return write


def _step(node: tuple) -> Callable[[dict, bool], Pieces]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, generated: ((text, generated),)
    if kind == "put":
        value = _value(node[1])
        return lambda scope, generated: ((_shown(value(scope)), generated),)
    if kind == "generation":
        inner = _writer(node[1])
        return lambda scope, generated: inner(scope, True)
    if kind == "if":
        test, then, other = _value(node[1]), _writer(node[2]), _writer(node[3])
        return lambda scope, generated: (then if test(scope) else other)(scope, generated)
    name, body = node[1], _writer(node[2])

    def walk(scope: dict, generated: bool) -> Pieces:
        messages = iter(scope["messages"])
        now = next(messages, None)
        index = 0
        while now is not None:
            following = next(messages, None)
            index += 1
            loop = {"index": index, "first": index == 1, "last": following is None}
            yield from body({**scope, name: now, "loop": loop}, generated)
            now = following

    return walk


def compile_stream(template: str) -> Callable[[Iterator[dict]], Pieces]:
    """A function that gives the pieces of a conversation (an iterator of messages) one by
    one, reading no more than one message ahead."""
    write = _writer(fold(parse(template)))
    return lambda messages: iter(write({"messages": messages}, False))


def compile_template(template: str) -> Callable[[Iterator[dict], Sink], None]:
    """A function that writes a conversation (an iterator of messages) to a sink."""
    stream = compile_stream(template)

    def write(messages: Iterator[dict], sink: Sink) -> None:
        for text, generated in stream(messages):
            sink(text, generated)

    return write


# -- over tables -----------------------------------------------------------------


def format_conversations(
    df: DataFrame,
    template: str = TEMPLATE,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``(conv_id, chunk, text, spans)``: formatted conversations in rows of limited length.

    ``spans`` are the ``[start, end)`` code points of generated text within the chunk.
    Chunks break between messages only, and those of a conversation lie in one
    partition, in order; a conversation is streamed through, whatever its length.
    """
    turns = df.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    return ordered.mapInArrow(chunked(template), f"conv_id {kind}, chunk long, text string, spans array<array<int>>")


def chunked(template: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches of sorted turns to batches of chunks. It holds one message,
    its batch, and about ``CHUNK`` code points of output."""
    stream = compile_stream(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        id_type = None

        def rows() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column(0).type
                yield from zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)))

        source = rows()
        head = next(source, None)
        held = 0  # code points in the chunks that are ready
        while head is not None:
            key = head[0]
            full = False  # whether a chunk may end before the next piece

            def messages() -> Iterator[dict]:
                nonlocal head, full
                while head is not None and head[0] == key:
                    now, head = head, next(source, None)
                    yield {"role": now[1], "text": now[2]}
                    # Looking ahead for loop.last runs one message before the pieces.
                    full = length > CHUNK

            parts: list[str] = []
            spans: list[list[int]] = []
            length = chunk = 0
            for piece, generated in stream(messages()):
                if full:
                    ready.append((key, chunk, "".join(parts), spans))
                    held += length
                    parts, spans, length, chunk, full = [], [], 0, chunk + 1, False
                    if held > CHUNK:
                        yield _chunks(ready, id_type)
                        ready, held = [], 0
                if generated and piece:
                    if spans and spans[-1][1] == length:
                        spans[-1][1] += len(piece)
                    else:
                        spans.append([length, length + len(piece)])
                parts.append(piece)
                length += len(piece)
            ready.append((key, chunk, "".join(parts), spans))
            held += length
            if len(ready) >= 200 or held > CHUNK:
                yield _chunks(ready, id_type)
                ready, held = [], 0
        if ready:
            yield _chunks(ready, id_type)

    return run


def _chunks(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", "chunk", "text", "spans"]
    )


def read_turns(chunk: str) -> Iterator[tuple[str, str]]:
    """The roles and texts written by ``TEMPLATE`` into one chunk."""
    for part in chunk.split(END + "\n"):
        if part:
            role, _, text = part.removeprefix(TURN).partition(BODY)
            yield unescape(role), unescape(text)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns, and the text under the mask.

    Chunks must come as :func:`format_conversations` gives them: in order, those of a
    conversation in one partition.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(done: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        state = None
        id_type = None
        for batch in batches:
            done: list[tuple] = []
            id_type = batch.column(0).type
            for key, chunk, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk == 0:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(key)
                state.add(text, spans)
            if done:
                yield emit(done, id_type)
        if state is not None:
            yield emit([state.row()], id_type)

    return formatted.mapInArrow(run, schema)


class _Digest:
    def __init__(self, key):
        self.key, self.turns, self.loss, self.chars = key, 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[list[int]]) -> None:
        self.chars += len(text)
        for role, said in read_turns(text):
            self.turns += 1
            self.turn_hash.update(f"{role}\n{said}\n".encode())
        for start, end in spans:
            plain = unescape(text[start:end])
            self.loss += len(plain)
            self.loss_hash.update(plain.encode())

    def row(self) -> tuple:
        return (
            self.key, self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars,
        )
