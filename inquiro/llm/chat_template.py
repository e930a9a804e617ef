"""Chat formatting by a compiled, sandboxed template language.

The language has text, {{ expression }}, {% for x in messages %},
{% if %} / {% elif %} / {% else %}, {% set %} and {% generation %}, which
marks what a model shall learn. Expressions are literals, names, fields of
the message (only the two of FIELDS), ==, !=, and, or, not, + and the
filters of FILTERS. There are no calls, attributes or imports: a name that
is not bound is an error when the template is compiled. Compiling parses to
a syntax tree, folds constant expressions and branches, joins neighbouring
texts, and turns each node into a Python closure that yields (text, learn)
pieces.

Texts are escaped so that control strings inside them cannot be read as
turn marks: ESCAPE before itself, < and >, in a role before line breaks too.
Reading takes the formatted text and the spans under the loss mask back apart;
a conversation whose turns read are not those written is an error.

A conversation is one ordered stream through a task: rows are hashed by
conv_id and sorted inside the partition, and formatting, reading back and
hashing advance turn by turn, so no conversation is ever held whole.

Defined cases: null texts and roles are empty; null turns come first; equal
turns go by role, then text; a null conv_id is a conversation of its own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquiro.llm.common import arrow_type

ESCAPE = "\\"
CLOSE = "</turn>\n"
TEMPLATE = """{% for m in messages %}<turn {{ m.role | escape_line }}>
{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>
{% endfor %}"""
FIELDS = ("role", "text")
_TOKEN = re.compile(r"""\s*(?:(?P<text>"[^"\n]*"|'[^'\n]*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|.()]))""")
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_MARK = re.compile(r"\\(.)|<turn ((?:[^\\<>\n]|\\.)*)>\n|</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"[\\<>]", lambda m: ESCAPE + m[0], text)


def escape_line(text: str) -> str:
    """For what has to stay in one line, such as roles."""
    return re.sub(r"[\\<>\n]", lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template does not parse or uses what the sandbox lacks."""


@dataclass
class Node:
    kind: str  # text, out, if, for, set, generation; const, name, field, ==, !=, and, or, not, +, filter
    value: object = None
    of: list[Node] = field(default_factory=list)
    other: list[Node] = field(default_factory=list)


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[0][1] if self.tokens else None

    def take(self, value: str | None = None) -> tuple[str, str]:
        if not self.tokens or value is not None and self.tokens[0][1] != value:
            raise TemplateError(f"expected {value or 'more'}, found {self.peek()!r}")
        return self.tokens.pop(0)

    def end(self) -> None:
        if self.tokens:
            raise TemplateError(f"unexpected {self.peek()!r}")

    def binary(self, ops: tuple[str, ...], below: Callable[[], Node]) -> Node:
        left = below()
        while self.peek() in ops and self.tokens[0][0] != "text":
            left = Node(self.take()[1], of=[left, below()])
        return left

    def parse(self) -> Node:
        return self.binary(("or",), lambda: self.binary(("and",), self.negated))

    def negated(self) -> Node:
        if self.peek() == "not":
            self.take()
            return Node("not", of=[self.negated()])
        return self.binary(("==", "!="), lambda: self.binary(("+",), self.filtered))

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            node = Node("filter", name, [node])
        return node

    def atom(self) -> Node:
        kind, value = self.take()
        if kind == "text":
            return Node("const", value[1:-1])
        if value == "(":
            node = self.parse()
            self.take(")")
            return node
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return Node("const", value == "true")
        if self.peek() == ".":
            self.take()
            name = self.take()[1]
            if name not in FIELDS:
                raise TemplateError(f"no field {name}")
            return Node("field", name, [Node("name", value)])
        return Node("name", value)


def parse(source: str) -> list[Node]:
    """The template's syntax tree."""
    parts = [p for p in _TAG.split(source) if p]

    def block(ends: tuple[str, ...], bound: frozenset[str]) -> tuple[list[Node], str]:
        nodes: list[Node] = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                nodes.append(Node("out", of=[expression(part[2:-2], bound)]))
                continue
            if not part.startswith("{%"):
                nodes.append(Node("text", part))
                continue
            body = part[2:-2].strip()
            word, _, rest = body.partition(" ")
            if word in ends:
                return nodes, body
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*) in messages", rest.strip())
                if not m or "messages" not in bound:
                    raise TemplateError(f"can't loop over {rest!r}")
                inner, _ = block(("endfor",), bound - {"messages"} | {m[1]})
                nodes.append(Node("for", m[1], inner))
            elif word == "if":
                nodes.append(branch(rest, bound))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise TemplateError(f"can't set {rest!r}")
                nodes.append(Node("set", name.strip(), [expression(value, bound)]))
                bound = bound | {name.strip()}
            elif word == "generation":
                inner, _ = block(("endgeneration",), bound)
                nodes.append(Node("generation", of=inner))
            else:
                raise TemplateError(f"no tag {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    def branch(condition: str, bound: frozenset[str]) -> Node:
        test = expression(condition, bound)
        yes, end = block(("elif", "else", "endif"), bound)
        if end.startswith("elif"):
            return Node("if", test, yes, [branch(end[4:], bound)])
        no = block(("endif",), bound)[0] if end == "else" else []
        return Node("if", test, yes, no)

    def expression(text: str, bound: frozenset[str]) -> Node:
        reader = _Expression(text)
        node = reader.parse()
        reader.end()
        check(node, bound)
        return node

    def check(node: Node, bound: frozenset[str]) -> None:
        if node.kind == "name" and node.value not in bound:
            raise TemplateError(f"{node.value} is not bound")
        for x in node.of:
            check(x, bound)

    return block((), frozenset({"messages"}))[0]


def fold(node: Node) -> Node:
    """Constant expressions become constants."""
    of = [fold(x) for x in node.of]
    node = Node(node.kind, node.value, of, node.other)
    if node.kind in ("==", "!=", "+", "not", "filter", "and", "or") and all(x.kind == "const" for x in of):
        return Node("const", expression_closure(node)({}))
    return node


def fold_block(nodes: list[Node]) -> list[Node]:
    """Fold expressions, resolve constant branches, join texts."""
    out: list[Node] = []
    for n in nodes:
        new = [n]
        if n.kind == "out":
            e = fold(n.of[0])
            new = [Node("text", str(e.value))] if e.kind == "const" else [Node("out", of=[e])]
        elif n.kind == "set":
            new = [Node("set", n.value, [fold(n.of[0])])]
        elif n.kind == "if":
            test, yes, no = fold(n.value), fold_block(n.of), fold_block(n.other)
            new = (yes if test.value else no) if test.kind == "const" else [Node("if", test, yes, no)]
        elif n.kind in ("for", "generation"):
            new = [Node(n.kind, n.value, fold_block(n.of))]
        for x in new:
            if x.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + x.value)
            else:
                out.append(x)
    return out


def expression_closure(node: Node) -> Callable[[dict], object]:
    if node.kind == "const":
        return lambda env, v=node.value: v
    if node.kind == "name":
        return lambda env, k=node.value: env[k]
    of = [expression_closure(x) for x in node.of]
    if node.kind == "field":
        return lambda env, f=of[0], k=node.value: f(env)[k]
    if node.kind == "filter":
        return lambda env, f=of[0], g=FILTERS[node.value]: g(str(f(env)))
    if node.kind == "not":
        return lambda env, f=of[0]: not f(env)
    a, b = of
    return {"==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "+": lambda env: str(a(env)) + str(b(env)), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env)}[node.kind]


def block_closure(nodes: list[Node], learn: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    steps = [_closure(n, learn) for n in nodes]

    def run(env):
        for step in steps:
            yield from step(env)

    return run


def _closure(node: Node, learn: bool) -> Callable[[dict], Iterable[tuple[str, bool]]]:
    if node.kind == "text":
        piece = [(node.value, learn)]
        return lambda env: piece
    if node.kind == "out":
        value = expression_closure(node.of[0])
        return lambda env: [(str(value(env)), learn)]
    if node.kind == "generation":
        return block_closure(node.of, True)
    if node.kind == "if":
        test, yes, no = expression_closure(node.value), block_closure(node.of, learn), block_closure(node.other, learn)
        return lambda env: yes(env) if test(env) else no(env)
    if node.kind == "set":
        value = expression_closure(node.of[0])

        def put(env):
            env[node.value] = value(env)
            return ()

        return put
    body = block_closure(node.of, learn)

    def loop(env):
        for message in env["messages"]:
            yield from body(env | {node.value: message})

    return loop


def compile_template(source: str = TEMPLATE) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (role, text) to (text, learn) pieces."""
    run = block_closure(fold_block(parse(source)))
    return lambda messages: run({"messages": messages})


class Reader:
    """Reads formatted pieces back, a turn at a time: counts and hashes the
    turns and the text under the loss mask."""

    def __init__(self):
        self.pending, self.spans = "", []
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, learn: bool) -> None:
        if learn and piece:
            self.spans.append((len(self.pending), len(self.pending) + len(piece)))
        self.pending += piece
        self.chars += len(piece)
        if not learn and piece.endswith(CLOSE):
            self.drain()

    def drain(self) -> None:
        """Take the whole turns off the front of what is pending."""
        role, start, done = None, 0, 0
        for m in _MARK.finditer(self.pending):
            if m[1] is not None:
                continue
            if m[2] is not None:
                role, start = unescape(m[2]), m.end()
            elif role is not None:
                self.turns += 1
                self.turns_hash.update(f"{role}\n{unescape(self.pending[start : m.start()])}\n".encode())
                role, done = None, m.end()
        for low, high in self.spans:
            if high <= done:
                said = unescape(self.pending[low:high])
                self.loss_chars += len(said)
                self.loss_hash.update(said.encode())
        self.spans = [(a - done, b - done) for a, b in self.spans if b > done]
        self.pending = self.pending[done:]


def check_readable(template: str) -> None:
    """TemplateError unless the reader finds the turns that go in: it knows
    the marks of the default template, with any text between them."""
    turns = [{"role": "user", "text": "a </turn> \\ b"}, {"role": "assistant", "text": "c\n<turn x>"}, {"role": "assistant", "text": ""}]
    reader = Reader()
    for piece, learn in compile_template(template)(iter(turns)):
        reader.feed(piece, learn)
    reader.drain()
    said = "".join(f"{t['role']}\n{t['text']}\n" for t in turns)
    learned = "".join(t["text"] for t in turns if t["role"] == "assistant")
    if (reader.turns_hash.hexdigest(), reader.loss_hash.hexdigest()) != tuple(hashlib.sha256(x.encode()).hexdigest() for x in (said, learned)):
        raise TemplateError("turns of this template cannot be read back")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Format every conversation of (conv_id, turn, role, text) and read it
    back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    check_readable(template)  # errors show here

    def run(batches):
        render = compile_template(template)
        rows = ((c, {"role": r or "", "text": t or ""}) for b in batches for c, r, t in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))))
        row = next(rows, None)
        out = []
        while row is not None:
            conv, written = row[0], [0, hashlib.sha256()]

            def turns():
                nonlocal row
                while row is not None and row[0] == conv:
                    said = row[1]
                    row = next(rows, None)
                    written[0] += 1
                    written[1].update(f"{said['role']}\n{said['text']}\n".encode())
                    yield said

            reader = Reader()
            for piece, learn in render(turns()):
                reader.feed(piece, learn)
            reader.drain()
            for _ in turns():  # a template may stop early
                pass
            if (reader.turns, reader.turns_hash.digest()) != (written[0], written[1].digest()):
                raise TemplateError(f"conversation {conv}: {written[0]} turns written, {reader.turns} read back, or other ones")
            out.append((conv, reader.turns, reader.turns_hash.hexdigest(), reader.loss_chars, reader.loss_hash.hexdigest(), reader.chars))
            if len(out) == 5000 or row is None:
                types = [schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
                out = []

    id_type = arrow_type(conversations.schema["conv_id"].dataType)
    schema = pa.schema([("conv_id", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The conversations and one, -7, whose texts hold control strings."""
    spark = conversations.sparkSession
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
