"""Chat formatting: a small sandboxed template language compiled to Python closures.

Grammar (a subset of a common templating syntax)::

    {{ expr }}   {% for name in expr %}..{% endfor %}   {% if expr %}..{% elif expr %}..{% else %}..{% endif %}
    {% set name = expr %}   {% generation %}..{% endgeneration %}   {# comment #}
    expr: or | and | not | == != < > <= >= in | + ~ | literals, names, a.b, a['b'], (..), filters x|name

Names reach only the values handed to the template, attributes only mapping keys: there are
no calls and no Python attributes, so a template cannot leave its sandbox. ``parse`` gives a
syntax tree, ``fold`` evaluates constant parts, ``generate`` turns the tree into nested
closures that yield (text, in generation block) pieces. Pieces are yielded while messages are
still being read, so a conversation of any length is formatted in the memory of one turn.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The production template. `e` escapes control strings in a text reversibly.
CHATML = (
    "{% set open = '<|im_' ~ 'start|>' %}{% for m in messages %}{{ open }}{{ m.role | e }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | e }}{% endgeneration %}{% else %}{{ m.text | e }}{% endif %}"
    "{{ '<|im_' ~ 'end|>' ~ '\n' }}{% endfor %}"
)
START, END = "<|im_start|>", "<|im_end|>"


def escape(s: str) -> str:
    """``<|`` can't occur in the result, nor can the role's line break; unescape() reverses it."""
    return s.replace("%", "%25").replace("<|", "%3C|")


def escape_role(s: str) -> str:
    return escape(s).replace("\n", "%0A")


def unescape(s: str) -> str:
    return re.sub("%(25|3C|0A)", lambda m: {"25": "%", "3C": "<", "0A": "\n"}[m[1]], s)


FILTERS: dict[str, Callable[[object], object]] = {"e": lambda v: escape(_text(v)), "line": lambda v: escape_role(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v)}
CHATML = CHATML.replace("m.role | e", "m.role | line")


def _text(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


class TemplateError(ValueError):
    """A template outside the language."""


# --- lexer and parser: text -> syntax tree of tuples -------------------------------------

_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.()\[\]]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_WORDS = {"true": True, "false": False, "none": None}


class _Expr:
    """Recursive-descent parser of one expression."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, object]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"bad expression: {text!r}")
            at = m.end()
            if m[1] is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m[1][1:-1], flags=re.S)))
            elif m[2] is not None:
                self.tokens.append(("const", float(m[2]) if "." in m[2] else int(m[2])))
            else:
                self.tokens.append(("name", m[3]) if m[3] else ("op", m[4]))
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values:
            self.at += 1
            return str(self.tokens[self.at - 1][1])
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return str(self.tokens[self.at - 1][1])

    def whole(self):
        tree = self.any_of()
        if self.at != len(self.tokens):
            raise TemplateError("text after the expression")
        return tree

    def any_of(self):
        tree = self.all_of()
        while self.take("or"):
            tree = ("or", tree, self.all_of())
        return tree

    def all_of(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        while op := self.take(*_COMPARE, "in"):
            tree = ("cmp", op, tree, self.joined())
        return tree

    def joined(self):
        tree = self.filtered()
        while op := self.take("+", "~"):
            tree = ("join", op, tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            tree = ("filter", name, tree)
        return tree

    def atom(self):
        if self.take("("):
            tree = self.any_of()
            self.need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            tree = ("const", self.tokens[self.at][1])
            self.at += 1
        else:
            name = self.name()
            tree = ("const", _WORDS[name]) if name in _WORDS else ("name", name)
        while op := self.take(".", "["):
            if op == ".":
                tree = ("item", tree, ("const", self.name()))
            else:
                tree = ("item", tree, self.any_of())
                self.need("]")
        return tree


def parse(source: str):
    """The syntax tree of a template: ("block", [statements])."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for m in _PIECE.finditer(source):
        pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:]))
    pieces = [p for p in pieces if p != ("text", "")]
    tree, rest = _block(pieces, 0, ())
    if rest != len(pieces):
        raise TemplateError(f"unexpected {pieces[rest][1]}")
    return tree


def _block(pieces, at: int, ends: tuple[str, ...]):
    body = []
    while at < len(pieces):
        kind, text = pieces[at]
        word = text.split(None, 1)[0] if kind == "tag" and text else ""
        if kind == "tag" and word in ends:
            return ("block", body), at
        at += 1
        if kind == "text":
            body.append(("out", ("const", text)))
        elif kind == "out":
            body.append(("out", _Expr(text).whole()))
        elif word == "for":
            m = re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", text, re.S)
            if not m:
                raise TemplateError(f"bad loop: {text}")
            inner, at = _closed(pieces, at, "endfor")
            body.append(("for", m[1], _Expr(m[2]).whole(), inner))
        elif word == "if":
            arms, test = [], _Expr(text[2:]).whole()
            while True:
                inner, at = _block(pieces, at, ("elif", "else", "endif"))
                arms.append((test, inner))
                if at >= len(pieces):
                    raise TemplateError("if without endif")
                tag = pieces[at][1]
                at += 1
                if tag.startswith("endif"):
                    break
                test = _Expr(tag[4:]).whole() if tag.startswith("elif") else ("const", True)
            body.append(("if", arms))
        elif word == "set":
            m = re.fullmatch(r"set\s+(\w+)\s*=\s*(.+)", text, re.S)
            if not m:
                raise TemplateError(f"bad set: {text}")
            body.append(("set", m[1], _Expr(m[2]).whole()))
        elif word == "generation":
            inner, at = _closed(pieces, at, "endgeneration")
            body.append(("generation", inner))
        else:
            raise TemplateError(f"no tag {text}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return ("block", body), at


def _closed(pieces, at: int, end: str):
    inner, at = _block(pieces, at, (end,))
    return inner, at + 1


# --- constant folding ---------------------------------------------------------------------

def fold(tree):
    """The same tree with constant expressions evaluated, dead branches dropped and neighbouring texts joined."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "block":
        body: list = []
        for s in (fold(x) for x in tree[1]):
            for s in s[1] if s[0] == "block" else [s]:
                if s[0] == "out" and s[1][0] == "const" and body and body[-1][0] == "out" and body[-1][1][0] == "const":
                    body[-1] = ("out", ("const", _text(body[-1][1][1]) + _text(s[1][1])))
                else:
                    body.append(s)
        return ("block", body)
    if kind == "for":
        return ("for", tree[1], fold(tree[2]), fold(tree[3]))
    if kind == "if":
        arms = []
        for test, inner in tree[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(inner)))
            if test[0] == "const":
                break
        if not arms:
            return ("block", [])
        return arms[0][1] if arms[0][0][0] == "const" else ("if", arms)
    if kind in ("out", "generation"):
        return (kind, fold(tree[1]))
    if kind == "set":
        return ("set", tree[1], fold(tree[2]))
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in tree)
    if all(x[0] == "const" for x in parts[1:] if isinstance(x, tuple)):
        return ("const", _expr(parts)({}))
    return parts


# --- closures -------------------------------------------------------------------------------

def _expr(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "item":
        of, key = _expr(tree[1]), _expr(tree[2])

        def item(env):
            value = of(env)
            return value.get(key(env)) if isinstance(value, dict) else None

        return item
    if kind == "filter":
        f, of = FILTERS[tree[1]], _expr(tree[2])
        return lambda env: f(of(env))
    if kind == "not":
        of = _expr(tree[1])
        return lambda env: not of(env)
    if kind in ("and", "or"):
        a, b = _expr(tree[1]), _expr(tree[2])
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    a, b = _expr(tree[2]), _expr(tree[3])
    if kind == "join":
        return (lambda env: _text(a(env)) + _text(b(env))) if tree[1] == "~" else (lambda env: a(env) + b(env))
    if tree[1] == "in":
        return lambda env: a(env) in b(env)
    f = _COMPARE[tree[1]]
    return lambda env: f(a(env), b(env))


Piece = tuple[str, bool]


def _statement(tree, marked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = tree[0]
    if kind == "block":
        parts = [_statement(x, marked) for x in tree[1]]

        def block(env):
            for p in parts:
                yield from p(env)

        return block
    if kind == "out":
        value = _expr(tree[1])

        def out(env):
            yield _text(value(env)), marked

        return out
    if kind == "generation":
        return _statement(tree[1], True)
    if kind == "set":
        name, value = tree[1], _expr(tree[2])

        def put(env):
            env[name] = value(env)
            return iter(())

        return put
    if kind == "for":
        name, over, inner = tree[1], _expr(tree[2]), _statement(tree[3], marked)

        def loop(env):
            for x in over(env) or ():
                env[name] = x
                yield from inner(env)

        return loop
    arms = [(_expr(t), _statement(b, marked)) for t, b in tree[1]]

    def choose(env):
        for test, inner in arms:
            if test(env):
                return inner(env)
        return iter(())

    return choose


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A generator function from variables to (text, in generation block) pieces."""
    return _statement(fold(parse(source)), False)


# --- rendering and reading back ----------------------------------------------------------------

class ReadBack:
    """Reads pieces of formatted text as they come: turns, digests and lengths.

    Only the turn being read is held. Role and text are found by the control strings in the
    text itself; the mask comes from the pieces.
    """

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest = ""

    def feed(self, text: str, marked: bool) -> None:
        self.chars += len(text)
        if marked:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.rest += text
        if END not in text:
            return
        while (end := self.rest.find(END + "\n")) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(END) + 1 :]
            role, _, said = turn.removeprefix(START).partition("\n")
            self.turns += 1
            self.all.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))

    def result(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TEXT = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>"


def _conversations(batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Consecutive rows of one conv_id, as a lazy iterator of messages."""
    import itertools

    rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield conv, ({"role": r[1] or "", "text": r[2] or ""} for r in group)


def _arranged(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation together and by turn; ties by role and text, nulls first."""
    plain = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """One formatted text and its generation spans (code points) for each conversation.

    Null role or text is empty, a null conv_id is a conversation of its own, repeated turns
    are all kept, an empty table gives an empty result, other columns are ignored.
    """
    def run(batches):
        import pyarrow as pa

        render = compile_template(template)
        for conv, messages in _conversations(batches):
            out, spans, at = [], [], 0
            for text, marked in render({"messages": messages}):
                if marked:
                    spans.append({"start": at, "end": at + len(text)})
                out.append(text)
                at += len(text)
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(out)], pa.string()), pa.array([spans], pa.list_(span))], names=["conv_id", "formatted", "loss_spans"])

    return _arranged(conversations).mapInArrow(run, TEXT)


def chat_digests(conversations: DataFrame, template: str = CHATML, batch: int = 2000) -> DataFrame:
    """Digests read back from the formatted text of each conversation, as a stream.

    Same defined cases as format_chats(); the memory used is that of one turn, so one
    conversation may hold a third of all rows.
    """
    fields = [f.split() for f in DIGEST.split(", ")]

    def frame(rows):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def run(batches):
        render, rows = compile_template(template), []
        for conv, messages in _conversations(batches):
            back = ReadBack()
            for text, marked in render({"messages": messages}):
                back.feed(text, marked)
            rows.append((conv, *back.result()))
            if len(rows) == batch:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)

    return _arranged(conversations).mapInArrow(run, DIGEST)
