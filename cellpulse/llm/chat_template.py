"""Compiler for chat templates: text to syntax tree, constants folded, Python closures out.

The language is a small sandboxed one:

* ``{{ expression }}``, ``{# comment #}``, and a ``-`` inside any brace to strip white space on that side;
* ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% set name = expression %}``;
* one ``{% for message in messages %} ... {% endfor %}``, outside all other blocks;
* ``{% generation %} ... {% endgeneration %}`` around what a model is to learn;
* strings, integers, ``true``, ``false``, ``none``, names, ``message.field``, ``loop.first``, ``loop.last``,
  ``loop.index``, ``loop.index0``, ``+``, ``~``, ``== != < <= > >= in``, ``and or not``, ``a if b else c`` and
  the filters of ``FILTERS``.

There are no calls, no other attributes or look-ups, no repetition and no inner loops, so a template can
reach nothing but the message, and its output is linear in it. Nothing before or after the loop, and no turn,
sees another turn. That lets a conversation of any length be rendered turn by turn, in pieces.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote

#: Bounds on a template: characters, and depth of nested expressions and blocks.
MOST_CHARS, MOST_DEPTH = 100_000, 50
LOOP_FIELDS = ("first", "last", "index", "index0")


class TemplateError(ValueError):
    """A template that the language does not allow."""


def escape(text: str, controls) -> str:
    """A backslash before each backslash, and one after the first character of each control string."""
    text = text.replace("\\", "\\\\")
    for control in controls:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


#: Name to function of (value, control strings of the template).
FILTERS: dict[str, Callable] = {
    "escape": lambda v, controls: escape(_text(v), controls),
    "urlencode": lambda v, _: quote(_text(v), safe=""),
    "trim": lambda v, _: _text(v).strip(),
    "upper": lambda v, _: _text(v).upper(),
    "lower": lambda v, _: _text(v).lower(),
    "length": lambda v, _: len(_text(v)),
}


def _text(value) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


# ---------------------------------------------------------------- syntax tree


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: str
    name: str


@dataclass
class Apply:
    """A function of sub-expressions. ``lazy`` ones get closures instead of values."""

    work: Callable
    parts: list
    lazy: bool = False


@dataclass
class Out:
    value: object


@dataclass
class Set:
    name: str
    value: object


@dataclass
class If:
    test: object
    yes: list
    no: list


@dataclass
class Generation:
    body: list


@dataclass
class For:
    name: str
    body: list


# ---------------------------------------------------------------- text to tokens

TAG = re.compile(r"\{\{-?(?P<expr>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.DOTALL)
TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>==|!=|<=|>=|[<>+~|().=]))",
    re.DOTALL,
)
# Escapes in string literals.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def pieces(source: str):
    """(kind, content) of text, expressions and tags, white space stripped where asked."""
    at, strip = 0, False
    for tag in TAG.finditer(source):
        text = source[at : tag.start()]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if tag[0][2] == "-" else text
        if tag["expr"] is not None:
            yield "expr", tag["expr"]
        elif tag["tag"] is not None:
            yield "tag", tag["tag"]
        at, strip = tag.end(), tag[0][-3] == "-"
    text = source[at:]
    yield "text", text.lstrip() if strip else text


def tokens(source: str) -> list[tuple[str, str]]:
    found, at, source = [], 0, source.strip()
    while at < len(source):
        token = TOKEN.match(source, at)
        if not token:
            raise TemplateError(f"unexpected {source[at:at + 20]!r}")
        found.append((token.lastgroup, token[token.lastgroup]))
        at = token.end()
    return found


# ---------------------------------------------------------------- tokens to expressions


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, controls):
        self.left, self.controls, self.depth = tokens(source)[::-1], controls, 0

    def take(self, *ops: str) -> str | None:
        if self.left and self.left[-1][1] in ops and self.left[-1][0] != "str":
            return self.left.pop()[1]
        return None

    def whole(self):
        tree = self.choice()
        if self.left:
            raise TemplateError(f"unexpected {self.left[-1][1]!r}")
        return tree

    def choice(self):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("expression nested too deeply")
        tree = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else Const(None)
            tree = Apply(lambda t, y, n: y() if t() else n(), [test, tree, other], lazy=True)
        self.depth -= 1
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Apply(lambda a, b: a() or b(), [tree, self.both()], lazy=True)
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = Apply(lambda a, b: a() and b(), [tree, self.negated()], lazy=True)
        return tree

    def negated(self):
        turns = 0
        while self.take("not"):
            turns += 1
        tree = self.compared()
        for _ in range(turns):
            tree = Apply(lambda v: not v, [tree])
        return tree

    def compared(self):
        tree = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            tree = Apply(COMPARE[op], [tree, self.joined()])
        return tree

    def joined(self):
        tree = self.filtered()
        while op := self.take("+", "~"):
            tree = Apply(_plus if op == "+" else lambda a, b: _text(a) + _text(b), [tree, self.filtered()])
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.left.pop() if self.left else ("", "nothing")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = Apply(lambda v, work=FILTERS[name]: work(v, self.controls), [tree])
        return tree

    def atom(self):
        if self.take("("):
            tree = self.choice()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        kind, text = self.left.pop() if self.left else ("", "end of expression")
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "int":
            return Const(int(text))
        if kind == "name" and text not in KEYWORDS:
            if text in CONSTANTS:
                return Const(CONSTANTS[text])
            if self.take("."):
                kind, part = self.left.pop() if self.left else ("", "nothing")
                if kind != "name" or part.startswith("_"):
                    raise TemplateError(f"no field {part!r}")
                return Field(text, part)
            return Name(text)
        raise TemplateError(f"unexpected {text!r}")


def _plus(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ needs two texts or two integers; ~ joins anything")


COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
KEYWORDS = {"if", "else", "elif", "endif", "for", "endfor", "set", "and", "or", "not", "in", "generation", "endgeneration"}


# ---------------------------------------------------------------- pieces to statements


def parse(source: str, controls=()) -> list:
    """Syntax tree of a template: a list of statements."""
    if len(source) > MOST_CHARS:
        raise TemplateError(f"template of {len(source)} characters; at most {MOST_CHARS}")
    stream = list(pieces(source))[::-1]

    def block(ends: tuple[str, ...], depth: int) -> tuple[list, str, str]:
        """Statements up to a tag among ``ends``, that tag and its rest."""
        if depth > MOST_DEPTH:
            raise TemplateError("blocks nested too deeply")
        body: list = []
        while stream:
            kind, content = stream.pop()
            if kind == "text":
                body.append(Out(Const(content)))
                continue
            if kind == "expr":
                body.append(Out(Expression(content, controls).whole()))
                continue
            word, _, rest = content.strip().partition(" ")
            if word in ends:
                return body, word, rest
            if word == "if":
                body.append(branch(rest, depth))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()) or name.strip() in ("loop", *KEYWORDS, *CONSTANTS):
                    raise TemplateError(f"cannot set {name.strip()!r}")
                body.append(Set(name.strip(), Expression(value, controls).whole()))
            elif word == "generation":
                body.append(Generation(block(("endgeneration",), depth + 1)[0]))
            elif word == "for":
                loop = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not loop or depth:
                    raise TemplateError("the one loop is {% for name in messages %}, outside other blocks")
                body.append(For(loop[1], block(("endfor",), depth + 1)[0]))
            else:
                raise TemplateError(f"no tag {word!r} here")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, "", ""

    def branch(test: str, depth: int) -> If:
        yes, word, rest = block(("elif", "else", "endif"), depth + 1)
        no: list = []
        if word == "elif":
            no = [branch(rest, depth + 1)]
        elif word == "else":
            no = block(("endif",), depth + 1)[0]
        return If(Expression(test, controls).whole(), yes, no)

    return block((), 0)[0]


# ---------------------------------------------------------------- folding


def fold(tree, known: dict):
    """An expression with what is known worked out."""
    if isinstance(tree, Name):
        return Const(known[tree.name]) if tree.name in known else tree
    if isinstance(tree, Apply):
        parts = [fold(part, known) for part in tree.parts]
        if tree.lazy and isinstance(parts[0], Const):
            # The first part decides; what it does not ask for may stay unknown.
            asked = [lambda p=p: p for p in parts]
            asked[0] = lambda: parts[0].value
            chosen = tree.work(*asked)
            return chosen if isinstance(chosen, (Const, Name, Field, Apply)) else Const(chosen)
        if all(isinstance(part, Const) for part in parts):
            return Const(tree.work(*(part.value for part in parts)))
        return Apply(tree.work, parts, tree.lazy)
    return tree


def fold_block(body: list, known: dict) -> list:
    """Statements with decided branches cut, texts joined; names set anew are known no more."""
    out: list = []
    for step in body:
        if isinstance(step, Out):
            steps = [Out(fold(step.value, known))]
        elif isinstance(step, Set):
            value = fold(step.value, known)
            known.pop(step.name, None)
            if isinstance(value, Const):
                known[step.name] = value.value
            steps = [Set(step.name, value)]
        elif isinstance(step, If):
            test = fold(step.test, known)
            if isinstance(test, Const):
                steps = fold_block(step.yes if test.value else step.no, known)
            else:
                sides = [fold_block(side, dict(known)) for side in (step.yes, step.no)]
                for name in set_in(step.yes) | set_in(step.no):
                    known.pop(name, None)
                steps = [If(test, *sides)]
        elif isinstance(step, Generation):
            steps = [Generation(fold_block(step.body, known))]
        else:
            inside = {k: v for k, v in known.items() if k not in set_in(step.body) | {step.name, "loop"}}
            steps = [For(step.name, fold_block(step.body, inside))]
        for one in steps:
            if isinstance(one, Out) and isinstance(one.value, Const):
                text = _text(one.value.value)
                if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                one = Out(Const(text))
                if not text:
                    continue
            out.append(one)
    return out


def set_in(body: list) -> set[str]:
    """Names that statements set."""
    found: set[str] = set()
    for step in body:
        if isinstance(step, Set):
            found.add(step.name)
        elif isinstance(step, If):
            found |= set_in(step.yes) | set_in(step.no)
        elif isinstance(step, (Generation, For)):
            found |= set_in(step.body)
    return found


# ---------------------------------------------------------------- closures


@dataclass
class Writer:
    """Rendered text with the spans of generation, in code points."""

    parts: list = field(default_factory=list)
    size: int = 0
    spans: list = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def closure(tree, names: set[str], message: str | None):
    """A function of the environment for an expression; names it cannot see are refused now."""
    if isinstance(tree, Const):
        return lambda env, value=tree.value: value
    if isinstance(tree, Name):
        if tree.name not in names:
            raise TemplateError(f"no name {tree.name!r} here")
        return lambda env, name=tree.name: env[name]
    if isinstance(tree, Field):
        if message is None or tree.of not in (message, "loop") or tree.of == "loop" and tree.name not in LOOP_FIELDS:
            raise TemplateError(f"no field {tree.of}.{tree.name} here")
        return lambda env, of=tree.of, name=tree.name: env[of].get(name)
    parts = [closure(part, names, message) for part in tree.parts]
    if tree.lazy:
        return lambda env, work=tree.work: work(*[lambda p=p: p(env) for p in parts])
    if len(parts) == 1:
        return lambda env, work=tree.work, only=parts[0]: work(only(env))
    return lambda env, work=tree.work: work(*[p(env) for p in parts])


def steps_of(body: list, names: set[str], message: str | None):
    """A function of (environment, writer) for statements."""
    steps = []
    for step in body:
        if isinstance(step, Out) and isinstance(step.value, Const):
            steps.append(lambda env, out, text=step.value.value: out.write(text))
        elif isinstance(step, Out):
            steps.append(lambda env, out, value=closure(step.value, names, message): out.write(_text(value(env))))
        elif isinstance(step, Set):
            value = closure(step.value, names, message)
            names.add(step.name)
            steps.append(lambda env, out, name=step.name, value=value: env.__setitem__(name, value(env)))
        elif isinstance(step, If):
            test = closure(step.test, names, message)
            sides = []
            for side in (step.yes, step.no):
                seen = set(names)
                sides.append((steps_of(side, seen, message), seen))
            names |= sides[0][1] & sides[1][1]
            steps.append(
                lambda env, out, test=test, yes=sides[0][0], no=sides[1][0]: yes(env, out) if test(env) else no(env, out)
            )
        elif isinstance(step, Generation):
            steps.append(_marked(steps_of(step.body, names, message)))
        else:
            raise TemplateError("the loop stands outside other blocks")

    def run(env, out):
        for one in steps:
            one(env, out)

    return run


def _marked(body):
    def run(env, out):
        start = out.size
        body(env, out)
        out.spans.append((start, out.size))

    return run


class Template:
    """A compiled template: ``head``, ``turn`` and ``tail`` write to a ``Writer``, ``render`` does all three."""

    def __init__(self, source: str, controls=(), **constants):
        if any(len(c) < 2 for c in controls):
            raise TemplateError("control strings have two characters at least")
        tree = fold_block(parse(source, controls), dict(constants))
        loops = [k for k, step in enumerate(tree) if isinstance(step, For)]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages")
        loop = tree[loops[0]]
        self.name = loop.name
        head, names = tree[: loops[0]], set(constants)
        self._constants = constants
        self._head = steps_of(head, names, None)
        if names & {loop.name, "loop"}:
            raise TemplateError(f"{loop.name!r} is the loop's name")
        self._turn = steps_of(loop.body, set(names), loop.name)
        self._tail = steps_of(tree[loops[0] + 1 :], set(names), None)
        # What the head sets is the same for every conversation.
        self._shared = dict(constants)
        self._head(self._shared, Writer())

    def head(self, out: Writer) -> None:
        self._head(dict(self._constants), out)

    def turn(self, message: dict, index0: int, last: bool, out: Writer) -> None:
        loop = {"first": index0 == 0, "last": last, "index": index0 + 1, "index0": index0}
        self._turn(self._shared | {self.name: message, "loop": loop}, out)

    def tail(self, out: Writer) -> None:
        self._tail(dict(self._shared), out)

    def render(self, messages: list[dict]) -> Writer:
        out = Writer()
        self.head(out)
        for k, message in enumerate(messages):
            self.turn(message, k, k == len(messages) - 1, out)
        self.tail(out)
        return out
