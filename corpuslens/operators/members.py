"""Members of the types in scripts: bodies by bracket depth, at any depth and over any number of lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from corpuslens.functions.batches import rows_of_texts
from corpuslens.functions.code_text import LITERAL, comment_pattern, possessive

COMMENT = comment_pattern()
# Type arguments up to three levels deep are one token, so that their commas end no member.
FLAT = r"[^<>(){};=\n]*"
ARGUMENTS = f"<{FLAT}(?:<{FLAT}(?:<{FLAT}>{FLAT})*>{FLAT})*>"
# A line break next to one of these signs ends no member.
CONTINUED = r"(?:[|&:=]|=>)[ \t]*\n\s*|\n\s*[|&?:=.]?"
TOKEN = rf"{COMMENT}|{LITERAL}|{ARGUMENTS}|{CONTINUED}|[^\"'`/<\[\](){{}};,\n|&:=]+|[\s\S]"
OPENING, CLOSING = ("{", "(", "["), ("}", ")", "]")
ENDING = r"^(?:[;,]|\n\s*)$"
BOUNDARIES = (";", "{", "}")
# The last such word before a brace, its name, and what may stand between the name and the brace.
HEAD = r"^[\s\S]*(?:^|\s)(interface|class|enum|type)\s+(\w+)([\s\S]*)$"
REST = r"""^(?:[\w\s.,<>|&\[\]"'$]*|[^=]*=\s*)$"""
DECORATORS = r"^(?:@[\w.]+(?:\([^)]*\))?\s*)+"
MEMBER = (
    r"^((?:(?:public|private|protected|static|readonly|async|abstract|override|declare|get|set)\s+)*)\*?\s*"
    r"""(#?[A-Za-z_$][\w$]*|\[[^\]]*\]|"[^"]*"|'[^']*')\s*([?!]?)\s*([\s\S]*)$"""
)
TYPE = r"^:\s*([\s\S]*?)(?:\s*=(?:[^>][\s\S]*)?)?$"
SCHEMA = (
    "repo string, path string, owner string, owner_kind string, line int, kind string, name string, type string, "
    "optional boolean, visibility string, is_static boolean, is_async boolean, is_readonly boolean"
)

_TOKEN = re.compile(possessive(TOKEN).replace(r"\z", r"\Z"), re.ASCII)
_ENDING, _HEAD, _REST, _MEMBER, _TYPE = (re.compile(p, re.ASCII) for p in (ENDING, HEAD, REST, MEMBER, TYPE))
_SPACES, _DECORATORS = re.compile(r"\s+", re.ASCII), re.compile(DECORATORS, re.ASCII)


class _Body:
    """An open body: its owner, the depth inside it, and where the member it is at starts and has its first brace."""

    def __init__(self, kind: str, owner: str, inside: int, start: int):
        self.kind, self.owner, self.inside, self.start, self.cut = kind, owner, inside, start, None


def _owner(head: str) -> tuple[str, str] | None:
    """Kind and name of the type whose body opens after this text."""
    found = _HEAD.match(head)
    if not found or found[2] == "extends" or not _REST.match(found[3]):
        return None
    return (found[1], found[2]) if found[3].rstrip().endswith("=") == (found[1] == "type") else None


def _parse(parts: list[str]) -> re.Match | None:
    text = _SPACES.sub(" ", "".join(parts)).strip(" ")
    return _MEMBER.match(_DECORATORS.sub("", text))


def _fields(body: _Body, parts: list[str], lines: list[int], end: int) -> list[tuple]:
    """The row of a member that ends before token ``end``; none where its text has no name.

    What follows its first brace is read only where it belongs to a type, so bodies within bodies stay cheap.
    """
    found = _parse(parts[body.start : end if body.cut is None else body.cut])
    if not found:
        return []
    called = found[4].startswith(("(", "<"))
    if body.cut is not None and (found[4].startswith(":") or (called and body.kind != "class")):
        found = _parse(parts[body.start : end])
    words, name, mark, rest = found[1].split(), found[2], found[3], found[4].strip(" ")
    if body.kind == "enum":
        kind, shown = "value", ""
    elif called:
        kind, shown = "method", rest
    else:
        typed = _TYPE.match(rest)
        kind, shown = "property", typed[1] if typed else ""
    hidden = "private" if "private" in words or name.startswith("#") else "protected" if "protected" in words else "public"
    first = next(i for i in range(body.start, end) if parts[i].strip(" \t\r\n\f"))
    return [(
        body.owner, body.kind, lines[first], kind, name, shown or None, mark == "?", hidden,
        "static" in words, "async" in words, "readonly" in words,
    )]


def members_of_text(code: str) -> Iterator[tuple]:
    """Members in one pass over the tokens; only the innermost body can end a member at a token."""
    parts: list[str] = []
    lines: list[int] = []
    bodies: list[_Body] = []
    depth, line, head = 0, 1, 0
    for i, token in enumerate(_TOKEN.findall(code)):
        lines.append(line)
        line += token.count("\n")
        if token in CLOSING:
            depth -= 1
            if bodies and depth < bodies[-1].inside:
                yield from _fields(bodies.pop(), parts, lines, i)
        body = bodies[-1] if bodies and bodies[-1].inside == depth else None
        if body and _ENDING.match(token):
            yield from _fields(body, parts, lines, i)
            body.start, body.cut = i + 1, None
        if token in OPENING:
            depth += 1
            if token == "{" and body and body.cut is None:
                body.cut = i
            if token == "{" and (found := _owner("".join(parts[head:i]))):
                bodies.append(_Body(*found, depth, i + 1))
        if token in BOUNDARIES:
            head = i + 1
        parts.append("" if token.startswith(("//", "/*")) else token)
    for body in reversed(bodies):
        yield from _fields(body, parts, lines, len(parts))


def type_members(files: DataFrame) -> DataFrame:
    """(repo, path, owner, owner_kind, line, kind, name, type, ...): one row a member of a script's types.

    Owners are interfaces, classes, enums and object types, also within functions and other bodies. A member is a
    property (``type``: its declared type), a method (``type``: parameters and result as written, without the
    body) or a value of an enum (no type). Members end with ``;``, ``,`` or a line break that no sign continues;
    two members of a class on one line need a sign between them. What has no name (a call form) is left out.
    Null and empty texts have no rows; a body that is never closed ends with the text.
    """
    return rows_of_texts(files, members_of_text, SCHEMA)


# A quote of a lifetime opens nothing, so a character is a literal only where its end follows.
RUST_LITERAL = r""""(?:[^"\\]|\\[\s\S])*"?|'(?:[^'\\\n]|\\.[^'\n]*)'"""
USE = r"(?:^|[;{}\n])[ \t\r]*(pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+)"
USE_PART = r"[{},]|[^{},]+"
USE_SCHEMA = "repo string, path string, line int, name string, alias string, source string, exported boolean"

_USE, _USE_PART = re.compile(USE, re.ASCII), re.compile(USE_PART)
_RUST_HIDDEN = re.compile(possessive(f"{RUST_LITERAL}|{COMMENT}").replace(r"\z", r"\Z"), re.ASCII)


def imports_of_text(code: str) -> Iterator[tuple]:
    """(line, name, alias, source, exported) of every leaf of every use tree, however deep and over any lines."""
    plain = _RUST_HIDDEN.sub(lambda m: "\n" * m[0].count("\n"), code)
    line, at = 1, 0
    for statement in _USE.finditer(plain):
        start = statement.start(2)
        line, at = line + plain.count("\n", at, start), start
        prefixes, pending = [""], None
        for part in [*_USE_PART.findall(statement[2]), ","]:
            if part == "{":
                prefixes.append(prefixes[-1] + (pending or ""))
                pending = None
            elif part in ("}", ","):
                if pending:
                    yield (line, *_leaf(prefixes[-1], pending), statement[1] is not None)
                pending = None
                if part == "}" and len(prefixes) > 1:
                    prefixes.pop()
            else:
                pending = _SPACES.sub(" ", part).strip(" ")


def _leaf(prefix: str, item: str) -> tuple[str, str | None, str]:
    """Name, alias and the path above the name; ``self`` stands for the last step of its prefix."""
    path, _, alias = item.partition(" as ")
    steps = [x.strip(" ") for x in (prefix + path).split("::")]
    if steps[-1] == "self" and len(steps) > 1:
        steps.pop()
    return steps[-1], alias.strip(" ") or None, "::".join(steps[:-1])


def rust_imports(files: DataFrame) -> DataFrame:
    """(repo, path, line, name, alias, source, exported): one row a name that a Rust file imports.

    ``use a::{b::{c, d as e}, self, f::*};`` gives c and d of ``a::b``, a itself and ``*`` of ``a::f``; ``line`` is the
    line on which the tree begins. Statements in literals and comments are none; raw literals with quotes in them and
    comments within comments are not told apart. Null and empty texts have no rows.
    """
    return rows_of_texts(files, imports_of_text, USE_SCHEMA)
