"""Code, literals and comments told apart in one pass, as expressions over the text of a row.

A text is read from left to right as literals, comments and the rest, so ``//`` inside a literal is no comment and
a quote inside a comment opens nothing. The passes are linear in the text: no pattern looks back or tries a
character twice, and the possessive loops of the JVM form need no stack, however long a literal is.

Decided: a quoted literal ends with its line unless a backslash precedes the line break; a template and a block
comment that are never closed end with the text; what ``${}`` holds belongs to its template. A pattern literal is
not told from a division, so a quote in it opens a literal up to the end of the line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.let import let

QUOTED = r'''"(?:[^"\\\n]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[\s\S])*'?'''
TEMPLATE = r"`(?:[^`\\]|\\[\s\S])*`?"
LITERAL = f"{QUOTED}|{TEMPLATE}"
# In a fragment the other end of a template or comment may be missing, so both end with their line.
LINE_LITERAL = QUOTED + r"|`(?:[^`\\\n]|\\[^\n])*`?"
LINE_COMMENT = r"//[^\n]*|/\*(?:[^*\n]|\*+[^*/\n])*\**/?"


def comment_pattern(single: str = "//", start: str = "/*", end: str = "*/") -> str:
    """Line comments and block comments with the given marks."""
    return f"{re.escape(single)}[^\\n]*|{re.escape(start)}[\\s\\S]*?(?:{re.escape(end)}|\\z)"


def possessive(pattern: str) -> str:
    """The JVM form of a pattern whose loops never have to give anything back."""
    return pattern.replace(")*", ")*+")


def strip_comments(code: Column, single: str = "//", start: str = "/*", end: str = "*/") -> Column:
    """The text without its comments; literals stay as they are."""
    return F.regexp_replace(code, f"({possessive(LITERAL)})|{comment_pattern(single, start, end)}", "$1")


def plain_code(code: Column) -> Column:
    """A fragment without comments and with every literal emptied to ``""``: what is left is code."""
    kept = F.regexp_replace(code, possessive(f"({LINE_LITERAL})|{LINE_COMMENT}"), "$1")
    return let(kept, lambda x: F.regexp_replace(x, possessive(LINE_LITERAL), '""'))
