"""Path expressions: parts of a path, language by extension, file classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by file extension.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python",
    "rb": "ruby", "go": "go", "rs": "rust", "java": "java", "cpp": "cpp", "c": "c", "cs": "csharp",
    "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "sh": "bash", "yml": "yaml",
    "yaml": "yaml", "json": "json", "md": "markdown", "sql": "sql", "html": "html", "css": "css",
    "scss": "scss", "vue": "vue", "svelte": "svelte",
}
# The shorter table used when whole files are reviewed as a diff.
REVIEW_LANGUAGES = (
    "ts", "tsx", "js", "jsx", "py", "rb", "go", "rs", "java", "cpp", "c", "cs", "php", "swift", "kt",
)
# Other names for a language.
LANGUAGE_ALIASES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python",
    "rs": "rust", "rb": "ruby", "cs": "csharp", "c++": "cpp", "kt": "kotlin",
}
# File endings that are never reviewed, and those that are.
SKIPPED_ENDINGS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".pdf", ".zip", ".tar", ".gz", ".lock",
    ".min.js", ".bundle.js",
]
CODE_ENDINGS = [
    ".ts", ".tsx", ".js", ".jsx", ".py", ".rb", ".go", ".rs", ".java", ".cpp", ".c", ".cs", ".php",
    ".swift", ".kt",
]
# Path marks of tests, documents, critical code and configuration.
TEST_MARKS = [".test.", ".spec.", "__tests__", "/tests/", "/test/"]
DOC_ENDINGS = [".md", ".txt", ".rst", ".adoc"]
DOC_MARKS = ["/docs/"]
CRITICAL_WORDS = [
    "auth", "login", "password", "token", "jwt", "payment", "billing", "charge", "transaction",
    "security", "crypto", "encrypt", "admin", "permission", "role", "database", "migration", "schema",
]
CONFIG_MARKS = ["package.json", "tsconfig", ".yml", ".yaml", "config"]


def any_of(words: list[str], suffix: bool = False) -> str:
    """One regular expression that finds any of the literal words (at the end if ``suffix``)."""
    body = "|".join(re.escape(w) for w in words)
    return f"({body})$" if suffix else f"({body})"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash, or the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Last dot-part of the base name with its dot; empty for none and for dot-files."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def last_dot_part(path: Column) -> Column:
    """Text after the last dot; the whole path when it has none."""
    return F.substring_index(path, ".", -1)


def _lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def language_of(path: Column) -> Column:
    return _lookup(F.lower(last_dot_part(path)), LANGUAGE_BY_EXTENSION, F.lit("unknown"))


def review_language_of(path: Column) -> Column:
    known = {e: LANGUAGE_BY_EXTENSION[e] for e in REVIEW_LANGUAGES}
    return _lookup(F.lower(last_dot_part(path)), known, F.lit("unknown"))


def language_name(name: Column) -> Column:
    """Standard name of a language given under any of its aliases."""
    plain = F.translate(F.lower(name), "_-", "")
    return _lookup(plain, LANGUAGE_ALIASES, plain)


def is_test(path: Column) -> Column:
    return path.rlike(any_of(TEST_MARKS))


def is_doc(path: Column) -> Column:
    return path.rlike(any_of(DOC_ENDINGS, suffix=True)) | path.rlike(any_of(DOC_MARKS))


def is_critical(path: Column) -> Column:
    return F.lower(path).rlike(any_of(CRITICAL_WORDS))


def is_config(path: Column) -> Column:
    return path.rlike(any_of(CONFIG_MARKS))


def is_reviewable(path: Column, status: Column) -> Column:
    low = F.lower(path)
    return (
        (status != "deleted")
        & ~low.rlike(any_of(SKIPPED_ENDINGS, suffix=True))
        & low.rlike(any_of(CODE_ENDINGS, suffix=True))
    )


def normalize(path: Column) -> Column:
    """Resolve ``.``, ``..`` and empty segments of a relative path."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, seg: F.when(seg.isin("", "."), done)
        .when(
            (seg == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .otherwise(F.concat(done, F.array(seg))),
    )
    return F.array_join(kept, "/")


def related(a: Column, b: Column) -> Column:
    """Same directory, or same base name once a test ending is removed."""
    tail = r"\.(test|spec)\.(ts|js|tsx|jsx)$"
    return (dirname(a) == dirname(b)) | (
        F.regexp_replace(basename(a), tail, "") == F.regexp_replace(basename(b), tail, "")
    )
