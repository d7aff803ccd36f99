"""Ignore rules and technology stacks of a repository."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ignore patterns per technology stack.
IGNORE_PATTERNS = {
    "nodejs": [
        "node_modules/", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "dist/", "build/",
        ".next/", ".nuxt/", "out/", "coverage/", ".cache/", "*.min.js", "*.bundle.js", "*.chunk.js",
        ".turbo/", ".vercel/", ".netlify/",
    ],
    "python": [
        "__pycache__/", "*.pyc", "*.pyo", "*.pyd", ".Python", "venv/", ".venv/", "env/", ".env/",
        "pip-lock.txt", "Pipfile.lock", "poetry.lock", "*.egg-info/", "*.egg", ".eggs/", ".pytest_cache/",
        ".mypy_cache/", ".tox/", "htmlcov/", ".coverage", "*.cover",
    ],
    "rust": ["target/", "Cargo.lock", "**/*.rs.bk"],
    "go": ["vendor/", "go.sum", "*.exe", "*.test"],
    "java": ["target/", "*.class", "*.jar", "*.war", "*.ear", ".gradle/", "build/", ".mvn/"],
    "general": [
        ".git/", ".svn/", ".hg/", ".DS_Store", "Thumbs.db", "*.log", "*.swp", "*.swo", "*~", ".idea/",
        ".vscode/", "*.map", ".env.local", ".env.*.local",
    ],
}
# Files at the root of a repository that mark a stack.
STACK_MARKERS = {
    "nodejs": ["package.json"],
    "python": ["requirements.txt", "pyproject.toml", "setup.py", "Pipfile"],
    "rust": ["Cargo.toml"],
    "go": ["go.mod"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
}
# Extensions and folders of the default scan, and the file size limit in bytes.
DEFAULT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py"]
DEFAULT_EXCLUDED_FOLDERS = ["node_modules", "dist", ".git"]
SELECTOR_EXCLUDED_ROOTS = ["node_modules", ".git", "dist", "build", ".next", "coverage"]
MAX_FILE_BYTES = 100 * 1024


def patterns_for(stacks: list[str]) -> list[str]:
    """Patterns of the stacks in order, each once."""
    return list(dict.fromkeys(p for s in stacks for p in IGNORE_PATTERNS.get(s, [])))


def _wildcard(pattern: str) -> str:
    """``*`` stays inside a path segment; a double star asks for one character more.

    The double star does not span segments here. That is what the given rules compute, so
    ``**/*.rs.bk`` needs at least one folder in front.
    """
    out = []
    for token in re.findall(r"\*\*|\*|[^*]+", pattern):
        out.append({"**": ".[^/]*", "*": "[^/]*"}.get(token, token.replace(".", r"\.")))
    return "".join(out)


def ignore_regex(patterns: list[str]) -> str:
    """One regular expression for a whole pattern list.

    ``name/`` matches a path segment, a bare name matches the base name, ``*`` patterns match the end of
    the path from a segment start, anything else matches anywhere.
    """
    folders, names, wild, inside = [], [], [], []
    for p in patterns:
        if p.endswith("/"):
            folders.append(re.escape(p[:-1]))
        elif "*" in p:
            wild.append(_wildcard(p))
        elif "/" in p:
            inside.append(re.escape(p))
        else:
            names.append(re.escape(p))
    parts = []
    if folders:
        parts.append(f"(^|/)({'|'.join(folders)})(/|$)")
    if names or wild:
        parts.append(f"(^|/)({'|'.join(names + wild)})$")
    parts += inside
    return "|".join(parts) if parts else r"(?!)"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    return F.translate(path, "\\", "/").rlike(ignore_regex(patterns))


def in_folder(path: Column, folders: list[str]) -> Column:
    """The path has one of the folders among its directories, at any level."""
    return path.rlike(f"(^|/)({'|'.join(re.escape(f) for f in folders)})/")


def under_root_folder(path: Column, folders: list[str]) -> Column:
    """The path starts with one of the folders."""
    return path.rlike(f"^({'|'.join(re.escape(f) for f in folders)})/")


def ignore_rules(df_or_spark) -> DataFrame:
    """Dimension (stack, pattern); its size is fixed by the constants above."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    rows = [(s, p) for s, ps in IGNORE_PATTERNS.items() for p in ps]
    return spark.createDataFrame(rows, "stack string, pattern string")


def detect_stacks(files: DataFrame) -> DataFrame:
    """(repo, stack): stacks whose marker file lies at the root, plus ``general`` for every repository."""
    spark = files.sparkSession
    markers = spark.createDataFrame(
        [(s, f) for s, fs in STACK_MARKERS.items() for f in fs], "stack string, path string"
    )
    # the marker list is a fixed handful of rows
    found = files.select("repo", "path").join(F.broadcast(markers), "path").select("repo", "stack")
    general = files.select("repo", F.lit("general").alias("stack"))
    return found.unionByName(general).distinct()


def stack_ignore_rules(stacks: DataFrame) -> DataFrame:
    """(repo, pattern): the distinct patterns of all stacks of a repository."""
    return (
        stacks.join(F.broadcast(ignore_rules(stacks)), "stack").select("repo", "pattern").distinct()
    )


def scan_files(
    files: DataFrame,
    extensions: list[str] = DEFAULT_EXTENSIONS,
    patterns: list[str] | None = None,
    folders: list[str] = DEFAULT_EXCLUDED_FOLDERS,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Files to index: not ignored, an allowed extension, not too large. Content is not looked at."""
    from corpuslens.functions.paths import extension

    path = F.col("path")
    keep = (F.col("size") <= max_bytes) & extension(path).isin(extensions) & ~in_folder(path, folders)
    if patterns:
        keep &= ~is_ignored(path, patterns)
    return files.filter(keep)


def select_files(files: DataFrame, folders: list[str] = SELECTOR_EXCLUDED_ROOTS) -> DataFrame:
    """Files a reviewer can pick from, in path order."""
    return files.filter(~under_root_folder(F.col("path"), folders)).orderBy("path")


def walk_source_files(files: DataFrame, extensions: list[str]) -> DataFrame:
    """Files with one of the endings, outside dot-folders and ``node_modules``."""
    from corpuslens.functions.paths import any_of

    path = F.col("path")
    return files.filter(
        path.rlike(any_of(extensions, suffix=True)) & ~path.rlike(r"(^|/)(\.[^/]*|node_modules)/")
    )
