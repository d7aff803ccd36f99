"""Relevance of context items for a reviewed file, and what each review strategy keeps.

All rankers yield the same long table: repo, file, category, item_key, score, reason, content. Scores are built
from whole hundredths, so equal sums compare equal; ties go to the item key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.functions.let import let, open_array
from corpuslens.functions.windows import top_per_group
from corpuslens.operators.symbols import count_mentions, find_all

# Path words of critical imports.
CRITICAL_IMPORTS = ["config", "schema", "type", "interface", "model", "api"]
MIN_SCORE = {"import": 0.3, "import_plain": 0.3, "pattern": 0.4, "type": 0.3, "test": 0.3, "dependency": 0.3}
MAX_ITEMS = {"import": 5, "import_plain": 3, "pattern": 3, "type": 5, "test": 3, "dependency": 5}
ITEM = ["repo", "file", "category", "item_key", "score", "reason", "content"]

# Items kept per strategy and category; None keeps all.
STRATEGY_LIMITS = [
    ("security", "import", 5), ("security", "type", 5), ("security", "pattern", 3), ("security", "upstream", 3),
    ("performance", "import_plain", 3), ("performance", "pattern", 5), ("performance", "upstream", 5),
    ("performance", "downstream", 3),
    ("logic", "import", 5), ("logic", "type", 7), ("logic", "test", 3), ("logic", "pattern", 3),
    ("logic", "upstream", None), ("logic", "downstream", None),
    ("code", "import", 7), ("code", "type", 7), ("code", "test", 3), ("code", "pattern", 5),
    ("code", "upstream", None), ("code", "downstream", None),
]

IMPORT_CLAUSE = r"""import\s+([\w{},\s*$]+?)\s+from\s+['"]([^'"]+)['"]"""


# Fixed output values: the reason texts of the rankers below ("used n times", "n direct references", "critical import",
# "heavily used", "n% similar", "related location", "n matching concepts", "potential duplicate" and so on).


def _points(condition: Column, points) -> Column:
    return F.when(condition, points).otherwise(F.lit(0))


def _reasons(*pairs: tuple[Column, Column]) -> Column:
    return F.concat_ws(", ", *[F.when(cond, text) for cond, text in pairs])


def _says(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def keep_best(scored: DataFrame, category: str, max_items: int | None = None) -> DataFrame:
    """Items that reach the category's least score, best first, up to its limit per file (0 keeps none)."""
    enough = scored.filter(F.col("score") >= MIN_SCORE[category])
    most = MAX_ITEMS[category] if max_items is None else max_items
    best = top_per_group(enough, ["repo", "file"], [F.col("score").desc(), F.col("item_key")], most)
    return best.withColumn("category", F.lit(category)).select(*ITEM)


def import_uses(files: DataFrame, code: str = "content") -> DataFrame:
    """(repo, file, import_path, names, uses, mentions) of static imports, all within the row of the file.

    ``uses`` counts whole-word occurrences of the local names, ``mentions`` the base name of the path.
    """
    local = lambda clause: find_all(F.regexp_replace(clause, r"\w+\s+as\s+", ""), r"[A-Za-z_$][\w$]*", 0)

    def build(words):
        def one(m):
            names = local(F.regexp_extract(m, IMPORT_CLAUSE, 1))
            path = F.regexp_extract(m, IMPORT_CLAUSE, 2)
            return F.struct(
                path.alias("import_path"),
                names.alias("names"),
                let(names, lambda ns: F.size(F.filter(words, lambda w: F.array_contains(ns, w)))).alias("uses"),
                count_mentions(F.col(code), F.substring_index(path, "/", -1)).alias("mentions"),
            )

        return F.transform(find_all(F.col(code), IMPORT_CLAUSE, 0), one)

    rows = open_array(files, ["repo", F.col("path").alias("file")], let(find_all(F.col(code), r"\w+", 0), build), "ordinal", "_u")
    return rows.select("repo", "file", "ordinal", "_u.*")


def score_imports(uses: DataFrame, plain_too: bool = False) -> DataFrame:
    """Base-name mentions, name usages, critical words in the path, heavy use.

    ``plain_too`` adds each import a second time, scored without its usages, as ``import_plain``.
    """
    kinds = ["import", "import_plain"] if plain_too else ["import"]
    uses = uses.withColumn("category", F.explode(F.array(*[F.lit(k) for k in kinds])))
    m = F.col("mentions")
    u = F.when(F.col("category") == "import", F.col("uses")).otherwise(0)
    critical = F.lower("import_path").rlike(P.any_of(CRITICAL_IMPORTS))
    points = (
        F.least(m * 20, F.lit(60)) + F.least(u * 15, F.lit(40)) + _points(critical, 30) + _points(u > 3, 20)
    )
    reason = _reasons(
        (m > 0, _says("used ", m, " times")), (u > 0, _says(u, " direct references")),
        (critical, F.lit("critical import")), (u > 3, F.lit("heavily used")),
    )
    return uses.select(
        "repo", "file", "category", F.col("import_path").alias("item_key"), (F.least(points, F.lit(100)) / 100).alias("score"),
        reason.alias("reason"), F.array_join("names", ", ").alias("content"),
    )


def score_patterns(patterns: DataFrame) -> DataFrame:
    """Similarity, related location, matching concepts; near copies are damped. Columns: file, file_path,
    similarity, concepts, code."""
    s, n = F.col("similarity"), F.col("concepts")
    near = P.related(F.col("file"), F.col("file_path"))
    raw = s + _points(near, 0.2) + n * F.lit(0.1)
    score = F.round(F.least(F.when(s > 0.95, raw * 0.7).otherwise(raw), F.lit(1.0)), 6)
    reason = F.concat_ws(
        ", ", _says(F.round(s * 100).cast("int"), "% similar"), F.when(near, "related location"),
        F.when(n > 0, _says(n, " matching concepts")), F.when(s > 0.95, "potential duplicate"),
    )
    return patterns.select(
        "repo", "file", F.col("file_path").alias("item_key"), score.alias("score"), reason.alias("reason"),
        F.col("code").alias("content"),
    )


def type_references(code: Column) -> Column:
    """Names that stand where a type is expected: after a colon, an angle bracket or ``as``."""
    return find_all(code, r"(?:[:<]\s*|\bas\s+)([A-Za-z_]\w*)", 1)


def score_types(types: DataFrame, usage: str | None = None) -> DataFrame:
    """Mentions, use as a type, exported, wide use. Columns: file, name, definition, changed_code."""
    m = count_mentions(F.col("changed_code"), F.col("name"))
    refs = F.size(F.filter(type_references(F.col("changed_code")), lambda x: F.contains(x, F.col("name"))))
    measured = types.withColumns({"_m": m, "_refs": refs})
    m, refs = F.col("_m"), F.col("_refs")
    exported = F.col("definition").rlike(r"^export\s")
    wide = F.coalesce(F.col(usage) > 5, F.lit(False)) if usage else F.lit(False)
    points = F.least(m * 25, F.lit(70)) + _points(refs > 0, 40) + _points(exported, 20) + _points(wide, 20)
    reason = _reasons(
        (m > 0, _says("used ", m, " times")), (refs > 0, _says("type annotation (", refs, " refs)")),
        (exported, F.lit("exported type")), (wide, F.lit("widely used")),
    )
    return measured.select(
        "repo", "file", F.col("name").alias("item_key"), (F.least(points, F.lit(100)) / 100).alias("score"),
        reason.alias("reason"), F.col("definition").alias("content"),
    )


def score_tests(tests: DataFrame) -> DataFrame:
    """Related path, number of tests, coverage above 70. Columns: file, test_path, tests, coverage."""
    n, c = F.size("tests"), F.col("coverage")
    near, covered = P.related(F.col("file"), F.col("test_path")), F.coalesce(F.col("coverage") > 70, F.lit(False))
    points = _points(near, 50) + F.least(n * 10, F.lit(30)) + _points(covered, 30)
    reason = _reasons(
        (near, F.lit("matching path")), (n > 0, _says(n, " tests")), (covered, _says(c, "% coverage"))
    )
    return tests.select(
        "repo", "file", F.col("test_path").alias("item_key"), (F.least(points, F.lit(100)) / 100).alias("score"),
        reason.alias("reason"), F.array_join("tests", "\n").alias("content"),
    )


def score_dependencies(deps: DataFrame) -> DataFrame:
    """Near before far, what a file needs before what needs it. Columns: file, node, relation, depth."""
    up = F.col("relation") == "upstream"
    points = F.greatest(F.lit(100) - F.col("depth") * 20 + _points(up, 20), F.lit(0))
    reason = F.concat_ws(
        ", ", _says("depth ", F.col("depth")), F.when(up, "direct dependency").otherwise("dependent")
    )
    return deps.select(
        "repo", "file", F.col("node").alias("item_key"), (points / 100).alias("score"), reason.alias("reason"),
        F.col("relation").alias("content"),
    )


def strategy_limits(spark) -> DataFrame:
    """The limits as a table; users add strategies by adding rows."""
    return spark.createDataFrame(STRATEGY_LIMITS, "strategy string, category string, max_items int")


def select_by_strategy(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items that each strategy keeps: the best ``max_items`` of each category per file, or all of them.

    ``items`` are scored items of all categories; they are materialised once, as two branches read them.
    The widest limit bounds the ranking window, so a hot file sends few rows. A category that is kept whole
    is not ranked at all.
    """
    from corpuslens.session import cut_lineage

    items = cut_lineage(items)
    widest = limits.agg(F.max("max_items")).first()[0] or 0
    numbered = (
        items.withColumn("_rank", _rank_within()).filter(F.col("_rank") <= widest)
        .join(limits.filter("max_items is not null"), "category")
        .filter(F.col("_rank") <= F.col("max_items"))
    )
    whole = items.join(limits.filter("max_items is null"), "category").withColumn("_rank", F.lit(0))
    return numbered.drop("max_items").unionByName(whole.drop("max_items")).withColumnRenamed("_rank", "item_rank")


def _rank_within() -> Column:
    from pyspark.sql import Window

    order = [F.col("score").desc(), F.col("item_key")]
    return F.row_number().over(Window.partitionBy("repo", "file", "category").orderBy(*order))


# ---------------------------------------------------------------- prompt text

# Order of the sections of a prompt, per strategy.
SECTIONS = {
    "security": ["import", "type", "pattern", "upstream"],
    "performance": ["pattern", "upstream", "downstream", "import_plain"],
    "logic": ["type", "test", "import", "upstream", "downstream", "pattern"],
    "code": ["type", "test", "import", "upstream", "downstream", "pattern"],
}
TITLES = {
    "import": "Imports", "import_plain": "Imports", "type": "Types", "pattern": "Similar code",
    "upstream": "Depends on", "downstream": "Used by", "test": "Tests",
}
TRUNCATE = {"security": 400, "performance": 500, "logic": 300, "code": 300}
FOCUS = {
    "security": "Look for security problems in this change.",
    "performance": "Look for performance problems in this change.",
    "logic": "Look for logic errors and missed cases in this change.",
    "code": "Look for logic errors, security problems and missed cases in this change.",
}
MARKER = "\n// ... truncated ..."


def _by_strategy(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col("strategy")]


def context_parts(
    selected: DataFrame, files: DataFrame, strategies: list[str], truncate: dict[str, int | None] = TRUNCATE
) -> DataFrame:
    """Ordered text parts of every prompt: (repo, file, strategy, section, item_rank, part).

    ``truncate``: characters of a similar code shown, per strategy; None shows all. Section 0 carries the
    changed code. Parts stay separate rows, because a strategy may keep a whole
    dependency list; a reader joins them in order.
    """
    cuts = {s: 2**31 - 1 if n is None else n for s, n in truncate.items()}
    place = {(s, c): i + 1 for s, cats in SECTIONS.items() for i, c in enumerate(cats)}
    order = F.create_map(*[x for (s, c), i in place.items() for x in (F.lit(f"{s}/{c}"), F.lit(i))])
    title = F.create_map(*[F.lit(x) for item in TITLES.items() for x in item])
    body = F.when(
        (F.col("category") == "pattern") & (F.length("content") > _by_strategy(cuts)),
        F.concat(F.expr("substring(content, 1, _cut)"), F.lit(MARKER)),
    ).otherwise(F.col("content"))
    rows = selected.filter(F.col("strategy").isin(strategies)).withColumn("_cut", _by_strategy(cuts))
    items = rows.select(
        "repo", "file", "strategy", order[F.concat_ws("/", "strategy", "category")].alias("section"), "item_rank",
        F.col("item_key"),
        F.concat(
            F.lit("## "), title[F.col("category")], F.lit(": "), F.col("item_key"), F.lit("\n"), F.coalesce(body, F.lit(""))
        ).alias("part"),
    )
    heads = files.select(
        "repo", "file", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"), "language", "changed_code"
    ).select(
        "repo", "file", "strategy", F.lit(0).alias("section"), F.lit(0).alias("item_rank"), F.lit("").alias("item_key"),
        F.concat(
            _by_strategy(FOCUS), F.lit("\n# File: "), "file", F.lit("\nLanguage: "), "language", F.lit("\n"), "changed_code"
        ).alias("part"),
    )
    return heads.unionByName(items)


def assemble_context(parts: DataFrame) -> DataFrame:
    """One prompt text per file and strategy, for strategies whose limits bound the number of parts."""
    return parts.groupBy("repo", "file", "strategy").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("section", "item_rank", "item_key", "part"))), lambda x: x["part"]
            ),
            "\n\n",
        ).alias("prompt"),
        F.count(F.lit(1)).alias("n_parts"),
    )


def stack_notes(stacks: DataFrame, notes: DataFrame) -> DataFrame:
    """Review notes of the detected stacks per repository and agent; ``general`` has none."""
    return (
        stacks.filter(F.col("stack") != "general")
        .join(notes.filter(F.trim("note") != ""), "stack")
        .select("repo", "agent", "stack", "note")
    )


# Short notes per stack and agent.
STACK_NOTES = [
    ("nodejs", "security", "Check logged values for secrets and untrusted input in shell or query text."),
    ("nodejs", "performance", "Check blocking calls on the event loop and awaits inside loops."),
    ("nodejs", "logic", "Check unhandled promise rejections and missing awaits."),
    ("python", "security", "Check unsafe loading of data, shell calls and query text built from input."),
    ("python", "performance", "Check repeated work in loops and large lists that could be streamed."),
    ("python", "logic", "Check mutable defaults, broad exception handlers and resource handling."),
    ("go", "security", "Check ignored errors and query text built from input."),
    ("go", "performance", "Check goroutine leaks and copies of large values."),
    ("go", "logic", "Check shared state without locks and shadowed errors."),
    ("rust", "security", "Check unsafe blocks and unchecked input."),
    ("rust", "performance", "Check needless clones and allocations."),
    ("rust", "logic", "Check unwraps on fallible values."),
    ("java", "security", "Check deserialization and query text built from input."),
    ("java", "performance", "Check boxing, string building in loops and unclosed streams."),
    ("java", "logic", "Check null handling and equality of objects."),
]


def enrich_context(
    imports: DataFrame, types: DataFrame, patterns: DataFrame, bundle: DataFrame
) -> DataFrame:
    """All context of all reviewed files as one long table: repo, file, category, item_key, detail."""
    parts = [
        imports.select("repo", "file", F.lit("import").alias("category"), F.col("import_path").alias("item_key"), F.col("uses").cast("string").alias("detail")),
        types.select("repo", "file", F.lit("type").alias("category"), F.col("name").alias("item_key"), F.col("rendered").alias("detail")),
        patterns.select("repo", "file", F.lit("pattern").alias("category"), F.col("file_path").alias("item_key"), F.col("similarity").cast("string").alias("detail")),
        bundle.select("repo", F.col("root").alias("file"), F.col("relation").alias("category"), F.col("node").alias("item_key"), F.col("depth").cast("string").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
