"""Import resolution and the dependency graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import paths as P
from corpuslens.functions.let import open_array
from corpuslens.operators.symbols import imports_js, test_names
from corpuslens.session import cut_lineage

# Source endings that an import may carry, and the endings tried per kind of importing file.
SOURCE_ENDINGS = [
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".kt", ".swift", ".rb", ".php",
]
SCRIPT_ENDINGS = [".ts", ".tsx", ".js", ".jsx"]
SINGLE_ENDINGS = [".py", ".go", ".rs", ".java", ".kt", ".rb", ".php", ".swift"]
TEST_SUFFIXES = [".test.ts", ".test.js", ".spec.ts", ".spec.js", ".test.tsx", ".spec.tsx"]


def base_path(imported: Column, importer: Column) -> Column:
    """Path that an import means, without source ending: ``@/x`` from the root, ``./`` and ``../`` from the
    importing folder, anything else unchanged."""
    strip = P.any_of(SOURCE_ENDINGS, suffix=True)
    bare = lambda p: F.regexp_replace(p, r"([^/])" + strip, "$1")
    near = P.normalize(F.concat_ws("/", P.dirname(importer), imported))
    return (
        F.when(imported.startswith("@/"), bare(F.substring(imported, F.lit(3), F.length(imported))))
        .when(imported.rlike(r"^\.\.?/"), bare(near))
        .otherwise(imported)
    )


def endings_for(importer: Column) -> Column:
    """The one ending tried for single-ending languages, else the empty string for scripts."""
    ext = P.extension(importer)
    return F.when(ext.isin(SINGLE_ENDINGS), ext).otherwise("")


def is_local(imported: Column) -> Column:
    return imported.rlike(r"^[@./]")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``base_path`` and ``resolved`` (null if none) to imports (repo, path, imported).

    Order of preference: the path itself, path + ending, path/index + ending. Each distinct target is
    resolved once; imports of a popular module meet its single answer in a join to a unique key, which
    adaptive execution may split.
    """
    asked = imports.withColumns(
        {"base_path": base_path(F.col("imported"), F.col("path")), "_ending": endings_for(F.col("path"))}
    )
    target = asked.select("repo", "base_path", "_ending").distinct()
    base, ending = F.col("base_path"), F.col("_ending")

    def tries(suffix: str) -> Column:
        scripts = F.array(*[F.concat(base, F.lit(suffix + e)) for e in SCRIPT_ENDINGS])
        return F.when(ending == "", scripts).otherwise(F.array(F.concat(base, F.lit(suffix), ending)))

    candidates = target.select(
        "repo", "base_path", "_ending",
        F.posexplode(F.concat(F.array(base), tries(""), tries("/index"))).alias("_priority", "_candidate"),
    )
    known = files.select("repo", F.col("path").alias("_candidate"))
    best = (
        candidates.join(known, ["repo", "_candidate"])
        .groupBy("repo", "base_path", "_ending")
        .agg(F.min_by("_candidate", "_priority").alias("resolved"))
    )
    return asked.join(best, ["repo", "base_path", "_ending"], "left").drop("_ending")


def import_rows(files: DataFrame, local_only: bool = True) -> DataFrame:
    """(repo, path, ordinal, imported) of script files."""
    rows = open_array(files, ["repo", "path"], imports_js(F.col("content")), "ordinal", "imported")
    return rows.filter(is_local(F.col("imported"))) if local_only else rows


def import_edges(files: DataFrame) -> DataFrame:
    """Distinct (repo, src, dst) file dependencies."""
    resolved = resolve_imports(import_rows(files), files.select("repo", "path"))
    return resolved.filter(F.col("resolved").isNotNull()).select(
        "repo", F.col("path").alias("src"), F.col("resolved").alias("dst")
    ).distinct()


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """Imports, resolved and failed counts and the success rate per file."""
    ok = F.col("resolved").isNotNull()
    return resolved.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("resolved"),
        F.count_if(~ok).alias("failed"),
        F.round(F.count_if(ok) / F.count(F.lit(1)) * 100, 1).alias("success_rate"),
    )


def language_candidates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Resolve dotted, package and ``::`` imports of Python, Go and Rust files (repo, path, imported).

    Python modules match a path ending, Go packages a folder name; both are equality joins on keys derived
    from every file (each path ending, its folder name). Among equal candidates the first path wins.
    """
    ext = P.extension(F.col("path"))
    spec = F.col("imported")
    module = F.replace(spec, F.lit("."), F.lit("/"))
    rust = F.replace(F.regexp_replace(spec, "^(crate|super|self)::", ""), F.lit("::"), F.lit("/"))
    parent = P.dirname(F.col("path"))
    near = F.when(spec.startswith("super::"), P.dirname(parent)).otherwise(parent)
    empty = F.array().cast("array<string>")
    folder_key = lambda name: F.concat(F.lit("dir:"), name)
    full_key = lambda p: F.concat(F.lit("path:"), F.regexp_replace(p, "^/", ""))
    end_key = lambda p: F.concat(F.lit("end:"), p)
    py = F.array(
        end_key(F.concat(F.lit("/"), module, F.lit(".py"))),
        end_key(F.concat(F.lit("/"), module, F.lit("/__init__.py"))),
        F.when(spec.startswith("."), full_key(F.concat(parent, F.lit("/"), F.ltrim(F.regexp_replace(module, "^/+", "")), F.lit(".py")))),
    )
    go = F.array(
        F.when(spec.startswith("."), F.concat(F.lit("in:"), P.normalize(F.concat_ws("/", parent, spec)))),
        folder_key(F.substring_index(spec, "/", -1)),
    )
    rs = F.when(spec.startswith("crate::"), F.array(
        full_key(F.concat(F.lit("src/"), rust, F.lit(".rs"))), full_key(F.concat(F.lit("src/"), rust, F.lit("/mod.rs")))
    )).when(spec.rlike("^(super|self)::"), F.array(full_key(F.concat_ws("/", near, F.concat(rust, F.lit(".rs")))))).otherwise(empty)
    keys = F.when(ext == ".py", py).when(ext == ".go", go).when(ext == ".rs", rs).otherwise(empty)
    target = imports.withColumn("_keys", F.array_compact(keys))
    distinct = target.select("repo", "_keys").distinct()
    tried = distinct.select("repo", "_keys", F.posexplode("_keys").alias("_priority", "_key"))
    parts = F.split(F.concat(F.lit("/"), F.col("path")), "/")
    ends = F.transform(
        F.sequence(F.lit(2), F.size(parts)),
        lambda i: end_key(F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/"))),
    )
    path_ext = P.extension(F.col("path"))
    own = (
        F.when(path_ext == ".py", F.concat(ends, F.array(full_key(F.col("path")))))
        .when(path_ext == ".go", F.array(folder_key(P.basename(P.dirname(F.col("path")))), F.concat(F.lit("in:"), P.dirname(F.col("path")))))
        .when(path_ext == ".rs", F.array(full_key(F.col("path"))))
        .otherwise(empty)
    )
    lookup = (
        files.select("repo", "path", F.explode(own).alias("_key"))
        .groupBy("repo", "_key")
        .agg(F.min("path").alias("_found"))
    )
    best = tried.join(lookup, ["repo", "_key"]).groupBy("repo", "_keys").agg(
        F.min_by("_found", "_priority").alias("resolved")
    )
    return target.join(best, ["repo", "_keys"], "left").drop("_keys")


def reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(repo, root, node, depth) with the least number of hops along (repo, src, dst), roots themselves left out.

    A walk stays in the repository of its root. One equality join per hop; pairs seen before are dropped by
    an anti join. Each hop but the last is written to the shared checkpoint folder, so the plan does not
    double with every hop. The result has a row per root and reachable node: roots are meant to be the files
    under review, and with every file as a root a hub makes it as large as all pairs.
    """
    step = edges.select("repo", F.col("src").alias("node"), F.col("dst").alias("_next")).distinct()
    frontier = roots.select("repo", "root", F.col("root").alias("node")).distinct()
    seen = frontier
    found = None
    for depth in range(1, max_depth + 1):
        frontier = (
            frontier.join(step, ["repo", "node"])
            .select("repo", "root", F.col("_next").alias("node"))
            .distinct()
            .join(seen, ["repo", "root", "node"], "left_anti")
        )
        if depth < max_depth:
            frontier = cut_lineage(frontier)
            seen = seen.unionByName(frontier)
        layer = frontier.withColumn("depth", F.lit(depth))
        found = layer if found is None else found.unionByName(layer)
    return found


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))


def upstream(edges: DataFrame, roots: DataFrame, max_depth: int = 2) -> DataFrame:
    """What the roots depend on."""
    return reach(edges, roots, max_depth)


def downstream(edges: DataFrame, roots: DataFrame, max_depth: int = 1, near: bool = False) -> DataFrame:
    """What depends on the roots; ``near`` keeps only files under the root's parent folder."""
    found = reach(reverse(edges), roots, max_depth)
    if near:
        wide = P.dirname(P.dirname(F.col("root")))
        inside = (wide == "") | F.col("node").startswith(F.concat(wide, F.lit("/")))
        found = found.filter(inside & (F.col("depth") == 1))
    return found


def related_tests(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, test_path, tests): test files by name next to a file or in its ``__tests__`` folder."""
    path = F.col("path")
    folder = P.dirname(path)
    stem = F.regexp_replace(P.basename(path), r"(.)\.[^.]*$", "$1")
    inside = F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))
    names = [F.concat(inside, F.lit(sub), stem, F.lit(s)) for sub in ("", "__tests__/") for s in TEST_SUFFIXES]
    candidates = sources.select("repo", "path", F.explode(F.array(*names)).alias("test_path"))
    tests = files.select("repo", F.col("path").alias("test_path"), test_names(F.col("content")).alias("tests"))
    return candidates.join(tests, ["repo", "test_path"]).select("repo", "path", "test_path", "tests")


def dependency_bundle(edges: DataFrame, tests: DataFrame, roots: DataFrame, max_depth: int = 1) -> DataFrame:
    """(repo, root, relation, node, depth): upstream, downstream and tests of every root in one table."""
    up = upstream(edges, roots, max_depth).withColumn("relation", F.lit("upstream"))
    down = downstream(edges, roots, 1).withColumn("relation", F.lit("downstream"))
    test = tests.join(roots.withColumnRenamed("root", "path"), ["repo", "path"], "left_semi").select(
        "repo", F.col("path").alias("root"), F.col("test_path").alias("node"), F.lit(0).alias("depth"), F.lit("test").alias("relation")
    )
    return up.unionByName(down).unionByName(test).select("repo", "root", "relation", "node", "depth")
