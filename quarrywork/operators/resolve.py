"""Import resolution: every statement becomes candidates with ranks, which meet the paths in one equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

# The extensions and index files that a module path stands for, in order.
PROBE = ("ts", "tsx", "d.ts", "js", "jsx", "mjs", "cjs", "mts", "cts", "json")
INDEX = ("ts", "tsx", "d.ts", "js", "jsx", "mjs", "cjs")
SOURCES = {"js": ("ts", "tsx"), "jsx": ("tsx",), "mjs": ("mts",), "cjs": ("cts",)}


def candidates(path: Column) -> Column:
    """The paths that a module path may mean, best first."""
    extension = P.extension_of(path)
    stem = F.substring(path, F.lit(1), F.length(path) - F.length(extension))
    mapped = [F.when(extension == js, F.concat(stem, F.lit(ts))) for js, sources in SOURCES.items() for ts in sources]
    named = [path, *mapped, *[F.concat(path, F.lit("." + e)) for e in PROBE]]
    own = F.when(path != "", F.array(*named)).otherwise(F.array().cast("array<string>"))
    prefix = F.when(path == "", "").otherwise(F.concat(path, F.lit("/")))
    return F.concat(own, F.array(*[F.concat(prefix, F.lit(f"index.{e}")) for e in INDEX]))


def resolve_relative_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds target, the first candidate that exists, to imports (repo_id, path, seq, specifier) with relative or root-relative specifiers; null where none does."""
    s = F.col("specifier")
    module = F.when(s.startswith("/"), P.join_path(F.lit(""), s)).when(s.startswith("."), P.join_path(P.parent_path(F.col("path")), s))
    asked = imports.withColumn("_module", module)
    tried = asked.filter("_module IS NOT NULL").select("repo_id", "path", "seq", F.posexplode(candidates(F.col("_module"))).alias("rank", "candidate")).filter("candidate IS NOT NULL")
    hits = tried.join(paths.select("repo_id", F.col("path").alias("candidate")), ["repo_id", "candidate"])
    first = hits.groupBy("repo_id", "path", "seq").agg(F.min_by("candidate", "rank").alias("target"))
    return asked.drop("_module").join(first, ["repo_id", "path", "seq"], "left")


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds config, the path of the configuration in the nearest directory above each file. configs: repo_id, path, one of each directory."""
    up = files.select("repo_id", "path", F.explode(P.ancestors(F.col("path"))).alias("directory"))
    found = up.join(configs.select("repo_id", P.parent_path(F.col("path")).alias("directory"), F.col("path").alias("config")), ["repo_id", "directory"])
    best = found.groupBy("repo_id", "path").agg(F.max_by("config", F.struct(F.length("directory"), "config")).alias("config"))
    return files.join(best, ["repo_id", "path"], "left")


#: language: (pattern, kind, group of the specifier, group of the names or 0). Every match is a statement; a statement begins a line or follows a semicolon,
#: which is never part of the one before.
STATEMENTS = {
    "python": ((r"(?:^|;)\s*from\s+([.\w]+)\s+import\b([^;#]*)", "import", 1, 2), (r"(?:^|;)\s*import\s+([.\w]+(?:\s+as\s+\w+)?(?:\s*,\s*[.\w]+(?:\s+as\s+\w+)?)*)", "import", 1, 0)),
    "javascript": ((r"(?:^|;)\s*import\b\s*(?:([^'\";()]*?)\bfrom\s*)?['\"]([^'\"]+)['\"]", "import", 2, 1), (r"(?:^|;)\s*export\b([^'\";]*?)\bfrom\s*['\"]([^'\"]+)['\"]", "re-export", 2, 1), (r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)", "require", 1, 0), (r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)", "dynamic-import", 1, 0)),
    "go": ((r"(?:^|;)\s*import\s+(?:[\w.]+\s+)?(\"[^\"]+\")", "import", 1, 0), (r"(?:^|;)\s*import\s*\(([^()]*)\)", "import", 1, 0)),
    "java": ((r"(?:^|;)\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*(?=;)", "import", 1, 1),),
    "rust": ((r"(?:^|;)\s*(?:pub\s+)?use\s+([^;]+)(?=;)", "use", 1, 1), (r"(?:^|;)\s*(?:pub\s+)?mod\s+(\w+)\s*(?=;)", "mod", 1, 0)),
}


def _listed(text: Column) -> Column:
    """The names of a list with commas, without their aliases."""
    bare = F.transform(F.split(F.regexp_replace(text, r"[(){}]", " "), ","), lambda t: F.regexp_replace(F.trim(t), r"^type\s+(?!as\b)|\s+as\s.*$", ""))
    return F.filter(bare, lambda t: t != "")


def _names(language: str, text: Column) -> Column:
    """The names that a statement brings in: as exported there, "default" for a default import, "*" for all."""
    if language == "python":
        return _listed(text)
    if language == "javascript":
        clause = F.regexp_replace(F.trim(text), r"^type\s+(?=[\w$*{])", "")
        outside = _listed(F.regexp_replace(clause, r"\{[^}]*\}", " "))
        return F.concat(F.transform(outside, lambda t: F.when(t.startswith("*"), "*").otherwise("default")), _listed(F.regexp_extract(clause, r"\{([^}]*)\}", 1)))
    last = F.regexp_extract(F.regexp_replace(text, r"\s+as\s.*$", ""), r"(\w+|\*)\s*$", 1)
    return F.when(last != "", F.array(last)).otherwise(F.array().cast("array<string>"))


def _hits(language: str, pattern: str, kind: str, specifier: int, names: int) -> Column:
    """(kind, specifier, names) of every match in code."""
    found = F.regexp_extract_all("code", F.lit(pattern), specifier)
    one = lambda s, n: F.struct(F.lit(kind).alias("kind"), F.trim(s).alias("specifier"), n.alias("names"))
    if names:
        return F.zip_with(found, F.regexp_extract_all("code", F.lit(pattern), names), lambda s, n: one(s, _names(language, n)))
    if language == "python":
        found = F.flatten(F.transform(found, _listed))
    if language == "go":
        found = F.flatten(F.transform(found, lambda s: F.regexp_extract_all(s, F.lit(r"[\"`]([^\"`]+)[\"`]"), 1)))
    return F.transform(found, lambda s: one(s, F.array().cast("array<string>")))


def extract_import_refs(texts: DataFrame) -> DataFrame:
    """repo_id, path, line, kind, specifier, names of every import statement on one line. texts: repo_id, path, language, text. Statements over several lines are out of scope."""
    lines = texts.select("repo_id", "path", F.when(F.col("language").isin("typescript", "tsx"), "javascript").otherwise(F.col("language")).alias("language"), F.posexplode(F.split("text", "\r?\n")).alias("line", "code"))
    hits = F.coalesce(*[F.when(F.col("language") == lang, F.concat(*[_hits(lang, *p) for p in ps])) for lang, ps in STATEMENTS.items()])
    found = lines.filter(F.col("code").rlike("import|export|require|use|mod")).select("repo_id", "path", (F.col("line") + 1).alias("line"), F.explode(hits).alias("hit"))
    return found.select("repo_id", "path", "line", "hit.kind", "hit.specifier", "hit.names")
