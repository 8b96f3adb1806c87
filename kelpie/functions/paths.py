"""Path functions: what is indexed, a file's category and language, its module."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is indexed, by category and language.
EXTENSIONS = {
    ("source-code", "csharp"): ".cs .cshtml .razor .xaml",
    ("source-code", "java"): ".java .jsp .ftl",
    ("source-code", "kotlin"): ".kt .kts",
    ("source-code", "swift"): ".swift",
    ("source-code", "javascript"): ".js .jsx .cjs .vue .svelte .ejs .njk .hbs .mustache",
    ("source-code", "typescript"): ".ts .tsx",
    ("source-code", "dart"): ".dart",
    ("source-code", "python"): ".py",
    ("source-code", "go"): ".go",
    ("source-code", "rust"): ".rs",
    ("source-code", "c"): ".h .c",
    ("source-code", "cpp"): ".cpp .cc",
    ("source-code", "css"): ".css",
    ("source-code", "ruby"): ".erb",
    ("source-code", "php"): ".twig",
    ("database", None): ".sql",
    ("documentation", None): ".html .md .txt",
    ("configuration", None): ".yaml .yml .xml .config .properties .proto .graphql",
    ("data", None): ".json",
    ("devops", "shell"): ".sh",
    ("devops", "powershell"): ".ps1",
    ("devops", "batch"): ".bat",
}
FILENAMES = ("Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".gitignore", ".dockerignore", "Makefile")
EXCLUDED_DIRS = ("bin", "obj", "node_modules", ".git", "packages", "__pycache__", ".venv", "venv", "dist", "build", "TestResults", ".vs", ".idea", ".kelpie-cache", "target", ".gradle")
EXCLUDED_ENDINGS = (".Designer.cs", ".g.cs", ".g.i.cs", ".AssemblyInfo.cs", "GlobalUsings.g.cs", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".min.js", ".min.css", ".map", ".nupkg.metadata")
HASHED_NAME = r"(?:^|\.)[a-f0-9]{6,20}(?:\.|$)"
CATEGORIES = ("source-code", "documentation", "database", "configuration", "data", "devops")

BY_EXTENSION = {x: k for k, xs in EXTENSIONS.items() for x in xs.split()}


def env_set(name: str) -> set[str]:
    """Comma-separated values of an environment variable."""
    return {x.strip() for x in os.environ.get(name, "").split(",")} - {""}


def indexable_extensions() -> set[str]:
    return (set(BY_EXTENSION) | env_set("INDEX_EXTRA_EXTENSIONS")) - env_set("INDEX_REMOVE_EXTENSIONS")


def excluded_dirs() -> set[str]:
    return set(EXCLUDED_DIRS) | env_set("INDEX_EXTRA_EXCLUDE_DIRS")


def excluded_endings() -> set[str]:
    return set(EXCLUDED_ENDINGS) | env_set("INDEX_EXTRA_EXCLUDE_FILES")


def _c(path: Column | str) -> Column:
    return F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit(""))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """The lower-cased last suffix with its point; names that only begin with a point have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def is_excluded(path: Column | str) -> Column:
    """Not to be indexed: by directory, by ending, by a hash in the name, or for want of a known extension."""
    name = file_name(path)
    stem = F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
    strings = lambda xs: F.array(*map(F.lit, sorted(xs)))
    by_dir = F.arrays_overlap(F.split(_c(path), "/"), strings(excluded_dirs()))
    by_end = _any([name.endswith(x) for x in sorted(excluded_endings())])
    known = extension(path).isin(*sorted(indexable_extensions())) | name.isin(*FILENAMES)
    return by_dir | by_end | stem.rlike(HASHED_NAME) | ~known


def _lookup(path: Column | str, at: int, default: str | None) -> Column:
    pairs = [F.lit(x) for k, v in BY_EXTENSION.items() for x in (k, v[at])]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit(default))


def category(path: Column | str) -> Column:
    return _lookup(path, 0, "other")


def language(path: Column | str) -> Column:
    return _lookup(path, 1, None)


def module_key(path: Column | str) -> Column:
    """The module a path lies in, by the first rule that fits; the empty path's is ``unknown``."""
    p = _c(path)
    parts = F.split(p, "/", -1)
    at = lambda i: F.get(parts, i)
    places = F.sequence(F.lit(0), F.size(parts) - 1)
    first = lambda cond: F.get(F.filter(places, cond), 0)
    has_next = lambda i: i + 1 < F.size(parts)
    modules = first(lambda i: (at(i) == "modules") & has_next(i))
    source = first(lambda i: (at(i) == "src") & at(i + 1).isin("main", "test") & (i >= 1))
    top = first(lambda i: at(i).isin("services", "apps", "packages", "libs", "service") & has_next(i))
    dotted = F.get(F.filter(parts, lambda x: F.contains(x, F.lit(".")) & x.rlike(r"^\p{Lu}") & ~x.rlike(r"\.(cs|py|js|ts)$")), 0)
    return (
        F.when(p == "", "unknown")
        .when(modules.isNotNull(), F.concat(F.lit("modules/"), at(modules + 1)))
        .when(source.isNotNull(), F.concat_ws("/", at(source - 1), at(source)))
        .when(top.isNotNull(), F.concat_ws("/", at(top), at(top + 1)))
        .when(dotted.isNotNull(), dotted)
        .otherwise(F.array_join(F.slice(parts, 1, 3), "/"))
    )
