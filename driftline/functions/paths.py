"""Path rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCLUDED_DIRS = tuple("__pycache__ build dist .driftline node_modules target third_party vendor venv .venv .yarn".split())
LOCK_FILES = tuple("Cargo.lock Gemfile.lock composer.lock go.sum package-lock.json pnpm-lock.yaml poetry.lock uv.lock yarn.lock".split())
EXCLUDED_SUFFIXES = (".lock", ".map", ".min.css", ".min.js", ".snap")
LANGS = {
    ext: lang
    for lang, exts in {
        "ts": "ts mts cts", "tsx": "tsx", "js": "js mjs cjs jsx", "py": "py pyi", "rust": "rs", "go": "go",
        "rb": "rb rake gemspec", "coffee": "coffee cjsx", "md": "md markdown mdx",
    }.items()
    for ext in exts.split()
}
CONTAINERS = tuple("apps crates libs modules packages services".split())


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    """What precedes the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_stem(path: Column) -> Column:
    """The name up to its first dot."""
    return F.substring_index(base_name(path), ".", 1)


def join_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def extension(path: Column) -> Column:
    name = base_name(path)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def lang_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGS.items() for x in kv])
    return table[extension(path)]


def is_doc(path: Column) -> Column:
    return F.coalesce(lang_of(path) == "md", F.lit(False))


def normalize_path(path: Column) -> Column:
    """Drops empty and `.` parts; `..` drops the part before it, never more than there is."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(kept, "/")


def is_excluded_path(path: Column) -> Column:
    """Vendored and built directories, lock files, and minified or generated files."""
    dirs = "|".join(d.replace(".", r"\.") for d in EXCLUDED_DIRS)
    ends = "|".join(s.replace(".", r"\.") for s in EXCLUDED_SUFFIXES)
    return path.rlike(f"(^|/)({dirs})/") | base_name(path).isin(*LOCK_FILES) | path.rlike(f"({ends})$")


def group_label(path: Column) -> Column:
    """First directory, two below a container directory if there is more below, `(root)` for a file at the root."""
    parts = F.split(path, "/")
    two = parts[0].isin(*CONTAINERS) & (F.size(parts) > 2)
    return F.when(F.size(parts) < 2, F.lit("(root)")).when(two, F.concat(parts[0], F.lit("/"), parts[1])).otherwise(parts[0])
