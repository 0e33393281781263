"""Column functions over repository paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions import rules as R


def _table(mapping: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; '.' without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extname(path: Column) -> Column:
    """From the last dot of the base name on; none for a name that begins with its only dot."""
    return F.regexp_extract(basename(path), r"[^.].*?(\.[^.]*)$", 1)


def normalize(path: Column) -> Column:
    """'.' and '..' segments resolved; '..' above the top stays."""
    def step(done: Column, part: Column) -> Column:
        pops = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(pops, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def detect_language(path: Column) -> Column:
    name = F.lower(basename(path))
    return F.coalesce(_table(R.NAME_LANGUAGE, name), _table(R.EXT_LANGUAGE, extname(name)), F.lit("text"))


def is_js_family(path: Column) -> Column:
    return detect_language(path).isin("javascript", "typescript")


def is_test_path(path: Column) -> Column:
    return reduce(Column.__or__, [path.rlike(p) for p in R.TEST_PATHS])


def exclusion(path: Column, size: Column, max_file_size: int = R.MAX_FILE_SIZE) -> Column:
    """Why a tree entry isn't read, or null: the first rule that applies, in this order."""
    base, low = basename(path), F.lower(path)
    folders = F.slice(F.split(path, "/"), F.lit(1), depth(path) - 1)
    bad = F.element_at(F.filter(folders, lambda s: s.isin(R.IGNORED_DIRS) | (s.startswith(".") & (s != ".github"))), 1)
    bad = F.when(F.size(F.filter(folders, lambda s: s.isin(R.IGNORED_DIRS) | (s.startswith(".") & (s != ".github")))) > 0, bad)
    ext = extname(low)
    return (
        F.when(bad.isNotNull(), F.concat(F.lit("ignored-dir:"), bad))
        .when(base.isin(R.LOCK_FILES), "lock-file")
        .when(low.rlike(r"\.min\.(js|css)$|\.d\.ts$|\.(map|snap)$"), "generated")
        .when(ext.isin(R.IGNORED_EXTS), F.concat(F.lit("binary:"), ext))
        .when(base.startswith(".") & ~base.isin(*R.DOTFILES), "dotfile")
        .when(size > max_file_size, "too-large")
        .when(size == 0, "empty")
        .when((detect_language(path) == "text") & ~low.rlike(r"\.(txt|md)$"), "unknown-language")
    )


def priority(path: Column, size: Column) -> Column:
    """How much a file explains of its repository: a sum of rules, less for depth and size."""
    add = lambda test, points: F.when(test, points).otherwise(0)
    lang = detect_language(path)
    kind = F.when(lang.isin(R.SOURCE_LANGUAGES), 70).when(lang.isin(R.MARKUP_LANGUAGES), 40).when(lang == "markdown", 6).when(lang.isin(R.CONFIG_LANGUAGES), 3).otherwise(0)
    return (
        add(basename(path).isin(R.MANIFEST_NAMES), 55) + add(path.rlike(R.ENTRY_NAMES), 45) + add(path.rlike(R.VALUABLE_DIRS), 35) + kind
        - add(is_test_path(path), 12) - add(path.rlike(R.SIDE_DIRS), 30) - add(basename(path).rlike(R.SIDE_NAMES), 25)
        - F.least(F.lit(20), depth(path) * 2) - F.coalesce(add(size > 60000, 15), F.lit(0))
    )


def looks_binary(content: Column) -> Column:
    """NUL, or more than 2 % control characters, among the first 4000; null counts as binary."""
    head = F.substring(content, 1, 4000)
    share = F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1F]")) / F.greatest(F.length(head), F.lit(1))
    return F.coalesce(head.contains("\0") | (share > 0.02), F.lit(True))


def top_directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("(root)")


def module_of(path: Column) -> Column:
    """The first two folders of a path, or as many as there are."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, "(root)").otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/"))


def prefixes(path: Column) -> Column:
    """All prefixes of a path by segment, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def unsafe_path(path: Column) -> Column:
    """Why a repository-relative path is refused, or null."""
    value = safe_path(path)
    parts = F.split(value, "/")
    return (
        F.when(path.isNull() | (value == ""), "missing")
        .when(value.contains("\0"), "nul")
        .when(value.startswith("/") | value.rlike("^[A-Za-z]:"), "absolute")
        .when(value.contains("\\"), "backslash")
        .when(F.exists(parts, lambda p: p.isin("..", ".", "")), "segment")
        .when(F.get(parts, F.lit(0)) == ".git", "internals")
        .when(F.length(value) > 400, "too-long")
    )


def safe_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"^\./", "")


def import_candidates(from_file: Column, raw: Column) -> Column:
    """Paths that an import may mean, the most likely first; empty for a third-party module."""
    bare = F.substring(raw, F.lit(3), F.length(raw))
    lone = lambda *c: F.array(*c)
    roots = (
        F.when(raw.startswith("."), lone(normalize(F.concat_ws("/", dirname(from_file), raw))))
        .when(raw.startswith("/"), lone(F.regexp_replace(raw, "^/+", "")))
        .when(raw.startswith("@/") | raw.startswith("~/"), lone(F.concat(F.lit("src/"), bare), bare, F.concat(F.lit("app/"), bare), F.concat(F.lit("lib/"), bare)))
        .when(raw.rlike("(?i)^[a-z0-9-]+/"), lone(raw, F.concat(F.lit("src/"), raw)))
        .otherwise(F.array().cast("array<string>"))
    )

    def spellings(root: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(root, r"^\./", ""), "/+$", "")
        stem = F.regexp_replace(clean, r"\.(js|jsx|mjs|cjs)$", "")
        ends = [F.concat(clean, F.lit(e)) for e in R.IMPORT_EXTS] + [F.concat(stem, F.lit(e)) for e in R.IMPORT_EXTS] + [F.concat(clean, F.lit(f"/index{e}")) for e in R.IMPORT_EXTS]
        return F.array(clean, *ends)

    return F.coalesce(F.array_distinct(F.flatten(F.transform(roots, spellings))), F.array().cast("array<string>"))
