"""Dependencies, scripts and the stack that manifests tell of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.paths import basename
from strataloom.functions.rules import DATABASES, FRAMEWORKS, MANIFESTS

MOST = 200


def dependencies(name: Column, content: Column) -> Column:
    """Dependency names in a manifest of the given base name, in the order of the file; a malformed one has none.

    The pattern of the two TOML manifests takes any key at the start of a line, `name` and `version` too.
    """
    every = lambda pattern: F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    keys = lambda field: F.coalesce(F.map_keys(F.from_json(F.get_json_object(content, f"$.{field}"), "map<string,string>")), F.array().cast("array<string>"))
    listed = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(F.split(x, r"[=<>~!\[\s]")[0])), lambda x: (x != "") & ~x.startswith("#"))
    found = (
        F.when(name == "package.json", F.concat(keys("dependencies"), keys("devDependencies")))
        .when(name == "composer.json", keys("require"))
        .when(name == "requirements.txt", listed)
        .when(name == "go.mod", every(r"(?m)^\s+([\w./-]+)\s+v"))
        .when(name == "pom.xml", every(r"<artifactId>([^<]+)</artifactId>"))
        .when(name.isin("Cargo.toml", "pyproject.toml"), every(r"(?m)^([a-zA-Z0-9_-]+)\s*="))
        .when(name == "Gemfile", every(r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"]"))
    )
    return F.slice(F.array_distinct(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda d: d != "")), 1, MOST)


def manifests(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys with found, dependencies (distinct, the first MOST by path and place), scripts, name, description."""
    name = basename(F.col("file_path"))
    rows = files.filter(name.isin(MANIFESTS) & (F.coalesce("content", F.lit("")) != "")).withColumn("manifest", name).withColumn("deps", dependencies(name, F.col("content")))
    package = lambda field: F.when(F.col("manifest") == "package.json", F.get_json_object("content", f"$.{field}"))
    rows = rows.withColumns({"scripts": F.coalesce(F.from_json(package("scripts"), "map<string,string>"), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")), "name": package("name"), "description": package("description")})
    # a repository has a few manifests, each with MOST dependencies at most
    order = F.sort_array(F.collect_list(F.struct("file_path", "manifest", "deps", "scripts_list", "name", "description")))
    folded = rows.withColumn("scripts_list", F.map_entries("scripts")).groupBy(*keys).agg(order.alias("m"))
    field = lambda f: F.transform("m", lambda x: x[f])
    first = lambda f: F.coalesce(F.get(F.filter(field(f), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), F.lit(""))
    scripts = F.flatten(field("scripts_list"))
    names = F.transform(scripts, lambda e: e["key"])
    last = F.filter(scripts, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    return folded.select(*keys, F.array_distinct(field("manifest")).alias("found"), F.slice(F.array_distinct(F.flatten(field("deps"))), 1, MOST).alias("dependencies"), F.map_from_entries(last).alias("scripts"), first("name").alias("name"), first("description").alias("description"))


def _signs(deps: Column, signs: tuple) -> Column:
    shows = lambda pattern: F.exists(deps, lambda d: d.rlike(pattern))
    hits = [F.when(shows(pattern), F.lit(name)) for pattern, name in signs]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def detect_stack(deps: Column) -> Column:
    """struct<frameworks, databases> by signs among dependency names, each once, in the order of the tables."""
    return F.struct(_signs(deps, FRAMEWORKS).alias("frameworks"), _signs(deps, DATABASES).alias("databases"))
