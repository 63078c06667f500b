"""Project graphs as edge tables: files, libraries, logical aliases, requirements and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar, text


def _folders(path: Column) -> Column:
    """All folders above a relative path, the project's root ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _logical(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.v$", ""), F.lit("/"), F.lit("."))


def add_files(files: DataFrame) -> DataFrame:
    """(project, src, dst, type): a ``ParentToChild`` edge from each folder to what lies in it.

    ``files`` has (project, path) with relative paths; folders above a file are added. Null paths are left out.
    """
    every = F.concat(_folders(F.col("path")), F.array("path"))
    step = F.arrays_zip(F.slice(every, F.lit(1), F.size(every) - 1).alias("src"), F.slice(every, F.lit(2), F.size(every) - 1).alias("dst"))
    steps = files.filter("path <> ''").select("project", F.explode(step).alias("s"))
    return steps.select("project", "s.src", "s.dst", F.lit("ParentToChild").alias("type")).distinct()


def libraries(files: DataFrame) -> DataFrame:
    """(project, path, library): folders and ``.v`` files of ``files`` (project, path) with their logical names."""
    files = files.filter("path <> ''")
    every = files.select("project", F.explode(_folders(F.col("path"))).alias("path")).filter("path <> ''")
    every = every.union(files.filter(F.col("path").endswith(".v")).select("project", "path"))
    return every.distinct().withColumn("library", _logical(F.col("path")))


def add_aliases(found: DataFrame, load_paths: DataFrame) -> DataFrame:
    """(project, alias, library): names that load paths (project, folder, name) give to the libraries below them.

    A folder is '.' or '' for the whole project, or a file; it covers itself, then under the name alone. Paths
    meet on equal folders, so no path is compared with every load path.
    """
    folder = F.when(F.col("folder") == ".", "").otherwise(F.regexp_replace(F.regexp_replace("folder", r"^(\./)+", ""), "/+$", ""))
    paths = load_paths.select("project", folder.alias("folder"), "name").distinct()
    under = found.select("project", "path", "library", F.explode(F.concat(_folders(F.col("path")), F.array("path"))).alias("folder"))
    rest = _logical(F.ltrim(F.substring("path", F.length("folder") + 1, F.length("path")), F.lit("/")))
    alias = F.when(F.col("path") == F.col("folder"), F.col("name")).otherwise(F.concat_ws(".", "name", rest))
    return under.join(paths, ["project", "folder"]).select("project", alias.alias("alias"), "library").distinct()


def add_requirements(sentences: DataFrame) -> DataFrame:
    """(project, library, requirement): what the sentences (project, library, text) of a library require."""
    named = F.explode(grammar.requirements(F.col("text")))
    return sentences.select("project", "library", named.alias("requirement")).distinct()


def add_dependencies(required: DataFrame, found: DataFrame, aliases: DataFrame) -> DataFrame:
    """(project, src, dst, type): from each dependency to the libraries that require it and to those it may be.

    ``DependencyToRequirement`` leads to a requiring library. ``DependencyToLibrary`` leads to ``project:library``
    of any project whose library, or an alias of it, has the dependency's name or a short form of it.
    """
    names = found.select("project", F.col("library").alias("known"), "library").union(aliases.select("project", "alias", "library"))
    names = names.select("known", F.concat_ws(":", "project", "library").alias("dst")).distinct()
    one = required.select("project", F.col("requirement").alias("src")).distinct()
    forms = F.array_union(F.array("src"), text.logical_short_names(F.col("src")))
    matched = one.withColumn("known", F.explode(forms)).join(names, "known").select("project", "src", "dst", F.lit("DependencyToLibrary").alias("type"))
    asked = required.select("project", F.col("requirement").alias("src"), F.col("library").alias("dst"), F.lit("DependencyToRequirement").alias("type"))
    return asked.union(matched).distinct()
