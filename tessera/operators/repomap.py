"""Repository maps: symbols by line patterns, the file graph, and ranked definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import approx_tokens

# Per language the prefixes of comment lines.
COMMENTS = {
    "scala": ["//", "*", "/*"], "kotlin": ["//", "*", "/*"], "swift": ["//", "*", "/*"], "haskell": ["--", "{-"], "lua": ["--"],
    "dart": ["//", "*", "/*"], "zig": ["//"], "elixir": ["#"], "perl": ["#"], "r": ["#"],
}
# Per language the line patterns in order, as (pattern, kind, type); the first that matches a line counts.
RULES = {
    "scala": [(r"(?:abstract\s+|sealed\s+|case\s+|final\s+)*class\s+(\w+)", "def", "class"), (r"(?:case\s+)?object\s+(\w+)", "def", "class"), (r"trait\s+(\w+)", "def", "interface"), (r"def\s+(\w+)", "def", "function"), (r"type\s+(\w+)", "def", "type"), (r"import\s+[\w.]+\.(\w+)", "ref", "import")],
    "kotlin": [(r"(?:data\s+|sealed\s+|abstract\s+|open\s+|inner\s+|enum\s+)*class\s+(\w+)", "def", "class"), (r"(?:companion\s+)?object\s+(\w+)", "def", "class"), (r"interface\s+(\w+)", "def", "interface"), (r"fun\s+(?:<[^>]+>\s+)?(\w+)", "def", "function"), (r"typealias\s+(\w+)", "def", "type"), (r"import\s+[\w.]+\.(\w+)", "ref", "import")],
    "swift": [(r"(?:public\s+|private\s+|internal\s+|open\s+|final\s+)*class\s+(\w+)", "def", "class"), (r"(?:public\s+|private\s+|internal\s+)*struct\s+(\w+)", "def", "class"), (r"(?:public\s+|private\s+|internal\s+)*enum\s+(\w+)", "def", "enum"), (r"(?:public\s+|private\s+|internal\s+)*protocol\s+(\w+)", "def", "interface"), (r"(?:public\s+|private\s+|internal\s+|open\s+|override\s+|static\s+|class\s+)*func\s+(\w+)", "def", "function"), (r"typealias\s+(\w+)", "def", "type"), (r"(?:public\s+|private\s+|internal\s+)*extension\s+(\w+)", "def", "class"), (r"import\s+(\w+)", "ref", "import")],
    "haskell": [(r"^data\s+(\w+)", "def", "type"), (r"^newtype\s+(\w+)", "def", "type"), (r"^type\s+(\w+)", "def", "type"), (r"^class\s+(?:\([^)]*\)\s*=>\s*)?(\w+)", "def", "class"), (r"^(\w+)\s+::", "def", "function"), (r"^import\s+(?:qualified\s+)?([A-Z][\w.]*)", "ref", "import")],
    "lua": [(r"(?:local\s+)?function\s+(\w[\w.]*)", "def", "function"), (r"(\w+)\s*=\s*function\s*\(", "def", "function"), (r"""(?:local\s+)?(\w+)\s*=\s*require\s*[("']""", "ref", "import")],
    "dart": [(r"(?:abstract\s+|base\s+|sealed\s+|final\s+)*class\s+(\w+)", "def", "class"), (r"mixin\s+(\w+)", "def", "class"), (r"enum\s+(\w+)", "def", "enum"), (r"extension\s+(\w+)\s+on\b", "def", "class"), (r"typedef\s+(\w+)", "def", "type"), (r"(?:\w+\s+)?(\w+)\s*\([^)]*\)\s*(?:async\s*)?\{", "def", "function"), (r"import\s+'[^']*/(\w+)\.dart'", "ref", "import")],
    "zig": [(r"(?:pub\s+)?fn\s+(\w+)", "def", "function"), (r"(?:pub\s+)?const\s+(\w+)\s*=\s*struct\b", "def", "class"), (r"(?:pub\s+)?const\s+(\w+)\s*=\s*enum\b", "def", "enum"), (r"(?:pub\s+)?const\s+(\w+)\s*=\s*union\b", "def", "class"), (r"(?:pub\s+)?const\s+(\w+)\s*=\s*@import\b", "ref", "import")],
    "elixir": [(r"defmodule\s+([\w.]+)", "def", "class"), (r"defprotocol\s+([\w.]+)", "def", "interface"), (r"def\s+(\w+[?!]?)", "def", "function"), (r"defp\s+(\w+[?!]?)", "def", "function"), (r"defmacro\s+(\w+[?!]?)", "def", "function"), (r"alias\s+([\w.]+)", "ref", "import"), (r"import\s+([\w.]+)", "ref", "import")],
    "perl": [(r"sub\s+(\w+)", "def", "function"), (r"package\s+([\w:]+)", "def", "class"), (r"use\s+([\w:]+)", "ref", "import")],
    "r": [(r"(\w+)\s*<-\s*function\s*\(", "def", "function"), (r"(\w+)\s*=\s*function\s*\(", "def", "function"), (r"""(?:library|require)\s*\(\s*["']?(\w+)""", "ref", "import")],
    "snippet": [(r"^\s*def\s+(\w+)", "def", "function"), (r"^\s*(?:const|let|var)\s+(\w+)", "def", "variable"), (r"^\s*class\s+(\w+)", "def", "class")],
}
# Extensions of the languages, and the order of symbol types.
LANGUAGES = {"scala": "scala", "kt": "kotlin", "swift": "swift", "hs": "haskell", "lua": "lua", "dart": "dart", "zig": "zig", "ex": "elixir", "exs": "elixir", "pl": "perl", "pm": "perl", "r": "r"}
TYPE_ORDER = ["class", "interface", "type", "enum", "function", "variable", "method", "export", "import", "identifier"]
_CALL = r"([A-Za-z_]\w{2,})\s*\("


def language_of(path: Column) -> Column:
    m = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, F.lower(F.element_at(F.split(path, r"\."), -1)))


def _glob(pattern: str) -> str:
    folder = pattern.endswith("/")
    parts = [".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", pattern.strip("/")) if p]
    return "".join(parts) + ("/" if folder else "(/|$)")


def scan_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """The source files under `root` by extension, without hidden and dependency folders and what the patterns of
    `ignore` (shell wildcards over the path below the root, `**` across folders, a trailing / for folders) name: file,
    language, mtime, source. Only names are listed before files are opened.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = f.withColumn("language", language_of(F.col("path"))).filter(F.col("language").isNotNull() & ~F.col("path").rlike(r"/(\.[^/]+|node_modules|dist|build|vendor)/"))
    for pattern in ignore or []:
        f = f.filter(~F.col("path").rlike("/" + _glob(pattern)))
    return f.select(F.col("path").alias("file"), "language", F.col("modificationTime").alias("mtime"), F.decode("content", "utf-8").alias("source"))


def tags(files: DataFrame, calls: bool = False) -> DataFrame:
    """file, name, kind, type, line of `file, language, source`: per line the first rule that matches, each (kind, name,
    type) once per file at its first line. With `calls`, called names are references too. Comment lines have none."""
    lines = files.select("file", "language", F.posexplode(F.split("source", "\n")).alias("line", "text"))
    for lang, prefixes in COMMENTS.items():
        lines = lines.filter(~((F.col("language") == lang) & F.trim("text").rlike("^(" + "|".join("\\Q" + p + "\\E" for p in prefixes) + ")")))
    found = F
    for lang, rules in RULES.items():
        for pattern, kind, type_ in rules:
            found = found.when((F.col("language") == lang) & F.col("text").rlike(pattern), F.struct(F.regexp_extract("text", pattern, 1).alias("name"), F.lit(kind).alias("kind"), F.lit(type_).alias("type")))
    t = lines.withColumn("t", found.otherwise(F.lit(None))).filter("t is not null").select("file", "t.*", "line")
    if calls:
        c = lines.select("file", "line", F.explode(F.regexp_extract_all("text", F.lit(_CALL), 1)).alias("name")).select("file", "name", F.lit("ref").alias("kind"), F.lit("identifier").alias("type"), "line")
        t = t.unionByName(c)
    return t.filter("name <> ''").groupBy("file", "name", "kind", "type").agg((F.min("line") + 1).alias("line"))


def file_edges(t: DataFrame) -> DataFrame:
    """src (refers), dst (defines), weight: the sum over shared names of max(1, log2(length)), between different files."""
    defs = t.filter("kind = 'def'").select("name", F.col("file").alias("dst")).distinct()
    refs = t.filter("kind = 'ref'").select("name", F.col("file").alias("src")).distinct()
    j = refs.join(defs, "name").filter("src <> dst")
    return j.groupBy("src", "dst").agg(F.sum(F.greatest(F.lit(1.0), F.log2(F.length("name")))).alias("weight"))


def file_ranks(t: DataFrame) -> DataFrame:
    """file and score: the weight that comes in plus a tenth per definition."""
    inward = file_edges(t).groupBy(F.col("dst").alias("file")).agg(F.sum("weight").alias("w"))
    defs = t.groupBy("file").agg(F.count(F.when(F.col("kind") == "def", 1)).alias("n_defs"))
    return defs.join(inward, "file", "left").select("file", "n_defs", (F.coalesce("w", F.lit(0.0)) + 0.1 * F.col("n_defs")).alias("score"))


def ranked_definitions(t: DataFrame) -> DataFrame:
    """Definitions by file score, type and line, with their running token cost within the file."""
    order = F.create_map(*[x for i, n in enumerate(TYPE_ORDER) for x in (F.lit(n), F.lit(i))])
    d = t.filter("kind = 'def'").join(file_ranks(t).select("file", F.round("score", 9).alias("score")), "file")
    w = Window.partitionBy("file").orderBy(order[F.col("type")], "line", "name")
    return d.withColumn("place", F.row_number().over(w)).withColumn("tokens", approx_tokens(F.concat_ws(" ", "type", "name")))
