"""Source files: which to read, and what their text says."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.naming import kebab_to_pascal

# Files that are scanned and folders, suffixes and names that aren't.
CODE = r"\.(astro|js|jsx|svelte|ts|tsx|vue)$"
IGNORED_FOLDERS = ".changeset .git .github .idea .next .nuxt .vscode build coverage demo demos dist example examples node_modules out storybook-static".split()
IGNORED_SUFFIXES = r"\.(stories|story)\.(ts|tsx|js|jsx)$|\.(spec|test)\.(ts|tsx)$"
NOISE_NAMES = "package.json package-lock.json npm-shrinkwrap.json nx.json project.json turbo.json lerna.json jsconfig.json".split()
NOISE = r"^tsconfig(\..+)?\.json$|^\.?eslintrc(\..+)?\.json$|^\.?prettierrc(\..+)?\.json$|^(?i:readme|changelog|contributing|code_of_conduct|license|security)(\..+)?\.(?i:md)$"
# Names and markers of files that say what goes into what.
NAME_PATTERNS = ("mapping", "meta", "registry", "schema", "composition")
MARKERS = ("requiredParent", "withParentType", "allowedTagNames", "createContext", "MappingContext", "allowedComponents")
EXTENSIONS = (".astro", ".js", ".jsx", ".svelte", ".ts", ".tsx", ".vue")
# How imports, exports and slots are written.
IMPORT = r"import\s+(?:type\s+)?(.+?)\s+from\s+['\"]([^'\"]+)['\"]"
EXPORT_NAMED = r"export\s+(?:const|function|class|type|interface|enum)\s+([A-Za-z0-9_]+)"
EXPORT_DEFAULT = r"export\s+default\s+([A-Za-z0-9_]+)"
EXPORT_LIST = r"export\s*\{([^}]+)\}"
TAG_SLOT = r"<slot(?:\s+name=[\"']([^\"']+)[\"'])?\s*/?>"
RENDERED_SLOT = r"Astro\.slots\.render\(\s*['\"]([^'\"]+)['\"]\s*\)"
ELEMENT_SLOT = r"<slot\b([^>]*)>"
DOC_SLOT = r"@slot[ \t]+([^\n@]*)"


def scanned(path: Column) -> Column:
    """Whether a path is a source file to scan."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    code = name.rlike(CODE) & ~name.endswith(".d.ts")
    doc = name.rlike(r"\.(json|md)$") & ~name.isin(NOISE_NAMES) & ~name.rlike(NOISE)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return (code | doc) & ~name.rlike(IGNORED_SUFFIXES) & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS)))


def is_scanned(name: str) -> bool:
    """scanned() for a file's name alone, in Python."""
    if re.search(IGNORED_SUFFIXES, name):
        return False
    code = re.search(CODE, name) and not name.endswith(".d.ts")
    return bool(code or (re.search(r"\.(json|md)$", name) and name not in NOISE_NAMES and not re.search(NOISE, name)))


def scan_source_files(files: DataFrame) -> DataFrame:
    return files.filter(scanned(F.col("path")))


def read_source_files(spark, root: str) -> DataFrame:
    """path, mtime and content of the files to scan below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.filter(scanned(F.col("path"))).select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def route_files(files: DataFrame) -> DataFrame:
    """path and extractor for every extractor that takes a file."""
    p = F.col("path")
    name = F.element_at(F.split(p, "/"), -1)
    takes = {
        "stencil": p.rlike(r"\.[jt]sx$"),
        "react": p.rlike(r"\.[jt]sx?$") & ~p.endswith(".d.ts"),
        "vue-tsx": p.rlike(r"\.[jt]sx?$") & ~p.endswith(".d.ts"),
        "vue": p.endswith(".vue"),
        "astro": p.endswith(".astro"),
        "web-components": p.rlike(r"\.[jt]s$") & ~p.endswith(".d.ts"),
        "svelte": p.endswith(".svelte") & ~name.rlike(r"^\+(page|layout|error)\.svelte$"),
    }
    return files.select("path", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in takes.items())))).alias("extractor"))


def select_candidate_files(files: DataFrame, names=NAME_PATTERNS, markers=MARKERS, keys=("path",)) -> DataFrame:
    """Files that may define composition, with the first reason: a name pattern in any part of the path, else a marker in the text. The first row of a file, which keys name, counts."""
    parts = F.filter(F.split(F.lower("path"), "/"), lambda s: s != "")
    by_name = [F.when(F.contains(F.array_join(parts, "\n"), F.lit(n)), F.lit(f"name:{n}")) for n in names]
    by_text = [F.when(F.col("content").contains(m), F.lit(f"content:{m}")) for m in markers]
    rows = files.withColumn("reason", F.coalesce(*by_name, *by_text)).filter("reason IS NOT NULL")
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("file_id"))).filter("__rn = 1").drop("__rn")


def slice_regions(files: DataFrame, markers=MARKERS, window: int = 3) -> DataFrame:
    """file_id, start, stop and text of the lines around markers; ranges that touch are one."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "line"), F.size(F.split("content", "\n")).alias("total"))
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.col("line").contains(m)
    around = lines.filter(hit).select("file_id", "n", F.greatest(F.lit(0), F.col("n") - window).alias("a"), F.least(F.col("total") - 1, F.col("n") + window).alias("b"))
    order = Window.partitionBy("file_id").orderBy("a", "b", "n")
    fresh = F.col("a") > F.coalesce(F.lag("b").over(order), F.lit(-9)) + 1
    islands = around.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("file_id", "island").agg(F.min("a").alias("start"), F.max("b").alias("stop"))
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("start") + 1, F.col("stop") - F.col("start") + 1), "\n")
    return spans.join(files.select("file_id", "content"), "file_id").select("file_id", "start", "stop", body.alias("text"))


def folder_of(path: str | Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("\n/* truncated */")))


def _imported_names(clause: Column) -> Column:
    """What an import clause names, split at commas; the braces of a list of several stay with its first and last name."""
    parts = F.filter(F.transform(F.split(clause, ","), lambda p: F.trim(p)), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.when(p.startswith("{") & p.endswith("}"), F.trim(F.substring(p, F.lit(2), F.length(p) - 2))).otherwise(p))
    names = F.transform(F.filter(bare, lambda p: p != ""), lambda p: F.trim(F.regexp_replace(p, r"(?is)\s+as\s+.*$", "")))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def extract_imports(files: DataFrame) -> DataFrame:
    """file_id, place, clause, source, names and local of each import of a file's text, in the order in which they stand."""
    found = F.arrays_zip(F.regexp_extract_all("content", F.lit(IMPORT), 1).alias("clause"), F.regexp_extract_all("content", F.lit(IMPORT), 2).alias("source"))
    rows = files.select("file_id", F.posexplode(found).alias("place", "i")).select("file_id", "place", F.trim("i.clause").alias("clause"), F.trim("i.source").alias("source"))
    return rows.select("file_id", "place", "clause", "source", _imported_names(F.col("clause")).alias("names"), F.col("source").startswith(".").alias("local"))


def exported(content: str | Column) -> Column:
    """What a text exports, each once: declared names, then defaults as default:name, then the items of lists as they are written."""
    defaults = F.transform(F.regexp_extract_all(content, F.lit(EXPORT_DEFAULT), 1), lambda n: F.concat(F.lit("default:"), n))
    items = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(EXPORT_LIST), 1), lambda x: F.filter(F.transform(F.split(x, ","), lambda i: F.regexp_replace(i, r"^\s+|\s+$", "")), lambda i: i != "")))
    return F.array_distinct(F.concat(F.regexp_extract_all(content, F.lit(EXPORT_NAMED), 1), defaults, items))


def extract_exports(files: DataFrame) -> DataFrame:
    """file_id, place and name of what a file exports, each once."""
    return files.select("file_id", F.posexplode(exported("content")).alias("place", "name"))


def _slots(names: Column, descriptions: Column | None = None) -> Column:
    texts = F.transform(names, lambda n: F.lit(None).cast("string")) if descriptions is None else descriptions
    return F.transform(F.arrays_zip(names.alias("name"), texts.alias("text")), lambda x: F.struct(F.coalesce(F.nullif(x["name"], F.lit("")), F.lit("default")).alias("name"), x["text"].alias("description")))


def _documented_slots(content: Column) -> Column:
    """Slots of @slot tags: a name and a description after a dash, a description of the default slot after a dash, or a description alone."""
    comments = F.filter(F.transform(F.regexp_extract_all(content, F.lit(DOC_SLOT), 1), lambda c: F.trim(F.regexp_replace(c, r"\s*\*/.*$", ""))), lambda c: c != "")
    named = r"(?s)^(\S+)\s*-\s*(.*)$"
    is_named = lambda c: ~c.startswith("-") & c.rlike(named)
    name = F.transform(comments, lambda c: F.when(is_named(c), F.regexp_extract(c, named, 1)).otherwise(F.lit("default")))
    text = F.transform(comments, lambda c: F.nullif(F.trim(F.when(c.startswith("-"), F.substring(c, F.lit(2), F.length(c))).when(is_named(c), F.regexp_extract(c, named, 2)).otherwise(c)), F.lit("")))
    return _slots(name, text)


def extract_template_slots(files: DataFrame) -> DataFrame:
    """file_id, name, is_default, description and place of the slots of files (path, content), each name once.

    Three dialects, by a file's ending. .astro: slot tags of the template, then slots rendered in the frontmatter, in
    that order. .js, .jsx, .ts, .tsx (custom elements): @slot tags of comments, then slot tags, the first description
    counts, sorted by name. Others: slot tags by their name attribute, in order. A slot without a name is the default.
    """
    path, content = F.col("path"), F.col("content")
    front = F.when(content.rlike(r"(?s)^---\r?\n.*?\r?\n---"), F.regexp_extract(content, r"(?s)^---\r?\n(.*?)\r?\n---", 1)).otherwise(F.lit(""))
    template = F.regexp_replace(content, r"(?s)^---\r?\n.*?\r?\n---", "")
    astro = F.concat(_slots(F.regexp_extract_all(template, F.lit(TAG_SLOT), 1)), _slots(F.regexp_extract_all(front, F.lit(RENDERED_SLOT), 1)))
    attributes = F.regexp_extract_all(content, F.lit(ELEMENT_SLOT), 1)
    tags = _slots(F.transform(attributes, lambda a: F.regexp_extract(a, r"\bname=[\"']([^\"']+)[\"']", 1)))
    element = path.rlike(r"\.[jt]sx?$")
    found = F.when(path.endswith(".astro"), astro).when(element, F.concat(_documented_slots(content), tags)).otherwise(tags)
    rows = files.select("file_id", element.alias("__sorted"), F.posexplode(found).alias("at", "s")).select("file_id", "__sorted", "at", "s.*")
    merged = rows.groupBy("file_id", "__sorted", "name").agg(F.min("at").alias("at"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("at"))).alias("description"))
    order = Window.partitionBy("file_id").orderBy(F.when(F.col("__sorted"), F.col("name")), "at")
    return merged.select("file_id", "name", (F.col("name") == "default").alias("is_default"), "description", (F.row_number().over(order) - 1).alias("place"))


def extract_links(files: DataFrame) -> DataFrame:
    """file_id and target of the links of a page's text, with repeats."""
    return files.select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r'<a href="([^"]*)"'), 1)).alias("target"))


def resolved(path: Column) -> Column:
    """An absolute path without . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda kept, p: F.when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def within(path: Column, root: str) -> Column:
    """Whether a path is root or below it."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(f"{root}/")


def resolve_local_imports(imports: DataFrame, files: DataFrame, root: str, extensions=EXTENSIONS) -> DataFrame:
    """imports (importer, an absolute path; source) with path, the file that a source beginning with a dot means, from root on.

    The path itself, with an ending, or its index file: the first that is among files and in root. Where none is, the
    path as it is written, if it is in root. Null for other sources.
    """
    root = root.rstrip("/")
    base = F.when(F.col("source").startswith("."), resolved(F.concat(folder_of("importer"), F.lit("/"), F.col("source"))))
    tries = ["", *extensions, *(f"/index{e}" for e in extensions)]
    ends = F.filter(F.array(*(F.struct(F.lit(n).alias("at"), F.lit(t).alias("end")) for n, t in enumerate(tries))), lambda t: F.col("path").endswith(t["end"]))
    meant = files.select("path").filter(within(F.col("path"), root)).select("path", F.explode(ends).alias("t"))  # a file offers itself for the few bases it ends, an import not its tries
    meant = meant.groupBy(F.expr("left(path, length(path) - length(t.end))").alias("base")).agg(F.min_by("path", "t.at").alias("candidate"))
    # what has no file to look for meets none, and is dealt out by its own text
    apart = F.when(F.col("base").isNull(), F.xxhash64("importer", "source"))
    own = imports.withColumn("base", F.when(within(base, root), base)).withColumn("__apart", F.coalesce(apart, F.lit(0).cast("long")))
    meant = meant.withColumn("__apart", F.lit(0).cast("long")).hint("merge")  # a small file's paths may be too many for a broadcast
    found = own.join(meant, ["base", "__apart"], "left")
    path = F.coalesce("candidate", "base")
    others = [c for c in imports.columns if c not in ("importer", "source")]
    return found.select("importer", "source", *others, F.substring(path, F.lit(len(root) + 2), F.length(path)).alias("path"))


def sibling_files(components: DataFrame, files: DataFrame, k: int = 5, snippet_chars: int = 1200) -> DataFrame:
    """own, path, n, exports and snippet of the first k other files in each component's folder. A folder's first k + 1 files are enough for all of its components."""
    place = F.row_number().over(Window.partitionBy("folder").orderBy("path"))
    first = files.select("path").distinct().withColumn("folder", folder_of("path")).withColumn("at", place).filter(F.col("at") <= k + 1)
    listed = first.groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]).alias("paths"))
    rows = components.select(F.col("path").alias("own")).distinct().withColumn("folder", folder_of("own")).join(listed, "folder")
    others = F.slice(F.filter("paths", lambda p: p != F.col("own")), 1, k)
    named = rows.select("own", F.posexplode(others).alias("n", "path")).select("own", "path", (F.col("n") + 1).alias("n"))
    texts = files.join(first.select("path"), "path", "left_semi").groupBy("path").agg(F.min("content").alias("content"))
    return named.join(texts, "path").select("own", "path", "n", exported("content").alias("exports"), truncated(F.col("content"), snippet_chars).alias("snippet"))


def manifest_edges(files: DataFrame, names: DataFrame) -> DataFrame:
    """parent and child of the preferred values of SLOT definitions in manifest.json files (path, content), between known names in Pascal case; text of another shape gives none."""
    text = lambda v, at: F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING", F.try_variant_get(v, at, "string"))
    docs = files.filter(F.col("path").endswith("manifest.json")).select(F.try_parse_json("content").alias("v"))
    owned = docs.select(kebab_to_pascal(text(F.col("v"), "$.component.name")).alias("parent"), F.explode(F.map_values(F.try_variant_get("v", "$.variantsMeta.componentPropertyDefinitions", "map<string,variant>"))).alias("d"))
    slots = owned.filter(text(F.col("d"), "$.type") == "SLOT").select("parent", F.explode(F.try_variant_get("d", "$.preferredValues", "array<variant>")).alias("p"))
    rows = slots.select("parent", kebab_to_pascal(text(F.col("p"), "$.name")).alias("child"))
    known = lambda c: names.select(F.col("name").alias(c)).distinct()
    return rows.join(known("parent"), "parent", "left_semi").join(known("child"), "child", "left_semi").filter("parent <> child").select("parent", "child").distinct()


def extraction_summary(components: DataFrame, warnings: DataFrame, errors: DataFrame) -> DataFrame:
    """Per session: files, components, props, slots, warnings and errors."""
    count = lambda rows, name: rows.groupBy("session_id").agg(F.count("*").alias(name))
    w = count(warnings, "warnings").join(count(errors, "errors"), "session_id", "full_outer")
    c = components.groupBy("session_id").agg(F.countDistinct("source").alias("files"), F.count("*").alias("components"), F.sum(F.size("props")).alias("props"), F.sum(F.size("slots")).alias("slots"))
    return c.join(w, "session_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("warnings", "errors")})
