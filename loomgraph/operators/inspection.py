"""What a component's source text says about it, and evidence of composition in text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.lineage import cut, rows
from loomgraph.functions.naming import kebab_to_pascal
from loomgraph.operators.files import extract_exports, extract_imports, folder_of, resolve_local_imports, sibling_files, truncated, within
from loomgraph.operators.graph import break_edge, cyclic_core, elementary_cycles

# Props of data wrappers, patterns of their sources, and the weight of each sign.
INFRA_PROPS = ["id", "locale", "preview", "slug", "topic", "previousComponent", "__typename"]
VISIBLE_TAG = r"<(?:[A-Z][A-Za-z0-9_.]*|div|span|section|main|article|header|footer|nav|aside|img|video|p|h[1-6]|ul|ol|li|button|input|textarea|select|form|label|table|tbody|thead|tr|td|th)\b"
GENERATED_IMPORT = r"from\s+['\"][^'\"]*__generated[^'\"]*['\"]"
GENERATED_HOOK = r"\buse[A-Z][A-Za-z0-9]*(?:Lazy|Suspense)?Query\s*\("
GQL_FILE = r"(?i)(?:-gql|-ggl)\.[cm]?[jt]sx?$"
LOADING_GUARD = r"if\s*\([^)]*(?:isLoading|loading|!data|!\w+)\s*[^)]*\)\s*return\s+null\b"
IMPORT = r"import\s+(?:type\s+)?(.+?)\s+from\s+['\"]([^'\"]+)['\"]"
GQL_PATH = r"(?i)-g(?:ql|gl)(?:$|\.)"
RESOLVER_HINT = "resolver|registry|componentmap|component-map|componentresolver|resolvecomponent"
ELEMENT_TYPE = r"(?:React\.)?ReactElement\s*<\s*([A-Za-z_$][\w$.]*)(?![\w$.])"
SNIPPET_TUPLE = r"Snippet\s*<\s*\[([^\]]*)\]\s*>"
IDENTIFIER = r"[A-Za-z_$][\w$.]*"
ALLOWED_TAG = r"@allowedComponents\s+([^\n*]+)"
DOC_KEYWORDS = ("slot", "child", "children", "compose", "nested", "contains", "wraps")
BOLD_CODE = r"\*\*`([^`]+)`\*\*"
#: Names of one automaton, at most; it is sent to every executor.
MAX_NAMES = 200_000


def _siblings(text: Column) -> Column:
    """The names that a text imports from files beside it, as they are called there: all of a clause, without generated files."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(IMPORT), 1).alias("clause"), F.regexp_extract_all(text, F.lit(IMPORT), 2).alias("path"))
    beside = F.filter(found, lambda m: m["path"].startswith("./") & ~m["path"].contains("__generated") & ~m["path"].rlike(GQL_PATH))
    parts = F.flatten(F.transform(beside, lambda m: F.split(m["clause"], "[{},]")))
    names = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"(?i)^type\s+|\s+as\s+.*$", ""))
    return F.array_distinct(F.filter(names, lambda n: n.rlike(r"^[\w$]+$")))


def _forwards(text: Column, siblings: Column) -> Column:
    """Whether a sibling is rendered with spread data other than the component's own props."""
    quoted = lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    spread = lambda n: F.regexp_like(text, F.concat(F.lit("<"), quoted(n), F.lit(r"\b[^>]*\{\.\.\.(?!props\b)[^}]+\}")))
    closed = lambda n: F.regexp_like(text, F.concat(F.lit("(?s)<"), quoted(n), F.lit(r"\b.*?(?:/>|</"), quoted(n), F.lit(">)")))
    return F.exists(siblings, lambda n: spread(n) & closed(n))


def inspect_source(components: DataFrame, runtime_calls: tuple[str, ...] = ()) -> DataFrame:
    """Add wrapper_confidence (0, 2 to 5), inspection_reasons and keep_despite_zero_surface to components with props, slots, source and text.

    runtime_calls are texts, such as a call of a content service's hooks, that hint at a data wrapper. A null text says nothing.
    """
    text = F.coalesce("text", F.lit(""))
    found = components.withColumn("__s", _siblings(text))
    hook = text.rlike(GENERATED_IMPORT) & text.rlike(GENERATED_HOOK)
    infra = (F.size("props") > 0) & F.forall("props", lambda p: p["name"].isin(INFRA_PROPS))
    siblings, used = F.col("__s"), F.lit(False)
    for call in runtime_calls:
        used = used | text.contains(call)
    signs = [
        ("gql-filename", 1, F.col("source").rlike(GQL_FILE)),
        ("generated-query-hook", 3, hook),
        ("sibling-renderer-import", 1, (F.size(siblings) > 0) & (hook | infra)),
        ("fetch-forward-render", 3, _forwards(text, siblings)),
        ("runtime-hooks", 1, used),
        ("infra-props", 2, infra),
        ("loading-null-guard", 1, text.rlike(LOADING_GUARD)),
    ]
    there = F.col("text").isNotNull()
    score = sum((F.when(there & test, w).otherwise(0) for _, w, test in signs), F.lit(0))
    confidence = F.when(score <= 0, 0).when(score <= 2, 2).when(score <= 4, 3).when(score <= 6, 4).otherwise(5)
    keep = (F.size("props") == 0) & (F.size("slots") == 0) & text.rlike(r"return\s*(?:\(|<)") & text.rlike(VISIBLE_TAG)
    summary = F.when(confidence >= 4, "data-fetch-wrapper").when(confidence == 3, "possible-data-fetch-wrapper")
    reasons = F.array_compact(F.array(summary, *(F.when(there & t, F.lit(f"data-wrapper:{n}")) for n, _, t in signs), F.when(keep, "zero-surface:rendered-ui")))
    return found.withColumn("wrapper_confidence", confidence).withColumn("inspection_reasons", reasons).withColumn("keep_despite_zero_surface", keep).drop("__s")


def extract_declared_children(slots: DataFrame, names: DataFrame, props_types: DataFrame) -> DataFrame:
    """Known names that a slot's type text or doc comment declares: component_id, slot and sorted children.

    In types, ReactElement<P, ...> and each identifier of a Snippet<[P, ...]> name a props type, which props_types
    (props_type, name) maps to its component. In comments, names follow @allowedComponents, separated by commas.
    """
    none = F.array().cast("array<string>")
    tuples = F.transform(F.regexp_extract_all("type", F.lit(SNIPPET_TUPLE), 1), lambda t: F.regexp_extract_all(t, F.lit(IDENTIFIER), 0))
    typed = slots.select("component_id", "slot", F.explode(F.array_distinct(F.concat(F.coalesce(F.regexp_extract_all("type", F.lit(ELEMENT_TYPE), 1), none), F.coalesce(F.flatten(tuples), none)))).alias("props_type"))
    typed = typed.join(props_types.select("props_type", "name").distinct(), "props_type").select("component_id", "slot", "name")
    listed = slots.select("component_id", "slot", F.explode(F.split(F.regexp_extract("doc", ALLOWED_TAG, 1), ",")).alias("name")).withColumn("name", F.trim("name"))
    rows = typed.unionByName(listed).join(names.select("name").distinct(), "name", "left_semi")
    return rows.groupBy("component_id", "slot").agg(F.array_sort(F.collect_set("name")).alias("children"))


def doc_edges(files: DataFrame, components: DataFrame, keywords=DOC_KEYWORDS) -> DataFrame:
    """Edges from the component of an AGENTS.md file's folder (the first by arrival) to known names that it sets in bold code on lines with a keyword.

    A name that isn't known as it stands is tried in Pascal case.
    """
    docs = files.filter(F.col("path").endswith("AGENTS.md"))
    lines = docs.select(folder_of("path").alias("folder"), F.explode(F.split("content", "\n")).alias("line")).filter(F.lower("line").rlike("|".join(keywords)))
    mentions = lines.select("folder", F.explode(F.regexp_extract_all("line", F.lit(BOLD_CODE), 1)).alias("raw")).withColumn("pascal", kebab_to_pascal("raw"))
    owners = components.withColumn("folder", folder_of("path")).groupBy("folder").agg(F.min_by("name", "arrival").alias("parent"))
    known = components.select("name").distinct()
    as_is, changed = known.select(F.col("name").alias("raw"), F.col("name").alias("__raw")), known.select(F.col("name").alias("pascal"), F.col("name").alias("__pascal"))
    found = mentions.join(owners, "folder").join(as_is, "raw", "left").join(changed, "pascal", "left").withColumn("child", F.coalesce("__raw", "__pascal"))
    return found.filter("child IS NOT NULL AND parent <> child").select("parent", "child").distinct()


def mentions(names: DataFrame, files: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """name, path and role for each file (path, content) whose text holds a name: reference for files with a resolver hint in path or text, usage for others that render, pass or register the name.

    The names are compiled into an automaton that finds all of them in one pass over a text. An automaton holds
    max_names of them; more names take more passes.
    """
    listed = cut(names.select("name").filter("name <> ''").distinct())
    passes = max(1, -(-rows(listed) // max_names))
    out = None
    for i in range(passes):
        part = listed.filter(F.pmod(F.xxhash64("name"), F.lit(passes)) == i)
        sent = part.sparkSession.sparkContext.broadcast([r.name for r in part.collect()])  # about max_names rows
        found = files.select("path", "content").mapInArrow(_finder(sent), "name string, path string, role string")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in sent.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        hint = re.compile(RESOLVER_HINT, re.IGNORECASE)
        for batch in batches:
            found = []
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                path, text = path.as_py(), text.as_py() or ""
                if not len(automaton) or not text:
                    continue
                held, used = {}, set()
                for end, name in automaton.iter(text):
                    held[name] = True
                    if name not in used and is_used(text, end + 1 - len(name), end + 1):
                        used.add(name)
                if held:
                    hinted = hint.search(path or "") or hint.search(text)
                    found += [(n, path, "reference") for n in held] if hinted else [] if text.startswith("// stub") else [(n, path, "usage") for n in held if n in used]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.record_batch([pa.array(c, pa.string()) for c in columns], names=["name", "path", "role"])

    return run


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def is_used(text: str, start: int, stop: int) -> bool:
    """Whether text[start:stop] stands there as a tag's name, or as a word before one of ) , } and :."""
    def edge(at: int) -> bool:
        return (at > 0 and _word(text[at - 1])) != (at < len(text) and _word(text[at]))

    if text[start - 1 : start] == "<" and edge(stop):
        return True
    if not edge(start):
        return False
    at = stop
    while at < len(text) and text[at].isspace():
        at += 1
    ahead = text[at : at + 1]
    return ahead in (")", ",", "}", ":")


def snippet(text: Column, token: Column, most: int = 800) -> Column:
    """The lines of text around the first place of token, half of `most` characters each way, cut at `most`."""
    half = most // 2
    at = F.instr(text, token) - 1
    head = F.substring(text, F.lit(1), F.greatest(F.lit(0), at - half) + 1)  # up to where the snippet's first line may begin
    start = F.when(F.instr(head, F.lit("\n")) > 0, F.length(head) - F.length(F.substring_index(head, "\n", -1))).otherwise(0)
    tail = F.substring(text, at + half + 1, F.length(text))
    ahead = F.instr(tail, F.lit("\n"))
    stop = F.when(ahead > 0, at + half + ahead - 1).otherwise(F.length(text))
    return F.when(at < 0, truncated(text, most)).otherwise(truncated(F.regexp_replace(F.substring(text, start + 1, stop - start), r"^\s+|\s+$", ""), most))


def _first_files(found: DataFrame, components: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """Of each component (name, path) the first k files in which it is found, but for its own, with place n and a snippet."""
    own = components.select("name", F.col("path").alias("own")).distinct()
    rows = found.distinct().join(own, "name").filter("path <> own")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("name", "own").orderBy("path"))).filter(F.col("n") <= k)
    texts = files.join(first.select("path"), "path", "left_semi").groupBy("path").agg(F.min("content").alias("content"))
    return first.join(texts, "path").select("name", "own", "path", "n", snippet(F.col("content"), F.col("name")).alias("snippet"))


def resolver_references(components: DataFrame, files: DataFrame, k: int = 3, found: DataFrame | None = None) -> DataFrame:
    """name, own, path, n and snippet: the first k files with a resolver hint that hold each component's name, other than its own. found: what mentions() gave, if it is there."""
    found = mentions(components, files) if found is None else found
    return _first_files(found.filter("role = 'reference'").select("name", "path"), components, files, k)


def parent_usage_site(components: DataFrame, files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """name, own, path and snippet: the first file without hints that renders, passes or registers each component, other than its own and stubs."""
    found = mentions(components, files) if found is None else found
    return _first_files(found.filter("role = 'usage'").select("name", "path"), components, files, 1).drop("n")


def selection_context(components: DataFrame, files: DataFrame, root: str, max_source: int = 8000) -> DataFrame:
    """What a decision about each component (name, path) is made on: code, imports, exports, siblings, references and usage, and their counts.

    Null in all for a component whose file isn't there or is outside root.
    """
    own = components.select("name", "path").distinct().join(files.select("path", "content"), "path")
    inside = own.filter(within(F.col("path"), root))
    hits = cut(mentions(inside, files))
    by_file = inside.select("path", "content").distinct().withColumn("file_id", F.col("path"))
    imports = resolve_local_imports(extract_imports(by_file).withColumn("importer", F.col("file_id")), files, root)
    lists = {
        "imports": imports.groupBy(F.col("importer").alias("path")).agg(F.array_sort(F.collect_list(F.struct("place", "source", "names", "local", F.col("path").alias("resolved")))).alias("imports")),
        "exports": extract_exports(by_file).groupBy(F.col("file_id").alias("path")).agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("exports")),
        "siblings": sibling_files(by_file, files).groupBy(F.col("own").alias("path")).agg(F.array_sort(F.collect_list(F.struct("n", "path", "exports", "snippet"))).alias("siblings")),
    }
    out = inside.select("name", "path", truncated(F.col("content"), max_source).alias("code"))
    for table in lists.values():
        out = out.join(table, "path", "left")
    references = resolver_references(inside, files, found=hits).groupBy("name", F.col("own").alias("path")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("path").alias("file"), "snippet"))).alias("references"))
    usage = parent_usage_site(inside, files, found=hits).select("name", F.col("own").alias("path"), F.struct(F.col("path").alias("file"), "snippet").alias("usage"))
    out = out.join(references, ["name", "path"], "left").join(usage, ["name", "path"], "left")
    counts = {f"n_{c}": F.coalesce(F.size(c), F.lit(0)) for c in ("imports", "siblings", "references")}
    return components.select("name", "path").distinct().join(out.withColumns(counts), ["name", "path"], "left")


def suggested_cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """Cycles (path, slots) with the edge (src, slot, dst) to break."""
    return break_edge(elementary_cycles(edges, max_len))


def store_cycles(stored: DataFrame, found: DataFrame, sessions: DataFrame) -> DataFrame:
    """The table of cycles (session_id, cycle_index, path, slots, suggested_break) with those of the sessions replaced by what was found for them, numbered by path."""
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("path", "slots")).cast("long") - 1
    new = found.join(sessions.select("session_id").distinct(), "session_id", "left_semi").withColumn("cycle_index", number)
    return stored.join(sessions, "session_id", "left_anti").unionByName(new.select(*stored.columns))


def load_cycles(stored: DataFrame, session_id) -> DataFrame:
    """A session's cycles, by cycle_index."""
    return stored.filter(F.col("session_id") == session_id).orderBy("cycle_index")


def exclude_until_valid(edges: DataFrame, entries: DataFrame, offenders, max_iter: int = 2) -> DataFrame:
    """Entries (node) left after dropping offenders(entries) up to max_iter times, and once the targets of edges that break cycles."""
    for _ in range(max_iter):
        bad = cut(offenders(entries).select("node").distinct())
        if not rows(bad):
            break
        entries = cut(entries.join(bad, "node", "left_anti"))
    keep = lambda c: entries.select(F.col("node").alias(c))
    left = edges.join(keep("src"), "src", "left_semi").join(keep("dst"), "dst", "left_semi")
    if not rows(cyclic_core(left)):
        return entries
    targets = break_edge(elementary_cycles(left.select("src", "slot", "dst"))).select(F.col("dst").alias("node")).distinct()
    return entries.join(targets, "node", "left_anti")
