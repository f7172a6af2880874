"""What source texts, documents and payloads say, on rows that the driver's tables don't hold."""

from pyspark.sql import functions as F

from loomgraph.operators import diff as D
from loomgraph.operators import files as S
from loomgraph.operators import inspection as Z
from loomgraph.operators import parsing as P

FILES = "path string, content string"
GQL = """import { HeroBanner } from './HeroBanner';
import { useHeroBannerQuery } from '../__generated/useHeroBannerQuery';

export function HeroBannerGql({ id }: { id: string }) {
  return <HeroBanner {...data.heroBanner} />;
}
"""
PROJECT = [
    ("/r/src/components/HeroBannerGql.tsx", GQL),
    ("/r/src/components/HeroBanner.tsx", "export function HeroBanner() {}\n"),
    ("/r/src/components/registry.ts", "import { HeroBannerGql } from './HeroBannerGql';\n\nexport const componentRegistry = {\n  hero: HeroBannerGql,\n};\n"),
    ("/r/src/pages/Home.tsx", "import { HeroBannerGql } from '../components/HeroBannerGql';\n\nexport function Home() {\n  return <HeroBannerGql id=\"hero-1\" />;\n}\n"),
    ("/r/src/__generated/useHeroBannerQuery.ts", "export function useHeroBannerQuery() {}\n"),
    ("/r/src/pages/Stub.tsx", "// stub\nHeroBannerGql: 1"),
    ("/r/src/pages/About.tsx", "// HeroBannerGql is not used here\n"),
    ("/r/outside.tsx", "export function Outside() {}\n"),
]


def test_context_of_a_component(spark):
    files = spark.createDataFrame(PROJECT, FILES)
    components = spark.createDataFrame([("HeroBannerGql", "/r/src/components/HeroBannerGql.tsx"), ("Foreign", "/tmp/foreign/Component.tsx"), ("Gone", "/r/src/Gone.tsx")], "name string, path string")
    rows = {r.name: r for r in Z.selection_context(components, files, "/r").collect()}
    hero = rows["HeroBannerGql"]
    assert [(i.source, i.resolved, list(i.names)) for i in hero.imports] == [("./HeroBanner", "src/components/HeroBanner.tsx", ["HeroBanner"]), ("../__generated/useHeroBannerQuery", "src/__generated/useHeroBannerQuery.ts", ["useHeroBannerQuery"])]
    assert [e.name for e in hero.exports] == ["HeroBannerGql"] and hero.code == GQL
    assert [s.path for s in hero.siblings] == ["/r/src/components/HeroBanner.tsx", "/r/src/components/registry.ts"] and list(hero.siblings[1].exports) == ["componentRegistry"]
    assert [r.file for r in hero.references] == ["/r/src/components/registry.ts"] and hero.usage.file == "/r/src/pages/Home.tsx"
    assert (hero.n_siblings, hero.n_references) == (2, 1) and hero.usage.snippet == PROJECT[3][1].strip()
    assert rows["Foreign"].code is None and rows["Gone"].n_imports is None


def test_names_take_several_passes(spark):
    files = spark.createDataFrame([(f"/r/f{i}.ts", f"<Card{i} />, Card{i + 1} : 2, XCard{i + 2}, Card{i + 3}") for i in range(6)] + [("/r/null.ts", None)], FILES)
    names = spark.createDataFrame([(f"Card{i}",) for i in range(9)] + [("",)], "name string")
    whole = {tuple(r) for r in Z.mentions(names, files).collect()}
    assert whole == {tuple(r) for r in Z.mentions(names, files, max_names=2).collect()}
    assert whole == {(f"Card{i + k}", f"/r/f{i}.ts", "usage") for i in range(6) for k in (0, 1)}
    assert Z.mentions(names.limit(0), files).count() == 0


def test_snippets_keep_to_lines_around_the_first_place(spark):
    text = "\n".join(f"line {i} {'x' * 20}" for i in range(100)).replace("line 50", "line 50 Here")
    for most in (100, 300, 5000):
        at = text.index("Here")
        start = max(0, text.rfind("\n", 0, max(0, at - most // 2) + 1) + 1)
        end = text.find("\n", at + most // 2)
        want = text[start : len(text) if end < 0 else end].strip()
        want = want if len(want) <= most else want[:most] + "\n/* truncated */"
        assert spark.createDataFrame([(text, "Here")], "t string, n string").select(Z.snippet(F.col("t"), F.col("n"), most)).first()[0] == want


def test_exports_of_all_forms(spark):
    text = "export { A, B as C };\nexport default Foo;\nexport const x = 1;\nexport interface I {}\nexport {\n  A,\n D }\nexport async function no() {}"
    rows = S.extract_exports(spark.createDataFrame([(1, text), (2, ""), (3, None)], "file_id int, content string")).orderBy("file_id", "place").collect()
    assert [(r.file_id, r.name) for r in rows] == [(1, n) for n in ("x", "I", "default:Foo", "A", "B as C", "D")]


def test_relative_imports(spark):
    files = spark.createDataFrame([("/r/src/c.vue",), ("/r/src/a/index.ts",), ("/r/src/a/b.tsx",), ("/o/x.ts",), ("/r/src/d.js",), ("/r/src/d.ts",)], "path string")
    imports = [("/r/src/a/b.ts", "../c"), ("/r/src/a/b.ts", "."), ("/r/src/a/b.ts", "./../a/./b"), ("/r/src/a/b.ts", "../../../o/x"), ("/r/src/a/b.ts", "./none"), ("/r/src/a/b.ts", "lib"), ("/r/src/a/b.ts", "../d")]
    rows = S.resolve_local_imports(spark.createDataFrame(imports, "importer string, source string"), files, "/r/")
    assert {r.source: r.path for r in rows.collect()} == {"../c": "src/c.vue", ".": "src/a/index.ts", "./../a/./b": "src/a/b.tsx", "../../../o/x": None, "./none": "src/a/none", "lib": None, "../d": "src/d.js"}


def test_slots_of_three_dialects(spark):
    astro = "---\nconst x = Astro.slots.render('body');\nAstro.slots.render(\"head\")\n---\n<slot name=\"head\" /><slot/><slot name='foot'>"
    element = "/**\n * @slot - Main content\n * @slot icon - The icon\n * @slot\n * @slot odd text\n */\nclass X { t = `<slot name=\"icon\"></slot><slot></slot><slot name='end'></slot>` }"
    vue = "<template><slot v-bind=\"x\" name=\"a\"/><slot/><slot name=\"a\"/></template>"
    rows = S.extract_template_slots(spark.createDataFrame([(1, "/a.astro", astro), (2, "/b.ts", element), (3, "/c.vue", vue), (4, "/d.vue", None)], "file_id int, path string, content string")).orderBy("file_id", "place").collect()
    assert [(r.file_id, r.name, r.is_default, r.description) for r in rows] == [
        (1, "head", False, None), (1, "default", True, None), (1, "foot", False, None), (1, "body", False, None),
        (2, "default", True, "Main content"), (2, "end", False, None), (2, "icon", False, "The icon"),
        (3, "a", False, None), (3, "default", True, None),
    ]


def test_declared_children_by_props_types(spark):
    slots = [(1, "a", "React.ReactElement<CardProps, string | JSXElementConstructor<any>>[]", None), (2, "a", "Snippet<[HeroProps, { x: CardProps }]>", "/** text */"), (3, "a", "ReactElement<CardPropsX>", "/** @allowedComponents Hero, Odd , Card\n */"), (4, "a", None, None)]
    names, types = spark.createDataFrame([("Card",), ("Hero",)], "name string"), spark.createDataFrame([("CardProps", "Card"), ("HeroProps", "Hero"), ("CardPropsX", "Gone")], "props_type string, name string")
    rows = Z.extract_declared_children(spark.createDataFrame(slots, "component_id int, slot string, type string, doc string"), names, types).collect()
    assert {(r.component_id, tuple(r.children)) for r in rows} == {(1, ("Card",)), (2, ("Card", "Hero")), (3, ("Card", "Hero"))}


def test_manifests_and_agent_documents(spark):
    manifest = '{"component":{"name":"blue-accordion"},"variantsMeta":{"componentPropertyDefinitions":{"S#1":{"type":"SLOT","preferredValues":[{"name":"blue-accordion-item"},{"name":"unknown"},{"name":"blue-accordion"},{"name":5},"x"]},"T":{"type":"TEXT","preferredValues":[{"name":"blue-card"}]},"n":null}}}'
    files = spark.createDataFrame([("/a/design/manifest.json", manifest), ("/a/design/manifest.json", manifest), ("/a/other.json", manifest), ("/b/manifest.json", "{oops"), ("/b/manifest.json", "[1]"), ("/b/manifest.json", '{"component":"x"}')], FILES)
    names = spark.createDataFrame([("BlueAccordion",), ("BlueAccordionItem",), ("BlueCard",)], "name string")
    assert [tuple(r) for r in S.manifest_edges(files, names).collect()] == [("BlueAccordion", "BlueAccordionItem")]
    doc = "Direct **`AccordionItem`** children only.\nSee **`Other`**.\nIt wraps **`blue-card`**, **`Accordion`** and **`nobody`**."
    docs = spark.createDataFrame([("/a/AGENTS.md", doc), ("/a/README.md", doc), ("/z/AGENTS.md", doc)], FILES)
    components = spark.createDataFrame([("Accordion", "/a/A.tsx", 1), ("Late", "/a/L.tsx", 2), ("AccordionItem", "/i/I.tsx", 3), ("BlueCard", "/c/C.tsx", 4), ("Other", "/o/O.tsx", 5)], "name string, path string, arrival int")
    assert {tuple(r) for r in Z.doc_edges(docs, components).collect()} == {("Accordion", "AccordionItem"), ("Accordion", "BlueCard")}


def test_secrets_at_every_level(spark):
    key = "CFPAT-" + "a" * 20
    df = spark.createDataFrame([({"a": "note: " + key}, [("x", "y")], ("z", {"n": 1})), (None, None, None)], "m map<string,string>, l array<struct<auth:string,author:string>>, s struct<api_key:string,counts:map<string,int>>")
    row, empty = P.redact(P.redact(P.redact(df, "m"), "l"), "s").collect()
    assert row.m == {"a": "«redacted»"} and [tuple(x) for x in row.l] == [("«redacted»", "y")] and tuple(row.s) == ("«redacted»", {"n": 1})
    assert (empty.m, empty.l, empty.s) == (None, None, None)
    lines = ['{"a":[{"cmaToken":{"x":1},"note":"see %s"},"Bearer abc","a Bearer abc"],"n":1,"CMA":2,"cmas":"x"}' % key, "not json " + key, None, '"' + "x" * 4001 + '"']
    got = [r.t for r in P.redact_json(spark.createDataFrame([(t,) for t in lines], "t string"), "t").collect()]
    assert got == ['{"a":[{"cmaToken":"«redacted»","note":"«redacted»"},"«redacted»","a Bearer abc"],"n":1,"CMA":"«redacted»","cmas":"x"}', "«redacted»", None, '"' + "x" * 4000 + '…«+1»"']


def test_names_with_dollars_in_sources(spark):
    rows = [(1, "x.tsx", 'import { $Card } from "./Card"; const d = 1; return <$Card {...d} />;', [], [])]
    kind = "component_id int, source string, text string, props array<struct<name:string>>, slots array<string>"
    assert "data-wrapper:fetch-forward-render" in Z.inspect_source(spark.createDataFrame(rows, kind)).first().inspection_reasons


def test_narrowing_of_values_and_slots_breaks(spark):
    kind = "k int, type string, category string, required boolean, default_value string, values array<string>"
    side = lambda rows: spark.createDataFrame([(k, "enum", "content", False, None, v) for k, v in rows], kind)
    old, new = side([(1, ["a", "b"]), (2, []), (3, ["a"]), (4, ["a"]), (5, None)]), side([(1, ["a"]), (2, ["a"]), (3, ["a", "b"]), (4, []), (5, None)])
    assert {(r.k, r.reason) for r in D.breaking_reasons(D.property_diff(old, new, ["k"])).collect()} == {(1, "validation_narrowed"), (2, "validation_narrowed")}
    changes = [(None, "s", "slot_allowed_components_narrowed"), ("p", None, "validation_narrowed"), (None, "s", "removed"), ("p", None, "slot_removed")]
    df = spark.createDataFrame([(changes,)], "breaking_changes array<struct<property_id:string,slot_id:string,reason:string>>")
    assert [b.reason for b in D.sanitize_breaking_changes(df).first()[0]] == ["slot_allowed_components_narrowed", "validation_narrowed"]


def test_patches_by_path(spark):
    proposal = '{"name":"Card","meta":{"a":{"b":1},"list":[1]},"props":[{"name":"label","type":"string"},{"name":"label","type":"x"}]}'
    components = spark.createDataFrame([("Card", "extracted", proposal), ("Plain", "extracted", proposal), ("Odd", "extracted", None)], "name string, status string, proposal string")
    sets = [("meta.a.b", "2"), ("props[name=label].type", '"enum"'), ("meta.new", '{"x":[1]}'), ("props[name=gone].type", "1"), ("a.constructor.b", "1"), ("meta.list.x", "1"), ("meta.list.0", "5"), ("meta.none.x", "1"), ("a b", "1"), ("title", '"é"'), ("none[name=x].top", "7")]
    ops = spark.createDataFrame([("Card", 1, "accepted", sets), ("Card", 2, "rejected", None), ("Odd", 3, None, [("a", "1")]), ("Nobody", 4, "accepted", None)], "name string, seq int, status string, sets array<struct<path:string,value:string>>")
    done, warnings = P.apply_patch(components, ops)
    rows = {r.name: (r.status, r.proposal) for r in done.collect()}
    assert rows["Card"] == ("accepted", '{"name":"Card","meta":{"a":{"b":2},"list":[5],"new":{"x":[1]}},"props":[{"name":"label","type":"enum"},{"name":"label","type":"x"}],"title":"é","top":7}')
    assert rows["Plain"] == ("extracted", proposal) and rows["Odd"][0] == "extracted"
    said = {(r.name, r.path): r.warning for r in warnings.collect()}
    assert said == {
        ("Card", "props[name=gone].type"): "array item [name=gone] not found in 'props'",
        ("Card", "a.constructor.b"): "path contains forbidden key: 'a.constructor.b'",
        ("Card", "meta.none.x"): "path 'meta.none.x' — 'none' is not an object",
        ("Card", "a b"): "path contains invalid characters: 'a b'",
        ("Odd", "a"): "proposal is not an object",
        ("Nobody", None): "no component of this name",
    }


def test_many_fuzzy_queries_give_what_one_gives(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Button", "button group", "Card", "BuTTon", "Abutment", "", "Été", "b"])], "arrival int, name string")
    asked = ["btn", "BTN", "card", "b", "é", "zz", "tto", "buttongroupx"]
    for most in (10_000, 2):
        got = P.fuzzy_search_all(names, spark.createDataFrame([(q,) for q in [*asked, "b"]], "query string"), 3, max_queries=most)
        found = {}
        for r in got.orderBy("query", "rank").collect():
            found.setdefault(r.query, []).append((r.arrival, float(r.score)))
        for q in asked:
            assert found.get(q, []) == [(r.arrival, float(r.score)) for r in P.fuzzy_search(names, q, 3).collect()], q


def test_documents_of_definitions(spark):
    url = "https://example.org/v1"
    docs = {
        1: '{"$schema":"%s","a":{"$type":"component","$properties":{"p":{"$type":"string","$category":"content","$default":[1],"$values":["x"],"$token.kind":"k","$description":"d"}},"$slots":{"s":{"$required":true,"$allowedComponents":[]}}},"g":{"$description":"d","b":{"$type":"component","$properties":{}}}}' % url,
        2: '{"$schema":"%s","a":{"$type":"component","$properties":{"p":{"$type":"x","$category":"y","$values":[1],"extra":null},"q":5},"$slots":{"s":{"$required":"no","k":1},"t":"x"},"other":1},"g":{"$x":1,"h":3}}' % url,
        3: '"text"', 4: "{oops", 5: '{"a":{"$type":"component"}}', 6: '{"$schema":5}', 7: None,
    }
    got = {(r.doc, r.path, r.code) for r in P.validate_documents(spark.createDataFrame(list(docs.items()), "doc int, value string"), url).collect()}
    assert got == {
        (2, "a.p", "unknown $type"), (2, "a.p", "unknown $category"), (2, "a.p", "wrong kind of $values"), (2, "a.p", "unknown key extra"), (2, "a.q", "not an object"),
        (2, "a.s", "wrong kind of $required"), (2, "a.s", "unknown key k"), (2, "a.t", "not an object"), (2, "a", "unknown key other"), (2, "g", "unknown key $x"), (2, "g.h", "neither component nor group"),
        (3, "/", "not an object"), (4, "/", "not an object"), (7, "/", "not an object"), (5, "/$schema", "missing $schema"), (5, "a", "missing $properties"), (6, "/$schema", "wrong $schema"),
    }
