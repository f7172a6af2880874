"""Writes to catalog tables on literal cases: order of calls, nulls written, names and positions, replaced lists."""

import pytest

from loomgraph.operators import catalog as K

COMPONENTS = "session_id int, component_id string, name string, source string, framework string, status string, description string, description_rationale string, props_rationale string, slots_rationale string"
PROPS = "session_id int, component_id string, name string, position int, type string, required boolean, cdf_type string, category string, token_kind string, description string, default_value string, rationale string"
VALUES = "session_id int, component_id string, prop_name string, position int, value string"
SLOTS = "session_id int, component_id string, name string, position int, is_default boolean, required boolean, description string, rationale string"
CHILDREN = "session_id int, component_id string, slot_name string, position int, child string"
CALLS = "session_id int, component_id string, seq int, tool string, name string, cdf_type string, cdf_category string, token_kind string, required boolean, description string, reason string, default_value string, list array<string>, about struct<description:string,props:string,slots:string>"


def catalog(spark, components=(), props=(), values=(), slots=(), children=()):
    return K.Catalog(*(spark.createDataFrame(list(r), s) for r, s in zip((components, props, values, slots, children), (COMPONENTS, PROPS, VALUES, SLOTS, CHILDREN), strict=True)))


def component(cid="c1", name="Card", session=1, description=None, status="extracted"):
    return (session, cid, name, f"/{name}.tsx", "react", status, description, None, None, None)


def prop(name, position, cdf_type=None, cid="c1", session=1, category=None, description=None, default=None):
    return (session, cid, name, position, "string", True, cdf_type, category, None, description, default, None)


def call(seq, tool, name=None, cdf_type=None, category=None, cid="c1", **more):
    fields = ("token_kind", "required", "description", "reason", "default_value", "list", "about")
    return (1, cid, seq, tool, name, cdf_type, category, *(more.get(f) for f in fields))


@pytest.fixture(scope="module")
def full(spark):
    return full_catalog(spark)


def full_catalog(spark):
    return catalog(
        spark,
        [component(), component("c2", "Hero", description="old")],
        [prop("size", 0, "string", category="content", description="was", default="m"), prop("label", 1), prop("size", 0, cid="c2")],
        [(1, "c1", "size", 0, "s"), (1, "c1", "size", 1, "m"), (1, "c2", "size", 0, "x")],
        [(1, "c1", "body", 0, True, False, "d", None), (1, "c1", "aside", 1, False, True, None, None)],
        [(1, "c1", "body", 0, "Hero"), (1, "c1", "aside", 0, "Hero")],
    )


def test_calls_are_applied_in_order(spark, full):
    calls = [
        call(1, "classify_prop", "size", "enum", "design", list=["s", "l", "s"], default_value="l", description="how big", reason="r1", token_kind="k"),
        call(2, "classify_prop", "size", "string", "content", required=True),
        call(3, "classify_prop", "label", "string", "content"),
        call(4, "exclude_prop", "label", reason=""),
        call(5, "classify_prop", "nope", "string", "content"),
        call(6, "exclude_prop", "nope"),
        call(7, "classify_slot", "body", description=None, list=["A", "B"], reason="why"),
        call(8, "classify_slot", "body", required=False),
        call(9, "classify_slot", "gone"),
        call(10, "classify_component", description="a card", about=("d", None, "s")),
        call(11, "classify_component"),
    ]
    out, warnings = K.apply_calls(full, spark.createDataFrame(calls, CALLS))
    props = {(r.component_id, r.name): r for r in out.props.collect()}
    size = props["c1", "size"]
    assert (size.cdf_type, size.category, size.required, size.description, size.default_value, size.rationale, size.token_kind) == ("string", "content", True, None, "l", None, None)
    label = props["c1", "label"]
    assert (label.cdf_type, label.category, label.rationale, label.required) == ("excluded", None, None, False)
    assert props["c2", "size"].cdf_type is None and len(props) == 3
    values = sorted((r.component_id, r.position, r.value) for r in out.allowed_values.collect())
    assert values == [("c1", 0, "s"), ("c1", 1, "l"), ("c2", 0, "x")]
    slots = {r.name: r for r in out.slots.collect()}
    assert (slots["body"].required, slots["body"].description, slots["body"].rationale, slots["body"].is_default) == (False, None, "why", True) and slots["aside"].required
    assert sorted((r.slot_name, r.position, r.child) for r in out.children.collect()) == [("aside", 0, "Hero"), ("body", 0, "A"), ("body", 1, "B")]
    named = {r.component_id: r for r in out.components.collect()}
    assert (named["c1"].status, named["c1"].description, named["c1"].description_rationale, named["c1"].props_rationale, named["c1"].slots_rationale) == ("generated", "a card", "d", None, "s")
    assert named["c2"].status == "extracted" and named["c2"].description == "old"
    assert sorted((r.tool, r.name) for r in warnings.collect()) == [("classify_prop", "nope"), ("classify_slot", "gone")]


def test_children_may_be_emptied(spark, full):
    out, _ = K.apply_calls(full, spark.createDataFrame([call(1, "classify_slot", "body", list=[])], CALLS))
    assert [r.slot_name for r in out.children.collect()] == ["aside"]


def test_classifications_come_back_by_name_then_position(spark):
    old = catalog(
        spark,
        [component(description="kept"), component("c9", "Bare", session=2, description="lost")],
        [prop("a", 0, "string", category="content"), prop("b", 1, "enum", category="design"), prop("c", 2, "link"), prop("z", 0, cid="c9", session=2)],
        [(1, "c1", "a", 0, "x"), (1, "c1", "b", 0, "y")],
    )
    new = catalog(
        spark,
        [component(), component("c9", "Bare", session=2)],
        [prop("b", 0), prop("renamed", 2), prop("a", 1, "number"), prop("extra", 5), prop("z", 0, cid="c9", session=2)],
        [(1, "c1", "b", 0, "other")],
    )
    out = K.restore(old, new)
    got = {r.name: (r.cdf_type, r.category) for r in out.props.collect()}
    assert got == {"b": ("enum", "design"), "renamed": ("link", None), "a": ("string", "content"), "extra": (None, None), "z": (None, None)}
    assert sorted((r.prop_name, r.value) for r in out.allowed_values.collect()) == [("a", "x"), ("b", "y")]
    assert {r.component_id: r.description for r in out.components.collect()} == {"c1": "kept", "c9": None}


def test_definitions_are_stored(spark, full):
    kind = "session_id int, key string, description string, properties array<struct<name:string,type:string,category:string,token_kind:string,required:boolean,allowed:array<string>>>, slots array<struct<name:string,required:boolean,description:string,allowed:array<string>>>"
    entries = [
        (1, "Card", "new", [("size", "enum", "design", None, None, ["l"]), ("absent", "string", "content", None, True, None)], [("body", True, "b", ["X"]), ("foot", None, None, None)]),
        (1, "Fresh", None, [("p", "string", "content", "tk", True, ["v", "w"])], None),
    ]
    out = K.store_definitions(full, spark.createDataFrame(entries, kind))
    named = {r.name: r for r in out.components.collect()}
    assert (named["Card"].status, named["Card"].description, named["Hero"].status) == ("generated", "new", "extracted")
    fresh = named["Fresh"]
    assert len(fresh.component_id) == 12 and (fresh.source, fresh.framework, fresh.status) == ("", "react", "generated")
    props = {(r.component_id, r.name): r for r in out.props.collect()}
    assert ("c1", "absent") not in props and (props["c1", "size"].cdf_type, props["c1", "size"].required) == ("enum", False)
    assert props["c1", "label"].cdf_type is None and (props[fresh.component_id, "p"].token_kind, props[fresh.component_id, "p"].position) == ("tk", 0)
    values = sorted((r.component_id == "c1", r.prop_name, r.value) for r in out.allowed_values.collect())
    assert values == [(False, "p", "v"), (False, "p", "w"), (False, "size", "x"), (True, "size", "l")]
    assert sorted((r.name, r.position, r.is_default, r.required) for r in out.slots.collect()) == [("body", 0, True, True), ("foot", 1, False, False)]
    assert [(r.slot_name, r.child) for r in out.children.collect()] == [("body", "X")]


def test_cached_work_is_copied_whole(spark):
    source = [(7, "c1", "body", 0, True, True, "said", None)]
    both = catalog(
        spark,
        [component(session=7, description="done", status="accepted"), component(), component("c2", "Hero")],
        [prop("a", 0, "enum", session=7, category="design", description="d", default="q"), prop("a", 3), prop("b", 1, "string"), prop("a", 0, cid="c2")],
        [(7, "c1", "a", 0, "x"), (1, "c1", "b", 0, "old"), (1, "c2", "a", 0, "stays")],
        [*source, (1, "c1", "body", 4, False, False, None, "r")],
        [(7, "c1", "body", 0, "Hero"), (1, "c1", "body", 0, "old")],
    )
    out = K.copy_components(both, spark.createDataFrame([(1, "c1", 7), (1, "c2", 7)], "session_id int, component_id string, source_session int"))
    assert {(r.session_id, r.component_id): (r.description, r.status) for r in out.components.collect()}[1, "c1"] == ("done", "accepted")
    props = {(r.session_id, r.component_id, r.name): r for r in out.props.collect()}
    a = props[1, "c1", "a"]
    assert (a.cdf_type, a.category, a.description, a.default_value, a.position) == ("enum", "design", "d", "q", 3) and props[1, "c1", "b"].cdf_type == "string"
    assert sorted((r.session_id, r.component_id, r.value) for r in out.allowed_values.collect()) == [(1, "c1", "x"), (7, "c1", "x")]
    assert {(r.session_id, r.description, r.position, r.rationale) for r in out.slots.collect()} == {(7, "said", 0, None), (1, "said", 4, "r")}
    assert sorted((r.session_id, r.child) for r in out.children.collect()) == [(1, "Hero"), (7, "Hero")]


def test_token_tables_are_replaced(spark):
    groups, tokens = spark.createDataFrame([(1, "g", None), (2, "h", "d")], "session_id int, path string, description string"), spark.createDataFrame([(1, "g.a", "color", "1"), (2, "h.b", "color", "2")], "session_id int, path string, type string, value string")
    sessions = spark.createDataFrame([(1,)], "session_id int")
    new = K.store_tokens(groups, tokens, groups.limit(0), spark.createDataFrame([(1, "x", "number", "3"), (2, "no", "number", "4")], tokens.schema), sessions)
    assert [r.path for r in new[0].collect()] == ["h"] and sorted(r.path for r in new[1].collect()) == ["h.b", "x"]
    copied = K.copy_tokens(groups, tokens, spark.createDataFrame([(1, 2), (5, 2)], "session_id int, source_session int"))
    assert sorted((r.session_id, r.path) for r in copied[1].collect()) == [(1, "h.b"), (2, "h.b"), (5, "h.b")] and {r.description for r in copied[0].collect()} == {"d"}


def test_runs_are_stale_by_time_hash_or_absence(spark):
    runs = [
        ("fresh", True, "t", 1, "ht", "c", "hc", "s", "hs"), ("time", True, "t", 2, None, None, None, None, None), ("hash", True, "t", None, "other", None, None, None, None), ("gone", True, "lost", None, None, "lost", "h", None, None),
        ("edited", True, None, None, None, "c", "other", "s", "other"), ("source", True, None, None, None, None, None, None, None), ("unknown", False, "lost", None, None, "lost", "h", None, None),
    ]
    kind = "run_id string, known boolean, tokens_path string, tokens_mtime int, tokens_hash string, components_path string, components_hash string, saved_tokens_path string, saved_tokens_hash string"
    prints = [("fresh", "a", 1, "A"), ("source", "a", 9, "A"), ("source", "b", 9, None), ("source", "none", 1, None), ("unknown", "none", 1, None)]
    files = [("a", 1, "ha"), ("b", 1, "hb"), ("t", 1, "ht"), ("c", 1, "hc"), ("s", 1, "hs")]
    rows = K.run_staleness(spark.createDataFrame(runs, kind), spark.createDataFrame(prints, "run_id string, path string, mtime int, component string"), spark.createDataFrame(files, "path string, mtime int, hash string"))
    got = {r.run_id: r for r in rows.collect()}
    assert [r for r in sorted(got) if not got[r].stale] == ["fresh", "unknown"] and not got["unknown"].known
    assert got["time"].stale_tokens and got["hash"].stale_tokens and got["gone"].stale_tokens and got["gone"].components_edited
    assert got["edited"].components_edited and got["edited"].tokens_edited and not got["edited"].stale_tokens
    assert got["source"].stale_components == ["A", "b"] and got["source"].missing_files == ["none"] and got["unknown"].missing_files == []
