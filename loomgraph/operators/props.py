"""Rules over single props: name and type decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Props that pass through to the DOM or the framework.
PASS_THROUGH = (
    "className class classes classNames rootClassName prefixCls style styles id role tabIndex tabindex htmlFor for slot is lang dir hidden draggable"
    " spellCheck spellcheck contentEditable contenteditable inputMode inputmode autoComplete autocomplete autoFocus autofocus translate part exportparts"
    " aria dt pt ptOptions unstyled sx as element component dataQa data-qa modelValue modelModifiers"
).split()
# Names of states, and of content that stays a prop though its type is a node.
STATES = "disabled loading expanded isOpen selected checked active preview".split()
IDENTIFIERS = "componentId sectionKey locale variantIndex".split()
CONTENT_NAMES = "label title description text caption message placeholder tooltip heading subheading body summary excerpt".split()
NODE_TYPES = ["ReactNode", "React.ReactNode", "ReactElement", "React.ReactElement", "JSX.Element"]
# Patterns of names.
DESIGN_NAME = r"^(?i:variant|size|spacing|gap|color|bg|theme|align|layout|orientation|position)|(Color|Size|Variant|Style)$"
TOGGLE_NAME = r"^(?i:hide|show|enable|disable|vertical|horizontal|reverse|bold|italic|imageOn|with)"
URL_NAME = r"^(?i:href|url|link|src)|(Url|Href|Link|Src)$"
TEXT_NAME = r"^(?i:label|title|text|description|caption|heading|subheading|body|alt|name|placeholder|summary)|(Text|Label|Title|Name)$"


def _hint(category: str, kind: str | None = None) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(kind).cast("string").alias("hint"))


def preclassified(name: Column, type_: Column, dom_attribute: Column) -> Column:
    """Category and type hint of a prop, null where no rule matches; the first of the rules decides."""
    plain = F.trim(type_)
    union = type_.contains("|") & type_.contains("'")
    simple = plain.isin("string", "boolean", "number") | union
    passes = name.isin(PASS_THROUGH) | name.rlike("^aria[-A-Z]") | name.startswith("data-")
    wiring = (
        name.rlike("^on[A-Z]") | type_.contains("=> void") | type_.contains("EventHandler")
        | name.isin("ref", "innerRef", "testId", "data-testid", "dataTestId", "key") | type_.contains("Ref<") | type_.contains("RefObject<")
        | type_.contains("Dispatch<") | type_.contains("SetStateAction") | passes | ((name == "name") & F.coalesce(dom_attribute, F.lit(False)))
    )
    return (
        F.when(wiring, _hint("exclude"))
        .when(union, _hint("design", "enum"))
        .when(simple & name.rlike(DESIGN_NAME), _hint("design", "string"))
        .when((plain == "boolean") & name.isin(STATES), _hint("state", "boolean"))
        .when((plain == "boolean") & name.rlike(TOGGLE_NAME), _hint("design", "boolean"))
        .when(name.isin(IDENTIFIERS), _hint("state", "string"))
        .when((plain == "string") & (name.rlike(URL_NAME) | name.rlike(TEXT_NAME)), _hint("content", "string"))
        .when(plain == "string", _hint("content", "string"))
        .when(plain == "boolean", _hint("design", "boolean"))
        .when(plain == "number", _hint("design", "string"))
    )


def preclassify_props(props: DataFrame) -> DataFrame:
    """Add rule_category and type_hint."""
    out = props.withColumn("__r", preclassified(F.col("name"), F.col("type"), F.col("dom_attribute")))
    return out.withColumn("rule_category", F.col("__r.category")).withColumn("type_hint", F.col("__r.hint")).drop("__r")


def drop_excluded_props(props: DataFrame) -> DataFrame:
    """Excluded props go, even with a category; others keep theirs or get the rule's. dom_attribute goes too."""
    found = preclassify_props(props).filter(~F.col("rule_category").eqNullSafe("exclude"))
    return found.withColumn("category", F.coalesce("category", "rule_category")).drop("rule_category", "type_hint", "dom_attribute")


def _node_type(type_: Column) -> Column:
    parts = F.transform(F.split(F.trim(F.regexp_replace(type_, r"\s+", " ")), r"\|"), lambda p: F.trim(p))
    return F.array_join(F.filter(parts, lambda p: ~p.isin("null", "undefined")), " | ")


def becomes_slot(name: Column, type_: Column) -> Column:
    """Whether a prop of a node type is a slot: an array of nodes always, a single node unless its name is content."""
    kind = _node_type(type_)
    many = kind.isin([f"{t}[]" for t in NODE_TYPES] + [f"Array<{t}>" for t in NODE_TYPES])
    return many | (kind.isin(NODE_TYPES) & ~name.isin(CONTENT_NAMES))


def slot_typed_props(props: DataFrame) -> DataFrame:
    """Add is_slot."""
    return props.withColumn("is_slot", becomes_slot(F.col("name"), F.col("type")))
