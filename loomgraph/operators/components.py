"""Rules over whole components, whose props and slots are arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types too vague to score, and names that need no description.
OPAQUE_TYPES = ["any", "unknown", "object", "Record<string, unknown>", "Record<string, any>"]
OBVIOUS_NAMES = (
    "className style id children disabled hidden onClick onChange onSubmit onBlur onFocus href src alt type value checked placeholder label title name"
    " required readOnly autoFocus tabIndex role aria-label aria-describedby"
).split()
NO_SURFACE = "component has no props and no slots"


def is_handler_or_ref(prop: Column) -> Column:
    kind, name = prop["type"], prop["name"]
    typed = kind.rlike(r"=>|EventHandler|Dispatch<|SetStateAction|Ref<|RefObject<|MutableRefObject")
    return typed | name.rlike("^(on|set)[A-Z]") | name.isin("ref", "innerRef")


def nonauthorable_reason(props: str = "props", slots: str = "slots", uses_context: str = "uses_context") -> Column:
    """Why a component has nothing to author, null if it has; the first of five rules decides."""
    p, context = F.col(props), F.col(uses_context)
    n = F.size(p)
    return (
        F.when((n == 0) & (F.size(slots) == 0), NO_SURFACE)
        .when(context & F.exists(p, lambda x: x["name"] == "value"), "source uses createContext and component exposes a Context.Provider value prop")
        .when(context & (n == 0), "source uses createContext and component has no props")
        .when(context & (n == 1) & ~is_handler_or_ref(F.get(p, F.lit(0))), "source uses createContext and component has a single non-handler prop")
        .when((n > 0) & F.forall(p, is_handler_or_ref), "every prop is a handler or ref")
    )


def nonauthorable_verdict(components: DataFrame) -> DataFrame:
    """Add skip and skip_reason."""
    return components.withColumn("skip_reason", nonauthorable_reason()).withColumn("skip", F.col("skip_reason").isNotNull())


def drop_hooks(components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components that aren't hooks by name, and a warning for each that is."""
    hook = F.col("name").rlike("^use[A-Z]")
    return components.filter(~hook), components.filter(hook).select("session_id", F.concat("name", F.lit(": skipped, looks like a hook")).alias("warning"))


def is_wide_union(type_: Column) -> Column:
    """A union of three primitives, or of two and null or undefined."""
    parts = F.transform(F.split(type_, r"\|"), lambda x: F.trim(x))
    base = F.size(F.filter(parts, lambda x: x.isin("string", "number", "boolean")))
    empty = F.size(F.filter(parts, lambda x: x.isin("null", "undefined")))
    return (F.size(parts) >= 3) & ((base >= 3) | ((base >= 2) & (empty > 0) & (base + empty >= 3)))


def _prop_issue(p: Column) -> Column:
    opaque, wide = F.trim(p["type"]).isin(OPAQUE_TYPES), is_wide_union(p["type"])
    bare = (F.coalesce(p["description"], F.lit("")) == "") & ~p["name"].isin(OBVIOUS_NAMES)
    return F.when(opaque, F.concat(F.lit("opaque-type:"), p["name"])).when(wide, F.concat(F.lit("wide-union:"), p["name"])).when(bare, "props-missing-description")


def score_extraction(components: DataFrame, extra_count: Column | None = None, extra_reasons: Column | None = None) -> DataFrame:
    """Add confidence (5 for no issue, down to 1 for four or more), reasons and needs_review. Of the props only the first with an issue counts."""
    n = F.size("props")
    first = F.get(F.filter(F.transform("props", _prop_issue), lambda x: x.isNotNull()), F.lit(0))
    own = F.array_compact(F.array(F.when((n == 0) & (F.size("slots") == 0), "no-props-or-slots"), F.when(n > 50, F.concat(F.lit("high-prop-count:"), n.cast("string"))), first))
    count = F.size(own) + (F.lit(0) if extra_count is None else extra_count)
    reasons = F.array_distinct(own if extra_reasons is None else F.concat(own, extra_reasons))
    confidence = F.greatest(F.lit(1), 5 - count)
    return components.withColumn("confidence", confidence).withColumn("reasons", reasons).withColumn("needs_review", confidence <= 2)


def finalize_review_flags(inspected: DataFrame) -> DataFrame:
    """Combine verdict, source inspection (wrapper_confidence, inspection_reasons, keep_despite_zero_surface), extractor reasons and score."""
    judged = nonauthorable_verdict(inspected)
    keep = (F.col("skip_reason") == NO_SURFACE) & F.col("keep_despite_zero_surface")
    held = F.col("skip") & ~F.coalesce(keep, F.lit(False))
    wrapper = F.when(F.col("wrapper_confidence") >= 4, 2).when(F.col("wrapper_confidence") == 3, 1).otherwise(0)
    held_reason = F.when(held, F.array(F.concat(F.lit("non-authorable:"), "skip_reason"))).otherwise(F.array().cast("array<string>"))
    extracted = F.coalesce("extractor_reasons", F.array().cast("array<string>"))
    scored = score_extraction(judged.withColumn("held", held), wrapper + F.size(extracted) + held.cast("int"), F.concat(extracted, F.col("inspection_reasons"), held_reason))
    unresolved = F.array_contains(extracted, "props-type-unresolved")
    return scored.withColumn("needs_review", F.col("needs_review") | (F.col("wrapper_confidence") >= 4) | F.col("keep_despite_zero_surface") | F.col("held") | unresolved)


def _issue(severity: str, code: str, at: Column | None = None) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(None).cast("string") if at is None else at).alias("field"))


def validate_components(components: DataFrame) -> DataFrame:
    """Add issues: empty names of component, props and slots, props and slots of one name, repeated names of components, empty components."""
    name = F.trim("name")
    same = F.count("*").over(Window.partitionBy("session_id", F.trim("name")))
    blank = lambda kind, code, severity: F.filter(
        F.transform(kind, lambda x, i: F.when(F.trim(x["name"]) == "", _issue(severity, code, F.concat(F.lit(f"{kind}["), i.cast("string"), F.lit("].name"))))), lambda x: x.isNotNull()
    )
    props = F.transform("props", lambda p: F.trim(p["name"]))
    clash = F.filter(
        F.transform("slots", lambda s, i: F.when((F.trim(s["name"]) != "") & F.array_contains(props, F.trim(s["name"])), _issue("error", "PROP_SLOT_NAME_COLLISION", F.concat(F.lit("slots["), i.cast("string"), F.lit("].name"))))),
        lambda x: x.isNotNull(),
    )
    one = lambda test, severity, code: F.when(test, F.array(_issue(severity, code))).otherwise(F.array().cast("array<struct<severity:string,code:string,field:string>>"))
    issues = F.concat(
        one(name == "", "error", "EMPTY_COMPONENT_NAME"),
        blank("props", "EMPTY_PROP_NAME", "error"),
        blank("slots", "EMPTY_SLOT_NAME", "warning"),
        clash,
        one((name != "") & (same > 1), "error", "DUPLICATE_COMPONENT_NAME"),
        one((F.size("props") == 0) & (F.size("slots") == 0), "warning", "EMPTY_COMPONENT"),
    )
    return components.withColumn("issues", issues)


def has_error(issues: str = "issues") -> Column:
    return F.exists(issues, lambda x: x["severity"] == "error")


def exclude_invalid(validated: DataFrame, opt_in: bool = True) -> tuple[DataFrame, DataFrame]:
    """Components without errors, and name and codes of the others. Without opt-in, reading the first fails if there are others."""
    bad = validated.filter(has_error())
    codes = F.array_join(F.transform(F.filter("issues", lambda x: x["severity"] == "error"), lambda x: x["code"]), ", ")
    report = bad.select("session_id", "component_id", "name", codes.alias("codes"))
    good = validated.filter(~has_error()) if opt_in else validated.filter(F.when(has_error(), F.raise_error(F.concat(F.lit("invalid component "), "name"))).otherwise(F.lit(True)))
    return good, report


def issue_counts(validated: DataFrame) -> DataFrame:
    of = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    return validated.select("session_id", "component_id", of("error").alias("errors"), of("warning").alias("warnings"))


def rename_empty_slots(slots: DataFrame) -> DataFrame:
    """A blank name becomes children if the component has one slot in all, else slot_ and its position."""
    total = F.count("*").over(Window.partitionBy("session_id", "component_id"))
    fresh = F.when(total == 1, "children").otherwise(F.concat(F.lit("slot_"), F.col("position").cast("string")))
    return slots.withColumn("name", F.when(F.trim("name") == "", fresh).otherwise(F.col("name")))


def _any_contains(text: Column, patterns: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: text.contains(p)) if patterns else F.lit(False)


def pattern_status(components: DataFrame, select=(), reject=(), select_all: bool = False, exclude_invalid: bool = False, exclude=()) -> DataFrame:
    """Set status by names: patterns to reject win, then invalid ones are rejected, then patterns select; exclude names reject last. Case doesn't matter for patterns."""
    lower = F.lower("name")
    status = F.when(_any_contains(lower, [p.lower() for p in reject]), "rejected")
    if select_all and exclude_invalid:
        status = status.when(has_error(), "rejected")
    status = status.when(F.lit(True) if select_all else _any_contains(lower, [p.lower() for p in select]), "accepted").otherwise(F.col("status"))
    return components.withColumn("status", F.when(F.col("name").isin(list(exclude)), "rejected").otherwise(status) if exclude else status)


def ai_flag(rows: DataFrame) -> DataFrame:
    """Add flagged (needs review, or the decision rejected or failed) and included, its opposite."""
    flagged = F.coalesce(F.col("needs_review"), F.lit(False)) | F.coalesce(F.col("decision").isin("rejected", "failed"), F.lit(False))
    return rows.withColumn("flagged", flagged).withColumn("included", ~flagged)


def strip_scoring_fields(components: DataFrame) -> DataFrame:
    return components.drop("confidence", "reasons", "needs_review")


def duplicate_names(components: DataFrame) -> DataFrame:
    """Names with more than one source, and the sources."""
    groups = components.groupBy("session_id", "name").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return groups.filter(F.size("sources") > 1)


def reject_names(components: DataFrame, names: DataFrame) -> DataFrame:
    """Status rejected for the components named."""
    named = names.select("session_id", "name").distinct().withColumn("__named", F.lit(True))
    return components.join(named, ["session_id", "name"], "left").withColumn("status", F.when(F.col("__named"), "rejected").otherwise(F.col("status"))).drop("__named")
