"""Declarations mapped to methods: key cascades, statuses, feature rules, patches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

class Rule:
    """A feature rule: where it applies, and where a translation fails it; both are column expressions, so callers may add their own."""

    def __init__(self, rule_id: str, applies: Callable[[Column], Column], fails: Callable[[Column, Column, Column], Column]):
        self.rule_id, self.applies, self.fails = rule_id, applies, fails


def _has(pattern: str) -> Callable[[Column], Column]:
    return lambda source: source.rlike("(?m)" + pattern)


def _keeps(pattern: str) -> Callable[[Column, Column, Column], Column]:
    """Fails if the translation still has what the pattern finds."""
    return lambda source, target, is_header: target.rlike("(?m)" + pattern)


def _in_headers(fails: Callable[[Column, Column], Column]) -> Callable[[Column, Column, Column], Column]:
    return lambda source, target, is_header: is_header & fails(source, target)


def _declared(source: Column, target: Column) -> Column:
    """The source's first type is not declared under its name."""
    kind, name = (F.regexp_extract(source, r"\b(class|interface|enum)\s+([A-Za-z_]\w*)", k) for k in (1, 2))
    wanted = F.when(kind == "enum", F.concat(F.lit(r"\benum(?:\s+class)?\s+"), name, F.lit(r"\b"))).otherwise(F.concat(F.lit(r"\b(?:class|struct)\s+"), name, F.lit(r"\b")))
    return (name != "") & ~F.regexp_like(target, wanted)


def _dispatch(source: Column, target: Column) -> Column:
    abstract = source.rlike(r"\([^;{}]*\)\s*;") & ~target.contains("= 0") & ~target.contains("=0")
    return source.rlike(r"\binterface\s+") & (~target.contains("virtual") | abstract)


def _constructors(source: Column, target: Column) -> Column:
    name = F.regexp_extract(source, r"\bclass\s+([A-Za-z_]\w*)", 1)
    return (name != "") & F.regexp_like(source, F.concat(F.lit(r"\b"), name, F.lit(r"\s*\("))) & ~F.regexp_like(target, F.concat(F.lit(r"\b"), name, F.lit(r"\s*\(")))


def _unlocked(source: Column, target: Column, is_header: Column) -> Column:
    return target.rlike(r"\bsynchronized\b") | ~reduce(lambda a, b: a | b, [target.contains(w) for w in ("mutex", "lock_guard", "scoped_lock", "unique_lock", "atomic")])


# The rules' ids, what they apply to and what fails them, in order.
FEATURE_RULES = (
    Rule("declaration-kind", _has(r"\b(?:class|interface|enum)\s+"), _in_headers(_declared)),
    Rule("interface-virtual-dispatch", _has(r"\binterface\s+"), _in_headers(_dispatch)),
    Rule("inheritance", _has(r"\b(?:extends|implements)\b"), _in_headers(lambda s, t: s.rlike(r"\b(?:extends|implements)\b") & ~t.rlike(r"\b(?:class|struct)\s+\w+[^\{;]*:\s*(?:public\s+)?\w+"))),
    Rule("primitive-types", _has(r"\b(?:boolean|byte|short|int|long|float|double|char)\b"), _keeps(r"\bboolean\b")),
    Rule("string", _has(r"\bString\b"), _keeps(r"(?<!:)\bString\b")),
    Rule("arrays", _has(r"\[\s*\]"), _keeps(r"\b[A-Za-z_]\w*(?:<[^;{}]+>)?\s*\[\s*\]")),
    Rule("collections-generics", _has(r"\b(?:List|ArrayList|Map|HashMap|Set|HashSet|Collection|Optional)\s*<"), _keeps(r"(?<!std::)\b(?:List|ArrayList|Map|HashMap|Set|HashSet|Collection|Optional)\s*<")),
    Rule("nullability", _has(r"\bnull\b"), _keeps(r"\bnull\b")),
    Rule("static-initialization", _has(r"\bstatic\b"), _in_headers(lambda s, t: s.rlike(r"\bstatic\b[^;()]*;") & ~t.contains("static"))),
    Rule("exceptions", _has(r"\b(?:throw|throws|Exception|Throwable)\b"), _keeps(r"\bthrows\b")),
    Rule("constructors-overloads", _has(r"\b(?:public|protected|private)\s+[A-Za-z_]\w*\s*\("), _in_headers(_constructors)),
    Rule("override", _has(r"@Override|\boverride\b"), _in_headers(lambda s, t: ~t.contains("override"))),
    Rule("synchronization", _has(r"\bsynchronized\b|\bAtomic[A-Za-z]+\b"), _unlocked),
    Rule("threading", _has(r"\b(?:Thread|ExecutorService|Future|CompletableFuture)\b"), _keeps(r"(?<!std::)\b(?:Thread|ExecutorService|Future|CompletableFuture)\b")),
    Rule("java-standard-library", _has(r"\bjava\.[A-Za-z_]"), _keeps(r"\bjava\s*(?:::|\.)")),
)


def applicable_features(source: Column, rules: tuple[Rule, ...] = FEATURE_RULES) -> Column:
    """Ids of the rules that apply to a source, in order."""
    return F.filter(F.array(*[F.when(r.applies(source), r.rule_id) for r in rules]), lambda x: x.isNotNull())


def broken_features(source: Column, target: Column, is_header: Column, rules: tuple[Rule, ...] = FEATURE_RULES) -> Column:
    """Ids of the applying rules that a translation fails."""
    return F.filter(F.array(*[F.when(r.applies(source) & r.fails(source, target, is_header), r.rule_id) for r in rules]), lambda x: x.isNotNull())


# ------------------------------------------------------------------ states of methods
def mapped_state(status: Column, location: Column, definition: Column, in_header: Column, defined: Column, template: Column, skipped_for: Column) -> Column:
    """struct(mapping_status, body_location, skip, reason) of a method that has a mapping: the first case that holds decides.

    ``in_header`` says the mapping claims a body in the header, ``defined`` that the header has one.
    """
    d = F.trim(F.coalesce(definition, F.lit("")))
    given = F.when(F.coalesce(F.trim(skipped_for), F.lit("")) != "", skipped_for)
    state = lambda s, at, skip, why: F.struct(s.alias("mapping_status"), at.alias("body_location"), F.lit(skip).alias("skip"), why.alias("reason"))
    none = F.lit("none")
    at = F.when(location.isin("header", "cpp"), location).when(F.coalesce(template, F.lit(False)), "header").otherwise("cpp")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(d == "", state(F.coalesce(F.when(status != "", status), F.lit("deleted_or_merged")), none, True, F.coalesce(given, F.lit("deleted_or_merged"))))
        .when(flag(in_header) & flag(defined), state(F.lit("already_implemented"), none, True, F.lit("already_implemented")))
        .when(d.rlike(r"=\s*0\s*;?\s*$"), state(F.lit("pure_virtual"), none, True, F.lit("pure_virtual")))
        .when(d.rlike(r"=\s*(?:default|delete)\s*;?\s*$"), state(F.lit("defaulted_or_deleted"), none, True, F.lit("defaulted_or_deleted")))
        .when(status.isin("invalid_cpp_definition", "unmapped"), state(status, none, True, F.coalesce(given, status)))
        .otherwise(state(F.when(at == "header", "needs_header_body").otherwise("needs_cpp_body"), at, False, F.lit("")))
    )


def declared_state(declaration: Column, owner_defined: Column, in_header: Column, mentioned: Column) -> Column:
    """struct(skip, deleted, reason) of a method without mapping, from its declaration in the translated header."""
    d = F.trim(F.coalesce(declaration, F.lit("")))
    state = lambda skip, deleted, why: F.struct(F.lit(skip).alias("skip"), F.lit(deleted).alias("deleted"), F.lit(why).alias("reason"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~flag(owner_defined), state(True, False, "owner_not_defined")).when(d.rlike(r"=\s*delete\s*;?\s*$"), state(True, True, "deleted")).when(d.rlike(r"=\s*0\s*;?\s*$"), state(True, False, "pure_virtual"))
        .when(d.rlike(r"=\s*default\s*;?\s*$"), state(True, False, "defaulted")).when(d.contains("{"), state(True, False, "declaration_has_body")).when(flag(in_header), state(True, False, "defined_in_header"))
        .when((d == "") & ~flag(mentioned), state(True, False, "not_declared")).otherwise(state(False, False, ""))
    )


def routing(location: Column, defined: Column, defaulted: Column, template: Column, all_to_header: Column) -> Column:
    """struct(in_header, in_cpp): where a method's code goes. Where a body is in the header already it goes nowhere."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    at = F.coalesce(location, F.lit(""))
    free = ~at.isin("header", "cpp", "none")
    up = flag(all_to_header) | flag(template)
    in_header = ~flag(defined) & ((at == "header") | free & up)
    return F.struct(in_header.alias("in_header"), ((at == "cpp") | free & ~up & ~flag(defined) & ~flag(defaulted)).alias("in_cpp"))


def key_index(methods: DataFrame, scope: list[str], keys: Column, id_col: str, order: str) -> DataFrame:
    """key -> first writer within its scope, from an array of keys by falling precision."""
    x = methods.select(*scope, id_col, order, F.posexplode(keys).alias("pos", "key"))
    return x.groupBy(*scope, "key").agg(F.min_by(F.struct(F.col(id_col), F.col("pos")), F.struct(order, id_col)).alias("m")).select(*scope, "key", F.col(f"m.{id_col}").alias(id_col))


def probe(items: DataFrame, index: DataFrame, scope: list[str], keys: Column, item_id: str, id_col: str) -> DataFrame:
    """The match of the most precise key of each item that the index has."""
    x = items.select(*scope, item_id, F.posexplode(keys).alias("pos", "key")).join(index, [*scope, "key"])
    return x.groupBy(*scope, item_id).agg(F.min(F.struct("pos", id_col)).alias("h")).select(*scope, item_id, F.col("h.pos").alias("key_pos"), F.col(f"h.{id_col}").alias(id_col))


def item_status(definition: Column, in_header: Column, deleted: Column, virtual: Column) -> Column:
    """The status that a mapped declaration gives its method."""
    d = F.trim(F.coalesce(definition, F.lit("")))
    return (
        F.when(F.coalesce(deleted, F.lit(False)), "deleted_or_merged").when(d == "", "unmapped").when(~d.contains("("), "invalid_cpp_definition").when(F.coalesce(virtual, F.lit(False)) | d.rlike(r"=\s*0\s*;?\s*$"), "pure_virtual")
        .when(d.rlike(r"=\s*(?:default|delete)\s*;?\s*$"), "defaulted_or_deleted").when(d.contains("{"), "already_implemented").when(F.coalesce(in_header, F.lit(False)), "needs_header_body").otherwise("needs_cpp_body")
    )


def completeness_violations(expected: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """Methods without mapping, mapped names nobody declares, and names mapped twice."""
    n = mapped.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = expected.select(key).distinct().withColumn("known", F.lit(True)).join(n, key, "full_outer")
    kind = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return j.withColumn("violation", kind).where("violation is not null").select(key, "violation")


def unique_in(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that alone have their key."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n"), keys)


def best_signature(pairs: DataFrame, keys: list[str], a: str, b: str, order: str) -> DataFrame:
    """Of candidate pairs with type arrays the one with most equal positions; ties: the first by ``order``."""
    score = F.aggregate(F.zip_with(a, b, lambda x, y: (x.eqNullSafe(y) & x.isNotNull()).cast("int")), F.lit(0), lambda s, x: s + x)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), order)
    return pairs.withColumn("score", score).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply_patches(files: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Replacements of a text that occurs exactly once; others are rejected and leave the file as it is."""
    j = files.join(patches, key)
    n = ((F.length("content") - F.length(F.replace("content", "original", F.lit("")))) / F.length("original")).cast("int")
    j = j.withColumn("n", F.when(F.length("original") > 0, n).otherwise(0))
    return j.select(key, F.when(F.col("n") == 1, "applied").otherwise("rejected").alias("outcome"), F.when(F.col("n") == 1, F.replace("content", "original", "new")).otherwise(F.col("content")).alias("content"))


def insert_absent(headers: DataFrame, patches: DataFrame, keys: list[str], content: str) -> tuple[DataFrame, DataFrame]:
    """(headers with the new ones, outcome per patch): a patch whose header exists is refused, of several for one header the first by content is taken."""
    one = patches.groupBy(*keys).agg(F.min(content).alias(content))
    known = headers.select(*keys).distinct().withColumn("_known", F.lit(True))
    j = one.join(known, keys, "left")
    added = j.where("_known is null").select(*keys, content, F.lit("generated_external").alias("source_kind"))
    return headers.unionByName(added, allowMissingColumns=True), j.select(*keys, F.when(F.col("_known").isNull(), "added").otherwise("exists").alias("outcome"))


def accepted_batches(outputs: DataFrame, expected: DataFrame, scope: list[str], batch: str, key: str) -> DataFrame:
    """Per batch whether it stands: one output that nobody expects rolls the whole batch back."""
    known = expected.select(*scope, key).distinct().withColumn("_known", F.lit(True))
    j = outputs.join(known, [*scope, key], "left")
    return j.groupBy(*scope, batch).agg(F.count(F.lit(1)).alias("n_outputs"), F.count_if(F.col("_known").isNull()).alias("n_unexpected")).withColumn("outcome", F.when(F.col("n_unexpected") > 0, "rolled_back").otherwise("kept"))


def semantic_warnings(java: Column, cpp: Column) -> Column:
    """What a definition lost of its method, as a list."""
    checks = [("static_lost", java.rlike(r"\bstatic\b") & ~cpp.rlike(r"\bstatic\b")), ("varargs_lost", java.contains("...") & ~cpp.rlike(r"\.\.\.|vector|initializer_list")), ("void_mismatch", java.rlike(r"\bvoid\s+\w+\s*\(") != cpp.rlike(r"\bvoid\s+[\w:]+\s*\("))]
    return F.filter(F.array(*[F.when(c, n) for n, c in checks]), lambda x: x.isNotNull())


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
