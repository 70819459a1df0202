"""Data-quality rules (V1-V14): each gives violations (rule, key, detail) instead of an exception."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUMAN_STATES = ("approved_for_training", "rejected_for_training", "needs_follow_up")
STATES = ("pending", *HUMAN_STATES)
# The words that decisions may hold.
PAGE_DECISIONS = ("keep", "reject")
PAGE_SCOPES = ("training_corpus_selection", "replacement_suitability_review")
APPLICATIONS = ("batch_selection", "audit_only_frozen_corpus", "review_evidence_only")
SUITABILITY_DECISIONS = ("suitable_for_training_corpus", "unsuitable_for_training_corpus")
SUITABILITY_SCOPE = "manuscript_training_corpus_suitability"
SPLITS = ("train", "validation", "test")


def row_rules(df: DataFrame, key: Column, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Any number of row predicates in one pass: {rule: (violated, detail)}; a null predicate is no violation."""
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(name).alias("rule"), F.coalesce(detail.cast("string"), F.lit("null")).alias("detail"))) for name, (bad, detail) in rules.items()]))
    return df.select(key.cast("string").alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.detail")


def required(df: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """V2: null or blank required fields."""
    return row_rules(df, key, {f"required:{f}": (F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields})


def _outside(name: str, value: Column, allowed: tuple) -> dict[str, tuple[Column, Column]]:
    return {f"domain:{name}": (value.isNotNull() & ~value.isin(*allowed), F.col(name))}


def _elsewhere(corpus: str | None) -> dict[str, tuple[Column, Column]]:
    return {} if corpus is None else {"decision:other_corpus": (~F.col("corpus_id").eqNullSafe(F.lit(corpus)), F.col("corpus_id"))}


def page_decisions(df: DataFrame, key: Column, *, corpus: str | None = None, batch: bool = False) -> DataFrame:
    """V3: faults of decisions (decision, decision_scope, selection_application, sequence_index, split) on pages; nulls are for ``required`` to find.

    Case and outer spaces of the decision do not count. With ``batch`` only decisions of batch selection, in the scope of corpus selection, may
    take effect; with ``corpus`` only those of this ``corpus_id``.
    """
    rules = _outside("decision", F.lower(F.trim("decision")), PAGE_DECISIONS) | _outside("decision_scope", F.col("decision_scope"), PAGE_SCOPES)
    rules |= _outside("selection_application", F.col("selection_application"), APPLICATIONS) | _outside("split", F.col("split"), SPLITS)
    rules["decision:negative_sequence"] = F.col("sequence_index") < 0, F.col("sequence_index")
    if batch:
        rules["decision:not_batch_selection"] = F.col("selection_application") != "batch_selection", F.col("selection_application")
        rules["decision:not_corpus_scope"] = F.col("decision_scope") != "training_corpus_selection", F.col("decision_scope")
    return row_rules(df, key, rules | _elsewhere(corpus))


def suitability_decisions(df: DataFrame, key: Column, *, corpus: str | None = None) -> DataFrame:
    """V3: faults of decisions (decision, decision_scope, selection_application) on whole groups; they always act on batch selection."""
    rules = _outside("decision", F.lower(F.trim("decision")), SUITABILITY_DECISIONS) | _outside("decision_scope", F.col("decision_scope"), (SUITABILITY_SCOPE,))
    rules["decision:not_batch_selection"] = F.col("selection_application") != "batch_selection", F.col("selection_application")
    return row_rules(df, key, rules | _elsewhere(corpus))


def domains(df: DataFrame, key: Column, allowed: dict[str, tuple]) -> DataFrame:
    """V3, V4: values outside a closed domain."""
    return row_rules(df, key, {f"domain:{f}": (F.col(f).isNotNull() & ~F.col(f).isin(*a), F.col(f)) for f, a in allowed.items()})


def ranges(df: DataFrame, key: Column, bounds: dict[str, tuple]) -> DataFrame:
    """V5: values outside [low, high]; either may be None."""
    rules = {}
    for f, (low, high) in bounds.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(f) < low)
        if high is not None:
            bad = bad | (F.col(f) > high)
        rules[f"range:{f}"] = (bad, F.col(f))
    return row_rules(df, key, rules)


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df if tasks is None else df.repartition(tasks, *keys)


def unique(df: DataFrame, fields: list[str], name: str, *, tasks: int | None = None) -> DataFrame:
    """V6: repeated keys, with how often they occur.

    Fields are counted as they are and only repeated ones are spelt. With ``tasks`` rows are dealt to that many tasks, where Spark would
    count tasks by compressed bytes, of which keys are many times as many in memory.
    """
    found = _dealt(df.select(*fields), tasks, *fields).groupBy(*fields).agg(F.count("*").alias("_n")).where("_n > 1")
    key = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("null")) for f in fields])
    return found.select(F.lit(f"unique:{name}").alias("rule"), key.alias("key"), F.col("_n").cast("string").alias("detail"))


def foreign_keys(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, name: str, *, tasks: int | None = None) -> DataFrame:
    """V7: child keys without a parent, each once, with the number of rows. ``tasks`` as for ``unique``."""
    held = _dealt(children.where(F.col(child_key).isNotNull()).select(child_key), tasks, child_key).groupBy(child_key).agg(F.count("*").alias("n"))
    lost = held.join(_dealt(parents.select(F.col(parent_key).alias(child_key)), tasks, child_key), child_key, "left_anti")
    return lost.select(F.lit(f"foreign_key:{name}").alias("rule"), F.col(child_key).cast("string").alias("key"), F.col("n").cast("string").alias("detail"))


def isolated(df: DataFrame, group: Column, split: str) -> DataFrame:
    """V8: groups in several splits."""
    found = df.groupBy(group.cast("string").alias("key")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    return found.select(F.lit("isolation").alias("rule"), "key", F.array_join("s", ",").alias("detail"))


def boxes(df: DataFrame, key: Column, tolerance: float = 0.002) -> DataFrame:
    """V9: boxes (x0, y0, x1, y1, w, h, page_w, page_h) off the page, empty, or at odds with their width and height."""
    far = lambda a, b: F.abs(a - b) > tolerance
    outside = (F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") > F.col("page_w")) | (F.col("y1") > F.col("page_h"))
    return row_rules(df, key, {
        "box:outside": (outside, F.lit("page")), "box:empty": ((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), F.lit("area")),
        "box:size": (far(F.col("x1") - F.col("x0"), F.col("w")) | far(F.col("y1") - F.col("y0"), F.col("h")), F.lit("w,h")),
    })


def cardinalities(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``expected`` (key, expected) against the rows of ``actual`` by key; also unexpected keys."""
    n = actual.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))
    both = expected.select(F.col(key).cast("string").alias("key"), "expected").join(n, "key", "full_outer")
    bad = both.where(~F.col("expected").eqNullSafe(F.coalesce("n", F.lit(0))))
    return bad.select(F.lit("cardinality").alias("rule"), "key", F.concat(F.lit("expected "), F.coalesce(F.col("expected").cast("string"), F.lit("none")), F.lit(", found "), F.coalesce("n", F.lit(0)).cast("string")).alias("detail"))


def selection_invariants(pages: DataFrame, key: Column) -> DataFrame:
    """Each status has a reason; what is rejected is never eligible."""
    return row_rules(pages, key, {"status_without_reason": (F.size("reasons") == 0, F.col("status")), "rejected_but_eligible": ((F.col("status") == "rejected") & F.col("eligible"), F.col("status"))})


def rights_state(df: DataFrame, key: Column) -> DataFrame:
    """V1: ``status``, ``training_allowed`` and ``review`` (struct) of image assets are coherent."""
    r = F.col("review")
    when = F.try_to_timestamp(r["reviewed_at"])
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    has = r.isNotNull()
    return row_rules(df, key, {
        "rights:status": (~F.col("status").isin(*STATES), F.col("status")),
        "rights:flag": (F.col("training_allowed") != (F.col("status") == "approved_for_training"), F.col("training_allowed")),
        "rights:provenance_missing": (F.col("status").isin(*HUMAN_STATES) & r.isNull(), F.col("status")),
        "rights:version": (has & blank(r["review_version"]), F.lit("review_version")),
        "rights:reviewer": (has & blank(r["reviewer"]), F.lit("reviewer")),
        "rights:reason": (has & blank(r["decision_reason"]), F.lit("decision_reason")),
        "rights:time": (has & (when.isNull() | ~r["reviewed_at"].rlike(r"(Z|[+-]\d\d:?\d\d)$")), r["reviewed_at"]),
        "rights:status_differs": (has & ~r["rights_review_status"].eqNullSafe(F.col("status")), r["rights_review_status"]),
        "rights:flag_differs": (has & ~r["training_allowed"].eqNullSafe(F.col("training_allowed")), r["training_allowed"]),
    })


def approved(df: DataFrame) -> DataFrame:
    """C4: rows that a valid human decision allows for training."""
    bad = rights_state(df, F.col("asset_id")).select(F.col("key").alias("_k")).distinct()
    return df.where((F.col("status") == "approved_for_training") & F.col("training_allowed")).join(bad, df.asset_id.cast("string") == F.col("_k"), "left_anti")


def specification(spec: DataFrame) -> DataFrame:
    """Sources of a corpus specification (id, manifest_url, train, validation, test, training_allowed, rules_version)."""
    from ..functions.text import canonical_url

    rows = row_rules(spec, F.col("id"), {
        "spec:id": (F.col("id").isNull() | (F.trim("id") == ""), F.col("id")), "spec:url": (F.col("manifest_url").isNull() | (F.trim("manifest_url") == ""), F.col("manifest_url")),
        "spec:ratios": (F.abs(F.col("train") + F.col("validation") + F.col("test") - 1) > 1e-9, F.col("train") + F.col("validation") + F.col("test")),
        "spec:training": (F.col("training_allowed"), F.lit("true")), "spec:rules": (~F.col("rules_version").isin("v0.1", "v0.2"), F.col("rules_version")),
    })
    same_url = spec.select(canonical_url(F.col("manifest_url")).alias("url"))
    return rows.unionByName(unique(spec, ["id"], "spec_id")).unionByName(unique(same_url, ["url"], "spec_url"))


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def enforce(found: DataFrame) -> None:
    """Strict mode: raise if there is any violation, naming a few."""
    some = found.limit(5).collect()
    if some:
        raise ValueError("; ".join(f"{r.rule} {r.key} {r.detail}" for r in some))
