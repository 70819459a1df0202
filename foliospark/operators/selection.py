"""Seeded page selection, replacement, splits and rule-version audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_digest
from . import ranking

SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def select_pages(pages: DataFrame, *, seed, quota: int, decisions: DataFrame | None = None, unsuitable: DataFrame | None = None) -> DataFrame:
    """Every page with its status, reasons, review status, eligibility and ranks.

    ``pages``: group_id, page_id, sequence, reject_codes and review_codes (arrays of strings).
    ``decisions``: page_id, decision (keep or reject). ``unsuitable``: group_id.
    Pages that no rule rejects or doubts are ranked within their group by seeded digest, sequence
    and id, before and after human decisions; the first ``quota`` of the latter rank are selected. A
    selected page beyond the quota of the former rank replaces the rejected ones.
    Precedence: human reject, rule, unsuitable group, doubt, selected, over quota. A keep resolves a
    doubt; it never overrides a rule (see ``decision_conflicts``).
    """
    df = pages
    if decisions is None:
        df = df.withColumn("decision", F.lit(None).cast("string"))
    else:
        df = df.join(decisions.select("page_id", "decision"), "page_id", "left")
    if unsuitable is None:
        df = df.withColumn("unsuitable", F.lit(False))
    else:
        df = df.join(unsuitable.select("group_id").distinct().withColumn("unsuitable", F.lit(True)), "group_id", "left").fillna(False, ["unsuitable"])
    keep, reject = F.coalesce(F.col("decision") == "keep", F.lit(False)), F.coalesce(F.col("decision") == "reject", F.lit(False))
    ruled, doubt = F.size("reject_codes") > 0, F.size("review_codes") > 0
    df = df.withColumn("digest", stable_digest(seed, F.col("group_id"), F.col("page_id")))
    df = df.withColumn("original", ~ruled & ~doubt).withColumn("accepted", ~F.col("unsuitable") & ~ruled & (~doubt | keep) & ~reject)
    df = ranking.ranks(df, ["group_id"], ["digest", "sequence", "page_id"], {"original_rank": F.col("original"), "rank": F.col("accepted")})
    # At most ``quota`` rejected pages of a group stood within the quota, so this list is bounded.
    gone = df.where(reject & (F.col("original_rank") <= quota)).groupBy(F.col("group_id").alias("_group")).agg(F.collect_list(F.struct(F.col("original_rank").alias("r"), F.col("page_id").alias("p"))).alias("_gone"))
    df = df.join(gone, F.col("group_id").eqNullSafe(F.col("_group")), "left").drop("_group")
    df = df.withColumn("replaced", F.transform(F.array_sort(F.coalesce("_gone", F.array().cast(gone.schema["_gone"].dataType))), lambda x: x["p"].cast("string")))
    chosen = F.col("rank") <= quota
    replacement = chosen & (F.col("original_rank") > quota) & (F.size("replaced") > 0)
    one = lambda *codes: F.array(*[F.lit(c) for c in codes])
    status = F.when(reject | ruled, "rejected").when(F.col("unsuitable"), "candidate").when(doubt & ~keep, "candidate").when(chosen, "selected").otherwise("candidate")
    reasons = (
        F.when(reject, F.concat(one("explicit_manual_review_reject"), F.col("reject_codes")))
        .when(ruled, F.col("reject_codes"))
        .when(F.col("unsuitable"), F.concat(one("manuscript_unsuitable_for_training_corpus"), F.col("review_codes")))
        .when(doubt & ~keep, F.col("review_codes"))
        .when(replacement, one("deterministic_seeded_selection", "deterministic_same_manuscript_replacement"))
        .when(chosen, one("deterministic_seeded_selection"))
        .otherwise(one("eligible_not_selected_page_limit"))
    )
    review = (
        F.when(reject, "resolved_reject").when(ruled, "not_required").when(F.col("unsuitable"), "manuscript_excluded").when(doubt & ~keep, "needs_manual_review")
        .when(keep, "resolved_keep").when(chosen, "post_download_review_required").otherwise("not_reviewed")
    )
    eligible = ~(reject | ruled | F.col("unsuitable") | (doubt & ~keep))
    return df.select(
        "group_id", "page_id", "sequence", "decision", status.alias("status"), reasons.alias("reasons"), review.alias("review_status"), eligible.alias("eligible"), "original_rank", "rank",
        F.when(replacement, F.col("replaced")).alias("replaces"), F.size("replaced").alias("group_rejected"),
    )


def decision_conflicts(pages: DataFrame, decisions: DataFrame) -> DataFrame:
    """Errors of W1 as rows (rule, key): decisions on unknown pages, sequence mismatches, keeps against a rule, repeats."""
    joined = decisions.alias("d").join(pages.alias("p"), "page_id", "left")
    unknown, found = F.col("p.group_id").isNull(), F.col("p.group_id").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(unknown, "unknown_page"),
        F.when(found & ~F.col("p.sequence").eqNullSafe(F.col("d.sequence")), "sequence_differs"),
        F.when(found & (F.col("d.decision") == "keep") & (F.size("p.reject_codes") > 0), "keep_overrides_rule"),
        F.when(~F.col("d.decision").isin("keep", "reject"), "unknown_decision"),
    ))
    found_rows = joined.select(F.explode(kinds).alias("rule"), F.col("page_id").cast("string").alias("key"))
    twice = decisions.groupBy("page_id").count().where("count > 1").select(F.lit("repeated_decision").alias("rule"), F.col("page_id").cast("string").alias("key"))
    return found_rows.union(twice)


def split_sizes(total: int, ratios: dict[str, float] = SPLITS) -> dict[str, int]:
    """Largest-remainder counts: floors first, the rest by remainder, ties by order."""
    exact = {k: total * r for k, r in ratios.items()}
    out = {k: math.floor(v) for k, v in exact.items()}
    by_rest = sorted(ratios, key=lambda k: -(exact[k] - out[k]))
    for k in by_rest[: total - sum(out.values())]:
        out[k] += 1
    return out


def assign_splits(groups: DataFrame, key: str, *, seed, ratios: dict[str, float] = SPLITS) -> DataFrame:
    """(key, position, split): whole groups in seeded order, cut into contiguous splits.

    Positions come from ranges of the order and the counts before them, the sizes from the number of groups, so no task orders them all.
    """
    keys = groups.select(key).distinct()
    numbered = ranking.numbered(keys.withColumn("_digest", stable_digest(seed, F.col(key))), ["_digest", key], "position").drop("_digest")
    placed = numbered.withColumn("position", F.col("position").cast("int")).join(F.broadcast(keys.agg(F.count("*").alias("total"))))  # a one-row aggregate
    exact = {k: F.col("total") * F.lit(r) for k, r in ratios.items()}
    # The rest by remainder is worked out in columns, so the number of groups never comes to the driver.
    rest = F.array_sort(F.array(*[F.struct((-(v - F.floor(v))).alias("r"), F.lit(i).alias("i")) for i, v in enumerate(exact.values())]))
    spare = F.col("total") - sum((F.floor(v) for v in exact.values()), F.lit(0))
    ranks = F.transform(rest, lambda x: x["i"])
    upto: Column = F.lit(0)
    split = F.lit(None).cast("string")
    bounds = []
    for i, (name, v) in enumerate(exact.items()):
        upto = upto + F.floor(v) + F.when(F.array_position(ranks, i) <= spare, 1).otherwise(0)
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        split = F.when(F.col("position") <= bound, F.lit(name)).otherwise(split)
    return placed.select(key, "position", split.alias("split"))


def split_leakage(pages: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split, with the splits and the number of rows."""
    found = pages.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("rows"))
    return found.where(F.size("splits") > 1)


def transitions(before: DataFrame, after: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(transition, rows): how statuses change under new rules."""
    both = before.select(key, F.col(status).alias("old")).join(after.select(key, F.col(status).alias("new")), key)
    return both.groupBy(F.concat_ws("->", "old", "new").alias("transition")).agg(F.count("*").alias("rows"))


def trace_rejections(selected: DataFrame, *, quota: int) -> DataFrame:
    """Each group with human rejections inside the quota: replacements found, or a shortfall."""
    by = selected.groupBy("group_id").agg(
        F.count(F.when((F.col("decision") == "reject") & (F.col("original_rank") <= quota), 1)).alias("rejected"),
        F.count(F.when(F.size("replaces") > 0, 1)).alias("replacements"),
        F.count(F.when(F.col("status") == "selected", 1)).alias("selected"),
    )
    outcome = F.when(F.col("rejected") == 0, "unchanged").when(F.col("selected") >= quota, "replaced").otherwise("shortfall")
    return by.select("group_id", "rejected", "replacements", "selected", (F.lit(quota) - F.col("selected")).alias("shortfall"), outcome.alias("outcome"))
