"""Versioned label rules (P26, P27): data, applied as one expression over a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (code, pattern) in order; patterns are case-insensitive.
REJECTION_V1 = (
    ("cover", r"\b(front|back|rear)?\s*cover\b"),
    ("paste_down", r"\bpaste[ -]?down\b"),
    ("binding", r"\bbinding\b|\bspine\b"),
    ("blank", r"\bblank(?: page)?\b|\bempty page\b"),
    ("color_target", r"\bcolou?r\s*(target|chart|bar)\b"),
    ("calibration", r"\bcalibrat(?:ion|ion image|e)\b|\btest chart\b"),
    ("digitization_target", r"\b(gray|grey)\s*scale\b|\bdigitization target\b"),
    ("administrative", r"\b(administrative|copyright)\s*(image|page|notice)\b"),
)
REJECTION_V2 = (
    *REJECTION_V1,
    ("color_target", r"\b(?:digital\s+)?colou?r(?:checker|\s+profile)\b"),
    ("digitization_target", r"^(?:ruler|qp\s*card)(?:\s+on\s+(?:page|binding))?$"),
    ("object_view", r"^(?:fore edge|head|tail|open view)(?:\s+[a-z])?$"),
)
REVIEW_V2 = (("uncertain_accompanying_materials", r"^accompanying materials(?:\s+\d+[rv]?)?$"),)


def rule_matches(label: Column, rules) -> Column:
    """array<struct<code, evidence>>: the rules that match, with the matched text untrimmed."""
    text = F.coalesce(label, F.lit(""))
    found = [F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(code).alias("code"), F.regexp_extract(text, f"(?i){p}", 0).alias("evidence"))) for code, p in rules]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<code:string,evidence:string>>")


def image_reasons(n_images: Column, n_addresses: Column) -> Column:
    """Structural reasons: no image at all, or none with an address."""
    one = lambda code, evidence: F.struct(F.lit(code).alias("code"), F.lit(evidence).alias("evidence"))
    return F.array_compact(F.array(F.when(n_images == 0, one("no_image_asset", "no image body")).when(n_addresses == 0, one("no_downloadable_image", "no address"))))
