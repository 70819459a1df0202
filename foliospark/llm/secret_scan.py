"""Secret scan: fixed patterns, and corpus-wide ownership of the values they find."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


@dataclass(frozen=True)
class Kind:
    """A pattern; ``value`` is the group that holds the secret, ``least`` its fewest characters."""

    name: str
    pattern: str
    value: int
    least: int


BASE_KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]+", 0, 24),
)
# Longer runs of key characters, for the ownership test only; letters and digits must mix.
OPEN_KIND = Kind("open", r"[A-Za-z0-9_+/-]{20,}", 0, 20)


def _quick(kind: Kind) -> str:
    """The pattern with its length bound inside, where that cannot change what matches: a class run."""
    return kind.pattern.replace("]+", f"]{{{kind.least - len(kind.pattern.partition('[')[0])},}}") if kind.value == 0 and kind.pattern.endswith("]+") else kind.pattern


def _matches(text: Column, kind: Kind) -> Column:
    """Struct of the lengths of the matches and of the gaps before and after each, and of each value length, hash and make-up: what is staged holds no secret."""
    pattern = F.lit(_quick(kind))
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    shape = lambda v: F.struct(F.char_length(v).alias("n"), F.xxhash64(v, F.char_length(v)).alias("hash"), (v.rlike("[0-9]") & v.rlike("[A-Za-z]")).alias("mixed"))
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(kind.value)), shape)
    gaps = F.transform(F.split(text, _quick(kind), -1), F.char_length)
    some = text.rlike(_quick(kind))
    return F.when(some, F.struct(F.lit(kind.name).alias("kind"), F.lit(kind.least).alias("least"), gaps.alias("gaps"), found.alias("found"), value.alias("value")))


def find_candidates(docs: DataFrame, kinds: tuple[Kind, ...], *, id_col: str, text_col: str, owner_col: str | None) -> DataFrame:
    """(doc_id, digest, owner, hits) of every row: one reading of the text. Equal id and digest mean equal rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col else F.lit("")
    hits = F.array_compact(F.array(*[_matches(F.col("t"), k) for k in kinds]))
    plain = docs.select(F.col(id_col).alias("doc_id"), owner.alias("owner"), text.alias("t"))
    return plain.select("doc_id", F.xxhash64("t", F.char_length("t")).alias("digest"), "owner", hits.alias("hits"))


def spans_of(candidates: DataFrame) -> DataFrame:
    """(doc_id, digest, owner, kind, start, end, value_hash, mixed): matches long enough, in code points.

    Positions are running sums of gaps and matches, by a window over one document's matches.
    """
    keys = ["doc_id", "digest", "owner"]
    once = candidates.where(F.size("hits") > 0).dropDuplicates(keys)
    each = once.select(*keys, F.explode("hits").alias("h")).select(*keys, "h.kind", "h.least", F.posexplode(F.arrays_zip("h.gaps", "h.found", "h.value")).alias("pos", "m"))
    upto = Window.partitionBy(*keys, "kind").orderBy("pos")
    length = F.coalesce("m.found", F.lit(0))
    each = each.withColumn("end", F.sum(F.col("m.gaps") + length).over(upto))
    each = each.where("m.found is not null").where(F.col("m.value.n") >= F.col("least"))
    return each.select(*keys, "kind", (F.col("end") - length).alias("start"), "end", (F.col("end") - F.col("m.value.n")).alias("value_start"), F.col("m.value.hash").alias("value_hash"), F.col("m.value.mixed").alias("mixed"))


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners): how many documents and owners hold a value.

    Each level is summed in every task before its shuffle, so a value in a third of all documents is
    a few rows by the time it is moved.
    """
    by_doc = spans.groupBy("value_hash", "owner", "doc_id", "digest").agg(F.lit(1).alias("one"))
    by_owner = by_doc.groupBy("value_hash", "owner").agg(F.count("*").alias("documents"))
    return by_owner.groupBy("value_hash").agg(F.sum("documents").alias("repositories"), F.count("*").alias("owners"))


def scan_secrets(docs: DataFrame, *, max_owners: int = 1, max_repositories: int = 3, kinds: tuple[Kind, ...] = BASE_KINDS, open_kind: Kind | None = OPEN_KIND, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source") -> DataFrame:
    """One row per document: (doc_id, n_<kind> for each kind, n_live, n_example, base_spans, spans).

    Base spans are the leftmost non-overlapping matches of each kind whose value is long
    enough. Their values and open key-like runs are then counted over the whole corpus: by distinct
    documents (repositories) and distinct ``owner_col`` values (owners). A value with letters and
    digits that at most ``max_owners`` owners hold, in at most ``max_repositories`` documents,
    looks live: its span is added as kind "live". Others are widely copied examples; those
    of base kinds stay in the result and are counted in n_example.

    ``base_spans`` and ``spans`` are arrays of (start, rank, kind, end), by start, then kind as
    listed. A null text is empty; null owners count as one owner; a null id is a document of its
    own; repeated rows are each returned and count once; an empty table gives no rows; other columns, whatever their names,
    are ignored. A very long text is one row of spans, nothing more.
    """
    every = (*kinds, open_kind) if open_kind else kinds
    found = stage(find_candidates(docs, every, id_col=id_col, text_col=text_col, owner_col=owner_col))
    spans = stage(spans_of(found))
    names = [k.name for k in kinds]
    rank = F.array_position(F.array(*[F.lit(n) for n in [*names, "live"]]), F.col("kind")).cast("int")
    # Staged, so that both sides of the join are plain shuffles: Spark then splits the spans of a value copied everywhere.
    known = spans.join(stage(ownership(spans)), "value_hash")
    live = F.col("mixed") & (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    keys = ["doc_id", "digest", "owner"]
    base = known.where(F.col("kind").isin(names)).select(*keys, "kind", "start", "end", live.alias("live"))
    added = known.where(live).select(*keys, F.lit("live").alias("kind"), F.col("value_start").alias("start"), "end", F.lit(True).alias("live")).dropDuplicates([*keys, "start", "end"])
    entry = F.struct("start", rank.alias("rank"), "kind", "end")
    counts = [F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{n}") for n in [*names, "live"]]
    by_doc = base.union(added).groupBy(*keys).agg(*counts, F.count(F.when(~F.col("live"), 1)).alias("n_example"), F.array_sort(F.collect_list(entry)).alias("spans"))
    d, s = found.select(*keys).alias("d"), by_doc.alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.digest") == F.col("s.digest")) & (F.col("d.owner") == F.col("s.owner"))
    all_spans = F.coalesce("s.spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    numbers = [F.coalesce(f"s.{c}", F.lit(0)).alias(c) for c in [*(f"n_{n}" for n in [*names, "live"]), "n_example"]]
    return d.join(s, same, "left").select("d.doc_id", *numbers, F.filter(all_spans, lambda x: x["kind"] != "live").alias("base_spans"), all_spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
