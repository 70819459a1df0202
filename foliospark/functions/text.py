"""Text, URL, date and metadata normalisers."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token lists of the metadata mapping.
MATERIALS = {"parchment": ("parchment", "pergament"), "paper": ("paper", "papier"), "papyrus": ("papyrus",), "linen": ("linen", "leinen"), "palm": ("palm",)}
OBJECT_FORMS = {
    "codex": ("codex", "kode", "handschrift"), "fragment": ("fragment",), "composite": ("composite", "zusammengesetzt"),
    "collection": ("collection", "sammlung"), "scroll": ("scroll", "rolle"), "singleSheet": ("singlesheet", "single sheet", "einzelblatt"),
}
OBJECT_STATES = ("existent", "missing", "destroyed", "displaced", "dismembered", "unknown")
OPEN_LICENCES = ("creativecommons.org/publicdomain/zero", "creativecommons.org/publicdomain/mark", "creativecommons.org/licenses/by/")
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"
ARCHIVES, IMAGES = ("zip", "tar", "tar.gz", "tgz", "7z", "rar"), ("jpg", "jpeg", "png", "tif", "tiff", "webp", "jp2", "gif")
WEIGHTS = {"pt": "pytorch", "pth": "pytorch", "ckpt": "pytorch", "safetensors": "safetensors", "onnx": "onnx", "h5": "keras", "keras": "keras", "tflite": "tensorflow", "pb": "tensorflow"}


def has_any(col: Column, tokens) -> Column:
    out = F.lit(False)
    for token in tokens:
        out = out | F.contains(col, F.lit(token))
    return out


def metadata_lookup(items: Column, names: list[str]) -> Column:
    """Value of the first item whose lower-cased label contains one of the names."""
    wanted = F.filter(items, lambda x: has_any(F.lower(F.coalesce(x["label"], F.lit(""))), [n.lower() for n in names]))
    return F.try_element_at(wanted, F.lit(1))["value"]


def exact_lookup(items: Column, name: str) -> Column:
    """Distinct values, in order and without tags, of the items with just this label."""
    own = F.filter(items, lambda x: F.lower(x["label"]) == name.lower())
    return F.array_distinct(F.array_compact(F.transform(own, lambda x: plain_html(x["value"]))))


def yes_no(col: Column) -> Column:
    """P9."""
    value = F.lower(F.trim(col))
    return F.when(value.isin("yes", "ja", "true", "1"), "yes").when(value.isin("no", "nein", "false", "0"), "no")


def categories(col: Column, tokens: dict) -> Column:
    """P10: the names, in fixed order, any of whose tokens occur."""
    value = F.lower(col)
    found = F.array_compact(F.array(*[F.when(has_any(value, t), F.lit(name)) for name, t in tokens.items()]))
    return F.coalesce(found, F.array().cast("array<string>"))


def category(col: Column, tokens: dict) -> Column:
    """The first name any of whose tokens occurs."""
    value = F.lower(F.trim(col))
    return F.coalesce(*[F.when(has_any(value, t), F.lit(name)) for name, t in tokens.items()])


def closed(col: Column, allowed) -> Column:
    """The lower-cased value if it is allowed."""
    value = F.lower(F.trim(col))
    return F.when(value.isin(*allowed), value)


def rights_policy(licence: Column) -> Column:
    """Training is never allowed by a licence text alone."""
    is_open = has_any(F.lower(F.coalesce(licence, F.lit(""))), OPEN_LICENCES)
    return F.struct(F.lit(False).alias("training_allowed"), is_open.alias("publication_allowed"), is_open.alias("demo_allowed"), F.when(is_open, "public").otherwise("internal").alias("access_level"))


def date_range(display: Column) -> Column:
    """struct(display, not_before, not_after, method) of a free-text date."""
    numbers = lambda pattern: F.transform(F.regexp_extract_all(display, F.lit(pattern), 1), lambda x: x.cast("int"))
    centuries = numbers(r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\s+century\b")
    years = numbers(r"(?<!\d)(\d{3,4})(?!\d)")
    vague = display.rlike(r"(?i)\b(around|circa|approximately|approx\.?|ca\.?)\b")
    none = F.lit(None).cast("int")

    def out(low: Column, high: Column, method: str) -> Column:
        return F.struct(F.nullif(display, F.lit("")).alias("display"), low.alias("not_before"), high.alias("not_after"), F.lit(method).alias("method"))

    return (
        F.when(display.isNull() | (display == ""), out(none, none, "unavailable"))
        .when(F.size(centuries) > 0, out((F.array_min(centuries) - 1) * 100 + 1, F.array_max(centuries) * 100, "broad_century_range_inferred_from_source_display"))
        .when((F.size(years) > 0) & vague, out(none, none, "comparator_language_preserved_unparsed"))
        .when(F.size(years) > 0, out(F.array_min(years), F.array_max(years), "year_tokens_extracted_from_source_display"))
        .otherwise(out(none, none, "display_preserved_unparsed"))
    )


def slug(col: Column, length: int = 80, default: str = "asset") -> Column:
    """P17."""
    dashed = F.regexp_replace(col, r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.substring(F.trim(dashed, F.lit("-._")), 1, length), F.lit("")), F.lit(default))


def image_request(service: Column, source: Column, *, region: str = "full", size: str = "full", rotation: str = "0", quality: str = "default", extension: str = "jpg") -> Column:
    """The IIIF image address, or the source address; an error where there is neither (null and empty alike)."""
    address = F.concat(F.rtrim(service, F.lit("/")), F.lit(f"/{region}/{size}/{rotation}/{quality}.{extension}"))
    neither = F.raise_error(F.lit("image has neither a source address nor a service address")).cast("string")
    return F.when(service != "", address).when(source != "", source).otherwise(neither)


def canonical_url(col: Column) -> Column:
    """P19."""
    return F.regexp_replace(F.trim(col), r"/+$", "")


def url_host(col: Column) -> Column:
    """P20."""
    return F.nullif(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def path_stem(col: Column) -> Column:
    """P20: last path part without its extension."""
    return F.regexp_extract(col, r"([^/]*?)(?:\.[^./]*)?$", 1)


def leaf_side(label: Column) -> Column:
    """P21."""
    return F.when(label.rlike("[rR]$"), "recto").when(label.rlike("[vV]$"), "verso").otherwise("not recorded")


def unescape_html(col: Column, closed: bool = False) -> Column:
    """Named (HTML5) and numeric character references undone, each once; unknown ones stay as they are, and with ``closed`` those without their semicolon."""
    entity = ENTITY.removesuffix("?") if closed else ENTITY
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def decoded(m: Column) -> Column:
        body = F.rtrim(F.substring(m, 3, 10), F.lit(";"))
        point = F.when(m.rlike("^&#[xX]"), F.conv(F.substring(body, 2, 8), 16, 10)).when(F.startswith(m, F.lit("&#")), body).cast("long")
        valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, point)), 8, "0")), "UTF-32")
        return F.coalesce(char, F.try_element_at(names, F.substring(m, 2, 40)), m)

    gaps, found = F.split(col, entity, -1), F.regexp_extract_all(col, F.lit(entity), 0)
    whole = F.array_join(F.zip_with(gaps, F.transform(found, decoded), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    return F.when(F.contains(col, F.lit("&")), whole).otherwise(col)


def plain_html(col: Column, closed: bool = False) -> Column:
    """Text without tags and with character references undone (``closed``: as in ``unescape_html``); blank is null."""
    return F.nullif(F.trim(unescape_html(F.regexp_replace(col, r"<[^>]+>", ""), closed)), F.lit(""))


def first_match(col: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, escaped slashes undone first."""
    value = F.replace(col, F.lit("\\/"), F.lit("/"))
    return F.coalesce(*[F.nullif(F.regexp_extract(value, p, 1), F.lit("")) for p in patterns])


def code_group(col: Column) -> Column:
    """``HSP-C012`` belongs to ``C-code``."""
    letter = F.nullif(F.regexp_extract(col, r"^[A-Z]+-([A-Z])\d+", 1), F.lit(""))
    return F.concat(letter, F.lit("-code"))


def allowed_values(col: Column) -> Column:
    """P25: the parts between bars; none without a bar."""
    parts = F.filter(F.transform(F.split(col, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.contains(col, F.lit("|")), parts).otherwise(F.array().cast("array<string>"))


def run_state(col: Column) -> Column:
    """P40."""
    return F.when(col.isin("success", "warning"), "completed").when(col.isin("error", "failure"), "failed")


def extension(path: Column) -> Column:
    """Lower-cased; ``.tar.gz`` is one extension."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return F.when(name.endswith(".tar.gz"), "tar.gz").otherwise(F.regexp_extract(name, r"\.([^.]+)$", 1))


def file_kind(ext: Column) -> Column:
    """P41."""
    return F.when(ext.isin(*ARCHIVES), "archive").when(ext.isin(*IMAGES), "image").when(ext.isin(*WEIGHTS), "model").when(ext.isin("json", "yaml", "yml", "csv", "parquet"), "data").otherwise("other")


def framework(ext: Column) -> Column:
    """P41."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair]), ext)


def human_bytes(col: Column, largest: str = "TB") -> Column:
    """In the units up to ``largest``."""
    units = ("B", "KB", "MB", "GB", "TB")
    top = units.index(largest)
    out = F.concat(F.format_string("%.1f", F.bround(col / float(1 << 10 * top), 1)), F.lit(f" {largest}"))
    for power, unit in reversed(list(enumerate(units[1:top], 1))):
        out = F.when(col < (1 << 10 * (power + 1)), F.concat(F.format_string("%.1f", F.bround(col / float(1 << 10 * power), 1)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(col < 1024, F.concat(col.cast("string"), F.lit(" B"))).otherwise(out)


def page_of_file(name: Column) -> Column:
    """``A_12...`` names its page; other names are slugs of 24 characters."""
    letter, number = F.regexp_extract(name, r"^([A-Z])_(\d+)", 1), F.regexp_extract(name, r"^([A-Z])_(\d+)", 2)
    return F.when(letter != "", F.concat(letter, F.lit("_"), number)).otherwise(slug(name, 24))


def json_keys(col: Column) -> Column:
    """All object keys in a JSON text at any depth, lower-cased, ``-`` as ``_``, sorted; none of broken JSON.

    In valid JSON quotes stand around strings only, so the text is read string by string; keys are those before a colon.
    """
    strings = F.regexp_extract_all(col, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?'), 0)
    plain = lambda k: F.try_variant_get(F.try_parse_json(F.rtrim(F.rtrim(k, F.lit(":")), F.lit(" \t\r\n"))), "$", "string")
    keys = F.transform(F.filter(strings, lambda k: F.endswith(k, F.lit(":"))), lambda k: F.replace(F.lower(plain(k)), F.lit("-"), F.lit("_")))
    return F.when(F.try_parse_json(col).isNotNull(), F.array_sort(F.array_distinct(keys))).otherwise(F.array().cast("array<string>"))


def survival_category(fraction: Column) -> Column:
    """Null is undefined; outside [0, 1] is an error."""
    return (
        F.when(fraction.isNull(), "undefined")
        .when((fraction < 0) | (fraction > 1), F.raise_error(F.lit("survival fraction outside [0, 1]")).cast("string"))
        .when(fraction == 0, "fully_removed")
        .when(fraction <= 0.05, "mostly_destroyed")
        .when(fraction >= 0.95, "almost_complete")
        .otherwise("partial")
    )
