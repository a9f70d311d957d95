"""Scalar functions of the graph model as Column expressions; all stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.model import ARCHITECTURE_MARKERS, DEFAULT_PREDICATE_WEIGHT, GENERIC_NAMES, HIDDEN_PATH_PARTS, HOTSPOT_TYPES, LINEAGE_TYPES, PREDICATE_ALIASES, PREDICATE_WEIGHTS, TYPE_WEIGHTS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column, mapping: Mapping[str, object], default: Column | object) -> Column:
    """A literal table as one CASE by value."""
    out = None
    for value in sorted({str(v) for v in mapping.values()}):
        keys = [k for k, v in mapping.items() if str(v) == value]
        result = F.lit(next(v for v in mapping.values() if str(v) == value))
        out = F.when(c.isin(keys), result) if out is None else out.when(c.isin(keys), result)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def slugify(c: Column | str) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "untitled").otherwise(slug)


def canonical_name(c: Column | str) -> Column:
    return F.replace(slugify(c), F.lit("-"), F.lit(" "))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 16 hex digits; a null part counts as empty."""
    whole = F.concat_ws("::", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(whole, 256), 1, 16))


def artifact_path(c: Column | str) -> Column:
    return F.substring_index(col(c), "#", 1)


def or_else(c: Column | str, other: Column) -> Column:
    """c, or other where it is null or empty."""
    c = col(c)
    return F.when(c.isNotNull() & (c != ""), c).otherwise(other)


def public_type(p: str = "") -> Column:
    return or_else(f"{p}mapped_type", F.when(F.col(f"{p}type") == "BusinessEntity", "Concept").otherwise(F.col(f"{p}type")))


def layer(p: str = "") -> Column:
    """data or repo."""
    structured = F.coalesce(F.col(f"{p}extraction_source") == "structured_connector", F.lit(False))
    return F.when(structured | (F.coalesce(f"{p}connector", F.lit("")) != ""), "data").otherwise("repo")


def is_business(p: str = "") -> Column:
    return (layer(p) == "data") | F.coalesce(F.col(f"{p}type") == "BusinessEntity", F.lit(False))


def normal_predicate(c: Column | str) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(col(c))), "[- ]", "_")
    return lookup(plain, PREDICATE_ALIASES, plain)


def relationship_type(c: Column | str) -> Column:
    t = F.upper(F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return or_else(t, F.lit("RELATED_TO"))


def is_opaque(c: Column | str) -> Column:
    low = F.lower(F.trim(col(c)))
    return F.coalesce(low.rlike(r"^(oe:|entity_)|^[0-9a-f-]{18,}$|[0-9a-f]{24,}"), F.lit(False))


def is_test(p: str = "") -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(f"{p}name", F.lit("")), F.coalesce(f"{p}source_path", F.lit(""))))
    return text.contains("/test") | text.contains("tests/") | F.coalesce(F.col(f"{p}name").startswith("test_"), F.lit(False))


def is_meaningful(p: str = "") -> Column:
    name = F.trim(F.coalesce(f"{p}name", F.lit("")))
    low = F.lower(name)
    constant = (F.upper(name) == name) & (low != name) & name.contains("_")
    good = (name != "") & ~low.isin(*GENERIC_NAMES) & ~is_test(p) & ~low.rlike("^(oe:|entity_)") & ~constant & (F.length(name) <= 80)
    good = good & (F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) <= 8) & ~name.endswith(".")
    return (layer(p) == "data") | good


def is_actionable(p: str = "") -> Column:
    return (layer(p) == "repo") & F.col(f"{p}type").isin(*HOTSPOT_TYPES) & is_meaningful(p)


def path_parts(c: Column | str, ignored: Iterable[str] = ()) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(col(c), F.lit("")), "^/+|/+$", ""), "/")
    drop = list(ignored)
    return F.filter(parts, lambda x: ~x.isin(drop)) if drop else parts


def area(p: str = "") -> Column:
    """The community, else the first two parts of the path, else the public type."""
    parts = path_parts(f"{p}source_path", ("data", "raw"))
    from_path = F.when(F.regexp_replace(F.coalesce(f"{p}source_path", F.lit("")), "^/+|/+$", "") == "", public_type(p)).otherwise(F.array_join(F.slice(parts, 1, 2), "/"))
    return or_else(f"{p}community", from_path)


def is_visible_architecture(p: str = "") -> Column:
    parts = F.filter(F.split(F.replace(F.lower(F.coalesce(f"{p}source_path", F.lit(""))), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    hidden = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in HIDDEN_PATH_PARTS])) | F.exists(parts, lambda x: x.startswith("test_"))
    bare = (F.size(parts) == 0) & F.lower(F.coalesce(f"{p}type", F.lit(""))).isin("class", "function", "method")
    return ~F.coalesce(hidden, F.lit(False)) & ~bare


def architecture_group(p: str = "") -> Column:
    """The part after a marker folder, else the first two plain parts, else community or type."""
    parts = F.filter(path_parts(F.replace(F.coalesce(f"{p}source_path", F.lit("")), F.lit("\\"), F.lit("/"))), lambda x: (x != "") & ~x.startswith("."))
    out = None
    for marker in ARCHITECTURE_MARKERS:
        at = F.array_position(parts, F.lit(marker)).cast("int")
        here = (at > 0) & (at < F.size(parts))
        label = F.concat(F.lit(marker + "/"), F.get(parts, at))
        out = F.when(here, label) if out is None else out.when(here, label)
    rest = F.filter(parts, lambda x: ~x.isin("data", "raw", "lib", "app"))
    out = out.when((F.size(rest) > 1) & ~F.get(rest, F.lit(1)).contains("."), F.array_join(F.slice(rest, 1, 2), "/"))
    out = out.when(F.size(rest) > 0, F.regexp_replace(F.get(rest, F.lit(0)), r"\.[^.]*$", ""))
    kind = or_else(or_else(f"{p}mapped_type", F.col(f"{p}type")), F.lit("Architecture"))
    return out.otherwise(or_else(F.trim(f"{p}community"), kind))


def is_lineage(p: str = "") -> Column:
    return F.coalesce(f"{p}semantic_summary", F.lit(False)) | F.col(f"{p}type").isin(*LINEAGE_TYPES)


def predicate_weight(c: Column | str) -> Column:
    return lookup(col(c), PREDICATE_WEIGHTS, DEFAULT_PREDICATE_WEIGHT)


def type_weight(c: Column | str, default: int) -> Column:
    return lookup(col(c), TYPE_WEIGHTS, default)


def value_kind(c: Column | str) -> Column:
    """What a text value of a delimited file is read as: empty, boolean, int, float or string."""
    c = col(c)
    whole = c.rlike("^(0|[1-9][0-9]*)$")
    number = c.rlike(r"[.eE]") & c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(c.isNull() | (c == ""), "empty").when(F.lower(c).isin("true", "false"), "boolean").when(whole, "int").when(number, "float").otherwise("string")


def clamp(c: Column | str, default: float = 0.7) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(c).cast("double"), F.lit(default))))


def edge_evidence(p: str = "") -> Column:
    """authoritative, evidence_backed or weak."""
    structured = F.coalesce(F.col(f"{p}extraction_source") == "structured_connector", F.lit(False))
    some = (F.coalesce(f"{p}evidence_text", F.lit("")) != "") | (F.coalesce(f"{p}source_path", F.lit("")) != "")
    return F.when(structured, "authoritative").when(some, "evidence_backed").otherwise("weak")


def truncate(c: Column | str, limit: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)
