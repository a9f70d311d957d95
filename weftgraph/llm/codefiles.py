"""Generated, minified or vendored source files, and data saved as code.

Method: layout statistics against thresholds tuned per language.  Of each span the number
of characters and lines, the longest line, the lines that repeat another one's shape, and the
characters in white space, letters and digits, numeric literals and long encoded runs are
counted in the JVM; a file has their sums and maxima.  Layout can't tell a generated or copied
file that is laid out like any other, so marks of origin are one more feature: what the leading
comment says in the usual idioms of generators and licences, and how path and file are named.
``marks=False`` leaves them out, to see what layout alone finds.

Only those few numbers are exchanged, never texts, and a file's spans are summed on the map
side: order, lost offsets, repeated spans and a file with very many spans do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """A file is minified or data from these values on."""

    mean_line: float = 110.0
    max_line: int = 300
    whitespace: float = 0.07  # at most, together with a line of max_line
    numeric: float = 0.33  # share of the visible characters in numeric literals
    encoded: float = 0.35  # share of all characters in long encoded runs
    alphanumeric: float = 0.97  # share of the visible characters, if hardly any are blank
    repeated: float = 0.85  # share of ten lines or more whose shape another one has
    prose: float = 0.1  # long lines with fewer signs than this are prose, not code


#: By file ending; SQL and Go have longer statements on a line, style sheets many numbers.
LANGUAGES = {
    "py": Thresholds(mean_line=100.0),
    "js": Thresholds(),
    "ts": Thresholds(),
    "css": Thresholds(numeric=0.6),
    "go": Thresholds(mean_line=130.0),
    "sql": Thresholds(mean_line=160.0, whitespace=0.04, numeric=0.4),
}
OTHER = Thresholds(mean_line=150.0)

# Idioms by which generators and licences mark a file, within the comment it begins with.
GENERATED = (
    r"\b(?:code|file|source|auto|automatically|machine|tool)[- ]?(?:is |was |has been )?(?:auto|automatically |machine[- ])?(?:generated|produced|created|written|made)\b|@generated\b"
    r"|\bgenerated (?:by|from|with|using|file|code|automatically)\b|\b(?:do not|don't|never) (?:edit|modify|change)(?: this file\b| by hand\b| manually\b|[^\w\n]*$)|\bregenerate\b|\bbuild (?:product|artifact|artefact|output)\b"
    r"|\b(?:edits|changes|modifications)\b[^\n]{0,40}\b(?:lost|overwritten|template|generator)\b"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|\bnicht (?:bearbeiten|ändern|editieren)\b"
    r"|\b(?:généré|produit|créé)e? (?:automatiquement|par)\b|\bne pas (?:modifier|éditer)\b|\b(?:generado|producido|creado) (?:automáticamente|por)\b|\bno (?:editar|modificar)\b|自動生成"
)
VENDORED = (
    r"\bvendored\b|\bcopied from\b[^\n]{0,80}(?:upstream|\d)|\bupstream\s*:|\bredistribution\b[^\n]{0,20}\bin source\b|\(c\) [^\n]{0,60}\bauthors\b"
    r"|\b(?:released|licensed) under the\b|\bsee licen[sc]e\b|@license\b|\bthird[- ]party\b"
)
GENERATED_PATHS = r"(?:^|/)(?:generated|__generated__|autogen|gen)/|[._-](?:gen|generated|pb|g)\.[a-z]+$|_pb2(?:_grpc)?\.pyi?$"
VENDORED_PATHS = r"(?:^|/)(?:node_modules|bower_components|vendor|_vendor|vendored|third_party|third-party|thirdparty|deps|site-packages|external/[^/]+)/"
MINIFIED_PATHS = r"[.-]min\.(?:js|css|mjs)$|(?:^|/)(?:bundle|chunk)[.-][0-9a-f]+\.(?:js|css)$"

#: From this length on a line's signs are counted, to tell packed code from prose.
LONG_LINE = 250

_COUNTS = ("chars", "lines", "blank", "alnum", "numeric", "encoded", "long_chars", "long_signs", "repeated")


def clean_path(path: Column) -> Column:
    """Up to ``#``, with slashes, without leading ``./`` or doubled slashes."""
    plain = F.regexp_replace(F.trim(F.regexp_extract(path, r"^[^#]*", 0)), r"\\+", "/")
    return F.regexp_replace(F.regexp_replace(plain, "/{2,}", "/"), r"^(?:\./)+", "")


def _header(rows: Column) -> Column:
    """The comment and blank lines a text begins with."""
    code = F.transform(rows, lambda x: ~x.rlike(r"^\s*(?:#|//|--|/\*|\*|<!--|\"\"\"|$)"))
    at = F.array_position(code, F.lit(True)).cast("int")
    return F.array_join(F.when(at > 0, F.slice(rows, 1, F.greatest(at - 1, F.lit(0)))).otherwise(rows), "\n")


def _statistics(text: Column) -> list[Column]:
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    rows = F.split(text, r"\r\n|\r|\n")
    lengths = F.transform(rows, lambda x: F.length(x))
    header, shapes = _header(rows), F.transform(F.filter(rows, lambda x: F.length(x) > 0), lambda x: F.regexp_replace(F.regexp_replace(x, "[A-Za-z_]+", "a"), "[0-9]+", "0"))
    long = F.array_join(F.filter(rows, lambda x: F.length(x) >= LONG_LINE), "")
    return [
        F.length(text).cast("long").alias("chars"),
        F.size(F.filter(lengths, lambda n: n > 0)).cast("long").alias("lines"),
        without(r"\s").cast("long").alias("blank"),
        without(r"[A-Za-z0-9]").cast("long").alias("alnum"),
        without(r"(?<!\w)(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?!\w)").cast("long").alias("numeric"),
        without(r"[A-Za-z0-9+/=]{64,}|(?:\\x[0-9A-Fa-f]{2}){8,}|(?:\\u[0-9A-Fa-f]{4}){8,}").cast("long").alias("encoded"),
        F.length(long).cast("long").alias("long_chars"),
        (F.length(long) - F.length(F.regexp_replace(long, r"[^\w\s]", ""))).cast("long").alias("long_signs"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("max_line"),
        (F.size(shapes) - F.size(F.array_distinct(shapes))).cast("long").alias("repeated"),
        header.rlike(f"(?im){GENERATED}").alias("says_generated"),
        header.rlike(f"(?im){VENDORED}").alias("says_vendored"),
        text.rlike(r"sourceMappingURL=").alias("says_minified"),
    ]


def _by_language(name: str) -> Column:
    value = F.lit(getattr(OTHER, name)).cast("double")
    for language, t in LANGUAGES.items():
        value = F.when(F.col("language") == language, F.lit(getattr(t, name)).cast("double")).otherwise(value)
    return value


def code_files(sources: DataFrame, spans: DataFrame, marks: bool = True) -> DataFrame:
    """``(project_slug, id, path, kind)`` of each code file that isn't hand-written.

    kind is 'vendored', 'generated', 'minified' or 'data', the first that holds.  A file is
    an id of source_type repo_file, in any of its rows; its content is that of all its spans.
    A file without span, with null texts or without path is judged by what there is.  Rows
    with null id, and empty tables, give nothing; other columns aren't read.
    """
    key = F.lower(F.regexp_replace("id", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    files = sources.where("source_type = 'repo_file' and id is not null").select(F.coalesce("project_slug", F.lit("")).alias("project"), key.alias("key"), "id", "project_slug", clean_path(F.col("path")).alias("path")).distinct()
    own = spans.where("text is not null and source_id is not null").select(
        F.coalesce("project_slug", F.lit("")).alias("project"),
        F.lower(F.regexp_replace("source_id", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("key"),
        F.coalesce("id", F.xxhash64("text").cast("string")).alias("span"),
        *_statistics(F.col("text")),
    )
    maxima = ("max_line", "says_generated", "says_vendored", "says_minified")
    once = own.groupBy("project", "key", "span").agg(*[F.max(c).alias(c) for c in (*_COUNTS, *maxima)])
    total = once.groupBy("project", "key").agg(*[F.sum(c).alias(c) for c in _COUNTS], *[F.max(c).alias(c) for c in maxima])

    f = files.join(total, ["project", "key"], "left").withColumn("language", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    path, visible = F.lower("path"), F.col("chars") - F.col("blank")
    share = lambda a, b: F.try_divide(F.col(a), F.col(b) if isinstance(b, str) else b)
    long_line = (F.col("max_line") >= _by_language("max_line")) & (share("long_signs", "long_chars") >= _by_language("prose"))
    dense = long_line & ((share("chars", "lines") >= _by_language("mean_line")) | (share("blank", "chars") <= _by_language("whitespace")))
    data = (share("encoded", "chars") >= _by_language("encoded")) | (share("numeric", visible) >= _by_language("numeric"))
    packed = share("blank", "chars") <= 0.03
    data = data | (packed & (share("alnum", visible) >= _by_language("alphanumeric"))) | (dense & F.col("language").isin("py", "go", "sql"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    uniform = (F.col("lines") >= 10) & (share("repeated", "lines") >= _by_language("repeated"))
    said = lambda c: yes(c) if marks else F.lit(False)
    kind = (
        F.when(said(F.col("says_vendored") | path.rlike(VENDORED_PATHS)), "vendored")
        .when(said(F.col("says_generated")) | said(path.rlike(GENERATED_PATHS)), "generated")
        .when(yes(data), "data")
        .when(yes(dense) | said(F.col("says_minified")) | said(path.rlike(MINIFIED_PATHS)), "minified")
        .when(yes(uniform), "generated")
    )
    return f.select("project_slug", "id", "path", kind.alias("kind")).where("kind is not null")


def pointing_entities(entities: DataFrame, files: DataFrame) -> DataFrame:
    """``(project_slug, id, kind)`` of each entity whose source_path names one of ``files``.

    Paths are compared as ``clean_path`` gives them, within the project.  Null paths and ids
    match nothing.
    """
    named = files.where("path <> ''").groupBy(F.coalesce("project_slug", F.lit("")).alias("project"), "path").agg(F.min("kind").alias("kind"))
    own = entities.where("id is not null and source_path is not null").select("project_slug", F.coalesce("project_slug", F.lit("")).alias("project"), "id", clean_path(F.col("source_path")).alias("path")).distinct()
    return own.join(named, ["project", "path"]).select("project_slug", "id", "kind")
