"""Scalar cleaning and parsing as Column expressions; Arrow UDFs only where no built-in has the semantics."""

from __future__ import annotations

import ast
import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.session import ship_package
from loomgraph.vocabulary import MISSING, PLACEHOLDERS, TIME_FORMATS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column | str) -> Column:
    """Null, blank, or one of nan, none, null in any case."""
    t = F.trim(col(c))
    # the bytes settle nearly all values before they are lower-cased; no letter of these words has a longer capital
    return col(c).isNull() | ((F.octet_length(t) <= max(map(len, MISSING))) & F.lower(t).isin("", *MISSING))


def is_placeholder(c: Column | str) -> Column:
    """An entity id that names nothing; a wider set than is_missing."""
    t = F.trim(col(c))
    # two bytes more than the longest, since the k of unknown may be the three bytes of the Kelvin sign
    return col(c).isNull() | ((F.octet_length(t) <= max(map(len, PLACEHOLDERS)) + 2) & F.lower(t).isin(*PLACEHOLDERS))


def first_present(*columns: Column | str) -> Column:
    """The first value that isn't missing, as it stands."""
    return F.coalesce(*[F.when(~is_missing(c), col(c).cast("string")) for c in columns])


def safe_text(c: Column | str) -> Column:
    """Trimmed text, empty where missing."""
    return F.when(is_missing(c), F.lit("")).otherwise(F.trim(col(c)))


def first_nonempty(*columns: Column | str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in columns], F.lit(""))


def raw_time(c: Column | str) -> Column:
    return F.when(~is_missing(c), F.trim(col(c)))


def _iso(ts: Column) -> Column:
    """UTC text ending in Z; microseconds only where they aren't zero."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.000000Z$", "Z")


def normal_time(c: Column | str) -> Column:
    """Epoch seconds or milliseconds, six fixed formats, then ISO with offset; null for anything else."""
    t = F.trim(col(c))
    epoch = F.try_to_number(t, F.lit("9" * 18)).cast("double")
    seconds = F.when(epoch > 1e11, epoch / 1000).otherwise(epoch)
    # the shape of the text picks its format, since a failed parse costs far more than a match
    parsed = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(t))
    for f in reversed(TIME_FORMATS):
        shape = re.sub("[yMdHms]", r"\\d", f.replace("'", "")).replace("/", "[/]")
        parsed = F.when(t.rlike(f"^{shape}$"), F.try_to_timestamp(t, F.lit(f))).otherwise(parsed)
    epoch_time = F.timestamp_micros(F.round(seconds * 1000000).cast("long"))
    # in UTC the most frequent format differs from the result by two letters; a cast, far faster than a format, tells if it is a time
    plain = F.current_timezone().isin("UTC", "Etc/UTC", "GMT") & t.rlike(r"^(?!0000)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z")
    iso = F.concat(F.substring(t, 1, 10), F.lit("T"), F.substring(t, 12, 8), F.lit("Z"))
    return (
        F.when(plain, F.when(t.try_cast("timestamp").isNotNull(), iso)).when(t.rlike(r"^\d+$"), _iso(epoch_time)).otherwise(_iso(parsed))
    )


def upper_snake(c: Column | str) -> Column:
    """OpenedBy to OPENED_BY."""
    s = F.regexp_replace(F.trim(col(c)), "([a-z0-9])([A-Z])", "$1_$2")
    s = F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]+", "_"), "_+", "_")
    return F.upper(F.regexp_replace(s, "^_|_$", ""))


def verb_from_label(c: Column | str) -> Column:
    """The middle of <Source>_<Verb>_<Target>; empty with fewer than three parts. Empty parts don't count."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    middle = F.regexp_extract(t, r"(?s)^_*[^_]+_+([^_].*?)_+[^_]+_*$", 1)
    any_label = F.when(middle.contains("__"), F.regexp_replace(middle, "_+", "_")).otherwise(middle)
    # two single underscores inside the text part it in three, which needs no pattern
    three = (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("_"), F.lit(""))) == 2) & ~t.startswith("_") & ~t.endswith("_") & ~t.contains("__")
    return F.when(three, F.substring_index(F.substring_index(t, "_", 2), "_", -1)).otherwise(any_label)


def first_url(*columns: Column | str, trimmed: bool = False) -> Column:
    """The first URL in the columns in order; trimmed stops before closing quotes and brackets."""
    pattern = r"(?i)https?://[^\s\]\)\"'>,;]+" if trimmed else r"(?i)https?://[^\s]+"
    return F.coalesce(*[F.nullif(F.regexp_extract(col(c).cast("string"), pattern, 0), F.lit("")) for c in columns])


def url_host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(url), F.lit("HOST")))


def url_domain(host: Column | str) -> Column:
    """The last two labels of a host; a single label is itself."""
    labels = F.split(col(host), r"\.")
    return F.when(F.size(labels) < 2, col(host)).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def is_code_host(host: Column | str) -> Column:
    h = col(host)
    return F.coalesce(
        (h == "github.com") | h.endswith(".github.com") | h.endswith(".githubusercontent.com")
        | (h == "github-redirect.dependabot.com"),
        F.lit(False),
    )


def url_info(text: Column | str) -> Column:
    """struct(url_raw, url_host, url_domain_etld1, url_is_github) of the first URL of a text."""
    url = first_url(text, trimmed=True)
    return url_parts(url, url_host(url))


def url_parts(url: Column | str, host: Column | str) -> Column:
    """The struct of url_info for a URL and a host that are there already."""
    return F.struct(
        col(url).alias("url_raw"), col(host).alias("url_host"), url_domain(host).alias("url_domain_etld1"), is_code_host(host).alias("url_is_github")
    )


def int_like(c: Column | str) -> Column:
    """12.0 to 12; other text as it stands."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"^-?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def issue_number(c: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"#(\d+)", 1)


def commit_sha(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"\b[0-9a-fA-F]{7,40}\b", 0))


def coerced_kind(c: Column | str) -> Column:
    """int, float or text: what a loose numeric reading of the text gives."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"^-?\d+$"), "int").when(t.try_cast("double").isNotNull(), "float").otherwise("text")


def coerced_number(c: Column | str) -> Column:
    return F.trim(col(c)).try_cast("double")


def escape_literal(c: Column | str) -> Column:
    return F.replace(F.replace(col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def normal_query(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(col(c)), r"\s+", " "))


def login(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(col(c)), "^@+", ""))


def canonical_number(c: Column | str, letter: str) -> Column:
    """Digits of R_12, A_12 or bare digits; empty otherwise."""
    return F.regexp_extract(F.trim(F.coalesce(col(c), F.lit(""))), rf"^(?:{letter}_)?(\d+)$", 1)


def key_value(c: Column | str) -> Column:
    """struct(key, value) around the first =, or else the first colon; null without either."""
    t = F.trim(col(c))
    cut = F.when(t.contains("="), F.lit("=")).when(t.contains(":"), F.lit(":"))
    at = F.when(t.contains("="), F.instr(t, "=")).otherwise(F.instr(t, ":"))
    return F.when(
        cut.isNotNull(),
        F.struct(F.lower(F.trim(F.substring(t, F.lit(1), at - 1))).alias("key"), F.trim(F.substring(t, at + 1, F.length(t))).alias("value")),
    )


def year_range(c: Column | str) -> Column:
    """struct(time_start, time_end) of the first year 2000 to 2100 named in a text; null without one."""
    year = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"\b(20\d\d|2100)\b", 1).try_cast("int")
    stamp = lambda y: F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-01-01T00:00:00Z"))
    return F.when(year.isNotNull(), F.struct(stamp(year).alias("time_start"), stamp(year + 1).alias("time_end")))


def id_type(c: Column | str, abbreviations: dict[str, str]) -> Column:
    """The entity type that the letters before the first underscore of an id stand for."""
    prefix = F.split(F.trim(col(c)), "_")[0]
    out = F.lit(None).cast("string")
    for name, short in abbreviations.items():
        out = F.when(prefix == short, F.lit(name)).otherwise(out)
    return out


def _python_literal(text: str | None) -> str | None:
    if text is None:
        return None
    t = text.strip()
    if t[:1] + t[-1:] not in ("{}", "[]"):
        return None
    for parse in (json.loads, ast.literal_eval):
        try:
            return json.dumps(parse(t), ensure_ascii=False, default=lambda v: sorted(v, key=str) if isinstance(v, (set, frozenset)) else str(v))
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
    return None


def _deep(value):
    """A value with objects, lists and numbers that are written as text read out, at every depth."""
    if isinstance(value, str):
        read = _python_literal(value)
        if read is not None:
            return _deep(json.loads(read))
        t = value.strip()
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        try:
            number = float(t)
        except ValueError:
            return value
        return number if math.isfinite(number) else value
    if isinstance(value, dict):
        return {str(k): _deep(v) for k, v in value.items()}
    return [_deep(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def deep_json(texts):
    """JSON of a text after deep reading: objects, lists and numbers within texts, at every depth; null stays null."""
    return texts.map(lambda t: None if t is None else json.dumps(_deep(t), ensure_ascii=False, separators=(",", ":")))


@F.pandas_udf(T.StringType())
def python_literal_json(texts):
    """JSON text of an object or list written as JSON or as a Python literal; evaluates nothing."""
    return texts.map(_python_literal)


_OBJECT = "map<string,string>"


def quick_object_map(c: Column | str) -> Column:
    """map<string,string> of an object written as JSON, or as a Python literal that JSON with other quotes and words can say.

    Null for anything else. The first quote tells which of the two is tried first.
    """
    t = F.trim(col(c))
    words = t
    for word, other in (("None", "null"), ("True", "true"), ("False", "false")):
        # the word comes first in the pattern, so that the search stops only where it stands
        pattern = rf"{word}(?<=[:,\[]\s?{word})(?=\s*[,}}\]])"
        words = F.when(t.contains(word), F.regexp_replace(words, pattern, other)).otherwise(words)
    strict = F.from_json(t, _OBJECT, {"allowSingleQuotes": "false"})
    return F.coalesce(F.when(t.rlike(r'^\{\s*"'), strict), F.when(t.startswith("{"), F.from_json(words, _OBJECT)))


def literal_object_map(c: Column | str) -> Column:
    """map<string,string> of an object written as any Python literal, by an Arrow UDF that evaluates nothing."""
    ship_package()
    return F.from_json(python_literal_json(F.trim(col(c))), _OBJECT)


def object_map(c: Column | str) -> Column:
    """map<string,string> of an object written as JSON or as a Python literal, empty for anything else.

    The JVM reads nearly all; only texts on which it fails, such as tuples, sets and escaped quotes, go to the Arrow UDF.
    """
    quick = quick_object_map(c)
    return F.coalesce(quick, literal_object_map(_left(quick, col(c))), F.create_map().cast(_OBJECT))


def _left(quick: Column, text: Column) -> Column:
    return F.when(quick.isNull() & F.trim(text).startswith("{"), text)


def with_object_map(rows: DataFrame, c: Column, name: str) -> DataFrame:
    """rows with object_map(c) as a column; each text is read once."""
    staged = rows.select("*", c.alias("__text"), quick_object_map(c).alias("__quick"))
    slow = literal_object_map(_left(F.col("__quick"), F.col("__text")))
    found = F.coalesce(F.col("__quick"), slow, F.create_map().cast(_OBJECT))
    return staged.select(*rows.columns, found.alias(name))
