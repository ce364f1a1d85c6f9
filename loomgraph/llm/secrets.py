"""Secret scans: pattern spans, and corpus-wide ownership frequency of candidate values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed patterns of the base kinds, in the order in which they are listed.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the frequency method looks at beside the base spans.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")
#: A value of this many owners is a widely copied example, and so is one of two owners in this many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5
MASK = "[SECRET]"


def _spans(text: Column, pattern: str, kind: int, value_group: int, keep) -> Column:
    """Spans (start, kind, end, value) of the leftmost non-overlapping matches for which keep(match, value) holds.

    Positions are code points: the lengths of the pieces between matches and of the matches, added up. Most texts have no
    match and pay for one search only.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole
    rows = F.zip_with(F.zip_with(whole, values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))), F.split(text, pattern, -1),
                      lambda a, p: F.struct(a["m"].alias("m"), a["v"].alias("v"), F.length(p).alias("gap")))
    kind_type = "array<struct<start:int,kind:int,end:int,value:string>>"
    empty = F.array().cast(kind_type)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        hit = x["m"].isNotNull() & keep(x["m"], x["v"])
        return F.struct(end.alias("at"), F.when(hit, F.concat(s["got"], F.array(span))).otherwise(s["got"]).alias("got"))

    walk = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("got")), step, lambda s: s["got"])
    return F.when(text.rlike(pattern), walk).otherwise(empty)


def _some(*_) -> Column:
    return F.lit(True)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")))
    )


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner=None, repository=None) -> DataFrame:
    """(doc_id, text_hash, owner, repository, spans, others): base spans, and long mixed tokens that overlap none of them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.concat(
        _spans(text, ASSIGN, 0, 2, lambda m, v: F.length(v) >= 6), _spans(text, ACCESS, 1, 0, _some), _spans(text, HEX, 2, 0, _some)
    )
    mixed = lambda m, v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
        (F.lit(None).cast("string") if owner is None else owner).alias("owner"),
        (F.lit(None).cast("string") if repository is None else repository).alias("repository"),
        F.sort_array(spans).alias("spans"), _spans(text, TOKEN, 3, 0, mixed).alias("others"),
    )
    free = F.filter("others", lambda o: ~F.exists("spans", lambda s: (s["start"] < o["end"]) & (o["start"] < s["end"])))
    return out.withColumn("others", free)


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories): distinct owners and repositories of each candidate value, counted level by level.

    Each level pre-aggregates before its shuffle, so a value in a third of all documents is a few rows a task.
    """
    values = F.transform(F.concat("spans", "others"), lambda s: F.xxhash64(s["value"]))
    each = found.select("owner", "repository", F.explode(F.array_distinct(values)).alias("digest"))
    pairs = each.groupBy("digest", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, all, n_live, n_example): base spans, all spans, and how many values look live or copied.

    A value of EXAMPLE_OWNERS distinct owners or more is an example, and so is one that two owners hold in
    EXAMPLE_REPOSITORIES distinct repositories or more; any other looks live, so one owner's value does however many of
    their repositories hold it. Tokens that look live are added to the base spans; base spans stay whatever the verdict. A
    null text is empty, null owners and repositories count as one owner or repository, repeated rows give equal rows, a
    text of any length is searched as a whole, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(base(docs, id_col, text_col, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    some = (F.size("spans") > 0) | (F.size("others") > 0)
    # written, so that the join can split a value of many documents
    counts = scratch.keep(ownership(found.where(some)))
    each = found.where(some).select("row", F.explode(F.concat("spans", "others")).alias("s"))
    judged = each.withColumn("digest", F.xxhash64("s.value")).join(counts, "digest")
    owners, repositories = F.col("owners"), F.col("repositories")
    live = (owners < 2) | ((owners < EXAMPLE_OWNERS) & (repositories < EXAMPLE_REPOSITORIES))
    verdict = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when((F.col("s.kind") == 3) & live, F.col("s")))).alias("added"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"),
    )
    out = found.select("doc_id", "text_hash", "row", "spans").join(verdict, "row", "left")
    none = F.array().cast(out.schema["spans"].dataType)
    return out.select(
        "doc_id", "text_hash", F.col("spans").alias("base"), F.sort_array(F.concat("spans", F.coalesce("added", none))).alias("all"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def op6(docs: DataFrame) -> DataFrame:
    """Spans of every document; source is the owner, a source's documents of one language a repository."""
    kinds = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, F.col("source"), F.concat_ws("/", "source", "lang")).select(
        "doc_id", kinds(0).alias("n_assign"), kinds(1).alias("n_access"), kinds(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), "n_live", "n_example",
    )


def redact(docs: DataFrame, length_col: str | None = None) -> DataFrame:
    """docs with every span masked: overlapping spans are one mask. Texts without a span stay as they are, null ones null.

    length_col, if given, is set to the new number of characters where a text changed.
    """
    found = scan(docs, F.col("source"), F.concat_ws("/", "source", "lang")).where(F.size("all") > 0)
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("all").alias("__spans"))
    found = found.dropDuplicates(["__id", "__hash"])
    suspect = F.coalesce(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}|{TOKEN}"), F.lit(False))
    hit = docs.where(suspect).withColumn("__key", F.xxhash64("text"))
    hit = hit.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left")
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        before = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(
            F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], before, F.lit(MASK))).otherwise(s["out"]).alias("out")
        )

    masked = F.aggregate("__spans", zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    hit = hit.withColumn("text", F.when(F.col("__spans").isNull(), text).otherwise(masked))
    if length_col:
        length = F.when(F.col("__spans").isNull(), F.col(length_col)).otherwise(F.length("text"))
        hit = hit.withColumn(length_col, length.cast(docs.schema[length_col].dataType))
    return hit.select(*docs.columns).unionByName(docs.where(~suspect))
