"""Offline entity resolution: name indexes, staged lookups with provenance, scope prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.clean import canonical_number, is_missing, key_value, login, with_object_map
from loomgraph.functions.mentions import mentions
from loomgraph.session import file_system
from loomgraph.vocabulary import ABBREVIATIONS

REPO_KEYS, ACTOR_KEYS = ("repo_full_name", "repo"), ("actor_login", "user", "login", "org", "username")


def build_indexes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, repo_full_name) and (actor_id, actor_login) from the objects in rows; both sides of a pair are needed."""
    get = lambda k: F.try_element_at(F.col("p"), F.lit(k))
    props = with_object_map(rows.select("tar_entity_objnt_prop_dict"), F.col("tar_entity_objnt_prop_dict"), "p")
    repos = props.select(get("repo_id").alias("repo_id"), F.coalesce(get("repo_full_name"), get("repo_name")).alias("repo_full_name"))
    actors = props.select(get("actor_id").alias("actor_id"), F.coalesce(get("actor_login"), get("login")).alias("actor_login"))
    full = lambda d: d.where(~is_missing(d.columns[0]) & ~is_missing(d.columns[1])).distinct()
    return full(repos), full(actors)


def _last(value: str, order: str | None) -> Column:
    """The value of the last row by order; without an order, which a table doesn't have by itself, the greatest value."""
    return F.max_by(value, F.struct(order, value)) if order else F.max(value)


def upsert(index: DataFrame, more: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """The index with newer rows in place of older ones of the same key; blank keys and values are left out.

    Within the newer rows the last by the column `order` counts.
    """
    place = lambda df: F.col(order) if order and order in df.columns else F.lit(None).cast("long")
    both = index.select(key, value, F.lit(0).alias("age"), F.lit(None).cast("long").alias("place"))
    both = both.unionByName(more.select(key, value, F.lit(1).alias("age"), place(more).cast("long").alias("place")))
    both = both.where(~is_missing(key) & ~is_missing(value))
    return both.groupBy(key).agg(F.max_by(value, F.struct("age", "place", value)).alias(value))


def rebuild_index(index: DataFrame, more: DataFrame, path: str, key: str, value: str, order: str | None = None) -> DataFrame:
    """Upsert into the index kept at path: the new one is written beside it and takes its place only when it is whole.

    A rebuild that would leave no rows is refused, and the old index stays.
    """
    spark = more.sparkSession
    fresh = f"{path}.new"
    upsert(index, more, key, value, order).write.mode("overwrite").parquet(fresh)
    if spark.read.parquet(fresh).isEmpty():
        raise ValueError("the rebuilt index is empty; the old one stays")
    (new, fs), (at, _), (old, _) = (file_system(spark, p) for p in (fresh, path, f"{path}.old"))
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)
    return spark.read.parquet(path)


def lookup(rows: DataFrame, name: str, index: DataFrame, id_col: str, name_col: str, order: str | None = None) -> DataFrame:
    """rows with the id of a name, in any case and with or without @; of equal names the last id by `order` wins.

    The index goes through one aggregate and a left join whose side Spark broadcasts if its statistics allow.
    """
    table = index.groupBy(login(name_col).alias("__index_name")).agg(_last(id_col, order).alias(id_col))
    return rows.join(table, login(name) == F.col("__index_name"), "left").drop("__index_name")


def index_quality(index: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """rows, distinct names and ids, rows whose id occurs more than once, and the share of missing names."""
    by_id = index.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    ids = by_id.agg(F.count(id_col).alias("distinct_ids"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicated_ids"))
    rest = index.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(name_col).alias("distinct_names"),
        F.coalesce(F.avg(F.when(is_missing(name_col), 1.0).otherwise(0.0)), F.lit(0.0)).alias("missing_name_rate"),
    )
    return rest.crossJoin(ids)


def _staged(rows: DataFrame, column: str, index: DataFrame, letter: str, id_key: str, names: tuple[str, ...], link: str, id_col: str, name_col: str) -> DataFrame:
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    pair = key_value(text)
    key, value = F.coalesce(pair["key"], F.lit("")), F.coalesce(pair["value"], F.lit(""))
    direct_kv = F.when((key == id_key) & (canonical_number(value, letter) != ""), canonical_number(value, letter))
    direct = F.nullif(canonical_number(text, letter), F.lit(""))
    linked = F.nullif(F.regexp_extract(text, link, 1), F.lit(""))
    asked = F.when(key.isin(*names), value).otherwise(F.coalesce(linked, text))
    staged = rows.select("*", direct_kv.alias("__kv"), direct.alias("__id"), asked.alias("__name"), (text == "").alias("__empty"))
    found = lookup(staged, "__name", index.withColumnRenamed(id_col, "__found"), "__found", name_col)
    number = F.coalesce("__kv", "__id", "__found")
    provenance = (
        F.when(F.col("__kv").isNotNull(), "direct_kv_id").when(F.col("__id").isNotNull(), "direct_id")
        .when(F.col("__found").isNotNull(), "local_index").otherwise("failed")
    )
    error = F.when(F.col("__empty"), "empty_input").when((key == id_key) & F.col("__kv").isNull(), f"invalid_{id_key}_kv")
    return found.withColumn("entity_id", F.concat(F.lit(f"{letter}_"), number)).withColumn("provenance", provenance).withColumn(
        "error", F.when(F.col("entity_id").isNull(), F.coalesce(error, F.lit("not_found")))
    ).drop("__kv", "__id", "__name", "__empty", "__found")


def resolve_repo(rows: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """rows with entity_id R_<id>, provenance and error: key-value ids, plain ids, then names and links in the index."""
    return _staged(rows, column, index, "R", "repo_id", REPO_KEYS, r"(?i)^https?://[^/]*github[^/]*/([^/\s]+/[^/\s?#]+)", "repo_id", "repo_full_name")


def resolve_actor(rows: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """rows with entity_id A_<id>, provenance and error, in the same stages."""
    return _staged(rows, column, index, "A", "actor_id", ACTOR_KEYS, r"(?i)^https?://[^/]*github[^/]*/@?([A-Za-z0-9-]+)/?$", "actor_id", "actor_login")


def extract_and_resolve(rows: DataFrame, text: str, key: str, repos: DataFrame, actors: DataFrame) -> DataFrame:
    """(key, entity_ids): distinct resolved ids of each text's mentions, in order of their first mention."""
    each = rows.select(key, F.explode(mentions(text)).alias("m")).select(key, "m.*")
    is_repo = F.col("hint_type").startswith("repo")
    found = resolve_repo(each.where(is_repo), "normalized_text", repos).unionByName(resolve_actor(each.where(~is_repo), "normalized_text", actors))
    first = found.where("entity_id IS NOT NULL").groupBy(key, "entity_id").agg(F.min("start").alias("at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "entity_id"))), lambda x: x["entity_id"]).alias("entity_ids"))


def scope_prefixes(repo: Column, labels: tuple[str, ...], separator: str = "") -> Column:
    """map<label, prefix> of the ids in a repository; a separator keeps R_15 from matching R_156."""
    number = F.regexp_extract(F.trim(repo), r"^R_(\d+)$", 1)
    pairs = [x for n in labels if n in ABBREVIATIONS for x in (F.lit(n), F.concat(F.lit(f"{ABBREVIATIONS[n]}_"), number, F.lit(separator)))]
    return F.when(number != "", F.create_map(*pairs))
