"""Running generators, checks and repairs over a corpus; counts and means as DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.rules import failure_category, query_level
from loomgraph.plans.generate import fill, slot_values
from loomgraph.plans.repair import Intent, repair
from loomgraph.plans.syntax import QueryError, parse
from loomgraph.plans.validate import Schema, Template, bound_codes, services, static_codes, template_codes


def same_query(a: str | None, b: str | None) -> bool:
    """Equal but for case and blanks."""
    plain = lambda t: " ".join(str(t or "").split()).lower()
    return plain(a) == plain(b)


def validate_batch(queries: DataFrame, text: str, schema: Schema, edge_labels: bool = False) -> DataFrame:
    """queries with codes and valid, all in one job."""
    out = queries.withColumn("codes", static_codes(text, schema, edge_labels))
    return out.withColumn("valid", F.size("codes") == 0)


_RUN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("query_id", "template_id", "mode", "text")]
    + [T.StructField("codes", T.ArrayType(T.StringType())), T.StructField("pending", T.BooleanType())]
)


def run_templates(
    spark: SparkSession, queries: list[dict], templates: dict[str, Template], of: dict[str, str], schema: Schema, parity: bool = True
) -> DataFrame:
    """A row for each query and mode (template_first, controlled) with the rendered text and its faults.

    controlled derives a year from the question and keeps to the template's constraints. parity reads hop limits of no
    hops as two. The corpus is small and read on the driver; checks of texts run as one job.
    """
    rows = []
    for q in queries:
        pending = not q.get("gold_cypher") and bool(q.get("expected_to_fail_until_injected", True))
        template = templates.get(of.get(q["id"], ""))
        asked = _services(q.get("gold_cypher"))
        for mode in ("template_first", "controlled"):
            text, codes = None, []
            if not pending and template is None:
                codes = ["NO_TEMPLATE"]
            elif not pending:
                values = slot_values(q.get("extracted_slot_candidates") or {}, q.get("nl_query", ""), asked, mode == "controlled")
                text, missing = fill(template, values)
                if missing:
                    codes = ["MISSING_REQUIRED_SLOT"]
                elif mode == "controlled":
                    codes = template_codes(text, template, values, parity)
            rows.append((q["id"], template.template_id if template else None, mode, text, codes, pending))
    df = spark.createDataFrame(rows, _RUN)
    static = F.when((F.size("codes") == 0) & ~F.col("pending"), static_codes("text", schema, True)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("codes", F.concat("codes", static))
    category = F.when(F.col("mode") == "controlled", failure_category(F.col("codes"), F.col("pending"), "controlled")).otherwise(
        failure_category(F.col("codes"), F.col("pending"), "template_first")
    )
    return df.withColumn("category", category).withColumn(
        "status", F.when(F.col("pending"), "skip").when(F.size("codes") == 0, "success").otherwise("fail")
    )


def _services(text: str | None) -> list[str]:
    try:
        return services(parse(text)) if text else []
    except QueryError:
        return []


def summary(runs: DataFrame) -> DataFrame:
    """success, fail and skip by mode, and the share of success among those not skipped."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = runs.groupBy("mode").agg(count("success"), count("fail"), count("skip"))
    return out.withColumn("rate", F.round(F.col("success") / F.nullif(F.col("success") + F.col("fail"), F.lit(0)), 4))


_CASE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("case_id", "failure_type", "text")]
    + [T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("valid", T.BooleanType()), T.StructField("exact", T.BooleanType())]
)


def run_repairs(spark: SparkSession, cases: list[dict], schema: Schema, intent: Callable[[dict], Intent], use_gold: bool = False) -> DataFrame:
    """A row for each failed query: the repair, its edits, whether it is valid and whether it equals the gold."""
    rows = []
    for c in cases:
        r = repair(c["generated_cypher"], c.get("validator_errors") or [], schema, intent(c), c.get("gold_cypher") if use_gold else None)
        rows.append((c["case_id"], c["failure_type"], r.text, list(r.edits), r.valid, same_query(r.text, c.get("gold_cypher"))))
    return spark.createDataFrame(rows, _CASE)


def joined_corpus(cases: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """Cases with the columns of their queries; a case whose query isn't there fails, and its key is named."""
    lost = cases.join(queries.select(key), key, "left_anti").select(key).distinct().orderBy(key).limit(10).collect()
    if lost:
        raise KeyError(", ".join(str(r[0]) for r in lost))
    return cases.join(queries, key)


def repair_report(runs: DataFrame) -> DataFrame:
    """By failure type: cases, valid and exact repairs, and edits a case."""
    return runs.groupBy("failure_type").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("valid").alias("valid"), F.count_if("exact").alias("exact"), F.avg(F.size("edits")).alias("mean_edits")
    )


def edit_report(runs: DataFrame) -> DataFrame:
    """How many cases each edit took part in."""
    return runs.select(F.explode("edits").alias("edit"), "exact").groupBy("edit").agg(F.count(F.lit(1)).alias("cases"), F.count_if("exact").alias("exact"))


def compare(spark: SparkSession, examples: list[dict], generators: dict[str, Callable[[dict], str | None]], schema: Schema, repaired: bool = True) -> DataFrame:
    """A row for each generator and example: text, validity before and after repair, edits, time, and whether it equals the gold."""
    rows = []
    for name, make in generators.items():
        for e in examples:
            began = time.perf_counter()
            text = make(e) or ""
            before = not bound_codes(text, schema)
            r = repair(text, bound_codes(text, schema), schema, Intent()) if repaired and not before else None
            final = r.text if r else text
            rows.append((name, e["id"], text, final, before, before or bool(r and r.valid), r is not None, bool(r and r.valid), same_query(final, e.get("gold_cypher")),
                         not text, len(r.edits) if r else 0, 1000 * (time.perf_counter() - began)))
    names = ("generator", "query_id", "text", "final", "valid_before", "valid", "attempted", "repaired", "exact",
             "abstained", "repair_edits", "latency_ms")
    kinds = [T.StringType()] * 4 + [T.BooleanType()] * 6 + [T.LongType(), T.DoubleType()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def level_matrix(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries (query_id, query_type, level, text) with their level, the relations they name, and the status of each mode."""
    relations = F.array_join(F.array_distinct(F.flatten(F.transform(
        F.regexp_extract_all("text", F.lit(r"\[[A-Za-z_]*:([A-Za-z_|]+)"), F.lit(1)), lambda x: F.split(x, r"\|")
    ))), ",")
    named = queries.select("query_id", "query_type", query_level("level", "query_type").alias("level"), relations.alias("relations"))
    status = runs.groupBy("query_id").pivot("mode", ["template_first", "controlled"]).agg(F.first("status"))
    return named.join(status, "query_id", "left")


def level_summary(runs: DataFrame, matrix: DataFrame) -> DataFrame:
    """Counts of each status by level and mode."""
    return runs.join(matrix.select("query_id", "level"), "query_id").groupBy("level", "mode", "status").agg(F.count(F.lit(1)).alias("n"))


def write_traces(runs: DataFrame, path: str) -> None:
    """One JSON object a line for each run."""
    runs.select(F.to_json(F.struct(*runs.columns))).write.mode("overwrite").text(path)


def markdown(rows: DataFrame) -> str:
    """A small report table as text; all of its rows come to the driver."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect()])
