"""Files of evaluation runs: rows as CSV with JSON cells, a summary, a commit; and folders of run summaries of any shape.

A run is a folder of its own under `runs`; its name under `commits` is written last.  Readers take committed runs only, so
that a writer that dies leaves nothing that is read, and one that runs again replaces what it left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quotes are doubled, line ends and spaces of a cell are kept; a missing cell is written as nothing, an empty text as two quotes.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
WRITTEN, READ = {"emptyValue": '""', "nullValue": ""}, {"emptyValue": "", "nullValue": "\x01missing"}
METRICS = "map<string, struct<mean: double, n: bigint, nan: bigint>>"


def _cell(field: T.StructField) -> Column:
    """A cell's text: lists, structs and maps as JSON, NaN as missing."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c).cast("string")
    return c.cast("string")


def written(rows: DataFrame, summary: DataFrame, folder: str, run: str) -> None:
    """Publishes a run: rows, then its summary (one row), then the commit."""
    rows.select(*(_cell(f).alias(f.name) for f in rows.schema.fields)).write.mode("overwrite").options(**CSV, **WRITTEN).csv(f"{folder}/runs/run={run}/rows")
    summary.write.mode("overwrite").json(f"{folder}/runs/run={run}/summary")
    rows.sparkSession.createDataFrame([(run,)], "name string").write.mode("overwrite").json(f"{folder}/commits/run={run}")


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The names of published runs."""
    try:
        return sorted(r["name"] for r in spark.read.schema("name string").json(f"{folder}/commits/*").collect())
    except AnalysisException:  # no run yet
        return []


def rows_of(spark: SparkSession, folder: str, run: str, schema: str) -> DataFrame:
    """A published run's rows by a schema, with bad: the columns whose cell can't be read (their value is null); a missing score is NaN."""
    if run not in committed(spark, folder):
        raise ValueError(f"no run {run} in {folder}")
    fields = T.StructType.fromDDL(schema).fields
    raw = spark.read.schema(", ".join(f"`{f.name}` string" for f in fields)).options(**CSV, **READ).option("enforceSchema", False).csv(f"{folder}/runs/run={run}/rows")
    return parsed(raw, fields)


def parsed(raw: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Columns of text as the fields say, and bad."""
    values, bad = [], []
    for f in fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            # a cell that is half read is bad too: read strictly, or not at all
            shape = f.dataType.simpleString()
            ok = F.try_variant_get(F.try_parse_json(c), "$", shape)
            values.append(ok.alias(f.name))
            bad.append(F.when(c.isNotNull() & ok.isNull(), F.lit(f.name)))
        elif isinstance(f.dataType, T.StringType):
            values.append(c)
        else:
            value = c.try_cast(f.dataType)
            bad.append(F.when(c.isNotNull() & value.isNull(), F.lit(f.name)))
            values.append((F.coalesce(value, F.lit(float("nan")).cast(f.dataType)) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else value).alias(f.name))
    return raw.select(*values, F.array_compact(F.array(*bad)).alias("bad") if bad else F.array().cast("array<string>").alias("bad"))


def summaries(files: DataFrame) -> DataFrame:
    """path, reason, label, timestamp, metrics, config, judge, golden of run summaries (path, value), whatever else they hold.

    reason says why a file isn't a run (null: it is one).  config, judge and golden map settings to their text; a
    setting within another has both names, with a dot between them.
    """
    doc = files.select("path", F.try_parse_json("value").alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    shape = F.schema_of_variant("v")
    reason = F.when(F.col("v").isNull(), "not JSON").when(~shape.startswith("OBJECT"), "not an object").when(F.try_variant_get("v", "$.label", "variant").isNull(), "no label").when(F.try_variant_get("v", "$.metrics", "variant").isNull(), "no metrics")
    fine = doc.withColumn("reason", reason)
    run = lambda c: F.when(F.col("reason").isNull(), c)
    return fine.select(
        "path", "reason", run(get("label", "string")).alias("label"), run(F.coalesce(get("timestamp", "string"), F.lit(""))).alias("timestamp"), run(get("metrics", METRICS)).alias("metrics"), *(run(_flat(name)).alias(name) for name in ("config", "judge", "golden"))
    )


def _flat(name: str) -> Column:
    """The settings of a part of a summary, one level of nesting with a dot."""
    top = F.coalesce(F.try_variant_get("v", f"$.{name}", "map<string, variant>"), F.create_map().cast("map<string, variant>"))

    def of(key: Column, value: Column) -> Column:
        inner = F.map_entries(F.try_variant_get(value, "$", "map<string, string>"))
        nested = F.transform(inner, lambda e: F.struct(F.concat(key, F.lit("."), e["key"]).alias("key"), e["value"].alias("value")))
        single = F.array(F.struct(key.alias("key"), F.try_variant_get(value, "$", "string").alias("value")))
        return F.when(F.schema_of_variant(value).startswith("OBJECT"), nested).otherwise(single)

    return F.map_from_entries(F.flatten(F.transform(F.map_entries(top), lambda e: of(e["key"], e["value"]))))


def run_files(spark: SparkSession, folder: str) -> DataFrame:
    """`summaries` of the JSON files directly in a folder, by time and then by name."""
    found = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(folder)
    named = found.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("path"), "value")
    return summaries(named).orderBy("timestamp", "path")


def _filled(defaults: dict[str, str]) -> Column:
    """The configuration, with defaults for the keys that it lacks."""
    config = F.coalesce("config", F.create_map().cast("map<string,string>"))
    given = F.create_map(*(F.lit(x) for kv in sorted(defaults.items()) for x in kv)).cast("map<string,string>")
    return F.map_concat(F.map_filter(given, lambda k, _: ~F.map_contains_key(config, k)), config)


def config_diff(runs: DataFrame, base: str, defaults: dict[str, str]) -> DataFrame:
    """label, changes ("key old→new" by key, "—" without any), warnings of each run against the base run.

    A key that only one side has changes from or to "—".  Warnings say what makes two runs incomparable: another judge,
    another golden set, another prompt for citations.
    """
    first = runs.filter(F.col("label") == base).first()
    if first is None:
        raise ValueError(f"no run {base}")
    old = {**defaults, **(first["config"] or {})}
    of_base = F.create_map(*(F.lit(x) for kv in sorted(old.items()) for x in kv)).cast("map<string,string>") if old else F.create_map().cast("map<string,string>")
    own = F.map_zip_with(_filled(defaults), of_base, lambda k, new, was: F.struct(new.alias("new"), was.alias("old")))
    differing = F.array_sort(F.filter(F.map_entries(own), lambda e: ~e["value"]["new"].eqNullSafe(e["value"]["old"])))
    line = lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(e["value"]["old"], F.lit("—")), F.lit("→"), F.coalesce(e["value"]["new"], F.lit("—")))
    changes = F.array_join(F.transform(differing, line), ", ")
    other = lambda part, key: ~F.col(part)[key].eqNullSafe(F.lit((first[part] or {}).get(key)).cast("string"))
    warnings = F.array_compact(F.array(F.when(other("judge", "judge_model"), "judge"), F.when(other("golden", "sha256"), "golden"), F.when(other("judge", "citation_prompt"), "citation prompt")))
    return runs.select("label", F.coalesce(F.nullif(changes, F.lit("")), F.lit("—")).alias("changes"), F.array_join(warnings, ", ").alias("warnings"))
