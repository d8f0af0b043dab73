"""Readers and writers of the stores: HTML folders, JSON lines, manifests, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import listed

CHUNKS = "id_ string, text string, metadata map<string,string>"
MANIFEST = "file string, sha256 string, mtime double, sections long, chunks long"


def html_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, html, sha256, mtime) of .html and .htm files below path; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.html?$"))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").cast("double").alias("mtime"))


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines of either key style (`id_`/`metadata`, `id`/`meta`); bad lines are skipped."""
    rows = spark.read.schema("id_ string, id string, text string, metadata map<string,string>, meta map<string,string>").option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.coalesce("id_", "id").alias("id_"), "text", F.coalesce("metadata", "meta").alias("metadata")).where("id_ is not null")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The stored manifest; an empty one where there is none, or where a line of it can't be read."""
    empty = spark.createDataFrame([], MANIFEST)
    if not _there(spark, path):
        return empty
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", MANIFEST).alias("m"))
    return empty if rows.where("m is null or m.file is null").limit(1).count() else rows.select("m.*")


def rules(spark: SparkSession, path: str) -> dict:
    """A rules file (YAML or JSON): viq_rules, synonyms and word lists; empty where there is none or it can't be read. It is small and
    parsed on the driver, but read by Spark, wherever it lies."""
    if not _there(spark, path):
        return {}
    text = spark.read.text(path, wholetext=True).first()
    try:
        import yaml

        found = yaml.safe_load(text[0]) if text else None
    except ImportError:
        import json

        try:
            found = json.loads(text[0]) if text else None
        except ValueError:
            found = None
    except Exception:  # noqa: BLE001  whatever a parser says of a broken file
        found = None
    return found if isinstance(found, dict) else {}


def rules_text(value: object, depth: int = 0) -> str:
    """Rules as YAML: a key or dash a line, two blanks a level, all scalars as JSON has them."""
    import json

    pad = "  " * depth
    if isinstance(value, (dict, list)):
        lines = []
        for head, x in [(f"{k}:", v) for k, v in value.items()] if isinstance(value, dict) else [("-", v) for v in value]:
            if isinstance(x, (dict, list)):
                lines += [f"{pad}{head}", rules_text(x, depth + 1)]
            else:
                lines.append(f"{pad}{head} {json.dumps(x, ensure_ascii=False)}")
        return "\n".join(lines)
    return pad + json.dumps(value, ensure_ascii=False)


def save_rules(spark: SparkSession, built: DataFrame, path: str, stopwords: tuple[str, ...] = (), generic: tuple[str, ...] = (), synonyms: DataFrame | None = None) -> None:
    """Rules (viq_no, chapter_no, patterns) and synonyms (base, variants) as one YAML file; as many rows as there are questions."""
    data = {"global_stopwords": sorted(stopwords), "generic_terms": sorted(generic), "viq_rules": [r.asDict() for r in built.orderBy("viq_no").collect()]}
    if synonyms is not None and (rows := synonyms.orderBy("base").collect()):
        data["synonyms"] = {r.base: list(r.variants) for r in rows}
    spark.createDataFrame([(rules_text(data),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def discovered(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever their case in df; null where it has none."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(f"`{have[n.lower()]}`").alias(n) if n.lower() in have else F.lit(None).cast("string").alias(n) for n in names))


def questions(df: DataFrame) -> DataFrame:
    """Rows of a question table, its columns found whatever their case."""
    return discovered(df, "chapter_no", "viq_no", "viq_question", "procedural_requirements")


def synonym_pairs(tables: dict[str, DataFrame]) -> DataFrame | None:
    """(base, synonym) from whichever schema the tables (by lower-case name) have: terms with ids and their synonyms; a flat table of both;
    the older two tables; or bases alone, with null synonyms. None without any of these."""
    columns = {name: {c.lower() for c in df.columns} for name, df in tables.items()}
    terms, flat = tables.get("maritime_terms"), columns.get("maritime_terms", set())
    pair = lambda base, synonym: (F.lower(F.trim(base)).alias("base"), F.lower(F.trim(synonym)).alias("synonym"))
    found = None
    if terms is not None and "term_synonyms" in tables and (exact := next((c for c in ("exact_term", "term") if c in flat), None)):
        found = terms.alias("t").join(tables["term_synonyms"].alias("s"), F.col("s.term_id") == F.col("t.id")).select(*pair(F.col(f"t.{exact}"), F.col("s.synonym")))
    elif terms is not None and {"term", "synonym"} <= flat:
        found = terms.select(*pair(F.col("term"), F.col("synonym")))
    elif {"terms", "synonyms"} <= tables.keys():
        alone = tables["terms"].select(*pair(F.col("term"), F.lit(None).cast("string")))
        if "term" in columns["synonyms"]:
            return alone.unionByName(tables["synonyms"].select(*pair(F.col("term"), F.col("synonym")))).where("base <> ''")
        return alone.unionByName(tables["synonyms"].select(*pair(F.col("synonym"), F.lit(None).cast("string")))).where("base <> ''")
    if found is not None and (kept := found.where("base <> '' and synonym <> ''")).limit(1).count():
        return kept
    if terms is not None and "exact_term" in flat:
        return terms.select(*pair(F.col("exact_term"), F.lit(None).cast("string"))).where("base <> ''")
    return None


def save_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """One JSON object with what a run was made with."""
    import json

    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_numbered(rows: DataFrame, path: str) -> DataFrame:
    """Append rows with ids above all there are, and return them with these, read from what was written. One writer at a time."""
    spark = rows.sparkSession
    last = spark.read.parquet(path).agg(F.max("id")).first()[0] if _there(spark, path) else None
    start = 0 if last is None else last
    rows.select((F.monotonically_increasing_id() + start + 1).alias("id"), "*").write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col("id") > start)


REFERENCES = "array<struct<title string, breadcrumb string, url string, score double, viq array<string>, tags array<string>, text string>>"


def reference_rows(logs: DataFrame) -> DataFrame:
    """Logs (id, references) -> a row a reference: its rank from 1, lists as JSON or null, 500 characters of text."""
    each = logs.select(F.col("id").alias("query_log_id"), F.posexplode("references").alias("pos", "r"))
    return each.select("query_log_id", (F.col("pos") + 1).cast("long").alias("reference_rank"), "r.title", "r.breadcrumb", "r.url", "r.score", listed(F.col("r.viq")).alias("viq_codes"), listed(F.col("r.tags")).alias("tags"), F.nullif(F.left("r.text", F.lit(500)), F.lit("")).alias("text_snippet"))


def append_logs(logs: DataFrame, log_path: str, reference_path: str) -> None:
    """Logs (id, ..., references) and their references. References go first: a log that is there has all of its own."""
    append(reference_rows(logs), reference_path)
    top = F.try_element_at("references", F.lit(1))
    append(logs.select("*", top["title"].alias("top_reference_title"), top["score"].alias("top_reference_score"), top["url"].alias("top_reference_url")).drop("references"), log_path)


def reset(schema: str, spark: SparkSession, path: str) -> None:
    """An empty collection in place of what is there."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def migrated(df: DataFrame, schema: StructType) -> DataFrame:
    """df with all columns of a newer schema: those it lacks are null, those that the schema doesn't name stay behind."""
    have = set(df.columns)
    new = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*new, *(c for c in df.columns if c not in schema.fieldNames()))


def export_csv(rows: DataFrame, path: str, order: str | None = None) -> None:
    """CSV with a header, in order of a column where one is given: file by file, as their names go."""
    (rows if order is None else rows.orderBy(order)).write.mode("overwrite").option("header", "true").csv(path)


def exported(rows: DataFrame, form: str, time: str = "timestamp") -> DataFrame:
    """(place, line) of rows as JSON or CSV, newest first; of CSV the first line is the header. Rows are placed within their hour, in many tasks;
    one task adds up the hours' counts alone."""
    if form not in ("json", "csv"):
        raise ValueError("form must be json or csv")
    columns = F.struct(*rows.columns)
    line = F.to_json(columns, {"ignoreNullFields": "false"}) if form == "json" else F.to_csv(columns)
    hour = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 3_600_000_000).cast("long")
    hours = rows.groupBy(hour.alias("__hour")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(F.desc("__hour")).rowsBetween(Window.unboundedPreceding, -1))
    hours = hours.select("__hour", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__hour").orderBy(F.desc(time), F.desc("id"))
    placed = rows.withColumns({"__line": line, "__hour": hour}).withColumn("__place", F.row_number().over(inside))
    met = placed.alias("a").join(F.broadcast(hours).alias("b"), F.col("a.__hour").eqNullSafe(F.col("b.__hour")))
    out = met.select((F.col("__before") + F.col("__place")).cast("long").alias("place"), F.col("__line").alias("line"))
    return out if form == "json" else out.unionByName(rows.sparkSession.createDataFrame([(0, ",".join(rows.columns))], "place long, line string"))


def clients(chunks: DataFrame) -> DataFrame:
    return chunks.select("client_id").distinct()
