"""Small tables in shared folders, and rows that try an operator's edges."""

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 40_000


def saved(df, tmp_path, name="t"):
    """df as a stored table: operators number the rows of files."""
    path = str(tmp_path / f"{name}.parquet")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def documents(spark, tmp_path, rows, name="documents"):
    """rows: (doc_id, text) or (doc_id, text, lang). Extra columns clash with names that operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("__row", "__spans", "spans", "score", "fp", "bucket", "h", "w", "length", "held_out", "items"):
        df = df.withColumn(c, F.lit(7))
    return saved(df.repartition(3), tmp_path, name)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Zwei drei"), (5, "Zwei drei"), (6, LONG), (None, "no id at all here"), (7, "¿Qué? İstanbul ǅ é 🎉"), (8, "\x00 \x1f")]


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
