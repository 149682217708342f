"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names, and the schema of documents."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    """n words that depend on the seed; different seeds share none."""
    out, x = [], seed * 2654435761 % (1 << 32) + 1
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{seed}x{x % 997}y{i}")
    return out


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("ids", "n", "key", "score", "kept", "component_id", "spans", "n_words", "shard"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df
