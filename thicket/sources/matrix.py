"""Matrices and annotations: readers, label rules, and the long and vector forms.

Long form: (unit_id, object, value).  Vector form: (unit_id, values) with an ordered
list of object labels.  NaN becomes NULL on entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Objects that the vector form may have.
MOST_OBJECTS = 10_000
_BOM = "﻿"


def check_labels(labels: list[str]) -> list[str]:
    """Labels must be distinct and free of the separators that identify clusters."""
    labels = [str(x) for x in labels]
    bad = [x for x in labels if "," in x or ";" in x]
    if bad:
        raise ValueError(f"labels may not contain ',' or ';': {bad[:4]}")
    if len(set(labels)) != len(labels):
        raise ValueError("labels are repeated")
    return labels


def read_table(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """A CSV or (by suffix .tsv, .txt) tab-separated table; Parquet and JSON by suffix too."""
    if path.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    df = spark.read.csv(path, header=True, inferSchema=infer, sep="\t" if path.endswith((".tsv", ".txt")) else ",", encoding="UTF-8")
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip(_BOM)) if first.startswith(_BOM) else df


def number(c: Column) -> Column:
    """A double; NaN and what isn't a number are NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def to_long(df: DataFrame, unit: str, objects: list[str]) -> DataFrame:
    wide = df.select(F.col(f"`{unit}`").cast("string").alias("unit_id"), *[number(F.col(f"`{o}`")).alias(o) for o in objects])
    return wide.unpivot("unit_id", objects, "object", "value")


def to_vectors(df: DataFrame, unit: str, objects: list[str]) -> DataFrame:
    return df.select(F.col(f"`{unit}`").cast("string").alias("unit_id"), F.array(*[number(F.col(f"`{o}`")) for o in objects]).alias("values"))


def orient(long: DataFrame, axis: str) -> DataFrame:
    """Units and objects as they are ('columns') or exchanged ('rows')."""
    if axis not in ("columns", "rows"):
        raise ValueError("axis is 'columns' or 'rows'")
    return long if axis == "columns" else long.select(F.col("object").alias("unit_id"), F.col("unit_id").alias("object"), "value")


def long_to_vectors(long: DataFrame) -> tuple[DataFrame, list[str]]:
    """Vector form of a long table and its sorted object labels (which must be few enough for a tree)."""
    found = [r[0] for r in long.select("object").distinct().limit(MOST_OBJECTS + 1).collect()]
    if len(found) > MOST_OBJECTS:
        raise ValueError(f"more than {MOST_OBJECTS} objects are too many for a tree")
    labels = check_labels(sorted(found))
    wide = long.groupBy("unit_id").pivot("object", labels).agg(F.first("value"))
    return wide.select("unit_id", F.array(*[F.col(f"`{x}`") for x in labels]).alias("values")), labels


def read_matrix(spark: SparkSession, path: str, transpose: bool = False, take_log2: bool = False, feature_map: DataFrame | None = None) -> DataFrame:
    """The long form of a matrix file whose first column is the unit id."""
    df = read_table(spark, path)
    long = to_long(df, df.columns[0], df.columns[1:])
    if feature_map is not None:
        long = relabel(long, feature_map)
    if transpose:
        long = orient(long, "rows")
    return log2(long) if take_log2 else long


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    return df.withColumnRenamed(df.columns[0], "unit_id").withColumn("unit_id", F.col("unit_id").cast("string"))


def relabel(long: DataFrame, feature_map: DataFrame) -> DataFrame:
    """Objects renamed by a (key, label) table: unmapped keys and missing labels keep the key; a label
    that several keys share is followed by the key."""
    key, label = feature_map.columns[:2]
    pairs = feature_map.select(F.col(key).cast("string").alias("object"), F.col(label).cast("string").alias("label")).dropDuplicates(["object"])
    named = long.select("object").distinct().join(pairs, "object", "left").withColumn("label", F.coalesce("label", "object"))
    shared = F.count("*").over(Window.partitionBy("label")) > 1
    named = named.withColumn("label", F.when(shared & (F.col("label") != F.col("object")), F.concat("label", F.lit(" ("), "object", F.lit(")"))).otherwise(F.col("label")))
    if named.count() != named.select("label").distinct().count():
        raise ValueError("labels are still repeated after adding keys")
    return long.join(named, "object").select("unit_id", F.col("label").alias("object"), "value")


def log2(long: DataFrame) -> DataFrame:
    """Base-2 logarithms; a value of zero or less stops the run."""
    bad = F.raise_error(F.lit("log2 needs values above zero"))
    return long.withColumn("value", F.when(F.col("value") <= 0, bad.cast("double")).otherwise(F.log2("value")))


def zscore(long: DataFrame, keep_null: bool = False) -> DataFrame:
    """Each object's values centred and divided by their sample deviation; missing values and objects
    without spread become 0 unless ``keep_null``."""
    own = long.groupBy("object").agg(F.avg("value").alias("mean_"), F.stddev_samp("value").alias("sd_"))
    z = F.when(F.col("sd_") > 0, (F.col("value") - F.col("mean_")) / F.col("sd_"))
    return long.join(own, "object").withColumn("value", z if keep_null else F.coalesce(z, F.lit(0.0))).select(*long.columns)


def top_variable(long: DataFrame, n: int) -> DataFrame:
    """Only the n objects of largest sample variance (ties by label)."""
    best = long.groupBy("object").agg(F.var_samp("value").alias("var")).orderBy(F.desc_nulls_last("var"), "object").limit(n)
    return long.join(best.select("object"), "object", "left_semi")


def restrict(long: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Only the objects in a (feature) table, all of which must be there."""
    wanted = vocabulary.select(F.col("feature").alias("object")).distinct()
    missing = [r[0] for r in wanted.join(long.select("object").distinct(), "object", "left_anti").limit(4).collect()]
    if missing:
        raise ValueError(f"features are missing: {missing}")
    return long.join(wanted, "object", "left_semi")


def vocabulary(long: DataFrame, project: str) -> DataFrame:
    """(feature, n_present, mean, sd, project)."""
    return long.groupBy(F.col("object").alias("feature")).agg(F.count("value").alias("n_present"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).withColumn("project", F.lit(project))


def read_positional(spark: SparkSession, values: str, samples: str, reagents: str, sample_id: str = "SampleId", reagent_id: str = "SeqId", label: str | None = None, sample_type: str | None = "Sample", take_log2: bool = False) -> DataFrame:
    """A headerless tab-separated value table whose i-th row is the i-th sample and whose j-th column is the
    j-th reagent.  Lines are numbered by their place in the file: by file blocks, and within each."""

    def numbered(path, header):
        raw = spark.read.text(path).select("value", F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("mid"))
        blocks = raw.groupBy("block").agg(F.count("*").alias("n"))  # a row per file block
        before = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
        own = F.row_number().over(Window.partitionBy("block").orderBy("mid")) - 1
        lines = raw.withColumn("own", own).join(F.broadcast(before), "block").select((F.col("before") + F.col("own")).cast("int").alias("at"), F.regexp_replace("value", "\r$", "").alias("line")).where("line <> ''")
        cells = lines.select("at", F.split("line", "\t").alias("cells"))
        if not header:
            return cells, None
        names = cells.where("at = 0").first()["cells"]
        return cells.where("at > 0").select((F.col("at") - 1).alias("at"), *[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)]), names

    grid, _ = numbered(values, False)
    people, _ = numbered(samples, True)
    things, names = numbered(reagents, True)
    n, p = people.count(), things.count()
    shape = grid.agg(F.count("*").alias("n"), F.min(F.size("cells")).alias("lo"), F.max(F.size("cells")).alias("hi")).first()
    if (shape["n"], shape["lo"], shape["hi"]) != (n, p, p):
        raise ValueError(f"values are {shape['n']} x {shape['lo']}..{shape['hi']}, annotations {n} x {p}")
    twice = F.count("*").over(Window.partitionBy(sample_id)) > 1
    people = people.withColumn("unit_id", F.when(twice, F.concat(F.col(sample_id), F.lit("_"), F.col("at").cast("string"))).otherwise(F.col(sample_id)))
    if sample_type is not None and "SampleType" in people.columns:
        people = people.where(F.col("SampleType") == sample_type)
    things = things.withColumn("object", F.col(label if label in names else reagent_id) if label else F.col(reagent_id)).select(F.col("at").alias("col"), "object")
    cells = grid.select("at", F.posexplode("cells").alias("col", "raw")).join(people.select("at", "unit_id"), "at").join(F.broadcast(things), "col")
    long = cells.select("unit_id", "object", number(F.col("raw")).alias("value"))
    return log2(long) if take_log2 else long
