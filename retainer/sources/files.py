"""Readers, writers, contracts and generators.

Readers always pass an explicit schema (no inference pass over the data);
writers keep the data partitioned -- nothing is coalesced to one file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retainer import schema as S


# A1 ---------------------------------------------------------------------------------------

def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str | None = None, header: bool = True, corrupt_column: str | None = None) -> DataFrame:
    """CSV (header row) or Parquet/JSON/ORC with an explicit schema.

    Every CSV file's header must name the schema's columns in order, else the
    read fails instead of shifting columns.  ``corrupt_column`` keeps the text
    of CSV and JSON records that did not parse, so that they can be counted."""
    fmt = fmt or _guess_format(path)
    reader = spark.read
    if schema is not None:
        if corrupt_column and fmt in ("csv", "json"):
            schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(schema.fields)
            schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
            reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
        reader = reader.schema(schema)
    if fmt == "csv":
        return (reader.option("header", str(header).lower()).option("enforceSchema", "false")
                .option("mode", "PERMISSIVE").csv(path))
    return reader.format(fmt).load(path)


def read_customers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The raw labelled customer table (``RAW_CUSTOMER_SCHEMA``)."""
    return read_table(spark, path, S.RAW_CUSTOMER_SCHEMA, fmt)


def read_scoring_input(spark: SparkSession, path: str, fmt: str | None = None,
                       schema: T.StructType = S.SCORING_INPUT_SCHEMA) -> DataFrame:
    """Scoring input; flags are read as text so Yes/No and 1/0 both parse.
    No format is read twice to find its types, and columns go by name in any order.

    CSV: the columns of the header, others than the schema's as text.  ORC and Parquet:
    the columns of the file footer, the schema's cast to its types.  JSON (a record a line):
    the schema's columns; a key that a record lacks is NULL, other keys are not read.  Pass a
    schema without CustomerId where records have none, and check the input with
    ``require_columns(filled=True)``, as a column that no record has cannot be told by its name."""
    fmt = fmt or _guess_format(path)
    if fmt == "csv":
        header = spark.read.option("header", "true").csv(path).columns  # reads the header line only
        fields = [schema[c] if c in schema.fieldNames() else T.StructField(c, T.StringType())
                  for c in header]
        return read_table(spark, path, T.StructType(fields), "csv")
    if fmt == "json":
        return read_table(spark, path, schema, "json")
    stored = read_table(spark, path, None, fmt)  # types come from a footer
    return stored.select([F.col(f"`{c}`").cast(schema[c].dataType).alias(c) if c in schema.fieldNames() else F.col(f"`{c}`")
                          for c in stored.columns])


def _guess_format(path: str) -> str:
    p = path.lower().rstrip("/")
    for ext, fmt in ((".csv", "csv"), (".json", "json"), (".jsonl", "json"), (".orc", "orc")):
        if p.endswith(ext):
            return fmt
    return "parquet"


# A2 ---------------------------------------------------------------------------------------

RECORD_SCHEMA = T.StructType([
    T.StructField("CustomerId", T.StringType()),
    T.StructField("CreditScore", T.DoubleType()),
    T.StructField("Geography", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.DoubleType()),
    T.StructField("Tenure", T.DoubleType()),
    T.StructField("Balance", T.DoubleType()),
    T.StructField("NumOfProducts", T.DoubleType()),
    T.StructField("HasCrCard", T.StringType()),
    T.StructField("IsActiveMember", T.StringType()),
    T.StructField("EstimatedSalary", T.DoubleType()),
])


def _typed_record_columns(src: str = "r") -> list:
    ints = ["CreditScore", "Age", "Tenure", "NumOfProducts"]
    out = []
    for f in RECORD_SCHEMA.fields:
        c = F.col(f"{src}.{f.name}")
        out.append((c.cast("int") if f.name in ints else c).alias(f.name))
    return out


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records (one object per line) -> typed rows; absent keys are NULL
    and get rule defaults later (B14)."""
    raw = spark.read.schema(RECORD_SCHEMA).json(path)
    return raw.select(F.struct(*raw.columns).alias("r")).select(*_typed_record_columns())


def parse_records(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON text column (e.g. a stream of messages) -> typed rows."""
    return df.select(F.from_json(F.col(column), RECORD_SCHEMA).alias("r")).select(*_typed_record_columns())


# A3 is in operators.batch.require_columns ---------------------------------------------------

# A4 / A5 ------------------------------------------------------------------------------------

def synthetic_customers(spark: SparkSession, n: int = 10000, seed: int = 42,
                        noise: bool = True, partitions: int | None = None) -> DataFrame:
    """Synthetic labelled customers: uniform ints, categorical draws by
    cumulative probability, label = additive rule (+ N(0, 0.05) noise) > 0.5.

    Distributed: every column is a seeded ``rand``/``randn`` over ``range``."""
    from retainer.functions import columns as C

    rng = spark.range(1, n + 1, numPartitions=partitions) if partitions else spark.range(1, n + 1)

    def u(i: int):
        return F.rand(seed + i)

    def uniform_int(i: int, lo: int, hi: int):
        return (F.floor(u(i) * (hi - lo)) + lo).cast("int")

    def draw(i: int, choices):
        r = u(i)
        acc, expr = 0.0, None
        for value, p in choices[:-1]:
            acc += p
            expr = F.when(r < acc, F.lit(value)) if expr is None else expr.when(r < acc, F.lit(value))
        return expr.otherwise(F.lit(choices[-1][0]))

    names = F.array(*[F.lit(s) for s in S.SYNTH_SURNAMES])
    df = rng.select(
        F.col("id").alias("RowNumber"),
        F.col("id").alias("CustomerId"),
        F.element_at(names, ((F.col("id") - 1) % len(S.SYNTH_SURNAMES) + 1).cast("int")).alias("Surname"),
        uniform_int(1, 300, 900).alias("CreditScore"),
        draw(2, S.SYNTH_GEOGRAPHY_P).alias("Geography"),
        F.when(u(3) < 0.5, "Male").otherwise("Female").alias("Gender"),
        uniform_int(4, 18, 95).alias("Age"),
        uniform_int(5, 0, 11).alias("Tenure"),
        (u(6) * 250000.0).alias("Balance"),
        draw(7, S.SYNTH_PRODUCTS_P).cast("int").alias("NumOfProducts"),
        (u(8) < 0.5).cast("int").alias("HasCrCard"),
        (u(9) < 0.5).cast("int").alias("IsActiveMember"),
        (u(10) * 190000.0 + 10000.0).alias("EstimatedSalary"),
    )
    score = C.additive_risk_terms()
    if noise:
        score = score + F.randn(seed + 11) * F.lit(0.05)
    return df.withColumn("Exited", (C.clip01(score) > 0.5).cast("int"))


# A7 / A8 ------------------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Partitioned sink; CSV gets a header row and no index column."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)


def write_nested_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested struct/array results as JSON lines."""
    df.write.mode(mode).json(path)


# A9 -----------------------------------------------------------------------------------------

def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


# A11 ----------------------------------------------------------------------------------------

def input_template(spark: SparkSession) -> DataFrame:
    """The 3-row upload template; its schema is the scoring contract."""
    return spark.createDataFrame(S.TEMPLATE_ROWS, S.SCORING_INPUT_SCHEMA)
