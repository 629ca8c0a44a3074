"""Documents from any Spark source: ids, dates, categories, metadata."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("str_id", T.StringType()),
        T.StructField("timestamp", T.DateType()),
        T.StructField("timestamp_ordinal", T.IntegerType()),
        T.StructField("categories", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


#: Ids from here up are hashes of string ids; those below are given or counted.
HASHED = 1 << 62


def hashed_id(text: Column) -> Column:
    """The doc_id of a string id; null for none."""
    return F.when(text.isNotNull(), F.xxhash64(text).bitwiseAND(F.lit(HASHED - 1)) + F.lit(HASHED))


def numbered(new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``new`` with ids where doc_id is null, above all given ids of ``new`` and ``known`` that aren't hashes.

    The ids hold only as long as the result isn't computed again: write it.
    """
    given = new if known is None else new.select("doc_id").unionByName(known.select("doc_id"))
    top, blank = given.agg(F.max(F.when(F.col("doc_id") < HASHED, F.col("doc_id"))), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    if not blank:
        return new
    return new.withColumn("doc_id", F.coalesce("doc_id", F.lit(max(0, top or 0) + 1) + F.monotonically_increasing_id()))


def _no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def documents(df: DataFrame, text: str = "text", doc_id: str | None = None, timestamp: str | None = None, ordinal: str | None = None, categories: list[str] | Column | None = None, metadata: list[str] | None = None, metadata_map: str | None = None) -> DataFrame:
    """A table of DOCUMENTS from the columns of ``df``.

    Integer ids become doc_id; string ids become str_id and doc_id their hash from
    HASHED up, the same for the same string in any batch.  Without ids doc_id is
    null, and every row is a document of its own, equal texts too; fitting a model
    numbers them.  ``categories`` names columns of strings or arrays of strings.
    """
    kinds = dict(df.dtypes)
    number = doc_id is not None and kinds[doc_id] in ("tinyint", "smallint", "int", "bigint")
    if doc_id is None:
        key, text_id = F.lit(None).cast("long"), F.lit(None).cast("string")
    elif number:
        key, text_id = F.col(doc_id).cast("long"), F.lit(None).cast("string")
    else:
        key, text_id = hashed_id(F.col(doc_id).cast("string")), F.col(doc_id).cast("string")
    if isinstance(categories, list):
        cats = category_map({c: F.col(c) if kinds[c].startswith("array") else F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))) for c in categories})
    else:
        cats = categories if categories is not None else F.create_map().cast("map<string,array<string>>")
    meta = F.map_filter(F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]), lambda _, v: v.isNotNull()) if metadata else F.col(metadata_map) if metadata_map else _no_metadata()
    return df.select(
        key.alias("doc_id"), F.col(text).cast("string").alias("text"), text_id.alias("str_id"),
        (F.col(timestamp).cast("date") if timestamp else F.lit(None).cast("date")).alias("timestamp"),
        (F.col(ordinal).cast("int") if ordinal else F.lit(None).cast("int")).alias("timestamp_ordinal"),
        cats.alias("categories"), meta.alias("metadata"),
    )


def category_map(columns: dict[str, Column]) -> Column:
    """A map of names to arrays of strings, without the names whose array is null or empty."""
    full = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c.cast("array<string>"))])
    return F.map_filter(full, lambda _, v: F.coalesce(F.size(v), F.lit(0)) > 0)


def normalize_categories(categories: Any, n_docs: int) -> list[dict[str, list[str]]]:
    """Categories of driver-side lists, in any of four shapes, as one map for each document.

    A list of strings or of lists of strings has the name "category"; a list of maps
    gives each document's own; a map of lists gives every name's values by document.
    None gives empty maps.  ValueError for other shapes and unequal lengths.
    """

    def values(v: Any) -> list[str]:
        return [] if v is None else [v] if isinstance(v, str) else list(v)

    if categories is None:
        return [{} for _ in range(n_docs)]
    if isinstance(categories, dict):
        for v in categories.values():
            if not isinstance(v, list):
                raise ValueError("the values of a map of categories must be lists")
            if len(v) != n_docs:
                raise ValueError("categories must be as many as documents")
        return [{name: values(v[i]) for name, v in categories.items()} for i in range(n_docs)]
    if not isinstance(categories, list):
        raise ValueError("categories must be a list or a map")
    if len(categories) != n_docs:
        raise ValueError("categories must be as many as documents")
    if categories and all(isinstance(c, dict) for c in categories):
        return [{name: values(v) for name, v in c.items()} for c in categories]
    if any(isinstance(c, dict) for c in categories):
        raise ValueError("categories must be all maps or none")
    return [{"category": values(c)} for c in categories]


def from_lists(spark: SparkSession, docs: list[str], doc_ids: list | None = None, timestamps: list | None = None, timestamps_ordinal: list[int] | None = None, categories: Any = None, metadata: list[dict] | None = None, first_id: int = 1) -> DataFrame:
    """A table of DOCUMENTS from parallel lists, which must be of one length.

    Without ids the documents are numbered from ``first_id``; see ``documents`` for string ids.
    """
    for name, values in (("doc_ids", doc_ids), ("timestamps", timestamps), ("timestamps_ordinal", timestamps_ordinal), ("metadata", metadata)):
        if values is not None and len(values) != len(docs):
            raise ValueError(f"{name} must be as many as documents")
    cats = normalize_categories(categories, len(docs))
    strings = doc_ids is not None and any(isinstance(i, str) for i in doc_ids)
    rows = []
    for k, text in enumerate(docs):
        t = timestamps[k] if timestamps else None
        rows.append(
            (
                None if strings else doc_ids[k] if doc_ids else first_id + k, text, str(doc_ids[k]) if strings else None, t.date() if hasattr(t, "date") else t,
                timestamps_ordinal[k] if timestamps_ordinal else None, cats[k], {m: str(v) for m, v in metadata[k].items()} if metadata else {},
            )
        )
    out = spark.createDataFrame(rows, DOCUMENTS)
    return out.withColumn("doc_id", hashed_id(F.col("str_id"))) if strings else out


def read_jsonl(spark: SparkSession, path: str, schema: str = "text string, id string, timestamp string, timestamp_ordinal int, category string, metadata map<string,string>") -> DataFrame:
    """Documents of JSON lines with a known schema, so that nothing is inferred."""
    df = spark.read.schema(schema).json(path)
    out = documents(df.withColumn("__metadata", F.coalesce("metadata", _no_metadata())), "text", "id", "timestamp", "timestamp_ordinal", ["category"], metadata_map="__metadata")
    return out


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


#: Sections of a book: parted by one blank line, or by several.
SECTIONS = r"(?<=\S)\n\n(?=\S)|\n{3}"


def sections(df: DataFrame, text: str = "text", pattern: str = SECTIONS) -> DataFrame:
    """The sections of each text with their ordinals."""
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, pattern)).alias("timestamp_ordinal", text)).filter(F.trim(F.col(text)) != "")


def demo_sample(df: DataFrame, category: str, values: list[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """A random sample of the rows of some categories, with headline and description as one text."""
    text = F.concat_ws("\n\n", "headline", "short_description")
    return df.filter(F.col(category).isin(*values)).orderBy(F.rand(seed)).limit(n).withColumn("text", text)
