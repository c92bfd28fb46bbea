"""Small constant relations, built as local tables: Spark knows their size and broadcasts them itself."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner import constants as K, schemas


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows as a local relation. A plain list would become an RDD of unknown size, which no join
    would broadcast before shuffling the other side."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))],
                     schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


def keyword_table(spark: SparkSession, extra_keywords=()) -> DataFrame:
    rows = list(enumerate([*K.CATEGORY_KEYWORDS, *extra_keywords]))
    return local_table(spark, rows, schemas.struct(kw_pos="int", category_keyword="string"))


def event_table(spark: SparkSession, events) -> DataFrame:
    """The caller's events as (date, label, type, colour); dates are ISO strings."""
    rows = [(dt.date.fromisoformat(d), label, kind, color) for d, label, kind, color in events]
    return local_table(spark, rows, schemas.EVENTS)


def label_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, K.LABEL_SCORES[name]) for i, name in enumerate(K.LABELS)]
    return local_table(spark, rows, schemas.struct(pred_idx="int", label="string", label_score="int"))


def topic_label_table(spark: SparkSession, titles: dict | None = None,
                      descriptions: dict | None = None) -> DataFrame:
    """Titles belong to one trained model: pass the ones written for yours."""
    rows = [(k, title, (descriptions or {}).get(k)) for k, title in (titles or {}).items()]
    return local_table(spark, rows, schemas.struct(topic="int", title="string", description="string"))


def stopword_table(spark: SparkSession, brand_terms=()) -> DataFrame:
    return local_table(spark, [(w,) for w in K.stopword_set(brand_terms)], schemas.struct(word="string"))


def term_table(spark: SparkSession, terms: list[str]) -> DataFrame:
    return local_table(spark, list(enumerate(terms)), schemas.struct(term_id="int", term="string"))
