"""Fixed schemas of the three stored tables, and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"bigint": T.LongType(), "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k], True) for n, k in (x.split(":") for x in text.split())])


COMPLAINTS = _schema(
    "id:bigint company:string complaint_url:string complaint_date:string title:string complaint_text:string resolved:int company_responded:int company_response_text:string "
    "company_response_date:string response_hours:double resolution_text:string resolution_date:string resolution_hours:double listing_page:int scraped_at:string"
)
CRAWL_ITEMS = T.StructType([T.StructField(f.name, T.BooleanType() if f.name in ("resolved", "company_responded") else f.dataType) for f in COMPLAINTS if f.name != "id"])
SENTIMENT_RESULTS = _schema("complaint_id:bigint model_id:string analyzer_version:string text_hash:string label:string confidence:double negative:double neutral:double positive:double analyzed_at:string")
ASPECT_SENTIMENT = _schema("complaint_id:bigint category:string model_id:string analyzer_version:string text_hash:string sentence_count:int negative:double neutral:double positive:double analyzed_at:string")
PAGES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("page_num", T.IntegerType()),
    ]
)
TABLES = {"complaints": COMPLAINTS, "sentiment_results": SENTIMENT_RESULTS, "aspect_sentiment": ASPECT_SENTIMENT}
#: Column order of exports.
COLUMNS = COMPLAINTS.fieldNames()


def without_nan(df: DataFrame) -> DataFrame:
    """Doubles that are no number become null, as in every stored table."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t == "double"})


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order: missing ones as nulls, others cast, NaN as null; extra columns are left out."""
    have = set(df.columns)
    return without_nan(df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]))
