"""Source files that do not parse in the language their extension names."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamgraph.llm.lexers import EXTENSIONS, fault
from loamgraph.sources.tables import spread


@F.pandas_udf(StringType())
def _fault(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([fault(t, g) if g is not None else None for t, g in zip(text, language)], dtype=object)


def file_faults(files: DataFrame) -> DataFrame:
    """file_no, repo, path, language, fault (null: valid) for every file.

    The language follows from the last extension of `path`, in any case; a path of no known extension, or
    null, gives a null language and no fault. A null text has no fault, an empty one is judged like any
    other. Whole texts are read, whatever their length; brackets nested deeper than the interpreter's
    stack allows count as valid. Files are judged one by one, so any distribution of rows balances. Other columns are ignored.
    """
    ext = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    language = F.element_at(F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p]), F.nullif(ext, F.lit("")))
    language = F.when(ext.isin(*EXTENSIONS), language)
    named = spread(files.select("file_no", "repo", "path", "content"), "file_no").select("file_no", "repo", "path", "content", language.alias("language"))
    return named.select("file_no", "repo", "path", "language", _fault("content", "language").alias("fault"))


def fault_rates(faults: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files, their rate, and how many of each fault."""
    kinds = ["unterminated_literal", "unterminated_comment", "unbalanced", "premature_end", "conflict_marker", "bad_character", "unexpected_token", "unexpected_indent", "foreign_declaration"]
    return (
        faults.where(F.col("language").isNotNull())
        .groupBy("repo", "language")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.count("fault").alias("n_invalid"),
            F.round(F.count("fault") / F.count(F.lit(1)), 6).alias("invalid_rate"),
            *[F.count_if(F.col("fault") == k).alias(f"n_{k}") for k in kinds],
        )
    )
