"""The engine's functions under their names in SQL."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lorespark.functions.quality import FILLERS
from lorespark.functions.stem import stem
from lorespark.operators.chunking import split_long


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: html.unescape(t) if t is not None else None)


@F.pandas_udf(StringType())
def ru_stem(s: pd.Series) -> pd.Series:
    forms = {w: stem(w.lower()) for w in s.dropna().unique()}
    return s.map(lambda w: forms.get(w) if w is not None else None)


class SplitLong:
    """(part, piece) of an oversized line."""

    def eval(self, line: str):
        for n, piece in enumerate(split_long(line), 1) if line is not None else ():
            yield n, piece


#: Functions that SQL itself can say, so that they stay in the JVM.
IN_SQL = [
    r"""collapse_repeats(t STRING) RETURNS STRING RETURN CASE WHEN t RLIKE r'([^\n]{1,4}?)\1{4}' THEN regexp_replace(t, r'(?U)(([\d.,\s]{1,4}?)\2{4,})|([^\n]{1,4}?)\3{4,}', '$1$3$3$3') ELSE t END""",
    """cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
       / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))""",
    r"""repetition_stats(t STRING) RETURNS STRUCT<best: INT, word: STRING, share: DOUBLE, n: INT> RETURN
       aggregate(regexp_extract_all(lower(coalesce(t, '')), r'(?U)(\w+)', 1), named_struct('best', 0, 'word', '', 'run', 0, 'prev', '', 'n', 0),
         (s, x) -> named_struct('best', greatest(s.best, if(x = s.prev, s.run + 1, 1)), 'word', if(if(x = s.prev, s.run + 1, 1) > s.best, x, s.word), 'run', if(x = s.prev, s.run + 1, 1), 'prev', x, 'n', s.n + 1),
         s -> named_struct('best', s.best, 'word', s.word, 'share', CAST(if(s.n > 0, s.best / s.n, 0) AS DOUBLE), 'n', s.n))""",
    f"""loops(r STRUCT<best: INT, word: STRING, share: DOUBLE, n: INT>) RETURNS BOOLEAN RETURN
       CASE WHEN r.best >= 15 THEN true WHEN r.word IN ({", ".join(repr(w) for w in FILLERS)}) THEN false WHEN r.best >= 7 THEN true ELSE r.best >= 4 AND r.share > 0.3 AND r.n >= 30 END""",
    "is_suspect(t STRING) RETURNS BOOLEAN RETURN loops(repetition_stats(t))",
]


def register(spark: SparkSession) -> None:
    """collapse_repeats, html_unescape, repetition_stats, is_suspect, ru_stem, cosine_distance, and the table function split_long."""
    for body in IN_SQL:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    spark.udf.register("html_unescape", html_unescape)
    spark.udf.register("ru_stem", ru_stem)
    spark.udtf.register("split_long", F.udtf(SplitLong, returnType="part int, piece string"))
