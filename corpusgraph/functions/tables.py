"""The chunkers as table functions for SQL: ``SELECT ... FROM notes, LATERAL chunks(text, 'hybrid')``.

What a call returns depends on its arguments, which are looked at when the query is planned: an unknown strategy is an error there, and
strategies that know no headings give no columns for them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusgraph.operators import chunking, ingest

_PLACE = [StructField("chunk", IntegerType()), StructField("text", StringType())]
_HEADINGS = [StructField("start", LongType()), StructField("heading_path", StringType()), StructField("heading_level", IntegerType()), StructField("section_title", StringType())]
#: Strategies that give places and headings as well.
STRUCTURED = tuple(ingest.STRATEGIES)
PLAIN = ("plain_recursive", "plain_cosine", "plain_semantic")


def _split(strategy: str, text: str) -> list[str]:
    return {"plain_recursive": chunking.split_recursive, "plain_cosine": chunking.split_by_similarity, "plain_semantic": ingest.split_semantic}[strategy](text)


@udtf
class Chunks:
    """chunks(text, strategy): the chunks of a text in order."""

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("the text must be a string")
        if not strategy.isConstantExpression or strategy.value not in (*STRUCTURED, *PLAIN):
            raise ValueError(f"unknown strategy {strategy.value}; known are {', '.join((*STRUCTURED, *PLAIN))}")
        return AnalyzeResult(StructType(_PLACE + (_HEADINGS if strategy.value in STRUCTURED else [])))

    def eval(self, text: str, strategy: str):
        if strategy in PLAIN:
            yield from enumerate(_split(strategy, text or ""))
        else:
            for c in ingest.STRATEGIES[strategy](text or ""):
                yield c["chunk"], c["text"], c["start"], c["heading_path"], c["heading_level"], c["section_title"]


@udtf(returnType="sentence int, start int, end int")
class Sentences:
    """sentences(text): the places of a text's sentences."""

    def eval(self, text: str):
        for k, (a, b) in enumerate(ingest.sentences(text or "")):
            yield k, a, b


def register(spark: SparkSession) -> None:
    """Makes ``chunks`` and ``sentences`` known to a session's SQL."""
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("sentences", Sentences)
