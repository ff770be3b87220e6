"""Small lookup tables: quality dictionaries, stop words, line counts."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topictide import schemas
from topictide.functions.text import strip

LIST_MARK = "、"


def _whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary JSON as ``kid, keyword, term, polarity``; the head word is no term of its own."""
    entries = _whole_text(spark, path).select(
        F.explode(F.from_json("value", schemas.DICTIONARY_JSON)).alias("kid", "entry")
    )
    return dictionary_terms(entries.select("kid", "entry.*"))


def dictionary_frame(spark: SparkSession, dictionary: dict) -> DataFrame:
    """A dictionary held in Python as ``kid, keyword, term, polarity``."""
    rows = [(kid, e["keyword"], e["synonyms"], e["antonyms"]) for kid, e in dictionary.items()]
    schema = "kid STRING, keyword STRING, synonyms ARRAY<STRING>, antonyms ARRAY<STRING>"
    return dictionary_terms(spark.createDataFrame(rows, schema))


def dictionary_terms(entries: DataFrame) -> DataFrame:
    """One row per quality and distinct term; a term in both lists counts as a synonym.

    A missing list is empty, and empty terms are none.
    """
    synonyms, antonyms = (
        F.filter(F.coalesce(name, F.array().cast("array<string>")), lambda t: t != "")
        for name in ("synonyms", "antonyms")
    )
    terms = F.array_union(
        F.transform(synonyms, lambda t: F.struct(t.alias("term"), F.lit("synonym").alias("p"))),
        F.transform(
            F.array_except(antonyms, synonyms),
            lambda t: F.struct(t.alias("term"), F.lit("antonym").alias("p")),
        ),
    )
    return entries.select("kid", "keyword", F.explode(terms).alias("t")).select(
        "kid", "keyword", F.col("t.term").alias("term"), F.col("t.p").alias("polarity")
    )


def build_dictionary(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Dictionary entries of a 3-column CSV table; ids count the rows from 1 in file order.

    The table is one small file, read as one value, so row numbers are plain
    array positions and need no global sort.
    """
    lines = F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")
    rows = F.filter(lines, lambda line: F.length(F.trim(line)) > 0)
    if header:
        rows = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    table = _whole_text(spark, path).select(F.posexplode(rows).alias("pos", "line"))
    parsed = table.select(
        "pos", F.from_csv(
            "line", "keyword STRING, synonyms STRING, antonyms STRING", {"escape": '"'}
        ).alias("r")
    )
    return parsed.select(
        (F.col("pos") + 1).cast("string").alias("kid"),
        "r.keyword",
        F.split("r.synonyms", LIST_MARK).alias("synonyms"),
        F.split("r.antonyms", LIST_MARK).alias("antonyms"),
    )


def dictionary_json(entries: DataFrame) -> DataFrame:
    """Dictionary entries as one JSON text: id -> keyword, synonyms, antonyms."""
    row = F.struct(
        F.col("kid").cast("int").alias("n"),
        "kid",
        F.struct("keyword", "synonyms", "antonyms").alias("entry"),
    )
    ordered = F.array_sort(F.collect_list(row))
    pairs = F.transform(ordered, lambda r: F.struct(r["kid"], r["entry"]))
    return entries.agg(F.to_json(F.map_from_entries(pairs)).alias("value"))


def read_stopwords(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """Distinct stop words as ``word``; a missing file is an empty list."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "word STRING")
    word = strip("value") if trim else F.col("value")
    return lines.select(word.alias("word")).distinct()


def read_line_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines per day, ``dt, total_count``, of ``date,count`` logs."""
    return spark.read.schema(schemas.LINE_COUNTS).csv(path)
