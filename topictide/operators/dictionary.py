"""Posts against the quality dictionary: texts per quality, counts per term.

``dictionary`` is ``kid, keyword, term, polarity`` as the dictionary readers give it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topictide.functions.rows import only_if
from topictide.functions.rules import contains_any
from topictide.functions.text import own_content
from topictide.lineage import cut_lineage
from topictide.operators.match import SCAN_TERMS, match_terms


def _known_terms(dictionary: DataFrame) -> DataFrame:
    """One row per term with the qualities it belongs to; an empty term is none."""
    return dictionary.where(F.col("term") != "").groupBy("term").agg(F.sort_array(F.collect_set("kid")).alias("kids"))


def _bounded_terms(dictionary: DataFrame) -> list[tuple[str, list[str]]] | None:
    """Terms as a list if they are few enough for the scan, else None."""
    rows = _known_terms(dictionary).limit(SCAN_TERMS + 1).collect()
    return [(r["term"], r["kids"]) for r in rows] if len(rows) <= SCAN_TERMS else None


def _scan_hits(texts: DataFrame, known: list[tuple[str, list[str]]]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(term).alias("term"), F.array(*[F.lit(kid) for kid in kids]).alias("kids"))
        for term, kids in known
    ])
    hits = F.filter(entries, lambda entry: F.contains(F.col("text"), entry["term"]))
    return texts.select("*", F.explode(only_if(hits, lambda h: F.size(h) > 0)).alias("hits"))


def _anchor_hits(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """As the scan, for many terms; rows of ``texts`` must be distinct, they are the key."""
    found = match_terms(texts, _known_terms(dictionary), "text", "term")
    return found.groupBy(*texts.columns).agg(
        F.collect_list(F.struct("term", "kids")).alias("hits")
    )


def _kids_of_hits() -> Column:
    return F.array_distinct(F.flatten(F.transform("hits", lambda hit: hit["kids"])))


def quality_hits(
    posts: DataFrame, dictionary: DataFrame, content: str = "weibo_content",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Distinct own contents (per ``by``) that hold a term: ``text, _posts, hits``, stored.

    ``_posts`` is how many posts have the content, ``hits`` the terms and their qualities.
    Texts per quality and counts of terms both come from this table, so the posts are read
    once.
    """
    texts = posts.select(*by, own_content(content).alias("text"))
    known = _bounded_terms(dictionary)
    if known is not None:
        some = texts.where(contains_any("text", [term for term, _ in known]))
        found = _scan_hits(_counted(some, by), known)
    else:
        found = _anchor_hits(_counted(texts, by), dictionary)
    return cut_lineage(found)


def _counted(texts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return texts.groupBy(*by, "text").agg(F.count(F.lit(1)).alias("_posts"))


def texts_of_hits(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``texts_by_quality`` from stored hits."""
    return hits.select(*by, F.explode(_kids_of_hits()).alias("kid"), "text")


def counts_of_hits(hits: DataFrame, weighted: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """``term_counts`` from stored hits."""
    weight = F.col("_posts") * F.size(_kids_of_hits()) if weighted else F.col("_posts")
    each = hits.select(*by, weight.alias("_w"), F.explode("hits").alias("hit"))
    return each.groupBy(*by, F.col("hit.term").alias("term")).agg(F.sum("_w").alias("count"))


def texts_by_quality(
    posts: DataFrame,
    dictionary: DataFrame,
    content: str = "weibo_content",
    by: tuple[str, ...] = ("year",),
) -> DataFrame:
    """Distinct own contents per quality (and ``by``) that hold a term of the quality.

    Texts without a term are dropped first; the rest are made distinct before
    they are spread over their qualities, so each is shuffled once.
    """
    texts = posts.select(*by, own_content(content).alias("text"))
    known = _bounded_terms(dictionary)
    if known is not None:
        some = contains_any("text", [term for term, _ in known])
        found = _scan_hits(texts.where(some).distinct(), known)
    else:
        found = _anchor_hits(texts.distinct(), dictionary)
    return found.select(*by, F.explode(_kids_of_hits()).alias("kid"), "text")


def term_counts(
    posts: DataFrame,
    dictionary: DataFrame,
    content: str = "weibo_content",
    weighted: bool = True,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``term, count`` over all posts (and per ``by``).

    Weighted, a post that matches k qualities adds k to each of its terms;
    plain, it adds 1.
    """
    texts = posts.select(*by, own_content(content).alias("text"))
    known = _bounded_terms(dictionary)
    if known is not None:
        found = _scan_hits(texts.withColumn("_posts", F.lit(1).cast("bigint")), known)
    else:
        # Equal texts are counted first, which also makes the text the key of its hits.
        texts = texts.groupBy(*by, "text").agg(F.count(F.lit(1)).alias("_posts"))
        found = _anchor_hits(texts, dictionary)
    weight = F.col("_posts")
    if weighted:
        weight = weight * F.size(_kids_of_hits())
    return (
        found.withColumn("_w", weight)
        .select(*by, "_w", F.explode("hits").alias("hit"))
        .groupBy(*by, F.col("hit.term").alias("term"))
        .agg(F.sum("_w").alias("count"))
    )


def merge_counts(*counts: DataFrame) -> DataFrame:
    """Sum of several ``term, count`` tables by term."""
    merged = counts[0].select("term", "count")
    for table in counts[1:]:
        merged = merged.unionByName(table.select("term", "count"))
    return merged.groupBy("term").agg(F.sum("count").alias("count"))


def describe_terms(counts: DataFrame, dictionary: DataFrame, mark: str = "、") -> DataFrame:
    """``term, qualities, count``: each counted term with the names of its qualities."""
    names = dictionary.groupBy("term").agg(
        F.array_join(F.sort_array(F.collect_set("keyword")), mark).alias("qualities")
    )
    return counts.join(names, "term", "left").select("term", "qualities", "count")
