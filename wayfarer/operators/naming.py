"""Learning which parts of names vary.  All of it works on distinct names and distinct attribute values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import collapse, substitute
from ..schema import CHANGE_KIND

# Fixed values of the learning rule.
MAX_VOCABULARY_SIZE = 12
MIN_VALUE_LENGTH = 3


def attribute_strings(events: DataFrame) -> DataFrame:
    long = events.select(F.explode("attributes").alias("attribute", "v"))
    return long.where((F.col("v.t") == "str") & (F.length("v.s") >= MIN_VALUE_LENGTH)).select("attribute", F.col("v.s").alias("value")).distinct()


def learn_vocabulary(events: DataFrame) -> DataFrame:
    """(value, placeholder): all values of each attribute with 2 to 12 distinct strings of which one occurs in a name.

    Of each attribute at most thirteen values pass the first step, so what meets the names is one row of at most twelve
    values an attribute; it is broadcast, and the distinct names, of which there may be any number, stay where they are.
    """
    first = F.row_number().over(Window.partitionBy("attribute").orderBy("value"))
    few = attribute_strings(events).withColumn("k", first).where(F.col("k") <= MAX_VOCABULARY_SIZE + 1)
    few = few.groupBy("attribute").agg(F.collect_list("value").alias("values")).where((F.size("values") > 1) & (F.size("values") <= MAX_VOCABULARY_SIZE))
    held = few.agg(F.collect_list(F.struct("attribute", "values")).alias("all"))
    occurs = F.filter("all", lambda x: F.exists(x["values"], lambda v: F.contains(F.col("name"), v)))
    seen = events.select("name").distinct().crossJoin(F.broadcast(held)).select(F.explode(occurs).alias("x")).select("x.*").distinct()
    return seen.select("attribute", F.explode("values").alias("value")).groupBy("value").agg(F.concat(F.lit("{"), F.min("attribute"), F.lit("}")).alias("placeholder"))


def vocabulary_array(vocabulary: DataFrame) -> list[tuple[str, str]]:
    """The vocabulary on the driver, longest first, then alphabetical: at most twelve entries an attribute."""
    rows = vocabulary.orderBy(F.desc(F.length("value")), "value").collect()
    return [(r["value"], r["placeholder"]) for r in rows]


def vocabulary_column(entries: list[tuple[str, str]]) -> Column:
    if not entries:
        return F.array().cast("array<struct<value:string,placeholder:string>>")
    return F.array(*[F.struct(F.lit(v).alias("value"), F.lit(p).alias("placeholder")) for v, p in entries])


def learn_names(events: DataFrame, vocabulary: Column) -> DataFrame:
    """(name, substituted, label): the collapsed form where it merges two or more substituted names, else as is."""
    names = events.where(F.col("kind") != CHANGE_KIND).select("name").distinct()
    names = names.withColumn("substituted", substitute(F.col("name"), vocabulary)).withColumn("collapsed", collapse(F.col("substituted")))
    shared = names.groupBy("collapsed").agg(F.count_distinct("substituted").alias("n")).where("n > 1").select("collapsed", F.lit(True).alias("earned"))
    label = F.when(F.col("earned"), F.col("collapsed")).otherwise(F.col("substituted"))
    return names.join(shared, "collapsed", "left").select("name", "substituted", label.alias("label"))


def with_nodes(events: DataFrame, names: DataFrame, vocabulary: Column) -> DataFrame:
    """Events with ``node``: source and learned label.  Names learned nowhere (changes) are only substituted.

    A left join whose large side is the events: where one name holds much of them, the adaptive skew join cuts its
    partition, as nothing after the join asks for that partitioning.
    """
    labelled = events.join(names.select("name", "label"), "name", "left")
    return labelled.withColumn("node", F.concat_ws(":", "source", F.coalesce("label", substitute(F.col("name"), vocabulary)))).drop("label")


def learned_nodes(events: DataFrame) -> DataFrame:
    vocabulary = vocabulary_column(vocabulary_array(learn_vocabulary(events)))
    return with_nodes(events, learn_names(events, vocabulary), vocabulary)


