"""The concepts and aliases that many queries name, found in one pass over the queries.

The thesaurus becomes automata of at most ``BLOCK`` aliases (Aho and Corasick's), each of which reads a
query once, whatever the number of aliases; queries stay where they are, so there is no join of
queries with aliases.  A task builds an automaton from a block of broadcast aliases; a thesaurus of more
than a block takes a pass for each block (a thesaurus is written by people: the driver can hold its
aliases, if not the queries)."""

from __future__ import annotations

import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark import shared

BLOCK = 200_000
LEAST_CHARS = 3
CONCEPTS, PER_CONCEPT, TERMS = 5, 8, 12
# Kinds of aliases, those that come first.
KINDS = ("preferred", "synonym", "translated", "acronym")

_BUILT: dict = {}


def _automaton(name, words):
    """The automaton of a broadcast block, kept by the worker for its next batches."""
    if name not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for w in words.value:
            made.add_word(w, w)
        made.make_automaton()
        _BUILT[name] = made
    return _BUILT[name]


def named(queries: DataFrame, aliases: DataFrame, key: str, text: str, alias: str = "normalized", most: int = BLOCK) -> DataFrame:
    """key, alias: each alias that a query's normalized text holds (3 characters or more) or is, once."""
    words = shared.keep(aliases.where(f"{alias} <> ''").select(F.col(alias).alias("w")).distinct().withColumn("n", F.xxhash64("w")), "aliases")
    blocks = max(1, -(-words.count() // most))
    asked = queries.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text <> ''")
    kind = queries.schema[key].dataType.simpleString()
    out = None
    for b in range(blocks):
        own = [r.w for r in words.where(F.pmod("n", F.lit(blocks)) == b).select("w").collect()]
        block = queries.sparkSession.sparkContext.broadcast(own)
        name = uuid.uuid4().hex

        def run(batches, block=block, name=name):
            found = _automaton(name, block) if block.value else None
            for pdf in batches:
                pairs = [(k, w) for k, t in zip(pdf["key"], pdf["text"]) for w in (sorted({w for _, w in found.iter(t) if len(w) >= LEAST_CHARS or w == t}) if found is not None else ())]
                yield pd.DataFrame(pairs, columns=["key", "alias"]).astype({"alias": object})

        part = asked.mapInPandas(run, f"key {kind}, alias string")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", key)


def detected(queries: DataFrame, aliases: DataFrame, key: str = "query_id", text: str = "normalized", concepts: int = CONCEPTS) -> DataFrame:
    """key, concept_id, strength, concept_rank: the first concepts that each query names; a query that is
    an alias (2) comes before one that holds it (1). aliases: concept_id, stable_key, normalized, raw, kind, language."""
    hits = named(queries, aliases, key, text)
    whole = queries.select(F.col(key).alias("k"), F.col(text).alias("t"))
    rows = hits.join(aliases.select("concept_id", "stable_key", F.col("normalized").alias("alias")), "alias")
    rows = rows.join(whole, F.col(key) == F.col("k")).groupBy(key, "concept_id", "stable_key").agg(F.max(F.when(F.col("alias") == F.col("t"), 2).otherwise(1)).alias("strength"))
    order = Window.partitionBy(key).orderBy(F.desc("strength"), "stable_key", "concept_id")
    return rows.withColumn("concept_rank", F.row_number().over(order)).where(F.col("concept_rank") <= concepts).drop("stable_key")


def _kind(c: Column) -> Column:
    rank = F.lit(len(KINDS) + 1)
    for i, k in reversed(list(enumerate(KINDS, 1))):
        rank = F.when(c == k, i).otherwise(rank)
    return rank


def alias_terms(queries: DataFrame, aliases: DataFrame, key: str = "query_id", text: str = "normalized", concepts: int = CONCEPTS, per_concept: int = PER_CONCEPT, terms: int = TERMS) -> DataFrame:
    """key, concept_id, raw, normalized, alias_rank: what else to search for, for every query at once: of the
    concepts that it names, aliases that it isn't itself, so many a concept and in all."""
    # an alias is left out where it is the query, so one more of each concept is enough
    line = Window.partitionBy("concept_id").orderBy("kind_rank", "language", "normalized")
    few = aliases.withColumn("kind_rank", _kind(F.col("kind"))).withColumn("place", F.row_number().over(line)).where(F.col("place") <= per_concept + 1)
    found = detected(queries, aliases, key, text, concepts).join(few.select("concept_id", "raw", "normalized", "place"), "concept_id")
    found = found.join(queries.select(F.col(key).alias("k"), F.col(text).alias("t")), F.col(key) == F.col("k")).where("normalized <> t")
    own = found.withColumn("alias_rank", F.row_number().over(Window.partitionBy(key, "concept_id").orderBy("place"))).where(F.col("alias_rank") <= per_concept)
    cut = Window.partitionBy(key).orderBy("concept_id", "alias_rank")
    return own.withColumn("n", F.row_number().over(cut)).where(F.col("n") <= terms).select(key, "concept_id", "raw", "normalized", "alias_rank")
