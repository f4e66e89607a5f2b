"""Licence notices found by a positional index of their rare words.

Texts are cut into words once; of each document the template words with their positions are stored. The words of the
templates are weighed by how rare they are in the corpus. Of every template the rarest half is indexed with its
positions. A document's indexed words look up their postings; postings that agree on where the template would begin are
intersected; and where enough agree, the template's key phrase must stand there word for word, which is looked up, word
by word and place by place, among the stored positions. A place that is not verified counts nothing. Everything is a
Column expression or a join on (row, place), so no row grows with what is found in it.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated rows are
separate documents and each gets its row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, cut

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` as they stand in a notice; ``key`` is the part that must be there; ``base`` labels count places."""

    label: str
    words: str
    key: str
    base: bool = False


# Phrases of well-known licence notices in lower case.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("reserved", "all rights reserved", "all rights reserved", base=True),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
)


def _spans(template: Template) -> tuple[list[str], list[str], int]:
    """The template's words, its key phrase and where that begins."""
    words, key = template.words.split(), template.key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return words, key, at


def template_words(docs: DataFrame, templates: Sequence[Template], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, hits): of every document, the words of templates (``at``, ``word``), stored."""
    wanted = sorted({w for t in templates for w in t.words.split()})
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    texts = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    hits = F.filter(
        F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(wanted))
    found = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    return cut(found, "license-words")


def word_rarity(documents: DataFrame, templates: Sequence[Template]) -> dict[str, float]:
    """Inverse document frequency of each template word over all documents. One row per template word reaches the
    driver."""
    found = documents.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
    counted = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    most = max(counted.values(), default=0) + 1
    return {w: float(most) / (counted.get(w, 0) + 1) for t in templates for w in t.words.split()}


def license_hits(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES,
    agree: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """(documents, places): one row per document with its number of words, and one row per place at which at least
    ``agree`` of a template's indexed words stand as they do in it, with ``verified`` if its key phrase is there.
    """
    documents = template_words(docs, templates, id_col, text_col)
    rarity = word_rarity(documents, templates)
    postings = []
    for number, template in enumerate(templates):
        words, key, at = _spans(template)
        # the key phrase's rarest half, so that a place of the phrase alone is found, and the template's rarest half
        inside = sorted(range(at, at + len(key)), key=lambda i: (-rarity[words[i]], i))[: -(-len(key) // 2)]
        anywhere = sorted(range(len(words)), key=lambda i: (-rarity[words[i]], i))[: -(-len(words) // 2)]
        indexed = sorted(set(inside) | set(anywhere)) if not template.base else sorted(inside)
        # enough to reach the share, but never more than the key phrase alone can give
        in_key = sum(at <= i < at + len(key) for i in indexed)
        need = max(1, min(in_key, -(-int(agree * len(indexed) * 100) // 100)))
        for i in indexed:
            postings.append((words[i], number, i, need, len(indexed)))
    spark = docs.sparkSession
    index_words = sorted({p[0] for p in postings})
    index = spark.createDataFrame(postings, "word string, template int, place int, need int, indexed int")
    keys = spark.createDataFrame(
        [(n, t.label, t.base, key, at, [rarity[w] for w in words])
         for n, t in enumerate(templates) for words, key, at in [_spans(t)]],
        "template int, label string, base boolean, key array<string>, key_at int, weights array<double>",
    )
    rare = documents.select("row", F.explode(F.filter("hits", lambda h: h["word"].isin(index_words))).alias("hit"))
    aligned = (
        rare.select("row", "hit.*").join(index, "word")
        .groupBy("row", "template", (F.col("at") - F.col("place")).alias("begin"))
        .agg(
            F.count("*").alias("agreeing"), F.first("need").alias("need"), F.first("indexed").alias("indexed"),
            F.collect_set("place").alias("places"),
        )
        .where("agreeing >= need")
    )
    aligned = cut(aligned, "license-places").join(keys, "template")
    # the words that the key phrase asks for, and those that stand there
    asked = aligned.select("row", "template", "begin", "key_at", F.posexplode("key").alias("n", "word")).select(
        "row", "template", "begin", (F.col("begin") + F.col("key_at") + F.col("n")).alias("at"), "word")
    key_words = sorted({w for t in templates for w in t.key.split()})
    standing = documents.join(aligned.select("row").distinct(), "row", "left_semi").select(
        "row", F.explode(F.filter("hits", lambda h: h["word"].isin(key_words))).alias("hit")).select("row", "hit.*")
    spelled = asked.join(standing, ["row", "at", "word"]).groupBy("row", "template", "begin").agg(F.count("*").alias("spelled"))
    mass = F.aggregate("places", F.lit(0.0), lambda a, i: a + F.get("weights", i))
    possible = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    places = aligned.join(spelled, ["row", "template", "begin"], "left").select(
        "row", "label", "base", (F.col("begin") + F.col("key_at")).cast("long").alias("start"),
        F.coalesce(F.col("spelled") == F.size("key"), F.lit(False)).alias("verified"),
        F.when(F.col("agreeing") == F.col("indexed"), 1.0).otherwise(mass / possible).alias("share"),
    )
    return documents.select("row", "doc_id", "n_words"), places


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its words, the places of base phrases, the labels, and the best share of a template's
    rarity that stands in a verified place (0 where there is none). Arguments as for ``license_hits``."""
    documents, places = license_hits(docs, **options)
    base = F.col("verified") & F.col("base")
    labels = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    summed = places.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("verified")).alias("labels"),
        F.max(F.when(F.col("verified"), F.col("share"))).alias("score"),
    )
    return documents.join(summed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
