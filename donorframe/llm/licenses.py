"""License scans by diagonal voting.

Every document's rolling word 3-gram hashes are joined in Spark to the positions of the same hashes in the templates;
votes are counted by offset diagonal (document position less template position), neighbouring diagonals are merged, and
spans are verified. A hit counts only if its three words are those of the template, byte by byte; the score of a span is
the share of the template's gram positions that it holds, each position once, however often the document repeats a gram.
Order needs no test of its own: diagonals of a span are at most NEIGHBOUR apart from the next, so hits stand as in the
template but for a few words inserted or left out. A base phrase stands exactly where one diagonal has the votes of all
its grams. Before the join, Python drops grams that occur in no template (the join's own semi-join filter, exact);
templates are a constant of this module, so broadcasting them is bounded.

Words are runs of lower-cased ASCII letters and digits and non-ASCII characters.

Defined cases: a null or empty text has no words and no labels; very long texts are hashed in segments of bounded memory; rows with null or repeated ids are scanned one by one;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textcore import ALNUM, HashFilter, Words, blocks, buffers
from .workspace import Workspace, prepare

GRAM = 3
#: Share of a template's grams that a verified span of merged diagonals has to hold.
COVERAGE = 0.6
#: Diagonals at most this far apart are one span (words inserted or left out).
NEIGHBOUR = 2

# Base phrases with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Further license statements with their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the bsd 3 clause license", "bsd-3"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]


def template_grams() -> list[tuple[int, int, int, int, str, bool]]:
    """(gram, template, position, grams of the template, label, base)."""
    out = []
    for t, (text, label) in enumerate(BASE + TEMPLATES):
        g, at = Words(*buffers(pa.array([text])), ALNUM).grams(GRAM)
        out += [(int(x), t, int(p), len(g), label, t < len(BASE)) for x, p in zip(g.view(np.int64), at)]
    return out


def gram_words() -> dict[int, list[bytes]]:
    """The words of every gram of the templates, by its hash."""
    out = {}
    for text, _ in BASE + TEMPLATES:
        g, at = Words(*buffers(pa.array([text])), ALNUM).grams(GRAM)
        out |= {int(x): [w.encode() for w in text.split(" ")[p : p + GRAM]] for x, p in zip(g, at)}
    return out


def scan_words(docs: DataFrame, grams: np.ndarray) -> DataFrame:
    """A row per document: key (unique), doc_id, n_words, hits (position and hash of grams that templates have)."""
    filtered, told = HashFilter(grams.view(np.uint64)), gram_words()

    def same(words: Words, first: int, gram: int) -> bool:
        return all(words.data[words.start[i] : words.end[i]].tobytes().lower() == w for i, w in enumerate(told[gram], first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            text = batch.column(1)
            for a, b in blocks(text):
                words = Words(*buffers(text.slice(a, b - a)), ALNUM)
                g, at = words.grams(GRAM)
                k, _ = filtered.find(g)
                k = k[np.fromiter((same(words, i, x) for i, x in zip(at[k].tolist(), g[k].tolist())), bool, len(k))]
                doc = words.doc[at[k]]
                cut = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(at[k] - words.first[doc], pa.int64()), pa.array(g[k].view(np.int64))], ["pos", "gram"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + b - a)), batch.column(0).slice(a, b - a), pa.array(words.count(), pa.int64()), pa.ListArray.from_arrays(pa.array(cut), hits)], ["key", "doc_id", "n_words", "hits"])
                key += b - a

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"key long, doc_id {id_type}, n_words long, hits array<struct<pos: long, gram: long>>")


def vote(spark: SparkSession, scanned: DataFrame) -> DataFrame:
    """Votes per document, template and diagonal; held: a bit for each gram position (templates have fewer than 64)."""
    grams = spark.createDataFrame(template_grams(), "gram long, template int, at long, n_grams int, label string, base boolean")
    hits = scanned.where(F.size("hits") > 0).select("key", F.explode("hits").alias("hit")).select("key", F.col("hit.pos").alias("pos"), F.col("hit.gram").alias("gram"))
    joined = hits.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
    return joined.groupBy("key", "template", "label", "base", "n_grams", "diagonal").agg(F.count("*").alias("votes"), F.bit_or(F.expr("shiftleft(1L, cast(at AS int))")).alias("held"), F.min("pos").alias("low"), F.max("pos").alias("high"))


def merge(votes: DataFrame) -> DataFrame:
    """Spans: runs of neighbouring diagonals of one document and template."""
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= NEIGHBOUR, 0).otherwise(1)
    runs = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("key", "template", "label", "base", "n_grams", "run").agg(
        F.bit_count(F.bit_or("held")).alias("held"), F.min("low").alias("start"), (F.max("high") + GRAM).alias("end"),
        F.sum(F.when(F.col("votes") == F.col("n_grams"), 1).otherwise(0)).alias("full"),
        F.min(F.when(F.col("votes") == F.col("n_grams"), F.col("diagonal"))).alias("first_full"),
        F.max(F.when(F.col("votes") == F.col("n_grams"), F.col("diagonal"))).alias("last_full"),
    )
    return spans.withColumn("score", F.col("held") / F.col("n_grams"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans (template's label, start and end word, score)."""
    spark = docs.sparkSession
    prepare(spark)
    work = Workspace(spark, "licenses")
    grams = np.unique(np.array([r[0] for r in template_grams()], dtype=np.int64))
    scanned = work.keep(scan_words(docs, grams), "scanned")
    spans = merge(vote(spark, scanned)).where(F.col("base") & (F.col("full") > 0) | ~F.col("base") & (F.col("score") >= COVERAGE))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_doc = spans.groupBy("key").agg(
        F.sum(F.when(F.col("base"), F.col("full")).otherwise(0)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_full"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last_full"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max(F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("score"))).alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("spans"),
    )
    return scanned.select("key", "doc_id", "n_words").join(per_doc, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
