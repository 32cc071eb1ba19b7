"""License scans (6): diagonal voting of rolling word k-grams.

Every text's words are hashed and rolled into k-gram hashes. Those that occur
in a template meet the template positions in a Spark join on the hash; the
words themselves confirm a hit. A hit at word i of the text and word j of the
template votes for the diagonal i - j. Votes are added up per diagonal,
diagonals of a text and template that lie within ``BAND`` of the one before
are merged, and a merged diagonal is a span if its hits cover at least
``LEAST_WORDS`` template words and ``LEAST_SHARE`` of the template, counted
over the distinct template words that the hits cover.

The scan tests each hash against a bit table of fixed size and hands on what
may be in a template; the join decides. Templates are a fixed table, whose
size is checked before it is broadcast.

``score``: 1 if a phrase is present, else the largest share of a template
that a span covers, 0 without one.

Defined cases: null and empty texts have no words and no labels (empty
strings), and score 0; repeated rows give a row each; null doc_ids stay;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec
from .storage import written
from .textvec import ALNUM, Words, rolling

K = 4
BAND = 3
LEAST_WORDS = 8
LEAST_SHARE = 0.5
BITS = 20
BROADCAST_POSITIONS = 200_000

#: Phrases and their labels: fixed values.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Sentences of public licences, by the label that the method gives.
TEMPLATES = [
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-text", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-text", "this work is licensed under the gnu general public license version 3"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-text", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-text", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]


def _words(text: str) -> Words:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return Words(data, np.array([0, len(data)]), ALNUM)


def positions(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> DataFrame:
    """hash, template, label, place, words of the k-gram, length of the template."""
    rows = []
    for t, (label, text) in enumerate(templates):
        split, hashes = text.split(), rolling(_words(text).hash, k).view(np.int64).tolist()
        rows += [(h, t, label, j, " ".join(split[j : j + k]), len(split)) for j, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "hash long, template int, label string, place int, gram string, size int")


def _scan(table: np.ndarray, phrases: list[tuple[np.ndarray, int]], k: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("found", pa.int32()), ("at", pa.list_(pa.int64())), ("hash", pa.list_(pa.int64())), ("gram", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            keys = b["doc_id"].to_pylist()
            for i, j, buf, offsets in textvec.blocks(b["text"]):
                w = Words(buf, offsets, ALNUM)
                h, first = w.hash, w.first
                base = []
                for p, (want, _) in enumerate(phrases):
                    at = np.flatnonzero(h[: len(h) - len(want) + 1] == want[0]) if len(h) >= len(want) else np.empty(0, dtype=np.int64)
                    for n in range(1, len(want)):
                        at = at[h[at + n] == want[n]]
                    doc = np.searchsorted(first, at, side="right") - 1
                    keep = at + len(want) <= first[doc + 1]
                    base += zip(doc[keep].tolist(), at[keep].tolist(), [p] * int(keep.sum()), strict=True)
                rolled = rolling(h, k)
                at = np.flatnonzero(table[(rolled >> np.uint64(64 - BITS)).astype(np.int64)])
                doc = np.searchsorted(first, at, side="right") - 1
                keep = at + k <= first[doc + 1]
                at, doc = at[keep], doc[keep]
                edges = np.searchsorted(doc, np.arange(j - i + 1))
                by_doc: dict[int, list[tuple[int, int]]] = {}
                for d, a, p in base:
                    by_doc.setdefault(d, []).append((a - int(first[d]), p))
                raw = buf.tobytes()
                rows = []
                for d in range(j - i):
                    own = by_doc.get(d, [])
                    hits = at[edges[d] : edges[d + 1]]
                    grams = [" ".join(raw[w.at[x] : w.to[x]].lower().decode("utf-8") for x in range(a, a + k)) for a in hits.tolist()]
                    found = 0
                    for _, p in own:
                        found |= 1 << p
                    starts = [a for a, _ in own]
                    rows.append((row, keys[i + d], int(first[d + 1] - first[d]), len(own), min(starts, default=None), max(starts, default=None), found, (hits - first[d]).tolist(), rolled[hits].view(np.int64).tolist(), grams))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def spans(scanned: DataFrame, places: DataFrame, k: int = K) -> DataFrame:
    """row, label, template, first_word, last_word, share of each verified span."""
    if places.count() <= BROADCAST_POSITIONS:
        places = F.broadcast(places)
    hits = scanned.select("row", F.explode(F.arrays_zip("at", "hash", "gram")).alias("x")).select("row", "x.at", "x.hash", F.col("x.gram").alias("seen"))
    hits = hits.join(places, "hash").where(F.col("seen") == F.col("gram"))
    votes = hits.groupBy("row", "template", "label", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(w) > BAND).cast("int")
    merged = votes.withColumn("group", F.sum(F.coalesce(new, F.lit(0))).over(w))
    # A diagonal holds a place at most once, so a group holds at most (BAND + 1) times the template's length per template passage.
    merged = merged.groupBy("row", "template", "label", "size", "group").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("lo").alias("first_word"), F.max("hi").alias("last_word"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (k - 1))))))
    merged = merged.withColumn("covered", covered).withColumn("share", F.col("covered") / F.col("size"))
    return merged.where((F.col("covered") >= LEAST_WORDS) & (F.col("share") >= LEAST_SHARE)).select("row", "label", "template", "first_word", (F.col("last_word") + (k - 1)).alias("last_word"), "share")


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    spark = docs.sparkSession
    places = positions(spark, templates)
    table = np.zeros(1 << BITS, dtype=bool)
    for _, text in templates:
        table[(rolling(_words(text).hash, K) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    wanted = [(_words(p).hash, i) for i, (p, _) in enumerate(phrases)]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = written(base.mapInArrow(_scan(table, wanted, K), "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, found int, at array<long>, hash array<long>, gram array<string>"), "license-scan")
    own = spans(scanned, places).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    base_labels = F.array_distinct(F.filter(F.array(*[F.when(F.col("found").bitwiseAND(1 << i) != 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull()))
    out = scanned.drop("at", "hash", "gram").join(own, "row", "left").withColumn("base", base_labels)
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
