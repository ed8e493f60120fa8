"""Licence notices found by a trained paragraph classifier, in DataFrame operations only.

A paragraph is a line, read in windows of ``SPAN`` words of which neighbours share
``SHARED``; a template of so many words or fewer stands whole in one of them, however
long the line is. Neighbouring lines of at most ``WRAPPED`` characters, none of them
blank, are a run and are read once more as one line, so that a notice wrapped over
several lines is found. Of a window's word pairs those that some template has are
hashed to a sparse vector; a multinomial logistic regression tells the licence families
and an unknown class apart. Whatever else a window holds has no part in it, so the many
windows of a corpus are few different sets of pairs, each with a count.

The regression is trained on notice templates, whole and cut at either end, and on
the windows of all documents but each fourth by hash of its id, as sets weighted by
their counts; windows that share much with a template are left out of the unknown class. A
prediction counts when its probability reaches a threshold that at most
``false_share`` of all windows of the other documents reach for all families together, and when a
template of the family confirms it: enough of the template's word pairs must
stand in the window. A line has one notice of a family at most, with the best
figures of its windows. So has a run, placed at its first line, unless a line of the
run has a notice of that family itself.

Training and scan each read every line of every text in one pass. Counted sets and
accepted windows are all that is shuffled.

Cases: a null or empty text has one empty line and no licence. Rows without an id
are scanned but not trained on. Repeated rows get the same result. An empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.session import staged

UNKNOWN = "unknown"
SPAN, SHARED = 40, 24
#: Characters of a line that may be part of a wrapped paragraph.
WRAPPED = 100
#: Short notices as the licences' publishers word them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the terms of the MIT license.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 3 or later.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0-1.0": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "Released into the public domain under CC0.",
    ),
}
FAMILIES = [UNKNOWN, *TEMPLATES]


@dataclass
class Scanner:
    model: LogisticRegressionModel
    threshold: float


def tokens(line: Column) -> Column:
    """Lower-case runs of letters, digits and dots between them."""
    return F.filter(F.split(F.regexp_replace(F.lower(line), r"\.(?![0-9])", " "), r"[^\p{L}\p{N}.]+"), lambda w: w != "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """One hash of every two neighbouring words, from the words' hashes."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def _windows(pairs: Column) -> Column:
    """The pairs of windows of ``SPAN`` words, from one item a word: its pair with the next word. A short line is one window."""
    step = SPAN - SHARED
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.size(pairs) - SPAN, F.lit(0)) / step).cast("int"))
    return F.when(F.size(pairs) <= SPAN, F.array(pairs)).otherwise(F.transform(starts, lambda k: F.slice(pairs, k * step + 1, F.lit(SPAN - 1))))


def _paragraphs(docs: DataFrame) -> DataFrame:
    """All lines of ``text`` and all runs of wrapped lines: the other columns, position, n_lines and line."""
    others = [c for c in docs.columns if c != "text"]
    # One-row inlines keep each array a column, computed once.
    listed = docs.select(*others, F.inline(F.array(F.struct(F.split("text", "\n", -1).alias("listed")))))
    short = F.transform("listed", lambda x: (F.length(x) <= WRAPPED) & (F.length(F.trim(x)) > 0))
    marked = listed.select("*", F.inline(F.array(F.struct(short.alias("short")))))
    # A line starts a run unless it and the line before it are short.
    first = F.filter(F.sequence(F.lit(0), F.size("listed") - 1), lambda i: ~(F.get("short", i) & F.coalesce(F.get("short", i - 1), F.lit(False))))
    started = marked.select(*others, "listed", F.inline(F.array(F.struct(first.alias("first")))))
    runs = F.transform("first", lambda a, k: F.struct(a.alias("position"), (F.coalesce(F.get("first", k + 1), F.size("listed")) - a).alias("n_lines")))
    joined = F.transform(
        F.filter(runs, lambda r: r["n_lines"] > 1),
        lambda r: F.struct(r["position"].alias("position"), r["n_lines"].alias("n_lines"), F.array_join(F.slice("listed", r["position"] + 1, r["n_lines"]), " ").alias("line")),
    )
    alone = F.transform("listed", lambda x, i: F.struct(i.alias("position"), F.lit(1).alias("n_lines"), x.alias("line")))
    return started.select(*others, F.inline(F.concat(alone, joined))).where("length(line) > 0")


def _template_pairs() -> list[tuple[str, list[int]]]:
    """Family and different word pairs of every template."""
    pairs = F.array_sort(F.array_distinct(F.array_compact(_pairs(_hashes(tokens(F.col("text")))))))
    return [(r.family, r.pairs) for r in _templates(SparkSession.active()).select("family", pairs.alias("pairs")).collect()]


def _sets(lines: DataFrame, line: str) -> DataFrame:
    """The windows of ``lines``, each with the sorted set of its word pairs that some template has."""
    known = sorted({p for _, own in _template_pairs() for p in own})
    # Words are hashed and pairs looked up once a line; windows are cut from these.
    words = lines.select("*", F.inline(F.array(F.struct(_hashes(tokens(F.col(line))).alias("all_words"))))).drop(line)
    looked = F.transform(_pairs(F.col("all_words")), lambda p: F.when(p.isin(known), p))
    paired = words.select("*", F.inline(F.array(F.struct(looked.alias("all_pairs"))))).drop("all_words")
    window = F.array_sort(F.array_distinct(F.array_compact("window")))
    return paired.select("*", F.explode(_windows(F.col("all_pairs"))).alias("window")).drop("all_pairs").withColumn("pairs", window).drop("window")


def _vectors(sets: DataFrame, bits: int) -> DataFrame:
    return HashingTF(numFeatures=1 << bits, binary=True, inputCol="pairs", outputCol="features").transform(sets)


def _templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(f).alias("family"), F.lit(float(FAMILIES.index(f))).alias("label"), F.lit(t).alias("text")) for f, ts in TEMPLATES.items() for t in ts]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _likeness(family: Column | None = None) -> Column:
    """Largest share of a template's word pairs found in ``pairs``; of one family, or of all."""
    shares = []
    for name, distinct in _template_pairs():
        share = F.size(F.array_intersect("pairs", F.array(*map(F.lit, distinct)))) / F.lit(len(distinct))
        shares.append(share if family is None else F.when(family == name, share).otherwise(0.0))
    return F.greatest(*shares)


def train(docs: DataFrame, bits: int = 13, false_share: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> Scanner:
    """Model and threshold from all windows of all documents with an id."""
    body = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    parted = body.select((F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("apart"), "text")
    counted = staged(_sets(_paragraphs(parted), "line").groupBy("apart", "pairs").agg(F.count("*").alias("n")), "licence-sets")
    unknown = counted.where(_likeness() < 0.4)
    total = unknown.where("NOT apart").agg(F.sum("n")).first()[0] or 1
    texts = _templates(docs.sparkSession)
    text_words = tokens(F.col("text"))
    # The end of a window can leave what several families begin with: such beginnings are trained on for each of them.
    cut = [F.array_join(F.slice(text_words, a, F.greatest(F.size(text_words) - b, F.lit(1))), " ") for a, b in ((1, 0), (2, 1), (3, 2), (1, 1), (1, 2), (1, 3))]
    known = _sets(texts.select("label", F.explode(F.array(*cut)).alias("line")), "line").select("label", "pairs", F.lit(1.0).alias("weight"))
    # The unknown class weighs as much as all families; a window without any template's pair is in it whatever the corpus.
    share = F.col("n") * F.lit(len(cut) * sum(map(len, TEMPLATES.values())) / total)
    none = texts.limit(1).select(F.lit(0.0).alias("label"), F.array().cast("array<bigint>").alias("pairs"), F.lit(1.0).alias("weight"))
    rows = known.unionByName(none).unionByName(unknown.where("NOT apart").select(F.lit(0.0).alias("label"), "pairs", share.alias("weight")))
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, weightCol="weight").fit(staged(_vectors(rows, bits), "licence-training"))
    best = model.transform(_vectors(unknown.where("apart"), bits)).select((1 - vector_to_array("probability")[0]).alias("p"), "n")
    # The smallest threshold that no more than the allowed share of these windows reaches, exact between its bounds.
    bounded = F.greatest(F.lit(0.5), F.least(F.lit(0.9), F.round("p", 5)))
    limit = best.groupBy(bounded.alias("p")).agg(F.sum("n").alias("n")).agg(F.expr(f"percentile(p, {1 - false_share}, n)")).first()[0]
    return Scanner(model, limit or 0.5)


def scan(docs: DataFrame, scanner: Scanner, min_likeness: float = 0.5, bits: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_license, families and notices (position, family, probability, likeness)."""
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    # A window without any template's pair has no notice.
    windows = _sets(_paragraphs(body.where("text IS NOT NULL")), "line").where("size(pairs) > 0")
    scored = scanner.model.transform(_vectors(windows, bits))
    # The classes' probabilities as a column, computed once.
    sure = scored.select("doc_id", "key", "position", "n_lines", "pairs", F.inline(F.array(F.struct(vector_to_array("probability").alias("p"), F.col("prediction").cast("int").alias("class")))))
    accepted = (
        sure.where((F.col("class") > 0) & (F.get("p", F.col("class")) >= scanner.threshold))
        .withColumn("family", F.get(F.array(*map(F.lit, FAMILIES)), F.col("class")))
        .withColumn("likeness", _likeness(F.col("family")))
        .where(F.col("likeness") >= min_likeness)
    )
    figures = F.max(F.struct("likeness", F.get("p", F.col("class")).alias("sure"))).alias("best")
    each = accepted.groupBy("doc_id", "key", "position", "n_lines", "family").agg(figures)
    # Repeated rows are one by now, so a window holds the notices of one text.
    later = Window.partitionBy("doc_id", "key", "family").orderBy("position").rangeBetween(0, Window.unboundedFollowing)
    told = each.withColumn("next", F.min(F.when(F.col("n_lines") == 1, F.col("position"))).over(later))
    per_line = told.where((F.col("n_lines") == 1) | F.col("next").isNull() | (F.col("next") >= F.col("position") + F.col("n_lines")))
    notice = F.struct("position", "family", F.round("best.sure", 6).alias("probability"), F.round("best.likeness", 6).alias("likeness"))
    found = per_line.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("hash")).agg(F.sort_array(F.collect_set(notice)).alias("notices"))
    counted = body.select("doc_id", "key", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_paragraphs"))
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("key").eqNullSafe(F.col("hash")), "left")
    notices = F.coalesce("notices", F.array().cast(found.schema["notices"].dataType))
    return joined.select(
        "doc_id",
        "n_paragraphs",
        F.size(notices).cast("long").alias("n_license"),
        F.array_sort(F.array_distinct(F.transform(notices, lambda x: x["family"]))).alias("families"),
        notices.alias("notices"),
    )
