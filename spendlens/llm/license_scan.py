"""Licence scans: a trained paragraph classifier, confirmed by templates.

Paragraphs (lines) are bags of hashed word 1- and 2-grams. A multinomial
logistic regression tells licence families from ordinary text; it is trained
on licence templates, filled with each family's names, and on one half (by
hash) of all distinct paragraphs without licence words. Two probabilities are
calibrated on the whole other half: from ``likely`` on a paragraph is predicted
a licence; from ``doubtful`` on it is at least not ordinary. A prediction counts only if the
paragraph resembles a template of its family and does not name a neighbouring
licence (``NEIGHBOURS``); else its family is ``unknown``.

DataFrame functions and the JVM classifier of Spark only; over many paragraphs
its parameters come from ``softmax_fit``, which solves a bounded problem on the
driver and sums the gradient over all rows on Spark. Defined results: a
null or blank text has no paragraphs; equal paragraphs are reported each with
its own position; null ids are kept; an empty table gives an empty result and
is trained on built-in sentences alone. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, stored
from .softmax_fit import fit_in_rounds

#: fixed values: names each family goes by
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT license (MIT)", "Expat License", "X11 License"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License", "Apache-2.0 licence"],
    "BSD": ["BSD License", "3-Clause BSD License", "2-Clause BSD License", "New BSD License", "BSD-3-Clause licence"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL v3", "GNU General Public Licence v2 or later"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPL v3", "GNU Library General Public License"],
    "MPL": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0 licence", "Mozilla Public Licence"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC-BY licence"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC-BY-SA licence"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC-BY-NC licence"],
}
#: fixed values: opening words of the licences' own texts
NOTICES = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "Apache": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "you may not use this file except in compliance with the License You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: fixed values: what tells a licence from a family whose templates it nearly equals
_SA, _NC, _ND = r"\bby[\s-]+(nc[\s-]+)?sa\b|share[\s-]*alike", r"\bby[\s-]+nc\b|non[\s-]*commercial", r"\bby[\s-]+(nc[\s-]+)?nd\b|no[\s-]*deriv"
_AFFERO, _LESSER = r"\baffero\b|\bagpl", r"\blesser\s+general\b|\blgpl"
NEIGHBOURS = {"GPL": [_AFFERO, _LESSER], "LGPL": [_AFFERO], "CC-BY": [_SA, _NC, _ND], "CC-BY-SA": [_NC, _ND], "CC-BY-NC": [_SA, _ND]}
SENTENCES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This project is distributed under the terms of the {}.", "Available under the {}; see LICENSE.", "{}", "License: {}", "Code in this repository is covered by the {}."]
ORDINARY = ["All rights reserved.", "A driving license is required to rent a car.", "The licensing board met on Tuesday.", "Press release: the new version is available now.", "She works at the public library of the general hospital.", "Released in the spring, the album was a commercial success.", "The software was written in the common source language.", "Version 2.0 of the report is attached.", "Permission to enter was granted by the guard.", "This work is free of errors.", "Copyright is a form of property.", "Public opinion under the new terms was divided."]
ORDINARY_LABEL = "none"
FAMILIES = [ORDINARY_LABEL, *NAMES]
# the look-ahead only spares most places the whole list
_LICENCE_WORDS = r"(?i)(?=[lcgsam])(?:licen[cs]e|copyright|gnu|gpl|spdx|creative commons|apache|mozilla)"
_LIKELY, _DOUBTFUL = 0.5, 0.4  # least thresholds
_PENALTY = 1e-4


@dataclass(frozen=True)
class Scanner:
    model: LogisticRegressionModel
    likely: float
    doubtful: float


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _vectors(rows: DataFrame, size: int) -> DataFrame:
    """``vector`` of the column ``paragraph``; ``words`` stays."""
    rows = rows.withColumn("words", words_of(F.col("paragraph")))
    pairs = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)).otherwise(F.lit("")))
    return HashingTF(numFeatures=size, binary=True, inputCol="terms", outputCol="vector").transform(rows.withColumn("terms", F.concat("words", pairs)))


def _literals(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(family, paragraph) rows as literals of the plan."""
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("paragraph")) for a, b in rows]))
    return spark.range(1).select(both.alias("r")).select("r.*")


def _wrapped(notice: str, lengths: tuple[int, ...] = (10, 16)) -> list[str]:
    """A notice, and pieces of it as lines of other lengths would hold them."""
    words = notice.split(" ")
    return [notice] + [" ".join(words[i : i + n]) for n in lengths for i in range(0, len(words) - n // 2, n // 2)]


def templates() -> dict[str, list[str]]:
    """Sentences naming a family, and its notices whole and in lines."""
    return {f: [s.format(n) for n in names for s in SENTENCES] + [p for t in NOTICES[f] for p in _wrapped(t)] for f, names in NAMES.items()}


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, paragraph): the non-blank lines of every whole text."""
    rows = keyed(docs, doc_id=id_col, text=text_col).select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "paragraph"))
    return rows.where(F.col("paragraph").rlike(r"\S"))


def _for_fit(h: Column) -> Column:
    """One half of all paragraphs, by hash."""
    return F.pmod(F.shiftright(h, 7), F.lit(2)) == 0


def _hashed(rows: DataFrame) -> DataFrame:
    """128 bits that tell paragraphs apart, so that their texts need not move."""
    return rows.withColumn("h", F.xxhash64("paragraph")).withColumn("h2", F.xxhash64(F.lit(1), "paragraph"))


def train_scanner(docs: DataFrame, sample: int = 4_000, size: int = 1 << 12, id_col: str = "doc_id", text_col: str = "text", at_once: int = 20_000) -> Scanner:
    """Fit on the templates and one half of all distinct ordinary paragraphs; calibrate on the whole other half.

    ``sample`` drops no paragraph: it is how many rows those of the fit weigh
    together at most, so the templates keep their weight in a large corpus.
    More than ``at_once`` rows are fitted in rounds over all of them (``softmax_fit``).
    """
    return _trained(docs, sample, size, id_col, text_col, at_once)[0]


def scan_corpus(docs: DataFrame, sample: int = 4_000, size: int = 1 << 12, least_similar: float = 0.5, id_col: str = "doc_id", text_col: str = "text", at_once: int = 20_000) -> DataFrame:
    """``scan_licences`` by a scanner trained on the same documents; what calibrates it is not judged again."""
    scanner, judged = _trained(docs, sample, size, id_col, text_col, at_once)
    return _confirmed(judged, scanner, least_similar)


def _trained(docs: DataFrame, sample: int, size: int, id_col: str, text_col: str, at_once: int) -> tuple[Scanner, DataFrame]:
    """The scanner, and all paragraphs judged by its model that can be licences or set the thresholds."""
    rows = _hashed(paragraphs(docs, id_col, text_col).where(~F.col("paragraph").rlike(_LICENCE_WORDS)))
    # the other half is only counted here
    rows = rows.select("h", "h2", F.when(_for_fit(F.col("h")), F.col("paragraph")).otherwise("").alias("paragraph")).distinct()
    ordinary = stored(_vectors(rows, size).select("h", "h2", "vector"), "licence-ordinary")
    fit = ordinary.where(_for_fit(F.col("h")))
    n_fit, n_other = ordinary.agg(F.count_if(_for_fit(F.col("h"))), F.count_if(~_for_fit(F.col("h")))).first()
    model = _fitted(fit, n_fit, min(1.0, sample / max(1, n_fit)), size, at_once)
    suspects = stored(model.transform(fit).where(_licence_chance() >= _DOUBTFUL).select("h", "h2", F.lit(True).alias("suspect")), "licence-suspects")
    judged = stored(_judged(docs, model, _DOUBTFUL, id_col, text_col, suspects), "licence-judged")
    other = judged.where(~_for_fit(F.xxhash64("paragraph")) & ~F.col("paragraph").rlike(_LICENCE_WORDS))
    high = _quantile(other.groupBy("paragraph").agg(F.max("probability").alias("p")), 0.999, n_other) or 0.0
    return Scanner(model, max(_LIKELY, high), max(_DOUBTFUL, high)), judged


def _fitted(fit: DataFrame, n: int, weight: float, size: int, at_once: int) -> LogisticRegressionModel:
    """The classifier of the templates and of ``n`` ordinary rows of ``weight`` each."""
    known = [(f, t) for f, ts in templates().items() for t in ts] + [(ORDINARY_LABEL, t) for t in ORDINARY for _ in range(3)]
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    rows = stored(_vectors(_literals(fit.sparkSession, known), size).select(label.alias("label"), "vector", F.lit(1.0).alias("weight")), "licence-templates")
    if n > at_once:
        part = F.pmod("h2", F.lit(1 << 31)) < math.ceil(at_once / n * (1 << 31))
        return fit_in_rounds(rows, fit, n, weight, part, size, len(FAMILIES), _PENALTY)
    rows = rows.unionByName(fit.select(F.lit(float(FAMILIES.index(ORDINARY_LABEL))).alias("label"), "vector", F.lit(weight).alias("weight")))
    return LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", family="multinomial", regParam=_PENALTY, maxIter=60, standardization=False).fit(rows)


def _quantile(values: DataFrame, share: float, n: int | None = None) -> float | None:
    """The smallest ``p`` with at least ``share`` of all rows at or below it, exactly; None without rows.

    If ``n`` is given, there are ``n`` rows in all and ``values`` are the largest of them; None if it is not among these.
    """
    if n is None:
        n = values.count()
        if n:
            # the sketch's rank is off by n / 10,000 at most, so the wanted row lies in the tail above it
            low = values.agg(F.percentile_approx("p", max(0.0, share - 0.001), 10_000)).first()[0]
            values = values.where(F.col("p") >= low)
    if not n:
        return None
    row = values.select("p").orderBy(F.desc("p")).offset(n - math.ceil(share * n)).first()
    return row.p if row else None


def scan_licences(docs: DataFrame, scanner: Scanner, least_similar: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, paragraph, family, predicted, probability, similarity) of licence paragraphs.

    ``predicted`` is the classifier's family; ``family`` is it when confirmed,
    else ``unknown``. ``similarity`` is the best Jaccard similarity of words
    with the family's templates.
    """
    return _confirmed(_judged(docs, scanner.model, scanner.doubtful, id_col, text_col), scanner, least_similar)


def _licence_chance() -> Column:
    return 1 - F.get(vector_to_array("probability"), F.lit(0))


def _judged(docs: DataFrame, model: LogisticRegressionModel, least: float, id_col: str, text_col: str, suspects: DataFrame | None = None) -> DataFrame:
    """(doc_id, position, paragraph, words, probability, by_family) of paragraphs of at least that probability.

    ``suspects`` are the hashes of all paragraphs of the fit that have it; the others of the fit are not judged again.
    """
    rows = paragraphs(docs, id_col, text_col)
    if suspects is not None:
        rows = _hashed(rows).join(suspects, ["h", "h2"], "left")
        rows = rows.where(F.col("suspect") | ~_for_fit(F.col("h")) | F.col("paragraph").rlike(_LICENCE_WORDS)).select("doc_id", "position", "paragraph")
    judged = model.transform(_vectors(rows, model.numFeatures))
    # columns of a generator are not inlined into the filter, which would find the words there several times more
    judged = judged.select("doc_id", "position", "paragraph", F.inline(F.array(F.struct("words", vector_to_array("probability").alias("chance")))))
    judged = judged.select("doc_id", "position", "paragraph", "words", (1 - F.get("chance", F.lit(0))).alias("probability"), F.slice("chance", 2, len(NAMES)).alias("by_family"))
    return judged.where(F.col("probability") >= least)


def _confirmed(judged: DataFrame, scanner: Scanner, least_similar: float) -> DataFrame:
    """Judged paragraphs that are at least doubtful, with the families that templates confirm."""
    judged = judged.where(F.col("probability") >= scanner.doubtful)
    best = F.array_position("by_family", F.array_max("by_family")).cast("int") - 1
    judged = judged.withColumn("predicted", F.get(F.array(*map(F.lit, NAMES)), best))
    similarity = F.lit(0.0)
    for family, texts in templates().items():
        bags = F.array(*[F.array(*[F.lit(w) for w in _bag(t)]) for t in texts])
        near = F.transform(bags, lambda t: F.size(F.array_intersect(t, "words")) / F.size(F.array_union(t, "words")))
        similarity = F.when(F.col("predicted") == family, F.array_max(near)).otherwise(similarity)
    judged = judged.withColumn("similarity", similarity)
    neighbour = F.lit(False)
    for family, signs in NEIGHBOURS.items():
        neighbour = F.when(F.col("predicted") == family, F.col("paragraph").rlike("(?i)" + "|".join(signs))).otherwise(neighbour)
    sure = (F.col("probability") >= scanner.likely) & (F.col("similarity") >= least_similar) & ~neighbour
    return judged.select("doc_id", "position", "paragraph", F.when(sure, F.col("predicted")).otherwise("unknown").alias("family"), "predicted", "probability", "similarity")


def _bag(text: str) -> list[str]:
    """Distinct lower-case words of a template, in order (as ``words_of`` finds them)."""
    words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return list(dict.fromkeys(words))
