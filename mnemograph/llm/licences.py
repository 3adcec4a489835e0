"""Licences of pages by sparse TF-IDF cosine to templates, inherited from the nearest directory.

A text is compared block by block, and as a whole where it is a licence file. Only blocks with
an anchor are compared: an anchor is one of the heaviest terms of a template, as many as it
takes that a block without any of them can't reach the least cosine.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.globs import url_parts
from mnemograph.llm.scratch import Scratch

#: Licence id and its usual notices (fixed public wording).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
INLINE = r"(?i)</?(?:a|abbr|b|code|em|font|i|small|span|strong|u)\b[^>]*>"
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|notice)(?:[.-][^/]*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 0.8


def weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """(idf by term, idf of any other term, (template, licence, term, weight of unit length))."""
    bags = [Counter(re.findall(TERM, text.lower())) for _, text in templates]
    seen = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for i, ((licence, _), bag) in enumerate(zip(templates, bags, strict=True)):
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(i, licence, t, n * idf[t] / length) for t, n in sorted(bag.items())]
    return idf, math.log(1 + len(bags)) + 1, rows


def anchors(rows: list[tuple[int, str, str, float]], least: float) -> list[str]:
    """Terms of which a block needs one to reach ``least``: without them a template's rest is shorter than that."""
    found = set()
    for i in {r[0] for r in rows}:
        left = 1.0
        for _, _, term, w in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[3], r[2])):
            if left < (least - 1e-9) ** 2:
                break
            found.add(term)
            left -= w * w
    return sorted(found)


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(f"({TERM})"), F.lit(1))


def scored(blocks: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(block_id, licence, score): the best template of each distinct block (block_id, block) that reaches ``least``."""
    spark = blocks.sparkSession
    idf, other, rows = weights(templates)
    table = F.broadcast(spark.createDataFrame(rows, "template int, licence string, term string, weight double"))
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    terms = blocks.select("block_id", "block").dropDuplicates(["block_id"]).select("block_id", F.explode(_terms(F.col("block"))).alias("term"))
    terms = terms.groupBy("block_id", "term").agg(F.count("*").alias("n"))
    terms = terms.join(known, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    length = terms.groupBy("block_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = terms.join(table, "term").groupBy("block_id", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dots.join(length, "block_id").select("block_id", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("score")).where(F.col("score") >= least)
    return cosine.groupBy("block_id").agg(F.max(F.struct("score", "licence")).alias("best")).select("block_id", "best.licence", "best.score")


def _prefixes(path: Column) -> Column:
    """All directories above ``path``, the root ``host/`` included; each ends with ``/``."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))


def scan(pages: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """The licence of each page (page_id, url, html): page_id, path, licence, score, found, directory.

    ``found`` is ``text`` where a block of the page's own text, or the whole text of a licence
    file, has a cosine of ``least`` or more to a template; the best one counts, of equal ones
    the greatest id. It is ``directory`` where the page has none and the nearest directory above
    it, on its host, has a licence file (``LICENSE``, ``COPYING``, ``NOTICE``, with any ending)
    with a licence; ``directory`` names it. Else licence, score and found are null.

    Blocks end at tags that aren't inline and at line ends; whole texts are read. A null html or
    url is empty and inherits nothing without a host. Rows that share a page_id share what their
    texts hold. Each distinct block is scored once, however many pages repeat it. Other columns
    are not read; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "licences")
    host, path = url_parts(F.col("url"))
    full = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))
    named = pages.select("page_id", full.alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    terms = [re.escape(t) for t in anchors(weights(templates)[2], least)]
    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(terms) + r")(?![a-z0-9])"
    name = F.element_at(F.split("path", "/", -1), -1)
    lines = F.split(F.regexp_replace("html", INLINE, ""), r"<[^>]*>|\n", -1)
    whole = F.when(name.rlike(LICENCE_FILE), F.array(F.regexp_replace("html", "<[^>]*>", " "))).otherwise(F.array().cast("array<string>"))
    anchored = F.filter(F.array_distinct(F.concat(lines, whole)), lambda x: x.rlike(pattern))
    blocks = named.select("page_id", "path", F.explode(anchored).alias("block"))
    blocks = blocks.withColumn("block_id", F.xxhash64("block"))
    hits = blocks.select("page_id", "path", "block_id").join(scratch.keep(scored(blocks, templates, least), "scored"), "block_id")
    own = scratch.keep(hits.groupBy("page_id", "path").agg(F.max(F.struct("score", "licence")).alias("best")), "own")

    files = own.where(name.rlike(LICENCE_FILE)).withColumn("directory", F.regexp_replace("path", "[^/]*$", ""))
    files = files.groupBy("directory").agg(F.max("best").alias("best"))
    mine = own.groupBy("page_id").agg(F.max("best").alias("best"))
    bare = named.select("page_id", "path").join(mine, "page_id", "left_anti").where("not startswith(path, '/')").select("path").distinct()
    above = bare.select("path", F.explode(_prefixes(F.col("path"))).alias("directory")).join(files, "directory")
    near = above.groupBy("path").agg(F.max(F.struct(F.length("directory").alias("n"), "directory", "best")).alias("near"))
    out = named.select("page_id", "path").join(mine, "page_id", "left").join(near, "path", "left")
    best = F.coalesce("best", F.col("near.best"))
    found = F.when(F.col("best").isNotNull(), "text").when(F.col("near").isNotNull(), "directory")
    return out.select("page_id", "path", best["licence"].alias("licence"), best["score"].alias("score"), found.alias("found"),
                      F.when(F.col("best").isNull(), F.col("near.directory")).alias("directory"))
