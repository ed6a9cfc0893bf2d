"""License scans: MinHash bands over overlapping text windows, exact shingle containment.

Windows of each template's size that share a shingle with it are signed by MinHash over their shingles. A window that
holds ``THRESHOLD`` of a template's shingles has at least the Jaccard similarity t / (2 - t) to it, for which ``BANDS``
bands of ``ROWS`` values collide with a probability above 0.9999. Colliding pairs are verified by exact containment.

Defined results: null and empty texts hold no license; templates without words match nothing; rows that agree in
``doc_id`` and text are one document in the result; only ``doc_id`` and ``text`` are read, so other columns cannot clash;
empty tables give an empty result. Words are compared in lower case without punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.llm.common import checkpointed, hinted, let
from verdict.llm.windows import SHINGLE, anchored_windows, containment, located, passages, shingles

GAP = r"[^\p{L}\p{N}]+"
BANDS, ROWS, THRESHOLD = 16, 2, 0.8

#: Notices by SPDX identifier. Templates are data: callers may pass their own.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("LGPL-2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    # The whole headers of two of these licenses hold up to 0.87 of each other; these parts, which "(at your option)" follows,
    # tell them apart: each holds at most 0.78 of another.
    ("GPL-2.0", "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
)


def templates(spark: SparkSession, rows: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(f"{name}/{k}", text) for k, (name, text) in enumerate(rows)], "template string, text string")


def signature(array: Column) -> Column:
    """BANDS * ROWS minima of the shingles' hashes under different seeds."""
    hashes = F.transform(shingles(array), lambda s: F.xxhash64(s))
    return let(hashes, lambda own: F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda k: F.array_min(F.transform(own, lambda h: F.xxhash64(h, k)))))


def bands(minima: Column) -> Column:
    return let(minima, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice(m, k * ROWS + 1, ROWS))))


def scan(docs: DataFrame, notices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, template, containment, start): every template that a document holds, at its best window."""
    own = passages(notices, "template", "text", GAP)
    windows = anchored_windows(docs, own, GAP)
    signed = windows.contents.select("content_id", "size", F.explode(bands(signature(F.col("window")))).alias("band"))
    targets = checkpointed(own.select("key", F.size("words").alias("size"), F.explode(bands(signature(F.col("words")))).alias("band")))
    pairs = signed.join(hinted(targets), ["size", "band"]).select("content_id", "key").distinct()
    pairs = pairs.join(hinted(own), "key").join(windows.contents, "content_id")
    scored = pairs.select("content_id", "key", containment(F.col("window"), F.col("words"), SHINGLE).alias("containment"))
    found = located(windows, scored.where(F.col("containment") >= threshold), "containment")
    return found.select("doc_id", F.regexp_extract("key", r"^(.*)/\d+$", 1).alias("license"), F.col("key").alias("template"), "containment", "start")
