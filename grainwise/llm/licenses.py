"""License scans: MinHash bands of overlapping word windows retrieve templates, exact shingle containment verifies them.

Built-in functions only. Windows of 8 words start at every 4th word, so any five words that belong together lie within
one. With three-word shingles such a window then has a similarity of 1/3 or more to a template of four to ten words
(1/2 to one of five), and one of twenty bands of one hash meets with probability 1 - (2/3)**20 = 0.9997 at least; a
template of 11 words or more has a whole window inside each occurrence, which meets for certain. A template of three words
is a single shingle; it is a band of its own, which every window that holds it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from grainwise.llm.common import F, cut, whole_text

#: The sentences by which licenses are stated.
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0",
                   "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "mit": ("Released under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "bsd-3-clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                     "the following conditions are met",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "all-rights-reserved": ("All rights reserved.",),
    "lgpl": ("GNU Lesser General Public License", "Licensed under the GNU LGPL"),
    "agpl-3.0": ("GNU Affero General Public License", "Licensed under the GNU AGPL"),
    "gpl-2.0": ("GNU General Public License, version 2", "Free Software Foundation; either version 2 of the License"),
    "bsd-2-clause": ("Released under the BSD 2-Clause License", "Licensed under the Simplified BSD License"),
    "cc-by-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0-1.0": ("CC0 1.0 Universal", "has waived all copyright and related or neighboring rights to"),
    "isc": ("Released under the ISC License",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "epl": ("Eclipse Public License",),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}
GRAM, WINDOW, STRIDE = 3, 8, 4
#: One permutation of the hashes for each band: exclusive-or with a constant.
BANDS = tuple(((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)) - (1 << 63) for i in range(1, 21))
CONTAINED = 0.8
#: Words: letters and digits, case aside.
_WORD = r"[\p{L}\p{N}]+"


def _shingles(df: DataFrame, text: Column) -> DataFrame:
    """`df` with `grams`: hashes of every three neighbouring words."""
    w = F.col("__w")
    return (df.withColumn("__w", F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))
            .withColumn("grams", F.when(F.size("__w") >= GRAM, F.transform(
                F.slice(w, 1, F.size("__w") - (GRAM - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, GRAM)])))
                .otherwise(F.array().cast("array<bigint>"))).drop("__w"))


def _bands(part: Column) -> Column:
    least = lambda c: F.array_min(F.transform(part, lambda x: x.bitwiseXOR(F.lit(c))))
    return F.array(*[least(c) for c in BANDS])


def _windows(df: DataFrame, stride: int, shingles: list[int] | None = None, single: list[int] | None = None) -> DataFrame:
    """`df` with `windows`: (at, bands) of every window; texts of fewer words are one window. Shingles in `single` are bands too.

    With `shingles`, bands are worked out only for windows that hold one of them: a band is the smallest permuted hash of
    a window, so windows that meet in a band share a shingle, and the others cannot meet any.
    """
    inside = WINDOW - GRAM + 1
    starts = F.when(F.size("grams") > 0, F.sequence(F.lit(0), F.greatest(
        F.ceil((F.size("grams") - inside) / stride), F.lit(0)).cast("int") * stride, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    part = lambda i: F.slice("grams", i + 1, F.lit(inside))
    if shingles is not None:
        df = df.withColumn("__hits", F.transform("grams", lambda x: x.isin(shingles)))
        starts = F.when(F.array_contains("__hits", True), F.filter(
            starts, lambda i: F.array_contains(F.slice("__hits", i + 1, F.lit(inside)), True))).otherwise(F.array().cast("array<int>"))
    bands = lambda i: F.concat(_bands(part(i)), F.filter(part(i), lambda x: x.isin(single))) if single else _bands(part(i))
    return df.withColumn("windows", F.transform(starts, lambda i: F.struct(i.alias("at"), bands(i).alias("bands")))).drop("__hits")


def templates(spark: SparkSession, known: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(license, part, grams, band): one row per band of every window of every template. As many as the templates given."""
    given = [(name, i, text) for name, parts in (known or TEMPLATES).items() for i, text in enumerate(parts)]
    rows = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(i).alias("part"), F.lit(t).alias("text")) for n, i, t in given])
    made = _windows(_shingles(spark.range(1).select(F.inline(rows)), F.col("text")), 1)
    return (made.select("license", "part", "grams", F.explode("windows.bands").alias("bands"))
            .withColumn("bands", F.when(F.size("grams") == 1, F.concat("bands", "grams")).otherwise(F.col("bands")))
            .select("license", "part", F.array_distinct("grams").alias("grams"), F.explode("bands").alias("band")).distinct())


def scan(df: DataFrame, known: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, row, license, part, at, containment): every place near which a template's shingles lie to 80% or more.

    `at` is the place of the window that met the template, in words. Words are compared by letters and digits, case aside.
    Null, empty and shorter texts match nothing. A repeated row is reported as often as it is there.
    """
    spark = df.sparkSession
    temp = cut(templates(spark, known))
    bands = [r["band"] for r in temp.select("band").distinct().collect()]
    shingles = [r["g"] for r in temp.select(F.explode("grams").alias("g")).distinct().collect()]
    single = [r["g"] for r in temp.where(F.size("grams") == 1).select(F.get("grams", F.lit(0)).alias("g")).distinct().collect()]
    reach = temp.agg(F.max(F.size("grams"))).first()[0]
    rows = df.select("doc_id", F.monotonically_increasing_id().alias("row"), whole_text().alias("text"))
    rows = _windows(_shingles(rows, F.col("text")).drop("text"), STRIDE, shingles, single)
    met = rows.withColumn("windows", F.filter("windows", lambda x: reduce(
        lambda a, b: a | b, [F.get(x["bands"], i).isin(bands) for i in range(len(BANDS))], F.size(x["bands"]) > len(BANDS))))
    near = lambda at: F.slice("grams", F.greatest(at - reach, F.lit(0)) + 1, F.lit(2 * reach + WINDOW))
    # What is around a window that met something goes with it; nothing else leaves the row.
    met = (met.select("doc_id", "row", F.explode(F.transform("windows", lambda x: F.struct(
        x["at"].alias("at"), x["bands"].alias("bands"), near(x["at"]).alias("around")))).alias("x"))
        .select("doc_id", "row", "x.at", "x.around", F.explode(F.array_distinct("x.bands")).alias("band")))
    # Bounded by the templates given to this function.
    found = met.join(F.broadcast(temp), "band")
    share = F.size(F.array_intersect("grams", "around")) / F.size("grams")
    return (found.withColumn("containment", share).where(F.col("containment") >= CONTAINED)
            .groupBy("doc_id", "row", "license", "part", "at").agg(F.max("containment").alias("containment")))


def op5_licenses(df: DataFrame) -> DataFrame:
    """(doc_id, license, part, at, containment): each template found in each document, with its first place and best share."""
    return (scan(df).groupBy("doc_id", "row", "license", "part")
            .agg(F.min("at").cast("long").alias("at"), F.max("containment").alias("containment")).drop("row"))
