"""License scans: Dice coefficient over word bigrams against licence templates, pruned by size."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import whole_text

# Notices as they are commonly worded, by licence.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
LEAST = 0.8
UNIT_END = "[.!?;]+[\\x20\\x09-\\x0D]+|[\\x0A-\\x0D]+"
OTHER = "[^a-z0-9\\n]+"


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bounds(n: int, least: float) -> tuple[int, int]:
    """Sizes of sets that can reach the coefficient with one of n: 2 min / (n + size) is its most."""
    return math.ceil(least * n / (2 - least) - 1e-9), math.floor((2 - least) * n / least + 1e-9)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, n_units, n_matches, licenses, best.

    Units are sentences or lines of the normalised text; a unit is compared with a template only
    if the sizes of their bigram sets allow the coefficient. ``licenses`` lists the matched
    licences by name, ``best`` is the largest coefficient from ``least`` up, or 0. NULL, empty
    and one-word units match nothing. Other columns are ignored.
    """
    pairs = {name: sorted(set(zip(w, w[1:]))) for name, t in sorted(templates.items()) if len(w := normal_words(t)) > 1}
    size = {name: bounds(len(b), least) for name, b in pairs.items()}
    low, high = min(a for a, _ in size.values()), max(b for _, b in size.values())
    flat = F.regexp_replace(F.lower(F.regexp_replace(whole_text(), UNIT_END, "\n")), OTHER, " ")
    words = F.filter(F.transform(F.split(flat, "\n"), lambda u: F.split(F.trim(u), " ")), lambda w: F.size(w) > low)
    hashed = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))
    units = F.filter(F.transform(words, hashed), lambda b: F.size(b).between(low, high))

    def best(b: Column) -> Column:
        """The template of the largest coefficient; of equals the first name."""
        each = []
        for rank, (name, own) in enumerate(pairs.items()):
            common = F.size(F.array_intersect(b, F.array(*[F.xxhash64(F.lit(x), F.lit(y)) for x, y in own])))
            dice = F.when(F.size(b).between(*size[name]), 2.0 * common / (F.size(b) + len(own))).otherwise(F.lit(0.0))
            each.append(F.struct(dice.alias("dice"), F.lit(-rank).alias("rank"), F.lit(name).alias("name")))
        return F.array_max(F.array(*each))

    rows = docs.select("doc_id", units.alias("units")).select("doc_id", F.size("units").alias("n_units"), F.filter(F.transform("units", best), lambda m: m["dice"] >= least).alias("found"))
    return rows.select(
        "doc_id",
        F.col("n_units").cast("long").alias("n_units"),
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.sort_array(F.array_distinct(F.col("found.name"))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.col("found.dice")), F.lit(0.0)).alias("best"),
    )


def _sql() -> str:
    pairs = {name: [" ".join(p) for p in sorted({*zip(w, w[1:])})] for name, t in sorted(TEMPLATES.items()) if (w := normal_words(t))}
    rows = ", ".join(f"('{name}', {rank}, {b}, {bounds(len(b), LEAST)[0]}, {bounds(len(b), LEAST)[1]})" for rank, (name, b) in enumerate(pairs.items()))
    low, high = min(bounds(len(b), LEAST)[0] for b in pairs.values()), max(bounds(len(b), LEAST)[1] for b in pairs.values())
    return f"""
WITH t(name, rank, own, low, high) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
u0 AS (SELECT row, unnest(string_split(regexp_replace(lower(regexp_replace(text, '{UNIT_END}', chr(10), 'g')), '{OTHER}', ' ', 'g'), chr(10))) AS u FROM d),
u1 AS (SELECT row, row_number() OVER () AS unit, string_split(trim(u), ' ') AS w FROM u0),
u2 AS (SELECT row, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM u1 WHERE len(w) > {low}),
u AS (SELECT * FROM u2 WHERE len(b) BETWEEN {low} AND {high}),
m AS (SELECT row, unit, name, 2.0::DOUBLE * len(list_intersect(b, own)) / (len(b) + len(own)) AS dice, rank FROM u JOIN t ON len(b) BETWEEN low AND high),
f AS (SELECT row, unit, name, dice FROM m WHERE dice >= {LEAST} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY dice DESC, rank) = 1),
a AS (SELECT row, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS best FROM f GROUP BY row),
c AS (SELECT row, count(*) AS n FROM u GROUP BY row)
SELECT doc_id, coalesce(c.n, 0) AS n_units, coalesce(a.n, 0) AS n_matches, coalesce(names, '') AS licenses, coalesce(best, 0.0::DOUBLE) AS best
FROM d LEFT JOIN a USING (row) LEFT JOIN c USING (row)"""


SQL = _sql()
