"""License scans: blocks of a text against license templates, by the Dice coefficient of their word bigrams.

Only DataFrame and SQL functions; every row is judged by itself, so there is no shuffle and no hot key.  A text is
lower-cased, everything but ASCII letters, digits and line ends becomes a space, and its lines and the text as a whole are
its blocks.  Dice = 2 |A and B| / (|A| + |B|) >= t needs t / (2 - t) |B| <= |A| <= (2 - t) / t |B|, so a block is compared
only with templates in these bounds; a block with more different words than the largest template allows bigrams is not
even cut into bigrams.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# Short license notices, in common wording.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT license.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0": "Released into the public domain under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    """Different word bigrams of a normalised text, in order of appearance."""
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _literal(templates: dict[str, str]) -> str:
    rows = ", ".join(
        f"struct('{name}' AS name, array({', '.join(repr(b) for b in bigrams(t))}) AS grams, {len(bigrams(t))} AS n)"
        for name, t in templates.items())
    return f"array({rows})"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
         at_least: float = 0.8) -> DataFrame:
    """``key, n_blocks, n_hits, licenses, best_license, best_dice`` for every row.

    ``n_blocks`` counts blocks of two words or more, ``n_hits`` those that match a template, ``licenses`` holds the names
    of all matched templates, sorted and joined by commas (empty without any); the best is the one of largest Dice, ties
    to the first name.  A null or empty text has no blocks.  Repeated rows and null keys are judged row by row; further
    columns are ignored.  Template names may not hold quotes or commas.
    """
    templates = TEMPLATES if templates is None else templates
    low, high = at_least / (2 - at_least), (2 - at_least) / at_least
    widest = int(high * max(len(bigrams(t)) for t in templates.values())) + 1
    flat = "regexp_replace(lower(text), '[^a-z0-9\\n]+', ' ')"
    blocks = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).select(key, F.expr(
        f"transform(concat(split({flat}, '\\n'), array(replace({flat}, '\\n', ' '))), b -> "
        "filter(split(b, ' '), w -> w != ''))").alias("blocks"))
    blocks = blocks.withColumn("blocks", F.expr("filter(blocks, w -> size(w) >= 2)"))
    grams = blocks.select(key, F.size("blocks").alias("n_blocks"), F.expr(
        f"transform(filter(blocks, w -> size(array_distinct(w)) <= {widest + 1}), w -> array_distinct("
        "zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (x, y) -> concat(x, ' ', y))))").alias("grams"))
    hits = grams.select(key, "n_blocks", F.expr(
        f"transform(grams, g -> filter(transform(filter({_literal(templates)}, t -> "
        f"size(g) >= {low!r}D * t.n - 1e-9D AND size(g) <= {high!r}D * t.n + 1e-9D), t -> struct("
        "2.0D * size(array_intersect(g, t.grams)) / (size(g) + t.n) AS dice, t.name AS name)), "
        f"m -> m.dice >= {at_least!r}D))").alias("hits"))
    every = F.flatten("hits")
    best = F.expr("reduce(flatten(hits), CAST(NULL AS struct<dice: double, name: string>), (a, m) -> if("
                  "a IS NULL OR m.dice > a.dice OR (m.dice = a.dice AND m.name < a.name), m, a))")
    return hits.select(
        key, "n_blocks", F.size(F.filter("hits", lambda h: F.size(h) > 0)).alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda m: m["name"]))), ",").alias("licenses"),
        best["name"].alias("best_license"), best["dice"].alias("best_dice"))


def oracle(at_least: float = 0.8) -> str:
    """The same over the view ``documents``, as joins of blocks, bigrams and templates."""
    rows = ", ".join(f"('{name}', '{b}')" for name, t in TEMPLATES.items() for b in bigrams(t))
    return f"""
WITH template(name, gram) AS (VALUES {rows}),
sized AS (SELECT name, count(*) AS n FROM template GROUP BY name),
flat AS (SELECT doc_id, row_number() OVER () AS r,
                regexp_replace(lower(coalesce(text, '')), '[^a-z0-9' || chr(10) || ']+', ' ', 'g') AS t FROM documents),
line AS (SELECT r, unnest(string_split(t, chr(10)) || [replace(t, chr(10), ' ')]) AS b FROM flat),
word AS (SELECT r, row_number() OVER () AS k, list_filter(string_split(b, ' '), lambda w: w <> '') AS w FROM line),
block AS (SELECT r, k, w FROM word WHERE len(w) >= 2),
pair AS (SELECT DISTINCT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM block),
size_of AS (SELECT k, count(*) AS n FROM pair GROUP BY k),
common AS (SELECT k, name, count(*) AS both FROM pair JOIN template USING (gram) GROUP BY k, name),
hit AS (SELECT b.r, c.k, c.name, 2.0::DOUBLE * c.both / (s.n + z.n) AS dice
        FROM common c JOIN size_of s USING (k) JOIN sized z USING (name) JOIN block b USING (k)
        WHERE 2.0::DOUBLE * c.both / (s.n + z.n) >= {at_least}),
told AS (SELECT r, count(DISTINCT k) AS n_hits, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
                arg_min(name, (-dice, name)) AS best_license, max(dice) AS best_dice FROM hit GROUP BY r),
counted AS (SELECT r, count(*) AS n_blocks FROM block GROUP BY r)
SELECT doc_id, CAST(coalesce(n_blocks, 0) AS INTEGER) AS n_blocks, CAST(coalesce(n_hits, 0) AS INTEGER) AS n_hits,
       coalesce(licenses, '') AS licenses, best_license, best_dice
FROM flat LEFT JOIN counted USING (r) LEFT JOIN told USING (r)"""
