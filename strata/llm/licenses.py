"""License scans by a positional index of rare words, in DataFrame functions alone.

Templates of license texts and notices make an index: word -> (template, place).  A pass over the texts keeps of each
file the places of index words and which mandatory phrases it has.  Document frequencies of the index words over
all files give their IDF; a file looks up the words of highest IDF that it shares with a template, and places
that agree on where the template would begin add up.  A template whose share of the weight reaches ``share`` and whose
mandatory phrase is there labels the file.  All of it happens inside a file's row: there is no shuffle, and no
list of candidates to grow.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, table

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_DRIFT = 3  # places that agree on a beginning differ by as much, at least
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """``phrase``: words that a text must have, one after another, to be of ``label``."""

    label: str
    text: str
    phrase: str


#: Phrases that label by themselves wherever they stand.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Sentences of public license texts.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", "under the mit license"),
    Template("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense', "permission is hereby granted free of charge to any person"),
    Template("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "apache license version 2 0"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "under the terms of the gnu general public license"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gnu lesser general public license"),
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
)


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def index_of(templates: tuple[Template, ...]) -> dict[str, dict[int, list[int]]]:
    """word -> template -> places; words of more than half of the templates are left out."""
    index: dict[str, dict[int, list[int]]] = {}
    for t, template in enumerate(templates):
        for place, word in enumerate(_words(template.text)):
            index.setdefault(word, {}).setdefault(t, []).append(place)
    return {word: postings for word, postings in index.items() if 2 * len(postings) <= len(templates)}


def _array(values: list[Column], kind: str) -> Column:
    return F.array(*values).cast(f"array<{kind}>")


def _starts(found: Column, phrase: str) -> Column:
    """Places where the words of ``phrase`` follow one another."""

    def begins(i: int, word: str) -> Column:
        return F.transform(F.filter(found, lambda x: x["w"] == word), lambda x: x["p"] - i)

    at = [begins(i, word) for i, word in enumerate(phrase.split(" "))]
    out = at[0]
    for other in at[1:]:
        out = F.array_intersect(out, other)
    return out


def _share(found: Column, seen: Column, words: list[tuple[str, list[int], float]], most: int) -> Column:
    """The largest weight of a template's words (word, places, IDF; highest IDF first) that agree on its beginning, of what
    its ``most`` words of highest IDF weigh.  Places agree in either of two grids, so a few words more or less are borne."""
    entry = lambda w, at, idf: F.struct(F.lit(w).alias("w"), _array([F.lit(p) for p in at], "int").alias("at"), F.lit(idf).alias("idf"))
    begin = lambda o, late: 2 * F.floor((o + late * _DRIFT) / (2 * _DRIFT)) + late
    mine = F.slice(F.filter(F.array(*[entry(*x) for x in words]), lambda x: F.array_contains(seen, x["w"])), 1, most)
    begins = F.flatten(F.transform(mine, lambda x: F.flatten(F.transform(F.filter(found, lambda f: f["w"] == x["w"]), lambda f: F.transform(x["at"], lambda at: F.struct(begin(f["p"] - at, 0).alias("o"), begin(f["p"] - at, 1).alias("also"), x["w"].alias("w"), x["idf"].alias("idf")))))))
    begins = F.concat(*[F.transform(begins, lambda b: F.struct(b[name].alias("o"), b["w"].alias("w"), b["idf"].alias("idf"))) for name in ("o", "also")])
    state = lambda o, w, now, best: F.struct(o.alias("o"), w.alias("w"), now.alias("now"), best.alias("best"))

    def step(s: Column, x: Column) -> Column:
        same = s["o"] == x["o"]
        now = F.when(same, s["now"]).otherwise(0.0) + F.when(same & (s["w"] == x["w"]), 0.0).otherwise(x["idf"])
        return state(x["o"], x["w"], now, F.greatest(s["best"], now))

    zero = state(F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0))
    total = sum(idf for _, _, idf in words[:most])
    best = F.aggregate(F.array_sort(begins), zero, step, lambda s: s["best"])
    return F.least(best / F.lit(total), F.lit(1.0)) if total else F.lit(0.0)


def scan_licenses(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, most: int = 8, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per input row.

    Words are runs of letters and digits, A-Z lower-cased, counted from 0.  n_base: places where a base phrase's words stand
    consecutively.  labels: those of base phrases and of templates found, distinct, in order.  score: the
    largest share of a template found, 0.5 at least with a base phrase, else 0.  Null texts count as empty; repeated rows come out repeated and
    count in the document frequencies as often; time and memory are linear in a text's length; an empty table gives an
    empty one; further columns are not read.
    """
    index = index_of(templates)
    listed = sorted({*index, *(w for phrase, _ in base for w in phrase.split(" "))})
    phrases = [t.phrase for t in templates]
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0)).alias("words"))
    rows = rows.select("id", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda x: x["w"].isin(listed)).alias("found"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"))
    has = F.array_compact(F.array(*[F.when(F.contains("line", F.lit(f" {p} ")), t) for t, p in enumerate(phrases)]))
    rows = rows.select("id", "n_words", "found", has.alias("has"), F.array_distinct(F.transform("found", lambda x: x["w"])).alias("seen"))
    starts = F.array(*[_starts(F.col("found"), p) for p, _ in base])
    base_labels = F.array_compact(F.array(*[F.when(F.size(F.get("starts", F.lit(i))) > 0, label) for i, (_, label) in enumerate(base)]))
    rows = rows.withColumn("starts", starts).select("id", "n_words", "seen", "has", F.when(F.size("has") > 0, F.col("found")).alias("found"), base_labels.alias("base_labels"), F.flatten("starts").alias("starts"))
    rows = cut(rows.select("id", "n_words", "seen", "has", "found", "base_labels", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word")), "marks")
    # At most one row for each index word.
    counted = {r["w"]: r["n"] for r in rows.select(F.explode("seen").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = rows.count()
    weights = {w: math.log((1 + total) / (1 + counted.get(w, 0))) for w in index}
    shares = []
    for t in range(len(templates)):
        words = sorted(((w, at[t], weights[w]) for w, at in index.items() if t in at), key=lambda x: (-x[2], x[0]))
        shares.append(F.when(F.array_contains("has", t), _share(F.col("found"), F.col("seen"), words, most)) if words else F.lit(None).cast("double"))
    rows = rows.withColumn("shares", F.when(F.size("has") > 0, F.array(*shares)))
    labels = F.array_compact(F.array(*[F.when(F.get("shares", F.lit(t)) >= share, template.label) for t, template in enumerate(templates)]))
    found = F.array_max(F.filter("shares", lambda s: s >= share))
    score = F.greatest(F.coalesce(found, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    listed_labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", listed_labels(F.col("base_labels")).alias("base_labels"), listed_labels(F.concat("base_labels", labels)).alias("labels"), F.round(score, 6).alias("score"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, base phrases, labels and score of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql(templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, most: int = 8, share: float = 0.6) -> str:
    index = index_of(templates)
    postings = ", ".join(f"('{w}', {t}, {p})" for w, of in index.items() for t, at in of.items() for p in at)
    names = ", ".join(f"({t}, '{x.label}', ' {x.phrase} ')" for t, x in enumerate(templates))
    place = " UNION ALL ".join(
        f"SELECT k, p, '{label}' AS label FROM (SELECT k, unnest(range(len(ws) - {len(phrase.split(' ')) - 1})) + 1 AS p, ws FROM words) WHERE " + " AND ".join(f"ws[p + {i}] = '{w}'" for i, w in enumerate(phrase.split(" ")))
        for phrase, label in base
    )
    return rf"""
WITH words AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
postings(w, t, tp) AS (VALUES {postings}),
templates(t, label, phrase) AS (VALUES {names}),
found AS (SELECT * FROM (SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM words) WHERE w IN (SELECT w FROM postings)),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM words)) / (1 + count(DISTINCT k))) AS idf FROM (SELECT DISTINCT w FROM postings) LEFT JOIN found USING (w) GROUP BY w),
vocabulary AS (SELECT DISTINCT t, w, idf FROM postings JOIN idf USING (w)),
total AS (SELECT t, sum(idf) AS total FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY idf DESC, w) AS r FROM vocabulary) WHERE r <= {most} GROUP BY t),
candidates AS (SELECT k, t FROM words, templates WHERE contains(' ' || array_to_string(ws, ' ') || ' ', phrase)),
mine AS (SELECT k, t, w, idf FROM (SELECT k, t, w, idf, row_number() OVER (PARTITION BY k, t ORDER BY idf DESC, w) AS r FROM candidates JOIN vocabulary USING (t) WHERE EXISTS (SELECT 1 FROM found f WHERE f.k = candidates.k AND f.w = vocabulary.w)) WHERE r <= {most}),
agreed AS (SELECT k, t, sum(idf) AS weight FROM (SELECT DISTINCT k, t, late, floor((f.p - o.tp + late * {_DRIFT}) / {2.0 * _DRIFT}) AS o, w, idf FROM mine JOIN found f USING (k, w) JOIN postings o USING (t, w), (VALUES (0), (1)) AS grid(late)) GROUP BY k, t, late, o),
hit AS (SELECT k, label, share FROM (SELECT k, t, least(max(weight) / any_value(total), 1.0) AS share FROM agreed JOIN total USING (t) GROUP BY k, t) JOIN templates USING (t) WHERE share >= {share}),
base AS ({place}),
bases AS (SELECT k, count(*) AS n_base, min(p) - 1 AS first_word, max(p) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY k),
labels AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM hit UNION ALL SELECT k, label FROM base) GROUP BY k)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(greatest(coalesce((SELECT max(share) FROM hit WHERE hit.k = words.k), 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END), 6) AS score
FROM words LEFT JOIN bases USING (k) LEFT JOIN labels USING (k)"""


OP12_SQL = _sql()
