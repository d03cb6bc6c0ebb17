"""Licence scans by a positional rare-token index (DataFrame functions only).

The licence templates below (whole notices and the usual short ones) are indexed by word: word -> (template, position)
postings. Of each wording only the LOOKED words of the highest IDF over all files are looked up; each match proposes a
relative position (place in the file minus place in the template), at which the whole wording is then read off. A
template is reported where a mandatory key phrase of each kind stands in the file and the share SHARE of the wording's
other words is in place: a key phrase alone proves nothing. Templates and their words are a fixed, small set, so the
index travels as a literal. Files that lack the longest word of every phrase are split into words and counted, no more.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelens.sources.corpus import spread

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label -> (notice wordings, mandatory key phrases of which one per inner tuple must stand in the file).
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple[tuple[str, ...], ...]]] = {
    "mit": (
        (
            "released under the mit license",
            "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ),
        (("mit license", "hereby granted free of charge"),),
    ),
    "apache": (
        (
            "licensed under the apache license version 2 0",
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
            "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ),
        (("apache license", "except in compliance with the license"),),
    ),
    "gpl": (
        (
            "licensed under the gnu general public license version 3",
            "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ),
        (("general public license",),),
    ),
    "lgpl": (
        (
            "licensed under the gnu lesser general public license version 2 1",
            "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        ),
        (("lesser general public license",),),
    ),
    "bsd": (
        (
            "redistribution and use in source and binary forms with or without modification are permitted",
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
            "licensed under the bsd 3 clause license",
            "licensed under the bsd 2 clause license",
        ),
        (("redistribution and use in source", "bsd 2 clause", "bsd 3 clause", "bsd license"),),
    ),
    "mpl": (
        (
            "this source code form is subject to the terms of the mozilla public license v 2 0",
            "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ),
        (("mozilla public license",),),
    ),
    "isc": (
        (
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies",
        ),
        (("purpose with or without fee",),),
    ),
    "cc-by-nc": (("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"), (("cc by nc", "attribution noncommercial"),)),
    "cc-by-sa": (("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 international license"), (("cc by sa", "attribution sharealike"),)),
    "cc-by": (
        ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license"),
        (("cc by 4", "cc by 3", "cc by 2", "commons attribution 4", "commons attribution 3"),),
    ),
    "proprietary": (
        (
            "copyright all rights reserved",
            "proprietary and confidential all rights reserved",
            "all rights reserved unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",
        ),
        (("all rights reserved",),),
    ),
    "unlicense": (
        (
            "this is free and unencumbered software released into the public domain",
            "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
            "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ),
        (("unencumbered software", "public domain"),),
    ),
}
#: Words of a wording that are looked up, and the share of its words outside key phrases that must be in place.
LOOKED, SHARE = 6, 0.6


def blanked(label: str, wording: str) -> list[str]:
    """The words of a wording, with those that belong to a key phrase of its label empty."""
    words = wording.split()
    out = list(words)
    for phrase in (p.split() for group in TEMPLATES[label][1] for p in group):
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                out[i : i + len(phrase)] = [""] * len(phrase)
    return out


def counted_words(label: str, wording: str) -> tuple[int, int]:
    """(words outside key phrases, how many of them must be in place)."""
    n = len([w for w in blanked(label, wording) if w])
    return n, math.ceil(SHARE * n)


def postings() -> list[tuple[str, int, int]]:
    """(word, wording number, position) for every word of every wording."""
    texts = [w for wordings, _ in TEMPLATES.values() for w in wordings]
    return [(w, t, i) for t, text in enumerate(texts) for i, w in enumerate(text.split())]


def phrase_starts(words: Column, phrase: str) -> Column:
    """Array of the places where the phrase's words stand one after another."""
    parts = phrase.split()

    def start(w: Column, i: Column) -> Column:
        hit = w == parts[-1]
        for back, p in enumerate(reversed(parts[:-1]), 1):
            hit = hit & (F.get(words, i - back) == p)
        return F.when(hit, i - (len(parts) - 1))

    # few texts hold the phrase's last word: the others skip the walk over positions
    walk = F.filter(F.transform(words, start), lambda x: x.isNotNull())
    return F.when(F.array_contains(words, parts[-1]), walk).otherwise(F.array().cast("array<int>"))


#: All that is no part of a word once A-Z are lower-cased, that is what WORD leaves out.
SEPARATORS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def literals(values: Iterable[str]) -> Column:
    """An array of strings without quotes, as one literal."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def words_of(text: Column) -> Column:
    """Words in order; null counts as empty. One translation lower-cases A-Z and blanks separators, so no pattern is run."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def gate(words: Column) -> Column:
    """False only where no base phrase and no key phrase can stand: the longest word of each is nowhere in the text."""
    phrases = [p for p, _ in BASE] + [p for _, keys in TEMPLATES.values() for group in keys for p in group]
    return F.arrays_overlap(words, literals(sorted({max(p.split(), key=len) for p in phrases})))


def word_idf(docs: DataFrame) -> dict[str, float]:
    """IDF over all ``docs`` of the template words that occur (at most one row per template word reaches the driver)."""
    vocabulary = sorted({w for w, _, _ in postings()})
    hits = docs.select(F.explode_outer(F.array_union(F.array(F.lit("")), F.array_intersect(words_of(F.col("text")), literals(vocabulary)))).alias("w"))
    df = dict(hits.groupBy("w").count().collect())  # "" stands for every file
    return {w: math.log((1 + df.get("", 0)) / (1 + df[w])) for w in vocabulary if w in df}


def looked_up(wording: str, idf: dict[str, float] | None) -> list[tuple[int, str]]:
    """(position, word) of the wording's LOOKED rarest words among those that ``idf`` knows, ties by word and position."""
    known = [(i, w) for i, w in enumerate(wording.split()) if idf is None or w in idf]
    return sorted(known, key=lambda x: (-(idf or {}).get(x[1], 0.0), x[1], x[0]))[:LOOKED]


def scan(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """``docs`` (a text column needed) with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Columns of those names are replaced; all others pass through, whatever their names. Null or empty text: no words,
    no labels, score 0; repeated rows get equal results; texts of any length are read whole; an empty table stays
    empty. Every place of a phrase counts in n_base, overlapping phrases each. base_labels follow from the base phrases
    alone; labels add what the index finds. score is 1 for a base phrase, otherwise the share of the best matched
    wording's words outside key phrases that are in place, or 0. ``idf`` (``word_idf`` of all files; all words alike
    where not given) decides which words are looked up: a wording none of whose LOOKED rarest words is in place is not
    found.
    """
    row = "_scan_row"
    wordings = [w for ws, _ in TEMPLATES.values() for w in ws]
    labelled = [(label, w) for label, (ws, _) in TEMPLATES.items() for w in ws]
    words, found = F.col("_scan_words"), F.col("_scan_found")
    # the columns of docs travel in one struct, so that no name can clash
    text = docs.select(F.struct("*").alias(row)).withColumn("_scan_words", words_of(F.col("_scan_row.text"))).withColumn("_scan_gate", gate(words))
    starts = F.array(*(phrase_starts(words, p) for p, _ in BASE))
    text = text.withColumn("_scan_starts", F.when(F.col("_scan_gate"), starts).otherwise(F.array(*(F.array().cast("array<int>") for _ in BASE))))

    # only wordings of labels whose key phrases all stand in the file are looked up
    text = text.withColumn("_scan_joined", F.when(F.col("_scan_gate"), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise(""))
    numbers, number, keyed = {}, 0, []
    for label, (ws, keys) in TEMPLATES.items():
        numbers[label] = list(range(number, number := number + len(ws)))
        here = " AND ".join("(" + " OR ".join(f"contains(_scan_joined, ' {p} ')" for p in group) + ")" for group in keys)
        keyed.append(f"IF({here}, array({', '.join(map(str, numbers[label]))}), array())")
    text = text.withColumn("_scan_keyed", F.expr(f"IF(_scan_gate, flatten(array({', '.join(keyed)})), array())"))

    index: dict[str, list[tuple[int, int]]] = {}
    for t, wording in enumerate(wordings):
        for i, w in looked_up(wording, idf):
            index.setdefault(w, []).append((t, i))
    # one literal map: word -> postings
    entries = F.expr("cast(map() as map<string,array<struct<t:int,i:int>>>)" if not index else "map(" + ", ".join(f"'{w}', array({', '.join(f"named_struct('t', {t}, 'i', {i})" for t, i in ps)})" for w, ps in index.items()) + ")")
    vocabulary = literals(index).cast("array<string>")
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(vocabulary, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    proposals = F.flatten(F.transform(hits, lambda h: F.transform(F.filter(entries[h["w"]], lambda p: F.array_contains("_scan_keyed", p["t"])), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["i"]).alias("o")))))
    empty = F.array().cast("array<struct<t:int,o:int>>")
    text = text.withColumn("_scan_proposals", F.when(F.size("_scan_keyed") > 0, F.array_distinct(proposals)).otherwise(empty))
    # the wording read off at each proposed place, words of key phrases left out
    whole = F.transform(literals(" ".join(blanked(*x)) for x in labelled), lambda w: F.split(w, " "))
    others, needed = (F.expr(f"array({', '.join(str(counted_words(*x)[k]) for x in labelled)})") for k in (0, 1))
    agreeing = lambda p: F.size(F.filter(F.get(whole, p["t"]), lambda w, i: F.get(words, p["o"] + i) == w))
    counted = F.transform("_scan_proposals", lambda p: F.struct(p["t"].alias("t"), agreeing(p).alias("n")))
    text = text.withColumn("_scan_found", F.filter(counted, lambda x: x["n"] >= F.get(needed, x["t"])))

    label_of = literals([label for label, own in numbers.items() for _ in own])
    share = F.coalesce(F.array_max(F.transform(found, lambda x: x["n"] / F.get(others, x["t"]))), F.lit(0.0))
    starts = F.col("_scan_starts")
    base = F.array_compact(F.array(*(F.when(F.size(F.get(starts, F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))))
    text = text.withColumns({"_scan_base": base, "_scan_labels": F.transform(found, lambda x: F.get(label_of, x["t"])), "_scan_every": F.flatten(starts)})
    every = F.col("_scan_every")
    new = {
        "n_words": F.size(words).cast("long"),
        "n_base": F.size(every).cast("long"),
        "first_word": F.array_min(every).cast("long"),
        "last_word": F.array_max(every).cast("long"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct("_scan_base")), ","),
        "labels": F.array_join(F.array_sort(F.array_union("_scan_base", "_scan_labels")), ","),
        "score": F.when(F.size(every) > 0, 1.0).when(F.size("_scan_labels") > 0, share).otherwise(0.0),
    }
    kept = [F.col(f"{row}.`{c}`") for c in docs.columns if c not in new]
    return text.select(*kept, *(c.alias(name) for name, c in new.items()))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every whole text of ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = scan(docs, word_idf(docs))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql_list(values) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in values) + ")"


_WORDINGS = [(t, label, w, *counted_words(label, w)) for t, (label, w) in enumerate((label, w) for label, (ws, _) in TEMPLATES.items() for w in ws)]
_POSTINGS = [(t, k, w, int(bool(other))) for t, label, wording, *_ in _WORDINGS for k, (w, other) in enumerate(zip(wording.split(), blanked(label, wording), strict=True))]
_KEYS = [(label, g, p) for label, (_, keys) in TEMPLATES.items() for g, group in enumerate(keys) for p in group]
#: Every word of every wording at every place, in every file whose key phrases stand; no index.
OP9_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t),
phrase(label, p) AS {_sql_list((label, p) for p, label in BASE)},
part AS (SELECT label, p, unnest(string_split(p, ' ')) AS w, unnest(range(len(string_split(p, ' ')))) AS k, len(string_split(p, ' ')) AS n FROM phrase),
place AS (SELECT doc_id, label, i - k AS start FROM w JOIN part USING (w) GROUP BY doc_id, label, p, n, start HAVING count(*) = n),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id),
keys(label, g, p) AS {_sql_list(_KEYS)},
keyed AS (SELECT doc_id, label FROM (SELECT doc_id, label, g, bool_or(contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || p || ' ')) AS here FROM t, keys GROUP BY ALL) GROUP BY ALL HAVING bool_and(here)),
wording(t, label, p, n, need) AS {_sql_list(_WORDINGS)},
posting(t, k, w, other) AS {_sql_list(_POSTINGS)},
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM w WHERE w IN (SELECT w FROM posting) GROUP BY w),
rarest AS (SELECT t, k FROM posting JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY df, w, k) <= {LOOKED}),
agreed AS (SELECT doc_id, label, t, n, sum(other) AS c FROM w JOIN posting USING (w) JOIN wording USING (t) JOIN keyed USING (doc_id, label) LEFT JOIN rarest r USING (t, k)
  GROUP BY doc_id, label, t, n, need, i - k HAVING sum(other) >= need AND count(r.t) > 0),
more AS (SELECT doc_id, max(c / n::DOUBLE) AS share FROM agreed GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM agreed UNION ALL SELECT doc_id, label FROM place) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN every USING (doc_id)"""
