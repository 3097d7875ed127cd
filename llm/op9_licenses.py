"""License scans as an exact set-similarity join, in DataFrame functions alone.

Blocks of a text are its lines and, so that notices wrapped over lines are found, its windows of consecutive
words, for each template as long as an edited copy of it may be (its words over THRESHOLD). A block's set of words is compared with a few license
templates, and matches one if it holds at least THRESHOLD of the template's distinct words. A window that starts with
a word of no template holds no more than one that starts later, so only the others are looked at. Words of
templates are ordered by how many documents of the whole corpus hold them, rarest first. A match
must share one of a template's first |T| - need + 1 words in that order (prefix filter), have at least ``need``
template words (length filter), and leave enough words on both sides of the shared one
(positional filter); what passes is verified exactly. The inverted index of those prefixes is a literal map:
templates are constants of this file, so its size is fixed, and blocks probe it where they stand, with no exchange.
Documents without any prefix word skip the block work.

Base labels are places of fixed phrases. Null texts are empty; repeated and null ids stay rows; a document
without license words has empty labels, null places and score 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import documents

THRESHOLD = 0.8
#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public notices, as word lists of lower case.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def window_words(template: str, threshold: float) -> int:
    """Words of the windows that are compared with a template."""
    return math.ceil(len(template.split()) / threshold - 1e-9)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _places(w: Column, phrase: list[str]) -> Column:
    def here(x: Column, i: Column) -> Column:
        cond = x == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            cond = cond & (F.get(w, i + k) == p)
        return F.when(cond, i)

    return F.filter(F.transform(w, here), lambda i: i.isNotNull())


def frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents with each template word, over all rows; no more numbers than the templates have words."""
    hit = words.select(F.explode(F.array_intersect("w", strings(vocabulary))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return {r["t"]: r["n"] for r in hit.collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), low.alias("low")).select("doc_id", "low", words_of(F.col("low")).alias("w"))
    sets = [(label, sorted(set(t.split()))) for label, t in templates]
    spans = [window_words(t, threshold) for _, t in templates]
    vocabulary = sorted({t for _, s in sets for t in s})
    seen = frequencies(d.select("w"), vocabulary)
    order = sorted(vocabulary, key=lambda t: (seen.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    postings: dict[str, list[Column]] = {}
    for k, (_, s) in enumerate(sets):
        s = sorted(s, key=rank.get)
        need = math.ceil(threshold * len(s) - 1e-9)
        for i, t in enumerate(s[: len(s) - need + 1]):
            postings.setdefault(t, []).append(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(len(s)).alias("size"), F.lit(need).alias("need")))
    index = F.create_map(*[x for t, p in sorted(postings.items()) for x in (F.lit(t), F.array(*p))])
    full = F.array(*[F.struct(F.lit(label).alias("label"), strings(s).alias("set"), F.lit(math.ceil(threshold * len(s) - 1e-9)).alias("need"), F.lit(span).alias("span")) for (label, s), span in zip(sets, spans, strict=True)])

    def probe(b: Column, held: Callable[[Column], Column] | None = None) -> Column:
        """Templates that block b (its template words, rarest first) matches, with their containment; ``held``: the part of b for a template's span."""
        n = F.size(b)
        cand = F.flatten(F.transform(b, lambda t, j: F.transform(
            F.filter(F.coalesce(F.try_element_at(index, t), F.array().cast("array<struct<k:int,i:int,size:int,need:int>>")),
                     lambda p: (n >= p["need"]) & (F.least(p["i"], j) + 1 + F.least(p["size"] - p["i"] - 1, n - j - 1) >= p["need"])),
            lambda p: p["k"])))
        scored = F.transform(F.array_distinct(cand), lambda k: F.struct(F.get(full, k)["label"].alias("label"), F.size(F.array_intersect(held(F.get(full, k)["span"]) if held else b, F.get(full, k)["set"])).alias("n"), F.size(F.get(full, k)["set"]).alias("size"), F.get(full, k)["need"].alias("need")))
        return F.filter(scored, lambda m: m["n"] >= m["need"])

    longest = max(spans, default=1)

    def window(spots: Column, j: Column) -> Column:
        """Templates that the windows from the j-th template word on match."""
        start = F.get(spots, j)["i"]
        near = F.filter(F.slice(spots, j + 1, longest), lambda e: e["i"] < start + longest)
        words = lambda x: F.transform(x, lambda e: e["x"])
        return probe(F.array_intersect(strings(order), words(near)), lambda span: words(F.filter(near, lambda e: e["i"] < start + span)))

    blocks = F.transform(F.split("low", "\n"), lambda line: F.array_intersect(strings(order), words_of(line)))
    none = F.array().cast("array<struct<label:string,n:int,size:int,need:int>>")
    likely = F.arrays_overlap("w", strings(sorted(postings)))
    hits = F.when(likely, F.flatten(F.transform(blocks, lambda b: probe(b)))).otherwise(none)
    # windows within one line hold no more than the line
    places = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"].isin(order))
    places = F.when(likely & F.col("low").contains("\n"), places).otherwise(F.array().cast("array<struct<i:int,x:string>>"))
    wrapped = F.flatten(F.transform("places", lambda _, j: window(F.col("places"), j)))
    # a text without one of a phrase's words holds no place of it
    may = lambda p: reduce(lambda a, b: a & b, [F.col("low").contains(x) for x in sorted(set(p.split()), key=lambda x: (-len(x), x))])
    spots = F.array(*[F.struct(F.lit(label).alias("label"), F.when(may(p), _places(F.col("w"), p.split())).otherwise(F.array().cast("array<int>")).alias("at")) for p, label in phrases.items()])
    d = d.select("doc_id", F.size("w").cast("bigint").alias("n_words"), hits.alias("hits"), places.alias("places"), spots.alias("spots"))
    d = d.select("doc_id", "n_words", F.concat("hits", wrapped).alias("hits"), "spots")
    at = F.flatten(F.transform("spots", lambda s: s["at"]))
    base = F.transform(F.filter("spots", lambda s: F.size(s["at"]) > 0), lambda s: s["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    d = d.select("doc_id", "n_words", at.alias("at"), base.alias("base"), F.transform("hits", lambda m: m["label"]).alias("found"), F.array_max(F.transform("hits", lambda m: m["n"] / m["size"])).alias("best"))
    return d.select(
        "doc_id", "n_words", F.size("at").cast("bigint").alias("n_base"), F.array_min("at").cast("bigint").alias("first_word"), F.array_max("at").cast("bigint").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.concat("base", "found")).alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    q = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    spot = lambda p: f"list_filter(range(len(w)), lambda i: " + " and ".join(f"w[i+{k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")"  # noqa: E731, F541
    kinds = ", ".join(f"({i}, '{label}', {q(sorted(set(t.split())))}, {window_words(t, THRESHOLD)})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
with d as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as low from documents),
w as (select r, doc_id, low, regexp_extract_all(low, '{word}') as w from d),
s as (select *, {', '.join(f'{spot(p)} as p{i}' for i, p in enumerate(PHRASES))} from w),
t(k, label, words, span) as (values {kinds}),
l as (select r, unnest(string_split(low, chr(10))) as line from d),
b as (select r, regexp_extract_all(line, '{word}') as lw from l),
m as (select r, label, len(list_intersect(list_distinct(lw), words)) / len(words)::DOUBLE as c, len(list_intersect(list_distinct(lw), words)) as n, len(words) as size from b, t),
v as (select r, label, len(words) as size, list_max(list_transform(list_filter(range(len(w)), lambda i: list_contains(words, w[i+1])), lambda i: len(list_intersect(list_distinct(w[i+1:i+span]), words)))) as n from w, t),
c as (select r, label, c, n, size from m union all select r, label, n / size::DOUBLE, n, size from v),
h as (select r, list(distinct label) as found, max(c) as best from c where n >= ceil({THRESHOLD} * size - 1e-9) group by r),
x as (select doc_id, len(w)::BIGINT as n_words, list_concat({', '.join(f'p{i}' for i in range(len(PHRASES)))}) as places,
  list_filter([{', '.join(f"case when len(p{i}) > 0 then '{label}' end" for i, label in enumerate(PHRASES.values()))}], lambda y: y is not null) as base, coalesce(found, []) as found, best from s left join h using (r))
select doc_id, n_words, len(places)::BIGINT as n_base, list_min(places)::BIGINT as first_word, list_max(places)::BIGINT as last_word,
  array_to_string(list_sort(list_distinct(base)), ',') as base_labels, array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') as labels,
  case when len(places) > 0 then 1.0::DOUBLE else coalesce(best, 0)::DOUBLE end as score from x"""


SQL = _sql()
