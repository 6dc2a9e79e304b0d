"""License scans by a positional rare-token index. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustwatch.llm.common import WORD, lower_ascii, whole


@dataclass(frozen=True)
class Notice:
    """A licence notice: its words, and the mandatory key phrase that has to stand in it word by word."""

    label: str
    text: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def offset(self) -> int:
        """Place of the key phrase in the notice."""
        words, key = self.words, self.key
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: Public licence notices and the phrases that identify them. The first three phrases are the base.
NOTICES: tuple[Notice, ...] = (
    Notice("mit", "released under the mit license", "under the mit license", True),
    Notice("apache-2", "licensed under the apache license version 2 0", "apache license version 2", True),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Notice("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Notice("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    Notice(
        "gpl-3",
        "this work is licensed under the gnu general public license version 3",
        "gnu general public license version 3",
    ),
    Notice(
        "gpl-2",
        "this work is licensed under the gnu general public license version 2",
        "gnu general public license version 2",
    ),
    Notice(
        "lgpl",
        "under the terms of the gnu lesser general public license",
        "gnu lesser general public license",
    ),
    Notice(
        "agpl",
        "under the terms of the gnu affero general public license",
        "gnu affero general public license",
    ),
    Notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    Notice(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2 0",
    ),
    Notice(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software released into the public domain",
    ),
    Notice(
        "mit",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "shall be included in all copies or substantial portions of the software",
    ),
    Notice(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
    Notice(
        "bsd-3",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
        "may be used to endorse or promote products derived from this software",
    ),
    Notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "distribute this software for any purpose with or without fee is hereby granted",
    ),
    Notice(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        "in no event will the authors be held liable",
    ),
    Notice("bsl-1", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    Notice("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Notice("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    Notice("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Notice(
        "gfdl",
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "gnu free documentation license",
    ),
    Notice("odbl", "this database is made available under the open database license", "open database license"),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> dict[str, float]:
    """Inverse document frequency over all of ``docs`` of every word of a key phrase: a few dozen numbers."""
    known = sorted({word for notice in notices for word in notice.key})
    held = docs.select(F.explode(F.array_intersect(_words(whole()), F.lit(known))).alias("word"))
    counted = {row["word"]: row["n"] for row in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(counted.values(), default=0)
    return {word: math.log((1 + total) / (1 + counted.get(word, 0))) for word in known}


def look_ups(notices: tuple[Notice, ...], idf: dict[str, float]) -> list[list[tuple[str, int]]]:
    """For each notice the two places of its key phrase with the rarest words, as (word, place); one place if the phrase is one word."""
    ordered = [sorted(range(len(n.key)), key=lambda i, n=n: (-idf.get(n.key[i], math.inf), i)) for n in notices]
    return [[(n.key[i], i) for i in (places * 2)[:2]] for n, places in zip(notices, ordered, strict=True)]


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, places.

    ``places`` is an array of (start, notice, share): where a notice's key
    phrase stands word by word (words from 0), and the share of the whole
    notice's words that stand at their places around it.

    Of each file, the licence words that it holds are taken. A notice is open
    while the file holds every word of its key phrase, the rarest asked first.
    The file's places of an open notice's two rarest words, each less its place
    in the phrase, are its postings as starts; starts in both are candidates,
    and the phrase is then verified word by word. Every place is found, since
    it holds both words. Rarity comes from all of ``docs``; it decides which
    words are looked up and how many candidates have to be verified, never what
    is found. Null and empty texts have no words; repeated rows and null ids
    keep their rows. No join, no shuffle but the count of a few words.
    """
    rare = look_ups(notices, rarity(docs, notices))
    keys = F.array(*[F.array(*map(F.lit, n.key)) for n in notices])
    texts = F.array(*[F.array(*map(F.lit, n.words)) for n in notices])
    offsets = F.array(*[F.lit(n.offset) for n in notices])
    numbers = F.array(*[F.lit(i) for i in range(len(notices))])
    word = [F.array(*[F.lit(pair[k][0]) for pair in rare]) for k in range(2)]
    place = [F.array(*[F.lit(pair[k][1]) for pair in rare]) for k in range(2)]
    known = F.lit(sorted({w for n in notices for w in n.key}))

    cut = docs.select("doc_id", _words(whole()).alias("__w"))
    held = cut.withColumn("__held", F.array_intersect("__w", known))
    opened = held.withColumn(
        "__open",
        F.filter(
            numbers,
            lambda n: F.array_contains("__held", F.get(word[0], n)) & (F.size(F.array_except(F.get(keys, n), F.col("__held"))) == 0),
        ),
    )
    wanted = F.flatten(F.transform("__open", lambda n: F.array(F.get(word[0], n), F.get(word[1], n))))
    asked = opened.withColumn("__q", F.array_distinct(wanted))
    # Only texts with an open notice are walked word by word.
    postings = F.filter(
        F.transform("__w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains("__q", x["w"])
    )
    posted = asked.withColumn("__r", F.when(F.size("__q") > 0, postings).otherwise(F.array().cast("array<struct<w:string,i:int>>")))

    def starts(n: Column, k: int) -> Column:
        return F.transform(F.filter("__r", lambda x: x["w"] == F.get(word[k], n)), lambda x: x["i"] - F.get(place[k], n))

    candidates = posted.withColumn(
        "__c",
        F.flatten(
            F.transform(
                "__open",
                lambda n: F.transform(
                    F.array_intersect(starts(n, 0), starts(n, 1)), lambda s: F.struct(s.alias("start"), n.alias("notice"))
                ),
            )
        ),
    )

    def stands(c: Column) -> Column:
        key = F.get(keys, c["notice"])
        return F.when(c["start"] >= 0, F.slice(F.col("__w"), c["start"] + 1, F.size(key)) == key).otherwise(F.lit(False))

    def share(c: Column) -> Column:
        text, first = F.get(texts, c["notice"]), c["start"] - F.get(offsets, c["notice"])
        equal = F.filter(text, lambda w, i: w.eqNullSafe(F.get(F.col("__w"), first + i)))
        return F.size(equal) / F.size(text)

    verified = candidates.withColumn("__v", F.filter("__c", stands))
    return verified.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.sort_array(
            F.transform("__v", lambda c: F.struct(c["start"].alias("start"), c["notice"].alias("notice"), share(c).alias("share")))
        ).alias("places"),
    )


def labels(places: Column, notices: tuple[Notice, ...] = NOTICES) -> Column:
    """Distinct labels of ``places``, sorted and comma-joined."""
    names = F.array(*[F.lit(n.label) for n in notices])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(names, p["notice"])))), ",")
