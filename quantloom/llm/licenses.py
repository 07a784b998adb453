"""License scan with ordered signature rules.

A text is read as words (runs of ASCII letters, digits and all other than ASCII characters, A-Z in lower case). Rules are
regular expressions over the words joined by single blanks, each with a label, a priority, a confidence and a keyword that
any match contains. Only texts with a keyword meet rules at all, and only the rules of the keywords they have. A detection
is an interval of words. One that lies within the interval of a detection of higher priority, or of the same priority and
greater length, is suppressed; so "apache license version 2.0" reports Apache-2.0 and not a bare mention of Apache as well.
Base phrases are counted at all places, apart from rules and suppression.

Defined cases: a null or empty text has no words, no detections and score 0; an empty table gives no rows; rows that
repeat are judged alike; equal intervals of the same priority are both kept if their labels differ. Extra columns are not read; names that begin
with ``_l_`` are reserved.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.store import landed, small, text_of

#: Words of a text as it is: A-Z become letters by lower-casing, so they belong to words here.
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of which every signature has one, or a word that begins so. A text without any is read no further.
KEYWORDS = ["license", "licensed", "licence", "licenced", "copyright", "gpl", "lgpl", "agpl", "gfdl", "spdx", "warranty", "redistribution",
            "creativecommons", "commons", "cc", "unlicense", "wtfpl", "permission", "copyleft", "domain", "rights"]

#: Signatures as label | priority | keyword | words as a regular expression. Priority 3 is an identifier or
#: a title with its version, 2 a title or characteristic sentence, 1 a mention.
SIGNATURES = """
mit | 3 | license | released under the mit license
mit | 3 | licensed | licensed under the mit license
mit | 2 | license | the mit license
mit | 2 | license | mit license
mit | 2 | licensed | mit licensed
mit | 2 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 2 | warranty | the software is provided as is without warranty of any kind express or implied
mit-0 | 3 | license | mit no attribution license
x11 | 2 | license | x11 license
expat | 2 | license | expat license
isc | 2 | license | isc license
isc | 2 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 3 | license | (?:0bsd|zero clause bsd) license
bsd | 1 | license | bsd license
bsd | 1 | license | bsd style license
bsd-2-clause | 3 | license | (?:2|two) clause bsd license
bsd-2-clause | 3 | license | bsd (?:2|two) clause(?: simplified)? license
bsd-2-clause | 2 | license | (?:simplified|freebsd) (?:bsd )?license
bsd-3-clause | 3 | license | (?:3|three) clause bsd license
bsd-3-clause | 3 | license | bsd (?:3|three) clause(?: new or revised)? license
bsd-3-clause | 2 | license | (?:new|revised|modified) bsd license
bsd-4-clause | 3 | license | (?:4|four) clause bsd license
bsd-4-clause | 2 | license | original bsd license
bsd | 2 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 2 | permission | neither the name of .{1,80} nor the names of its contributors may be used .{1,60} without specific prior written permission
apache | 1 | license | apache license
apache | 1 | licence | apache licence
apache | 2 | license | apache software license
apache-1.0 | 3 | license | apache (?:software )?license version 1 0
apache-1.1 | 3 | license | apache (?:software )?license version 1 1
apache-2.0 | 3 | license | apache license version 2 0
apache-2.0 | 3 | license | apache license v?2(?: 0)?
apache-2.0 | 3 | license | licensed under the apache license version 2 0
apache-2.0 | 2 | license | unless required by applicable law or agreed to in writing software distributed under the license
gpl | 1 | license | general public license
gpl | 1 | licence | general public licence
gpl | 1 | license | gnu public license
gpl | 1 | gpl | gnu gpl
gpl | 1 | gpl | under the gpl
lgpl | 1 | license | (?:lesser|library) general public license
lgpl | 1 | lgpl | under the lgpl
agpl | 1 | license | affero general public license
agpl | 1 | agpl | under the agpl
gfdl | 1 | license | free documentation license
gpl | 2 | warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | 2 | license | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | 2 | license | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | 2 | license | you can redistribute it and or modify it under the terms of the gnu affero general public license
mpl | 1 | license | mozilla public license
epl | 1 | license | eclipse public license
cddl | 1 | license | common development and distribution license
cpl | 1 | license | common public license
eupl | 1 | licence | european union public licence
osl | 1 | license | open software license
afl | 1 | license | academic free license
artistic | 1 | license | artistic license
ms-pl | 2 | license | microsoft public license
ms-rl | 2 | license | microsoft reciprocal license
bsl-1.0 | 3 | license | boost software license(?: version 1 0)?
python | 2 | license | (?:python software foundation|psf) license
php | 2 | license | php license(?: version 3 0[01]?)?
zlib | 2 | license | zlib license
libpng | 2 | license | libpng license
openssl | 2 | license | openssl license
ncsa | 2 | license | (?:university of illinois|ncsa) open source license
postgresql | 2 | license | postgresql license
w3c | 2 | license | w3c software (?:notice and )?license
curl | 2 | license | curl license
unicode | 2 | license | unicode license agreement
ruby | 2 | license | ruby license
vim | 2 | license | vim license
json | 2 | license | json license
tcl | 2 | license | tcl license
ofl-1.1 | 3 | license | sil open font license(?: version 1 1)?
wtfpl | 2 | license | do what the (?:fuck|f) you want to public license
wtfpl | 2 | wtfpl | wtfpl
unlicense | 2 | unlicense | the unlicense
unlicense | 2 | domain | this is free and unencumbered software released into the public domain
public-domain | 1 | domain | (?:in|into|to) the public domain
public-domain | 2 | domain | dedicated to the public domain
odbl | 2 | license | open database license
odc-by | 2 | license | open data commons attribution license
pddl | 2 | license | public domain dedication and license
cdla-permissive | 2 | license | community data license agreement permissive
cdla-sharing | 2 | license | community data license agreement sharing
etalab | 2 | licence | licence ouverte
ogl-uk | 2 | licence | open government licence
openrail | 2 | license | (?:creativeml |bigscience )?open ?rail(?: m)? license
llama | 2 | license | llama [23](?: [0-9])? community license
elastic-2.0 | 3 | license | elastic license(?: 2 0)?
sspl-1.0 | 3 | license | server side public license
busl-1.1 | 3 | license | business source license(?: 1 1)?
polyform | 2 | license | polyform (?:noncommercial|small business|shield) license
hippocratic | 2 | license | hippocratic license
proprietary | 1 | rights | all rights reserved
proprietary | 1 | license | (?:proprietary|commercial|end user) license
copyright | 1 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
copyright | 1 | copyright | copyright by
copyleft | 1 | copyleft | copyleft license
cc | 1 | commons | creative commons
cc0-1.0 | 3 | cc | cc0(?: 1 0)?
cc0-1.0 | 3 | commons | creative commons zero
"""
#: Families whose signatures follow one pattern, with their versions.
GNU = {"gpl": ("general public license", ["1", "2", "3"]), "lgpl": ("(?:lesser|library) general public license", ["2", "2 1", "3"]),
       "agpl": ("affero general public license", ["1", "3"]), "gfdl": ("free documentation license", ["1 1", "1 2", "1 3"])}
CC = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s",
      "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
VERSIONED = {"mpl": ("mozilla public license", ["1 0", "1 1", "2 0"]), "epl": ("eclipse public license", ["1 0", "2 0"]),
             "cddl": ("common development and distribution license", ["1 0", "1 1"]), "osl": ("open software license", ["1 0", "2 0", "2 1", "3 0"]),
             "afl": ("academic free license", ["1 1", "1 2", "2 0", "2 1", "3 0"]), "artistic": ("artistic license", ["1 0", "2 0"]),
             "eupl": ("european union public licence", ["1 0", "1 1", "1 2"]), "apl": ("adaptive public license", ["1 0"]),
             "apsl": ("apple public source license", ["1 0", "1 1", "1 2", "2 0"]), "lppl": ("latex project public license", ["1 0", "1 1", "1 2", "1 3c?"])}
SPDX = ["mit", "isc", "apache 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later",
        "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "mpl 2 0", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause",
        "epl 1 0", "epl 2 0", "cddl 1 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "cc by nc 4 0", "unlicense", "zlib", "bsl 1 0", "artistic 2 0",
        "ms pl", "postgresql", "ofl 1 1", "0bsd", "wtfpl", "ncsa", "python 2 0", "ruby", "php 3 01", "vim", "x11", "eupl 1 2"]
CONFIDENCE = {1: 0.5, 2: 0.8, 3: 1.0}


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, signature) of all rules, in order."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, keyword, words = line.split(" | ", 3)
        out.append((label, int(priority), keyword, words))
    for label, (title, versions) in GNU.items():
        keyword = "license"
        for version in versions:
            name = f"{label}-{version.replace(' ', '.')}" + ("" if " " in version else ".0")
            zero = version if " " in version else f"{version}(?: 0)?"
            out += [(name, 3, keyword, f"{title} version {zero}"), (name, 3, keyword, f"{title} v{zero}"),
                    (name, 3, keyword, f"{title} as published by the free software foundation (?:either )?version {zero}"),
                    (name, 3, label, f"{label} ?v?{zero}"), (name, 3, label, f"gnu {label} version {zero}")]
    for code, title in CC.items():
        out += [(f"cc-{code.replace(' ', '-')}", 2, "cc", f"cc {code}"), (f"cc-{code.replace(' ', '-')}", 2, "commons", f"creative commons {title}")]
        for version in CC_VERSIONS:
            name = f"cc-{code.replace(' ', '-')}-{version.replace(' ', '.')}"
            out += [(name, 3, "cc", f"cc {code} {version}"), (name, 3, "commons", f"creative commons {title} {version}"),
                    (name, 3, "license", f"creative commons {title} (?:international |unported |generic )?(?:public )?license (?:version )?{version}")]
    for label, (title, versions) in VERSIONED.items():
        keyword = title.split()[-1]
        for version in versions:
            name = f"{label}-{version.replace(' ', '.').rstrip('?')}"
            out += [(name, 3, keyword, f"{title} (?:version |v)?{version}"), (name, 3, keyword, f"{label} {version} {keyword}")]
    for name in SPDX:
        out.append((name.replace(" clause", "-clause").replace(" only", "").replace(" or later", "-or-later").replace(" ", "-", 1).replace(" ", "."),
                    3, "spdx", f"spdx license identifier {name}"))
    return out


def anchor(words: str) -> str:
    """The longest text that any match of a signature contains: what is left between its choices and repetitions."""
    return max(re.split(r"\(\?:.*?\)\??|\[[^\]]*\](?:\{\d+\}|\?)?|\.\{[^}]*\}|.\?", words), key=len)


def pattern(words: str) -> str:
    """A signature behind the gap ahead of it. Words may hold U+0085, U+2028 and U+2029, which a dot meets only by (?s)."""
    return f"(?s)\\G(.*?)((?<= ){words}(?= ))"


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(k, label, priority, keyword, anchor(words), pattern(words)) for k, (label, priority, keyword, words) in enumerate(rules())]
    return spark.createDataFrame(rows, "_l_rule int, label string, priority int, keyword string, anchor string, signature string")


def words_of(text: Column) -> Column:
    """The words between single blanks, with a blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), BETWEEN, " ")), F.lit(" "))


def _places(body: str, key: str, rows: DataFrame, signature: Column, more: list[str]) -> DataFrame:
    """Word intervals [first, last) of all matches of a signature."""
    found = rows.select(key, *more, F.posexplode(F.arrays_zip(
        F.regexp_extract_all(body, signature, F.lit(1)).alias("gap"), F.regexp_extract_all(body, signature, F.lit(2)).alias("hit"))).alias("at", "m"))

    def blanks(x: Column) -> Column:
        return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")

    own = Window.partitionBy(key, *more).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # The blank before a match ends its gap; one gap after another, blanks count words.
    upto = F.sum(blanks(F.col("m.gap")) + blanks(F.col("m.hit"))).over(own)
    found = found.withColumn("last", upto).withColumn("first", F.col("last") - blanks(F.col("m.hit")) - 1)
    return found.select(key, *more, "first", "last")


def detections(texts: DataFrame, key: str, body: str) -> DataFrame:
    """Detections that are not suppressed: key, label, priority, first, last. ``body`` holds the words of each text."""
    spark = texts.sparkSession
    has = F.filter(F.lit(KEYWORDS), lambda k: F.contains(F.col(body), F.concat(F.lit(" "), k)))
    gated = texts.select(key, body, F.explode(has).alias("keyword"))
    gated = gated.join(F.broadcast(rule_table(spark)), "keyword")  # the rules are a fixed table
    gated = gated.where(F.contains(F.col(body), F.col("anchor")))
    found = _places(body, key, gated, F.col("signature"), ["_l_rule", "label", "priority"])
    out = found.groupBy(key, "label", "priority", "first", "last").agg(F.count(F.lit(1)).alias("_l_n"))
    # Contained in a longer interval of the same or any interval of a higher priority: a running largest end, for each priority.
    own = Window.partitionBy(key)
    ahead = own.orderBy("first").rangeBetween(Window.unboundedPreceding, 0)
    earlier = own.orderBy("first").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(key, "first")
    shadow = F.lit(False)
    for level in (1, 2, 3):
        end = F.when(F.col("priority") == level, F.col("last"))
        higher = F.coalesce(F.max(end).over(ahead) >= F.col("last"), F.lit(False)) & (F.col("priority") < level)
        longer = (F.coalesce(F.max(end).over(earlier) >= F.col("last"), F.lit(False))
                  | F.coalesce(F.max(end).over(same) > F.col("last"), F.lit(False)))
        shadow = shadow | higher | (longer & (F.col("priority") == level))
    return out.withColumn("_l_shadow", shadow).where(~F.col("_l_shadow")).select(key, "label", "priority", "first", "last")


def base_places(texts: DataFrame, key: str, body: str) -> DataFrame:
    """All places of the base phrases: key, label, first."""
    spark = texts.sparkSession
    phrases = spark.createDataFrame([(p, label, pattern(p)) for p, label in BASE.items()], "phrase string, label string, signature string")
    # No phrase has a word that begins it again, so places do not overlap.
    hits = F.filter(F.lit(list(BASE)), lambda p: F.contains(F.col(body), F.concat(F.lit(" "), p, F.lit(" "))))
    some = texts.select(key, body, F.explode(hits).alias("phrase")).join(F.broadcast(phrases), "phrase")
    return _places(body, key, some, F.col("signature"), ["label"]).drop("last")


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: words, base places, labels, and the confidence of the best detection as score."""
    text = text_of()
    gate = "(?i)(?<![A-Za-z0-9])(?:" + "|".join(KEYWORDS) + ")"
    read = docs.select("doc_id", text.alias("_l_text"), text.rlike(gate).alias("_l_open"))
    read = read.select("doc_id", F.regexp_count("_l_text", F.lit(WORD)).cast("long").alias("n_words"), F.when(
        F.col("_l_open"), F.struct(F.sha2("_l_text", 256).alias("_l_blob"), words_of(F.col("_l_text")).alias("_l_words"))).alias("_l_go"))
    read = landed(read, "license_words")  # only texts with a keyword go on
    counted = read.select("doc_id", "n_words", F.col("_l_go._l_blob").alias("_l_blob"))
    texts = read.where("_l_go IS NOT NULL").select("_l_go.*").dropDuplicates(["_l_blob"])
    texts = landed(texts, "license_texts")
    base = base_places(texts, "_l_blob", "_l_words").groupBy("_l_blob").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"),
        F.collect_set("label").alias("_l_base"))
    confidence = F.lit(0.0)
    for level, value in CONFIDENCE.items():
        confidence = F.when(F.col("priority") == level, value).otherwise(confidence)
    other = detections(texts, "_l_blob", "_l_words").groupBy("_l_blob").agg(
        F.collect_set("label").alias("_l_more"), F.max(confidence).alias("score"))
    digest = landed(base.join(other, "_l_blob", "full"), "licenses")
    out = counted.join(small(digest), "_l_blob", "left")
    none = F.array().cast("array<string>")

    def joined(x: Column) -> Column:
        return F.array_join(F.array_sort(x), ",")

    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        joined(F.coalesce("_l_base", none)).alias("base_labels"),
        joined(F.array_union(F.coalesce("_l_base", none), F.coalesce("_l_more", none))).alias("labels"),
        F.coalesce("score", F.when(F.size("_l_base") > 0, 0.5), F.lit(0.0)).alias("score"))
