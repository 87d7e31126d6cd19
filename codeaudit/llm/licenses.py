"""License scan by ordered signature rules.

Texts are brought to their words, in lower case and with one blank between them, so a
signature is a regular expression over words and a span counts words.  A rule is tried on
a text only when its keyword is there.  Detections are ordered by priority (tag, full
text, grant, name, mention); one that lies inside the span of another of better priority,
or of the same priority and longer or earlier in the list, is dropped.  The base phrases
are never dropped.

The rules are rows of one literal array, evaluated by built-in functions inside the row
of the document: no join, no shuffle, no Python.

Defined cases: a null text is empty and has no words and no labels; repeated places all
count; equal spans of equal priority go to the rule listed first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import once
from codeaudit.llm.common import free_name, lower_ascii, table

# Phrases of the base scan with their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Confidence of a detection by priority; 0 is a base phrase.
CONFIDENCE = (1.0, 1.0, 0.95, 0.9, 0.7, 0.4)

V = r"(?: version| v)?"
ONLY = r"(?: only| or later| or any later version)?"

#: Licenses: label, identifier as words, names as they stand in running text.
LICENSES = (
    ("mit", "mit", r"mit license|expat license|mit x11 license"),
    ("mit-0", "mit 0", r"mit no attribution license|mit 0 license"),
    ("apache-1", r"apache 1 [01]", rf"apache(?: software)? license{V} 1(?: [01])?"),
    ("apache-2", "apache 2 0", rf"apache(?: software)? license{V} 2(?: 0)?|apache 2(?: 0)? license"),
    ("bsd-2-clause", r"bsd 2 clause(?: patent| views)?", r"bsd 2 clause(?: license)?|(?:simplified|freebsd|two clause|2 clause) bsd license"),
    ("bsd-3-clause", r"bsd 3 clause(?: clear| lbnl| attribution)?", r"bsd 3 clause(?: license)?|(?:new|modified|revised|three clause|3 clause) bsd license"),
    ("bsd-4-clause", r"bsd 4 clause(?: uc)?", r"bsd 4 clause(?: license)?|(?:original|old|four clause|4 clause) bsd license"),
    ("0bsd", "0bsd", r"bsd zero clause(?: license)?|zero clause bsd(?: license)?"),
    ("isc", "isc", r"isc license"),
    ("gpl-1", rf"gpl 1 0{ONLY}", rf"gnu general public license{V} 1(?: 0)?{ONLY}|gplv1|gnu gpl{V} 1"),
    ("gpl-2", rf"gpl 2 0{ONLY}", rf"gnu general public license{V} 2(?: 0)?{ONLY}|gplv2|gnu gpl{V} 2"),
    ("gpl-3", rf"gpl 3 0{ONLY}", rf"gnu general public license{V} 3(?: 0)?{ONLY}|gplv3|gnu gpl{V} 3"),
    ("lgpl-2", rf"lgpl 2 0{ONLY}", rf"gnu library general public license{V} 2(?: 0)?{ONLY}|lgplv2"),
    ("lgpl-2.1", rf"lgpl 2 1{ONLY}", rf"gnu lesser general public license{V} 2 1{ONLY}|lgplv2 1|gnu lgpl{V} 2 1"),
    ("lgpl-3", rf"lgpl 3 0{ONLY}", rf"gnu lesser general public license{V} 3(?: 0)?{ONLY}|lgplv3|gnu lgpl{V} 3"),
    ("agpl-3", rf"agpl 3 0{ONLY}", rf"gnu affero general public license{V} 3(?: 0)?{ONLY}|agplv3|gnu agpl{V} 3"),
    ("gfdl", rf"gfdl 1 [123]{ONLY}", rf"gnu free documentation license(?:{V} 1 [123])?"),
    ("mpl-1", r"mpl 1 [01]", rf"mozilla public license{V} 1(?: [01])?|mpl 1 1 license"),
    ("mpl-2", r"mpl 2 0(?: no copyleft exception)?", rf"mozilla public license{V} 2(?: 0)?|mpl 2 0 license"),
    ("epl-1", "epl 1 0", rf"eclipse public license{V} 1(?: 0)?|epl 1 0 license"),
    ("epl-2", "epl 2 0", rf"eclipse public license{V} 2(?: 0)?|epl 2 0 license"),
    ("edl-1", "edl 1 0", rf"eclipse distribution license{V} 1(?: 0)?"),
    ("cddl-1", r"cddl 1 [01]", rf"common development and distribution license(?:{V} 1(?: [01])?)?"),
    ("cpl-1", "cpl 1 0", rf"common public license{V} 1(?: 0)?"),
    ("ipl-1", "ipl 1 0", rf"ibm public license{V} 1(?: 0)?"),
    ("artistic-1", r"artistic 1 0(?: perl| cl8)?", rf"artistic license{V} 1(?: 0)?"),
    ("artistic-2", "artistic 2 0", rf"artistic license{V} 2(?: 0)?"),
    ("bsl-1", "bsl 1 0", rf"boost software license(?:{V} 1(?: 0)?)?"),
    ("busl-1.1", "busl 1 1", rf"business source license(?:{V} 1 1)?"),
    ("cc0-1", "cc0 1 0", r"cc0 1 0 universal|creative commons zero(?: license)?|cc0 license"),
    ("cc-by", r"cc by [1234] [05]", r"creative commons attribution (?:license|[1234] [05]|international)"),
    ("cc-by-sa", r"cc by sa [1234] [05]", r"creative commons attribution share ?alike|cc by sa(?: [1234] [05])? license"),
    ("cc-by-nc", r"cc by nc [1234] [05]", r"creative commons attribution non ?commercial (?:license|[1234] [05]|international)"),
    ("cc-by-nc-sa", r"cc by nc sa [1234] [05]", r"creative commons attribution non ?commercial share ?alike|cc by nc sa"),
    ("cc-by-nc-nd", r"cc by nc nd [1234] [05]", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)|cc by nc nd"),
    ("cc-by-nd", r"cc by nd [1234] [05]", r"creative commons attribution no ?deriv(?:s|atives)|cc by nd(?: [1234] [05])? license"),
    ("unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public license"),
    ("zlib", "zlib(?: acknowledgement)?", r"zlib license|zlib libpng license"),
    ("libpng", r"libpng(?: 2 0)?", r"libpng license|png reference library license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("python-2", r"(?:python|psf) 2 0", r"python software foundation license|psf license(?: agreement)?"),
    ("ruby", "ruby", r"ruby license"),
    ("php-3", r"php 3 01?", rf"php license{V} 3(?: 0[01]?)?"),
    ("openssl", "openssl", r"openssl license|original ssleay license"),
    ("curl", "curl", r"curl license"),
    ("ncsa", "ncsa", r"university of illinois ncsa open source license|ncsa open source license"),
    ("upl-1", "upl 1 0", rf"universal permissive license(?:{V} 1(?: 0)?)?"),
    ("ms-pl", "ms pl", r"microsoft public license"),
    ("ms-rl", "ms rl", r"microsoft reciprocal license"),
    ("ofl-1.1", r"ofl 1 [01](?: rfn| no rfn)?", rf"sil open font license(?:{V} 1 1)?"),
    ("odbl", "odbl 1 0", r"open database license|open data commons open database license"),
    ("odc-by", "odc by 1 0", r"open data commons attribution license"),
    ("pddl", "pddl 1 0", r"public domain dedication and license"),
    ("cdla-permissive", r"cdla permissive [12] 0", r"community data license agreement permissive"),
    ("cdla-sharing", "cdla sharing 1 0", r"community data license agreement sharing"),
    ("eupl", r"eupl 1 [012]", rf"european union public licen[cs]e(?:{V} 1 [012])?"),
    ("cecill", r"cecill (?:1 [01]|2 [01]|b|c)", r"cecill license|cecill free software license"),
    ("osl-3", "osl 3 0", rf"open software license(?:{V} 3(?: 0)?)?"),
    ("afl-3", "afl 3 0", rf"academic free license(?:{V} 3(?: 0)?)?"),
    ("apsl-2", "apsl 2 0", rf"apple public source license(?:{V} 2(?: 0)?)?"),
    ("bittorrent", r"bittorrent 1 [01]", r"bittorrent open source license"),
    ("blueoak", "blueoak 1 0 0", r"blue oak model license"),
    ("elastic-2", "elastic 2 0", rf"elastic license(?:{V} 2(?: 0)?)?"),
    ("sspl-1", "sspl 1 0", rf"server side public license(?:{V} 1)?"),
    ("json", "json", r"the json license"),
    ("beerware", "beerware", r"the beer ?ware license"),
    ("vim", "vim", r"vim license"),
    ("w3c", r"w3c(?: 19980720| 20150513)?", r"w3c software(?: notice)?(?: and)?(?: document)? license"),
    ("x11", "x11", r"x11 license|x consortium license"),
    ("zpl-2", r"zpl 2 [01]", rf"zope public license(?:{V} 2(?: [01])?)?"),
    ("ecl-2", "ecl 2 0", rf"educational community license(?:{V} 2(?: 0)?)?"),
    ("llama", r"llama (?:2|3)", r"llama [23](?: [0-9])? community license(?: agreement)?"),
    ("openrail", r"(?:bigscience|creativeml) open ?rail m?", r"(?:bigscience|creativeml)(?: bloom)? (?:open)?rail(?: [m0-9]+)?(?: license)?"),
)

#: Sentences of license texts and notices: label, priority, keyword, signature.
SENTENCES = (
    ("mit", 2, "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 2, "software", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", 2, "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", 2, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", 2, "endorse", r"neither the names? of(?: [^ ]+){1,12} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 2, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", 2, "license", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", 2, "apache", r"(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("gpl-3", 2, "license", r"under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", 2, "license", r"under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("lgpl-2.1", 2, "license", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", 2, "license", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3", 2, "license", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("gfdl", 2, "license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", 2, "license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 2, "mozilla", r"(?:https? )?mozilla org mpl 2 0"),
    ("epl-2", 2, "eclipse", r"(?:https? )?(?:www )?eclipse org legal epl 2 0"),
    ("epl-1", 2, "eclipse", r"(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?"),
    ("unlicense", 2, "software", r"this is free and unencumbered software released into the public domain"),
    ("zlib", 2, "software", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1", 2, "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("wtfpl", 2, "fuck", r"you just do what the fuck you want to"),
    ("cc0-1", 2, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", 2, "creativecommons", r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-sa", 2, "creativecommons", r"creativecommons org licenses by sa [1234] [05]"),
    ("cc-by-nc", 2, "creativecommons", r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-sa", 2, "creativecommons", r"creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc-nd", 2, "creativecommons", r"creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nd", 2, "creativecommons", r"creativecommons org licenses by nd [1234] [05]"),
    ("ofl-1.1", 2, "sil", r"scripts sil org ofl"),
    ("python-2", 2, "license", r"psf is making python available to licensee on an as is basis"),
    ("llama", 2, "license", r"is licensed under the llama [23](?: [0-9])? community license"),
    ("all-rights-reserved", 3, "rights", r"copyright(?: c)? (?:19|20)[0-9]{2}(?: [^ ]+){0,8} all rights reserved"),
    ("all-rights-reserved", 5, "rights", r"all rights reserved"),
    ("public-domain", 3, "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("proprietary", 3, "proprietary", r"proprietary and confidential"),
    ("proprietary", 3, "permission", r"no part of this(?: [^ ]+){1,4} may be reproduced(?: [^ ]+){0,12} permission"),
    ("gpl", 5, "general public", r"gnu general public license"),
    ("lgpl", 5, "general public", r"gnu (?:lesser|library) general public license"),
    ("agpl", 5, "general public", r"gnu affero general public license"),
    ("bsd", 5, "bsd", r"bsd (?:style )?license"),
    ("cc", 5, "creative commons", r"creative commons license"),
    ("apache", 5, "apache", r"apache(?: software)? license"),
    ("mpl", 5, "mozilla", r"mozilla public license"),
    ("see-license", 5, "license", r"see(?: the)? license(?: file)? for (?:details|more information|the full license text)"),
)

#: Every text with a match of any rule holds one of these.
GATES = (
    "licen", "apache", "bsd", "cc by", "cc0", "creative", "eclipse", "mozilla", "gpl", "public",
    "permission", "redistribution", "endorse", "advertising", "software", "rights", "fuck",
    "scripts sil", "proprietary", "rail", "affero",
)


def alternatives(rule: str) -> list[str]:
    """The alternatives of a regular expression outside its groups."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(rule):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(rule[start:i])
            start = i + 1
    return [*out, rule[start:]]


def keyword_of(rule: str) -> str:
    """The longest text that every match of a rule without outer alternatives holds."""
    last = None
    while last != rule:  # groups from the inside out
        last, rule = rule, re.sub(r"\((?:\?:)?[^()]*\)(?:[?*+]|\{[^}]*\})?", "#", rule)
    rule = re.sub(r"\[[^\]]*\](?:[?*+]|\{[^}]*\})?|.[?*]", "#", rule)
    return max(re.findall(r"[a-z0-9 ]+", rule), key=len).strip()


def signatures() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, regular expression) in rule order."""
    rules = [(label, phrase, 0, phrase) for phrase, label in BASE_PHRASES]
    for label, identifier, _ in LICENSES:
        rules.append((label, "spdx license identifier", 1, rf"spdx license identifier (?:{identifier})"))
    rules += [(label, word, priority, rule) for label, priority, word, rule in SENTENCES]
    grant = r"(?:licensed|released|distributed|available|provided)(?: to you)? under(?: the)?(?: terms of)?(?: the)?"
    for label, identifier, names in LICENSES:
        for name in alternatives(names):
            rules.append((label, keyword_of(name), 3, rf"{grant} (?:{name})"))
            rules.append((label, keyword_of(name), 4, rf"(?:{name})"))
        for name in alternatives(identifier):
            stated = r"licen[cs]e(?: is| name| type)?"
            rules.append((label, keyword_of(name), 3, rf"{stated} (?:{name})"))
    return [(a, b, p, rf"(?<= )(?:{rule})(?= )") for a, b, p, rule in rules]


@cache
def _rules_sql() -> str:
    def quoted(value: str) -> str:
        return "r'" + value + "'" if "'" not in value else repr(value)

    rows = ", ".join(
        f"struct({i} as rule, {quoted(label)} as label, {quoted(word)} as keyword, "
        f"{priority} as priority, {quoted(rule)} as pattern)"
        for i, (label, word, priority, rule) in enumerate(signatures())
    )
    return f"array({rows})"


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def word_text(text: str | Column) -> Column:
    """The words of a text with one blank before, between and after them."""
    value = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.regexp_replace(value, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _places(words: Column, rule: Column) -> Column:
    """Spans, in words, of all matches of one rule: (first, last, priority, rule, label)."""
    hits = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    gaps = F.split(words, rule["pattern"], -1)
    kind = "array<struct<first:int,last:int,priority:int,rule:int,label:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + _spaces(pair["gap"]) - 1
        last = first + _spaces(pair["hit"])
        span = F.struct(
            first.alias("first"), last.alias("last"), rule["priority"].alias("priority"),
            rule["rule"].alias("rule"), rule["label"].alias("label"),
        )
        return F.struct((last + 1).alias("at"), F.array_append(state["spans"], span).alias("spans"))

    pairs = F.zip_with(
        hits, F.slice(gaps, F.lit(1), F.size(hits)),
        lambda h, g: F.struct(h.alias("hit"), g.alias("gap")),
    )
    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def detections(words: Column) -> Column:
    """All detections of all rules whose keyword the text holds."""
    rules = F.filter(F.expr(_rules_sql()), lambda r: F.contains(words, r["keyword"]))
    return F.flatten(F.transform(rules, lambda r: _places(words, r)))


def unsuppressed(found: Column) -> Column:
    """Detections that lie inside no better one; base phrases always stay.

    Sorted by start, longest first, a span lies inside an earlier one when that one's end
    reaches as far, so the largest end so far of each priority decides, in one pass.
    """
    levels = len(CONFIDENCE)
    order = F.transform(
        found,
        lambda d: F.struct(
            d["first"].alias("first"), (-d["last"]).alias("back"), d["priority"].alias("priority"),
            d["rule"].alias("rule"), d["label"].alias("label"),
        ),
    )
    kind = "array<struct<first:int,last:int,priority:int,rule:int,label:string>>"
    start = F.struct(
        F.array_repeat(F.lit(-1), levels).alias("ends"), F.array().cast(kind).alias("kept")
    )

    def step(state: Column, d: Column) -> Column:
        last = -d["back"]
        better = F.array_max(F.slice(state["ends"], F.lit(1), d["priority"] + 1))
        stays = (d["priority"] == 0) | (better < last)
        span = F.struct(
            d["first"].alias("first"), last.alias("last"), d["priority"].alias("priority"),
            d["rule"].alias("rule"), d["label"].alias("label"),
        )
        ends = F.transform(
            state["ends"],
            lambda end, level: F.when(level == d["priority"], F.greatest(end, last)).otherwise(end),
        )
        return F.struct(
            ends.alias("ends"),
            F.when(stays, F.array_append(state["kept"], span)).otherwise(state["kept"])
            .alias("kept"),
        )

    return F.aggregate(F.array_sort(order), start, step, lambda state: state["kept"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words and detections: spans in words, with rule, priority and label.

    Columns of these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "detections")]
    name, low = free_name(docs, "words"), free_name(docs, "low_words")
    words = F.col(name)
    spelled = docs.select(*kept, once(word_text(text)).alias(name))
    spelled = spelled.select(*kept, name, once(F.lower(words)).alias(low))
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains(F.col(low), F.lit(word))
    n_words = F.when(words == "  ", 0).otherwise(_spaces(words) - 1)
    # one copy in lower case for the gate, and the exact one only for texts that pass it
    passed = spelled.select(
        *kept, n_words.cast("long").alias("n_words"),
        once(F.when(gate, lower_ascii(words))).alias(name),
    )
    kind = "array<struct<first:int,last:int,priority:int,rule:int,label:string>>"
    found = F.when(words.isNotNull(), unsuppressed(detections(words)))
    return passed.select(
        *kept, "n_words", once(F.coalesce(found, F.array().cast(kind))).alias("detections")
    )


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("detections")
    base = F.filter(found, lambda d: d["priority"] == 0)
    sure = F.array(*[F.lit(c) for c in CONFIDENCE])

    def names(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(spans["label"])), ",")

    best = F.array_min(found["priority"])
    return scan(docs).select(
        "doc_id", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first"]).cast("long").alias("first_word"),
        F.array_max(base["first"]).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(found).alias("labels"),
        F.when(F.size(found) > 0, F.get(sure, best)).otherwise(0.0).alias("score"),
    )
