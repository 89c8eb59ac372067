"""Licence scan by sentence rules.

A text is cut into sentences (at blank lines, and after . ! ? ; : before white space; a wrapped line goes on), each is
normalised (lower case, runs of anything but letters and digits, such as comment marks, become one blank) and mapped to the
identifiers of the known licence sentences that it holds, on word boundaries, in order. The identifiers of a text are then
matched against ordered rules. A rule names a sequence of identifiers that must follow each other with no other *known*
sentence between them; rules are tried in order and each known sentence serves one rule only. "All rights reserved"
right before a licence's first sentence belongs to that licence.

A known sentence inside a longer one doesn't count. Licences are also known by tag lines
(``SPDX-License-Identifier: <id>``) and by their names behind "licensed under" and the like; these sentences are made from
``NAMES`` by ``named_sentences``. A sentence that says that something is not under a licence (``NEGATIONS``) is known as
``negated`` and names none.

Defined results: null or empty text, and one without a known sentence, gives an empty list and the verdict ``none``;
very long texts are scanned whole; of equal rules in one text the first place counts; repeated rows are scanned each; an
empty table gives an empty table; the four result columns are replaced where they exist, others may have any names. Every
row is judged in place: nothing is shuffled, so neither copies nor a hot licence line gather anywhere. The tables below
are constants of the code, so their size is bounded.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawmill.llm.arrays import once

#: Known licence sentences, or the part that does not vary, in normal form and their identifiers. Fixed values.
SENTENCES = {
    "under the apache license version 2 0": "apache-2.0-notice",
    "apache license version 2 0 january 2004": "apache-2.0-title",
    "not use this file except in compliance with the license": "apache-2.0-comply",
    "you may obtain a copy of the license at": "license-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2.0-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0-see",
    "under the mit license": "mit-notice",
    "mit license copyright": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind": "as-is",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "nor the names of its contributors may be used to endorse or promote products": "bsd-name",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "this software is provided by the copyright holders and contributors as is": "bsd-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose": "zlib-grant",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "gnu general public license version 3": "gpl-3.0-notice",
    "gnu general public license version 2": "gpl-2.0-notice",
    "gnu lesser general public license version 3": "lgpl-3.0-notice",
    "gnu lesser general public license version 2 1": "lgpl-2.1-notice",
    "gnu affero general public license version 3": "agpl-3.0-notice",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "either version 2 of the license": "version-2",
    "either version 2 1 of the license": "version-2.1",
    "either version 3 of the license": "version-3",
    "this program is free software you can redistribute it and or modify it": "gnu-free",
    "this library is free software you can redistribute it and or modify it": "gnu-free",
    "distributed in the hope that it will be useful but without any warranty": "gnu-hope",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0-notice",
    "mozilla public license version 2 0": "mpl-2.0-title",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-copy",
    "eclipse public license 2 0": "epl-2.0-notice",
    "eclipse public license version 2 0": "epl-2.0-notice",
    "boost software license version 1 0": "bsl-1.0-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0-notice",
    "licensed under cc by 4 0": "cc-by-4.0-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-notice",
    "creative commons attribution 4 0 international": "cc-by-4.0-notice",
    "creative commons attribution sharealike 4 0 international": "cc-by-sa-4.0-notice",
    "creative commons attribution share alike 4 0 international": "cc-by-sa-4.0-notice",
    "creative commons attribution noncommercial 4 0 international": "cc-by-nc-4.0-notice",
    "creative commons attribution noncommercial sharealike 4 0 international": "cc-by-nc-sa-4.0-notice",
    "creative commons attribution noderivatives 4 0 international": "cc-by-nd-4.0-notice",
    "creative commons attribution noncommercial noderivatives 4 0 international": "cc-by-nc-nd-4.0-notice",
    "cc0 1 0 universal": "cc0-notice",
    "dedicated to the public domain": "cc0-notice",
    "all rights reserved": "all-rights",
}
#: Identifier to the normal forms of a licence's SPDX identifier and of its names in running text. Fixed values.
NAMES = {
    "apache-2.0-notice": ("apache 2 0", "apache license 2 0", "apache license version 2 0", "apache license v2 0", "apache 2 0 license", "apache version 2 0"),
    "mit-notice": ("mit", "mit license", "expat license"),
    "mit-0-notice": ("mit 0",),
    "bsd-2-notice": ("bsd 2 clause", "bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"),
    "bsd-3-notice": ("bsd 3 clause", "bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd license"),
    "bsd-4-notice": ("bsd 4 clause", "bsd 4 clause license", "original bsd license"),
    "0bsd-notice": ("0bsd", "bsd zero clause license", "zero clause bsd license"),
    "isc-notice": ("isc", "isc license"),
    "zlib-notice": ("zlib", "zlib license"),
    "bsl-1.0-notice": ("bsl 1 0", "boost software license 1 0", "boost software license"),
    "unlicense-notice": ("unlicense", "the unlicense"),
    "wtfpl-notice": ("wtfpl", "do what the fuck you want to public license"),
    "psf-notice": ("psf 2 0", "python 2 0", "psf license", "python software foundation license"),
    "artistic-2.0-notice": ("artistic 2 0", "artistic license 2 0", "artistic license"),
    "unicode-notice": ("unicode 3 0", "unicode dfs 2016", "unicode license v3", "unicode license"),
    "gpl-2.0-notice": ("gpl 2 0", "gnu gpl v2", "gpl v2", "gplv2", "gnu gplv2", "gnu gpl version 2", "gpl version 2"),
    "gpl-3.0-notice": ("gpl 3 0", "gnu gpl v3", "gpl v3", "gplv3", "gnu gplv3", "gnu gpl version 3", "gpl version 3"),
    "lgpl-2.1-notice": ("lgpl 2 1", "gnu lgpl v2 1", "lgpl v2 1", "lgplv2 1"),
    "lgpl-3.0-notice": ("lgpl 3 0", "gnu lgpl v3", "lgpl v3", "lgplv3"),
    "agpl-3.0-notice": ("agpl 3 0", "gnu agpl v3", "agpl v3", "agplv3"),
    "mpl-2.0-title": ("mpl 2 0", "mpl v2 0", "mozilla public license 2 0"),
    "epl-2.0-notice": ("epl 2 0", "epl v2 0"),
    "cc0-notice": ("cc0 1 0", "cc0"),
    "cc-by-4.0-notice": ("cc by 4 0",),
    "cc-by-sa-4.0-notice": ("cc by sa 4 0",),
    "cc-by-nc-4.0-notice": ("cc by nc 4 0",),
    "cc-by-nd-4.0-notice": ("cc by nd 4 0",),
    "cc-by-nc-sa-4.0-notice": ("cc by nc sa 4 0",),
    "cc-by-nc-nd-4.0-notice": ("cc by nc nd 4 0",),
}
TAG = "spdx license identifier"
LEADS = ("licensed under the", "licensed under", "licensed with the", "released under the", "released under", "distributed under the", "available under the", "covered by the", "subject to the")
#: Names that need no word before them, as they are said of nothing else.
PLAIN = ("gplv2", "gplv3", "gnu gpl v2", "gnu gpl v3", "gnu gplv2", "gnu gplv3", "lgplv3", "agplv3", "isc license", "apache 2 0 license", "bsd 2 clause license", "bsd 3 clause license", "wtfpl", "unicode license v3", "mozilla public license 2 0")
#: A sentence with one of these says that something is not licensed so. Fixed values.
NEGATIONS = tuple(
    f"{word} {verb} {tie}"
    for word in ("not", "isn t", "aren t", "never", "no longer", "not be")
    for verb, tie in (("licensed", "under"), ("released", "under"), ("distributed", "under"), ("available", "under"), ("covered", "by"), ("subject", "to"))
)
NEGATED = "negated"


def named_sentences() -> dict[str, str]:
    """Sentences made of the names: tag lines, and names behind words that license something."""
    found = {}
    for name, forms in NAMES.items():
        found |= {f"{TAG} {forms[0]}": name}
        for form in forms:
            found |= {f"{lead} {form}": name for lead in LEADS}
            if form in PLAIN:
                found[form] = name
    return found


KNOWN = named_sentences() | SENTENCES
#: Ordered rules: name, sequence of identifiers, class. Fixed values; earlier rules win.
RULES = (
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-comply", "license-copy", "apache-2.0-as-is", "apache-2.0-see"), "permissive"),
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-comply", "license-copy"), "permissive"),
    ("Apache-2.0", ("apache-2.0-notice",), "permissive"),
    ("Apache-2.0", ("apache-2.0-title",), "permissive"),
    ("Apache-2.0", ("apache-2.0-comply", "license-copy"), "permissive"),
    ("MIT", ("mit-title", "mit-grant", "mit-keep", "as-is"), "permissive"),
    ("MIT", ("mit-grant", "mit-keep", "as-is"), "permissive"),
    ("MIT", ("mit-grant",), "permissive"),
    ("MIT", ("mit-notice",), "permissive"),
    ("MIT", ("mit-title",), "permissive"),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name", "bsd-as-is"), "permissive"),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-as-is"), "permissive"),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name"), "permissive"),
    ("BSD-3-Clause", ("bsd-grant", "bsd-name"), "permissive"),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"), "permissive"),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), "permissive"),
    ("BSD-2-Clause", ("bsd-grant",), "permissive"),
    ("ISC", ("isc-grant",), "permissive"),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin"), "permissive"),
    ("AGPL-3.0", ("gnu-free", "agpl-terms", "version-3"), "copyleft"),
    ("AGPL-3.0", ("agpl-terms", "version-3"), "copyleft"),
    ("AGPL-3.0", ("agpl-3.0-notice",), "copyleft"),
    ("LGPL-3.0", ("gnu-free", "lgpl-terms", "version-3"), "copyleft"),
    ("LGPL-3.0", ("lgpl-3.0-notice",), "copyleft"),
    ("LGPL-2.1", ("gnu-free", "lgpl-terms", "version-2.1"), "copyleft"),
    ("LGPL-2.1", ("lgpl-2.1-notice",), "copyleft"),
    ("GPL-3.0", ("gnu-free", "gpl-terms", "version-3"), "copyleft"),
    ("GPL-3.0", ("gpl-terms", "version-3"), "copyleft"),
    ("GPL-3.0", ("gnu-free", "gpl-3.0-notice"), "copyleft"),
    ("GPL-3.0", ("gpl-3.0-notice",), "copyleft"),
    ("GPL-2.0", ("gnu-free", "gpl-terms", "version-2"), "copyleft"),
    ("GPL-2.0", ("gpl-terms", "version-2"), "copyleft"),
    ("GPL-2.0", ("gpl-2.0-notice",), "copyleft"),
    ("MPL-2.0", ("mpl-2.0-notice", "mpl-copy"), "copyleft"),
    ("MPL-2.0", ("mpl-2.0-notice",), "copyleft"),
    ("MPL-2.0", ("mpl-2.0-title",), "copyleft"),
    ("EPL-2.0", ("epl-2.0-notice",), "copyleft"),
    ("BSL-1.0", ("bsl-1.0-notice",), "permissive"),
    ("MIT-0", ("mit-0-notice",), "permissive"),
    ("BSD-2-Clause", ("bsd-2-notice",), "permissive"),
    ("BSD-3-Clause", ("bsd-3-notice",), "permissive"),
    ("BSD-4-Clause", ("bsd-4-notice",), "permissive"),
    ("0BSD", ("0bsd-notice",), "permissive"),
    ("ISC", ("isc-notice",), "permissive"),
    ("Zlib", ("zlib-notice",), "permissive"),
    ("Unlicense", ("unlicense-notice",), "permissive"),
    ("WTFPL", ("wtfpl-notice",), "permissive"),
    ("PSF-2.0", ("psf-notice",), "permissive"),
    ("Artistic-2.0", ("artistic-2.0-notice",), "permissive"),
    ("Unicode-3.0", ("unicode-notice",), "permissive"),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4.0-notice",), "restricted"),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0-notice",), "restricted"),
    ("Unlicense", ("unlicense-grant",), "permissive"),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.0-notice",), "restricted"),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",), "restricted"),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-notice",), "copyleft"),
    ("CC-BY-4.0", ("cc-by-4.0-notice",), "permissive"),
    ("CC0-1.0", ("cc0-notice",), "permissive"),
)
ALL_RIGHTS = "all-rights"
#: The rules as they are tried: each first with "all rights reserved" before it, that sentence alone last.
ORDERED = (*(r for name, ids, kind in RULES for r in ((name, (ALL_RIGHTS, *ids), kind), (name, ids, kind))), ("Proprietary", (ALL_RIGHTS,), "restricted"))
#: Every known sentence holds one of these letters, so a text or sentence without any needs no look-up.
ANCHORS = ("licen", "reserved", "permission", "warranty", "redistribut", "copyright", "domain", "provided", "universal", "commons", "misrepresented", "mpl", "advertising", "endorse", "gpl", "wtf", "released under", "distributed under", "available under", "covered by", "subject to")
#: A stop and the white space behind it end a sentence, and so does a line without a letter or digit.
STOP, PART = r"([.!?;:])[ \t\r\n\f\x0B]+", r"\n[^\p{L}\p{N}\n]*\n"
TAG_LINE = r"(?i)(spdx-license-identifier):"
MATCHES = "array<struct<at:int,rule:int,name:string,kind:string>>"
NOT_WORD = r"[^\p{L}\p{N}]+"

assert all(any(a in s for a in ANCHORS) for s in KNOWN)


def anchored(low: Column) -> Column:
    """Whether a lower-cased text holds an anchor. Words of an anchor may stand on two lines, so its first word is looked for."""
    found = F.lit(False)
    for word in dict.fromkeys(a.split()[0] for a in ANCHORS):
        found = found | low.contains(word)
    return found


def key_words() -> dict[str, list[str]]:
    """Known sentences by the word of each that the fewest others hold."""
    counts: dict[str, int] = {}
    for sentence in KNOWN:
        for word in set(sentence.split()):
            counts[word] = counts.get(word, 0) + 1
    found: dict[str, list[str]] = {}
    for sentence in KNOWN:
        found.setdefault(min(sentence.split(), key=lambda w: (counts[w], w)), []).append(sentence)
    return found


def sentences(text: Column) -> Column:
    """Array of the sentences of a text. A tag line's colon ends none."""
    return F.split(F.regexp_replace(F.regexp_replace(text, TAG_LINE, "$1 "), STOP, "$1\n\n"), PART, -1)


def _constant(value, kind: str) -> Column:
    """A constant of many parts as one expression, which Spark works out once when it plans."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def known_sentences(text: Column) -> Column:
    """Array of identifiers of the known sentences of a text, in order."""
    own = [{"word": f" {word} ", "own": [{"sentence": f" {x} ", "id": KNOWN[x]} for x in some]} for word, some in key_words().items()]
    known = _constant(own, "array<struct<word:string,own:array<struct<sentence:string,id:string>>>>")
    denials = _constant([f" {n} " for n in NEGATIONS], "array<string>")

    def ids(plain: Column) -> Column:
        tried = F.flatten(F.transform(F.filter(known, lambda k: F.instr(plain, k["word"]) > 0), lambda k: k["own"]))
        places = F.transform(tried, lambda k: F.struct(F.instr(plain, k["sentence"]).alias("at"), F.length(k["sentence"]).alias("n"), k["id"].alias("id")))
        found = F.array_sort(F.filter(places, lambda p: p["at"] > 0))

        def named(hits: Column) -> Column:
            inside = lambda p, q: (q["at"] <= p["at"]) & (q["at"] + q["n"] >= p["at"] + p["n"]) & (q["n"] > p["n"])
            first = F.filter(hits, lambda p: ~F.exists(hits, lambda q: inside(p, q)))
            negated = (F.size(hits) > 0) & F.exists(denials, lambda n: F.instr(plain, n) > 0)
            return F.when(negated, F.array(F.lit(NEGATED))).otherwise(F.transform(first, lambda p: p["id"]))

        return once(found, named)

    def held(sentence: Column) -> Column:
        plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(sentence), NOT_WORD, " ")), F.lit(" "))
        return once(plain, ids)

    found = F.flatten(F.transform(F.filter(sentences(text), lambda s: anchored(F.lower(s))), held))
    return F.when(anchored(F.lower(text)), found).otherwise(F.array().cast("array<string>"))


def rule_pattern(sequence: tuple[str, ...]) -> str:
    return " " + "  ".join(sequence) + " "


def match_rules(ids: Column) -> Column:
    """Array of (at, rule, name, kind) in text order of where each rule first matches."""
    rows = [{"pattern": rule_pattern(ids_of), "rule": n, "name": name, "kind": kind} for n, (name, ids_of, kind) in enumerate(ORDERED)]
    rules = _constant(rows, "array<struct<pattern:string,rule:int,name:string,kind:string>>")
    text = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    none = F.from_json(F.lit("[]"), MATCHES)

    def step(acc: Column, rule: Column) -> Column:
        at = F.instr(acc["rest"], rule["pattern"])
        one = F.struct(at.alias("at"), rule["rule"].alias("rule"), rule["name"].alias("name"), rule["kind"].alias("kind"))
        rest = F.replace(acc["rest"], rule["pattern"], F.repeat(F.lit("#"), F.length(rule["pattern"])))  # as long, so that places stay
        found = F.when(at > 0, F.concat(acc["found"], F.array(one))).otherwise(acc["found"])
        return F.struct(rest.alias("rest"), found.alias("found")).cast(f"struct<rest:string,found:{MATCHES}>")

    # what isn't there at first isn't there later, as matches are only taken out
    present = F.filter(rules, lambda r: F.instr(text, r["pattern"]) > 0)
    first = F.struct(text.alias("rest"), none.alias("found")).cast(f"struct<rest:string,found:{MATCHES}>")
    return F.array_sort(F.aggregate(present, first, step, lambda acc: acc["found"]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``license_sentences``, ``license_matches``, ``licenses`` (distinct names in text order) and
    ``license_verdict``: the strictest class found (restricted, copyleft, permissive; unknown where sentences
    match no rule; none without any known sentence)."""
    plain = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("license_sentences", known_sentences(plain))
    none = F.from_json(F.lit("[]"), MATCHES)
    out = out.withColumn(
        "license_matches", F.when(F.size("license_sentences") > 0, match_rules(F.col("license_sentences"))).otherwise(none)
    )
    out = out.withColumn("licenses", F.array_distinct(F.transform("license_matches", lambda m: m["name"])))
    kinds = F.transform("license_matches", lambda m: m["kind"])
    verdict = F.when(F.size("license_sentences") == 0, "none")
    for kind in ("restricted", "copyleft", "permissive"):
        verdict = verdict.when(F.array_contains(kinds, kind), kind)
    return out.withColumn("license_verdict", verdict.otherwise("unknown"))
