"""Licence scan by sentence rules (native).

A text is cut into sentences, each is normalised, and known licence sentences
get their identifier.  A line end may end a sentence or only wrap it, so a known
sentence is found on one line and over several; a blank line (also one of
comment marks) always ends it.  The identifiers of a text, in order, form a sequence in
which rules are looked for.  Rules are ordered: an earlier one takes its
sentences before a later one is tried, so a full licence text wins over its
title.  All of it is one projection; only texts with a trigger word are cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.llm.common import table, text_of

#: Every known sentence has one of these (as letters, whatever the case).
TRIGGER = "(?i)licen[cs]e|copyright|warrant|permission|redistribut|creative commons|public domain|spdx|cc by|cc0|gnu"
#: A sentence ends at one of these marks before white space or the end; for line ends see ``MARKED``.
SENTENCE_END = "[.;:!?]+(?=[\\x20\\x09-\\x0D]|$)"
#: Normalising, in order: (pattern, replacement) on the lower-case sentence.
NORMAL = (
    ("[^\\p{L}\\p{N}]+", " "),
    ("licence", "license"),
    ("^ +| +$", ""),
    ("^(?:this|the) (?:work|file|document|text|software|program|project|code|page|content|article|library|material) is ", ""),
    ("^(?:is )?(?:licensed|released|distributed|published|available|provided|made available) under (?:the terms of )?(?:the )?", "under "),
    (" (?:version|v) ?(?=[0-9])", " "),
    ("^all content ", ""),
)

#: Known sentences after normalising (fixed values): identifier, sentence.
SENTENCES = (
    ("mit-name", "under mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "mit license"),
    ("mit-title", "the mit license mit"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2-name", "under apache license 2 0"),
    ("apache-2-name", "under apache license 2 0 the license"),
    ("apache-may", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3-name", "under gnu general public license 3"),
    ("gpl-3-name", "under gnu gpl 3"),
    ("gpl-2-name", "under gnu general public license 2"),
    ("lgpl-name", "under gnu lesser general public license 3"),
    ("agpl-name", "under gnu affero general public license 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-free", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl-implied", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-name", "under bsd license"),
    ("bsd-3-name", "under bsd 3 clause license"),
    ("bsd-redist", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2-name", "under mozilla public license 2 0"),
    ("cc-by-4", "under cc by 4 0"),
    ("cc-by-4", "under creative commons attribution 4 0 international license"),
    ("cc-by-sa-4", "under cc by sa 4 0"),
    ("cc-by-sa-4", "under creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4", "under cc by nc 4 0"),
    ("cc-by-nc-4", "under creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd-4", "under cc by nd 4 0"),
    ("cc-by-nc-sa-4", "under cc by nc sa 4 0"),
    ("cc-by-nc-nd-4", "under cc by nc nd 4 0"),
    ("cc0", "under cc0 1 0"),
    ("cc0", "under cc0 license"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "in the public domain"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache-2", "spdx license identifier apache 2 0"),
    ("spdx-gpl-3", "spdx license identifier gpl 3 0 or later"),
    ("gpl-2-only", "you can redistribute it and or modify it under the terms of the gnu general public license 2 as published by the free software foundation"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-name", "under bsd 2 clause license"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-name", "under isc license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # "v." ends a sentence, its number is the next one
    ("mpl-2-notice", "this source code form is subject to the terms of the mozilla public license v"),
    ("spdx-mit-or-apache", "spdx license identifier mit or apache 2 0"),
    ("spdx-mit-or-apache", "spdx license identifier apache 2 0 or mit"),
)
#: Notices "either version N of the License, or (at your option) any later version" (fixed values): identifier, kind, version, licence.
LATER = (
    ("gpl-2-free", "general", "2", "GPL-2.0-or-later"),
    ("lgpl-21-free", "lesser general", "2 1", "LGPL-2.1-or-later"),
    ("lgpl-3-free", "lesser general", "3", "LGPL-3.0-or-later"),
    ("agpl-3-free", "affero general", "3", "AGPL-3.0-or-later"),
)
#: The same notices with a semicolon before "either": two sentences, the kind and the versions (fixed values).
SPLIT = (("gnu-general", "2", "GPL-2.0-or-later"), ("gnu-general", "3", "GPL-3.0-or-later"), ("gnu-lesser-general", "2 1", "LGPL-2.1-or-later"),
         ("gnu-lesser-general", "3", "LGPL-3.0-or-later"), ("gnu-affero-general", "3", "AGPL-3.0-or-later"))
#: Licences known by their tag (fixed values); those listed above have their own identifiers.
TAGS = ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0",
        "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")
#: Creative Commons licences (fixed values): identifier, short and long name.
COMMONS = (
    ("cc-by-4", "by", "attribution"), ("cc-by-sa-4", "by sa", "attribution sharealike"),
    ("cc-by-nc-4", "by nc", "attribution noncommercial"), ("cc-by-nd-4", "by nd", "attribution noderivatives"),
    ("cc-by-nc-sa-4", "by nc sa", "attribution noncommercial sharealike"),
    ("cc-by-nc-nd-4", "by nc nd", "attribution noncommercial noderivatives"),
)
#: What may follow the name of a licence in its sentence (fixed values).
EXCEPT = ("", " license", " unless noted", " unless otherwise noted", " unless otherwise stated", " except where otherwise noted")


def _tag_words(tag: str) -> str:
    return tag.lower().replace("-", " ").replace(".", " ")


def _later(version: str) -> str:
    return "later-" + version.replace(" ", "-")


def _made_sentences() -> tuple:
    """Sentences that follow from the tables above."""
    later = [(i, f"you can redistribute it and or modify it under the terms of the gnu {kind} public license as published by the free "
                 f"software foundation either {version} of the license or at your option any later version") for i, kind, version, _ in LATER]
    later += [(i, f"you can redistribute it and or modify it under the terms of the {i.replace('-', ' ')} public license as published by the "
                  "free software foundation") for i, _, _ in SPLIT]
    later += [(_later(v), f"either {v} of the license or at your option any later version") for _, v, _ in SPLIT]
    later += [("only-2", "version 2 of the license")]
    tags = [(f"spdx-{_tag_words(t).replace(' ', '-')}", f"spdx license identifier {_tag_words(t)}") for t in TAGS]
    commons = [(i, f"under {a}{name}{end}") for i, short, long in COMMONS for a in ("", "a ") for name in (
        f"cc {short} 4 0", f"creative commons {long} 4 0", f"creative commons {long} 4 0 international",
        f"creative commons {long} 4 0 international license") for end in EXCEPT if not name.endswith("license") or end != " license"]
    return tuple(dict.fromkeys((*later, *tags, *commons)))


SENTENCES = tuple(dict.fromkeys((*SENTENCES, *_made_sentences())))
#: Ordered rules: licence, identifiers that follow one another.
RULES = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-2-name", "apache-may", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-2-name", "apache-may", "apache-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-implied")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    *((name, (i, *rest)) for rest in (("gpl-hope", "gpl-implied"), ()) for i, _, _, name in LATER),
    *((name, (i, _later(v), *rest)) for rest in (("gpl-hope", "gpl-implied"), ()) for i, v, name in SPLIT),
    ("GPL-2.0-only", ("gnu-general", "only-2", "gpl-hope", "gpl-implied")), ("GPL-2.0-only", ("gnu-general", "only-2")),
    ("GPL-2.0-only", ("gpl-2-only", "gpl-hope", "gpl-implied")), ("GPL-2.0-only", ("gpl-2-only",)),
    ("BSD-3-Clause", ("bsd-redist", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redist", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-redist", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-2-name",)),
    ("ISC", ("isc-name", "isc-grant")), ("ISC", ("isc-grant",)), ("ISC", ("isc-name",)), ("Unlicense", ("unlicense",)),
    ("MPL-2.0", ("mpl-2-notice",)), ("MIT OR Apache-2.0", ("spdx-mit-or-apache",)),
    *((tag, (f"spdx-{_tag_words(tag).replace(' ', '-')}",)) for tag in TAGS),
    ("MIT", ("mit-name",)), ("MIT", ("mit-title",)), ("MIT", ("mit-grant",)), ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache-2-name",)), ("Apache-2.0", ("spdx-apache-2",)),
    ("GPL-3.0", ("gpl-3-name",)), ("GPL-2.0", ("gpl-2-name",)), ("LGPL-3.0", ("lgpl-name",)), ("AGPL-3.0", ("agpl-name",)),
    ("GPL-3.0-or-later", ("spdx-gpl-3",)),
    ("BSD", ("bsd-name", "bsd-redist")), ("BSD-3-Clause", ("bsd-3-name",)), ("BSD", ("bsd-name",)), ("BSD", ("bsd-redist",)),
    ("MPL-2.0", ("mpl-2-name",)),
    ("CC-BY-4.0", ("cc-by-4",)), ("CC-BY-SA-4.0", ("cc-by-sa-4",)), ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)), ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4",)), ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4",)),
    ("CC0-1.0", ("cc0",)), ("public-domain", ("public-domain",)),
)


def normalised(sentence: Column) -> Column:
    out = F.lower(sentence)
    for pattern, to in NORMAL:
        out = F.regexp_replace(out, pattern, to)
    return out


#: Mark of a sure end of a sentence; a line end is a possible one.
END = "\x01"
#: The text with its ends marked, in order: (pattern, replacement) on lower case.
MARKED = (
    (END, " "),
    ("(spdx-license-identifier)[\\x20\\x09]*:", "$1\n"),  # the tag's colon ends no sentence, nor does it join what is one
    (SENTENCE_END, END),
    (f"[^\\p{{L}}\\p{{N}}\n{END}]+", " "),
    (" ?\n ?", "\n"),
    ("\n{2,}", END),
    (f"[ \n]*{END}[ \n{END}]*", END),
    ("licence", "license"),
    ("^ +| +$", ""),
    ("([ \n])(?:version|v)[ \n]?(?=[0-9])", "$1"),
)


def _canonical(sentence: str) -> str:
    """A known sentence as ``normalised`` gives it."""
    for pattern, to in NORMAL[1:]:  # letters, digits and blanks only
        sentence = re.sub(pattern, to, sentence)
    return sentence


def _known_pattern(sentences) -> str:
    """Matches the known sentences between ends in a marked text, wrapped or not, with what ``normalised`` takes off them."""
    subject, under = (p.removeprefix("^") for p, _ in (NORMAL[3], NORMAL[4]))
    forms = sorted({_canonical(x) for _, x in sentences}, key=lambda x: (-len(x), x))
    named = "|".join(x.removeprefix("under ") for x in forms if x.startswith("under "))
    other = "|".join(x for x in forms if not x.startswith("under "))
    parts = [f"(?:{under}|(?:all content )?under )(?:{named})"] * bool(named) + [f"(?:all content )?(?:{other})"] * bool(other)
    return f"(?<![^\n{END}])(?:{subject})?(?:{'|'.join(parts)})(?![^\n{END}])".replace(" ", "[ \n]")


def marked(text: Column) -> Column:
    out = F.lower(text)
    for pattern, to in MARKED:
        out = F.regexp_replace(out, pattern, to)
    return out


def licence_scan(docs: DataFrame, sentences=SENTENCES, rules=RULES, text: str = "text") -> DataFrame:
    """Add ``sentence_ids`` (the identifiers in order, as ``<id><id>``), ``licences``
    (names in the order of the text) and ``left_over`` (identifiers no rule took).

    Texts without a known sentence, null and empty texts get empty values.
    Rows are looked at one by one, so repeated rows and ids do not matter.
    """
    t = text_of(f"`{text}`")
    ids = {_canonical(x): i for i, x in sentences}
    known = F.create_map(*[F.lit(x) for s, i in ids.items() for x in (s, f"<{i}>")])
    said = F.regexp_extract_all(marked(t), F.lit(_known_pattern(sentences)), 0)
    found = F.transform(said, lambda s: F.element_at(known, normalised(s)))
    trigger = TRIGGER.replace(" ", "[^\\p{L}\\p{N}]+")
    out = docs.withColumn("sentence_ids", F.when(t.rlike(trigger), F.array_join(found, "")).otherwise(""))
    seq = F.col("sentence_ids")
    for n, (_, ids) in enumerate(rules):
        seq = F.replace(seq, F.lit("".join(f"<{i}>" for i in ids)), F.lit(f"[{n}]"))
    out = out.withColumn("__seq", seq)
    names = F.array(*[F.lit(name) for name, _ in rules])
    return (out.withColumn("licences", F.transform(
                F.regexp_extract_all("__seq", F.lit(r"\[(\d+)\]"), 1), lambda n: F.get(names, n.cast("int"))))
            .withColumn("left_over", F.regexp_replace("__seq", r"\[\d+\]", "")).drop("__seq"))


def op8_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a known licence sentence."""
    out = licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.filter("sentence_ids != ''").select(
        "doc_id", "sentence_ids", F.array_join("licences", ",").alias("licences"), "left_over")


def _oracle() -> str:
    s = "lower(x)"
    for pattern, to in NORMAL:
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    # no look-ahead in this engine: mark the sentence ends first
    s = s.replace(" (?:version|v) ?(?=[0-9])', ' '", " (?:version|v) ?([0-9])', ' \\1'")
    known = "MAP {" + ", ".join(f"'{t}': '<{i}>'" for t, i in {t: i for i, t in SENTENCES}.items()) + "}"
    seq = "sentence_ids"
    for n, (_, ids) in enumerate(RULES):
        seq = f"replace({seq}, '{''.join(f'<{i}>' for i in ids)}', '[{n}]')"
    names = "[" + ", ".join(f"'{name}'" for name, _ in RULES) + "]"
    return f"""
SELECT doc_id, sentence_ids,
  array_to_string(list_transform(regexp_extract_all(seq, '\\[(\\d+)\\]', 1), lambda n: ({names})[n::INTEGER + 1]), ',') AS licences,
  regexp_replace(seq, '\\[\\d+\\]', '', 'g') AS left_over
FROM (SELECT doc_id, sentence_ids, {seq} AS seq FROM (
  SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(list_transform(
    string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[.;:!?]+([\\x20\\x09-\\x0D]|$)', chr(10) || '\\1', 'g'), '\\n+', chr(10), 'g'), chr(10)),
    lambda x: {s}), lambda y: ({known})[y]), lambda z: z IS NOT NULL), ''), '') AS sentence_ids
  FROM documents)) WHERE sentence_ids <> ''"""


ORACLE = _oracle()
