"""License scans by ordered signature rules, with built-in functions only.

Texts become words with single spaces. A rule has a keyword, a regular expression over words, a label and a priority: names, identifiers and addresses of license families in six
forms, and sentences of license texts and notices. Only texts that
hold one of the general keywords go on, and only the rules whose keyword occurs are run on them; a rule's keyword is a literal part of its own expression. A detection inside another one, or equal to
one of higher priority, is suppressed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bind, count_words, running_greatest, running_totals, spaced_words, table, unused

#: The phrases of the base and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Families: label, names, identifiers, and words of addresses or of the text itself. All are regular expressions over lower-case words; V stands for a version.
FAMILIES = (
    ("agpl", ("(?:gnu )?affero general public licen[cs]e",), ("agpl V(?: only| or later)?",), ("gnu org licenses agpl",)),
    ("agpl", ("(?:gnu )?agpl(?:v[0-9])?",), ("agpl V(?: only| or later)?",), ("affero gpl",)),
    ("lgpl", ("(?:gnu )?lesser general public licen[cs]e",), ("lgpl V(?: only| or later)?",), ("gnu org licenses lgpl",)),
    ("lgpl", ("(?:gnu )?library general public licen[cs]e",), ("lgpl 2 0",), ("gnu org copyleft lgpl",)),
    ("lgpl", ("(?:gnu )?lgpl(?:v[0-9])?",), ("lgpl V(?: only| or later)?",), ("lesser gpl",)),
    ("gfdl", ("(?:gnu )?free documentation licen[cs]e",), ("gfdl V(?: only| or later)?",), ("gnu org licenses fdl",)),
    ("gpl", ("(?:the )?gnu general public licen[cs]e", "general public licen[cs]e"), ("gpl V(?: only| or later)?",), ("free software foundation either version V",)),
    ("gpl", ("(?:gnu )?gpl(?:v[0-9])?",), ("gpl V(?: only| or later)?",), ("gnu org licenses gpl", "gnu org licenses old licenses gpl")),
    ("apache", ("apache (?:software )?licen[cs]e", "the apache 2 0 licen[cs]e"), ("apache V",), ("apache org licenses license V", "opensource org licenses apache V")),
    ("mit", ("(?:the )?mit(?: x11| expat)? licen[cs]e",), ("mit",), ("opensource org licenses mit", "mit style licen[cs]e")),
    ("mit", ("permission is hereby granted free of charge to any person obtaining a copy",), ("mit 0",), ("the above copyright notice and this permission notice shall be included in all copies",)),
    ("mit", ("expat licen[cs]e",), ("mit",), ("expat mit licen[cs]e",)),
    ("bsd-4-clause", ("(?:the )?(?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e",), ("bsd 4 clause",), ("all advertising materials mentioning features or use of this software",)),
    ("bsd-3-clause", ("(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e",), ("bsd 3 clause",), ("opensource org licenses bsd 3 clause",)),
    ("bsd-2-clause", ("(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[cs]e",), ("bsd 2 clause",), ("opensource org licenses bsd 2 clause",)),
    ("bsd", ("(?:the )?bsd(?: style| type)? licen[cs]e",), ("bsd [0-9a-z]+",), ("opensource org licenses bsd",)),
    ("bsd", ("redistribution and use in source and binary forms with or without modification are permitted",), ("0bsd",), ("redistributions of source code must retain the above copyright notice",)),
    ("isc", ("(?:the )?isc licen[cs]e",), ("isc",), ("opensource org licenses isc",)),
    ("isc", ("permission to use copy modify and or distribute this software for any purpose with or without fee",), ("isc",), ("the software is provided as is and the author disclaims all warranties",)),
    ("mpl", ("mozilla public licen[cs]e",), ("mpl V",), ("mozilla org mpl",)),
    ("mpl", ("mpl V",), ("mpl V",), ("this source code form is subject to the terms of the mozilla public license",)),
    ("epl", ("eclipse public licen[cs]e",), ("epl V",), ("eclipse org legal epl", "eclipse org org documents epl")),
    ("edl", ("eclipse distribution licen[cs]e",), ("edl V",), ("eclipse org org documents edl",)),
    ("cddl", ("common development and distribution licen[cs]e",), ("cddl V",), ("opensource org licenses cddl",)),
    ("cpl", ("common public licen[cs]e",), ("cpl V",), ("opensource org licenses cpl",)),
    ("ipl", ("ibm public licen[cs]e",), ("ipl V",), ("opensource org licenses ibmpl",)),
    ("eupl", ("european union public licen[cs]e",), ("eupl V",), ("joinup ec europa eu",)),
    ("artistic", ("(?:the )?(?:perl )?artistic licen[cs]e",), ("artistic V",), ("opensource org licenses artistic",)),
    ("boost", ("boost software licen[cs]e",), ("bsl V",), ("boost org license V",)),
    ("zlib", ("(?:the )?zlib(?: libpng)? licen[cs]e",), ("zlib",), ("opensource org licenses zlib", "zlib net zlib license")),
    ("libpng", ("libpng licen[cs]e",), ("libpng V",), ("libpng org pub png src libpng license",)),
    ("unlicense", ("(?:the )?unlicense",), ("unlicense",), ("unlicense org",)),
    ("public-domain", ("(?:released|dedicated|placed|is) (?:in|into|to) the public domain",), ("pd",), ("public domain dedication",)),
    ("wtfpl", ("wtfpl",), ("wtfpl",), ("wtfpl net",)),
    ("python", ("python software foundation licen[cs]e", "psf licen[cs]e"), ("python V", "psf V"), ("docs python org license",)),
    ("php", ("(?:the )?php licen[cs]e",), ("php V",), ("php net license",)),
    ("ruby", ("ruby licen[cs]e", "ruby s licen[cs]e"), ("ruby",), ("ruby lang org en about license",)),
    ("openssl", ("openssl licen[cs]e",), ("openssl",), ("openssl org source license",)),
    ("postgresql", ("postgresql licen[cs]e",), ("postgresql",), ("opensource org licenses postgresql",)),
    ("curl", ("(?:the )?curl licen[cs]e",), ("curl",), ("curl se docs copyright",)),
    ("ofl", ("(?:sil )?open font licen[cs]e",), ("ofl V",), ("scripts sil org ofl",)),
    ("vim", ("vim licen[cs]e",), ("vim",), ("vimdoc sourceforge net",)),
    ("json", ("the software shall be used for good not evil",), ("json",), ("json org license",)),
    ("ms-pl", ("microsoft public licen[cs]e",), ("ms pl",), ("opensource org licenses ms pl",)),
    ("ms-rl", ("microsoft reciprocal licen[cs]e",), ("ms rl",), ("opensource org licenses ms rl",)),
    ("upl", ("universal permissive licen[cs]e",), ("upl V",), ("opensource org licenses upl",)),
    ("ncsa", ("(?:university of illinois )?ncsa(?: open source)? licen[cs]e",), ("ncsa",), ("opensource org licenses ncsa",)),
    ("busl", ("business source licen[cs]e",), ("busl V",), ("mariadb com bsl",)),
    ("sspl", ("server side public licen[cs]e",), ("sspl V",), ("mongodb com licensing server side public license",)),
    ("elastic", ("elastic licen[cs]e",), ("elastic V",), ("elastic co licensing elastic license",)),
    ("cc0", ("cc0(?: V)?",), ("cc0 V",), ("creativecommons org publicdomain zero",)),
    ("cc-by-nc-nd", ("cc by nc nd(?: V)?", "(?:creative commons )?attribution noncommercial no ?deriv[a-z]+"), ("cc by nc nd V",), ("creativecommons org licenses by nc nd",)),
    ("cc-by-nc-sa", ("cc by nc sa(?: V)?", "(?:creative commons )?attribution noncommercial share ?alike"), ("cc by nc sa V",), ("creativecommons org licenses by nc sa",)),
    ("cc-by-nc", ("cc by nc(?: V)?",), ("cc by nc V",), ("creativecommons org licenses by nc",)),
    ("cc-by-nc", ("(?:creative commons )?attribution noncommercial(?: V)?(?: international)?",), ("cc by nc V",), ("creative commons noncommercial",)),
    ("cc-by-nd", ("cc by nd(?: V)?",), ("cc by nd V",), ("creativecommons org licenses by nd",)),
    ("cc-by-sa", ("cc by sa(?: V)?",), ("cc by sa V",), ("creativecommons org licenses by sa",)),
    ("cc-by-sa", ("(?:creative commons )?attribution share ?alike(?: V)?(?: international)?",), ("cc by sa V",), ("creative commons share ?alike",)),
    ("cc-by", ("cc by(?: V)?",), ("cc by V",), ("under cc by",)),
    ("cc-by", ("creative commons attribution(?: V)?(?: international)? licen[cs]e",), ("cc by V",), ("creativecommons org licenses by [0-9]",)),
    ("creative-commons", ("creative commons(?: [a-z]+)? licen[cs]e",), ("cc [a-z]+ [a-z]+ V",), ("creativecommons org licenses",)),
    ("all-rights-reserved", ("all rights reserved",), ("licenseref proprietary",), ("no part of this publication may be reproduced",)),
    ("proprietary", ("proprietary (?:and confidential|licen[cs]e|information)",), ("licenseref proprietary",), ("unauthori[sz]ed copying of this (?:file|document)",)),
)

#: Sentences of license texts and notices, each a rule of its own: label, expression, confidence.
NOTICES = (
    ("agpl", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", 1.0),
    ("agpl", "remote network interaction use with the gnu general public license", 1.0),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)", 1.0),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library", 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", 1.0),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.8),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty", 0.8),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", 0.9),
    ("apache", "you may not use this (?:file|software) except in compliance with the license", 0.9),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache", "this product includes software developed by the apache software foundation", 0.9),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 0.8),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", 1.0),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.8),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 0.8),
    ("bsd", "redistributions of source code must retain", 0.8),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|author|regents and contributors) as is and any express or implied warranties", 0.9),
    ("bsd", "this list of conditions and the following disclaimer", 0.7),
    ("bsd-3-clause", "neither the name of [a-z0-9 ]{1,80} nor the names of (?:its|their|any) contributors may be used to endorse or promote products", 1.0),
    ("bsd-3-clause", "the name of the author may not be used to endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "this product includes software developed by the university of california", 0.9),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("isc", "in no event shall the author be liable for any special direct indirect or consequential damages", 0.9),
    ("isc", "permission to use copy modify and distribute this software (?:and its documentation )?for any purpose", 0.8),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl", "this source code form is incompatible with secondary licenses", 0.9),
    ("mpl", "the contents of this file are subject to the mozilla public license", 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", 1.0),
    ("epl", "the accompanying materials are made available under the terms of the eclipse", 0.9),
    ("edl", "terms of the eclipse distribution license", 1.0),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cddl", "when distributing covered code include this cddl header notice in each file", 1.0),
    ("cpl", "the accompanying materials are made available under the terms of the common public license", 1.0),
    ("eupl", "you may not use this work except in compliance with the licen[cs]e", 0.9),
    ("eupl", "licensed under the eupl", 1.0),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("artistic", "under the same terms as perl itself", 0.9),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("boost", "unless such copies or derivative works are solely in the form of machine executable object code", 0.9),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", 1.0),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("public-domain", "no rights reserved", 0.5),
    ("public-domain", "(?:dedicates?|waives?) all (?:copyright|rights) [a-z0-9 ]{0,80}public domain", 0.8),
    ("wtfpl", "do what the fuck you want to", 1.0),
    ("python", "this license agreement is between the python software foundation", 1.0),
    ("php", "this product includes php software freely available from", 1.0),
    ("openssl", "this product includes software developed by the openssl project", 1.0),
    ("openssl", "this product includes cryptographic software written by eric young", 0.9),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 1.0),
    ("ofl", "this font software is licensed under the sil open font license", 1.0),
    ("ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", 1.0),
    ("vim", "vim is charityware", 0.9),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge", 1.0),
    ("ncsa", "neither the names of [a-z0-9 ]{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("upl", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software", 0.9),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 1.0),
    ("sspl", "making the functionality of the program or modified version available to third parties as a service", 1.0),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", 1.0),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made", 0.9),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original", 0.9),
    ("cc-by-nc", "you may not use the material for commercial purposes", 0.9),
    ("cc-by-nc", "attribution noncommercial V international", 1.0),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", 0.9),
    ("cc-by-nd", "attribution no ?deriv[a-z]+ V international", 1.0),
    ("cc-by-nc-sa", "attribution noncommercial share ?alike V international", 1.0),
    ("cc-by-nc-nd", "attribution noncommercial no ?deriv[a-z]+ V international", 1.0),
    ("creative-commons", "some rights reserved", 0.6),
    ("all-rights-reserved", "copyright(?: c)? [0-9]{4} [a-z0-9 ]{1,60} all rights reserved", 0.8),
    ("all-rights-reserved", "may be reproduced (?:stored in a retrieval system )?(?:or )?(?:distributed or )?transmitted in any form or by any means", 0.8),
    ("proprietary", "unauthori[sz]ed copying of this file via any medium is strictly prohibited", 1.0),
    ("proprietary", "contains confidential and proprietary", 0.8),
    ("proprietary", "contains proprietary and confidential", 0.8),
    ("proprietary", "contains trade secrets?", 0.8),
    ("proprietary", "for internal use only", 0.5),
    ("proprietary", "you may not reverse engineer decompile or disassemble", 0.7),
)

#: Forms in which a family is written: what the expression is made of, its priority and its confidence.
NAME, IDENTIFIER, ADDRESS = 1, 2, 3
FORMS = (
    (IDENTIFIER, "spdx license identifier {}", 100, 1.0),
    (IDENTIFIER, "license {}", 60, 0.8),
    (NAME, "(?:licensed|released|distributed|available|published|covered|provided) under(?: the)?(?: terms (?:of|and conditions of)(?: the)?)? {}(?: version)?(?: V)?", 90, 1.0),
    (NAME, "(?:subject to|terms of|governed by|see|under)(?: the)? {}(?: version)?(?: V)?", 80, 0.9),
    (NAME, "{}(?: as published by the free software foundation)?(?: version)?(?: V)?", 50, 0.7),
    (ADDRESS, "(?:https? )?(?:www )?{}", 70, 0.9),
)
VERSION = "v?[0-9]+(?: [0-9]+)?"
#: Words that many families share, and so poor keywords.
COMMON = ("licen", "public domain", "creative")


def _shared(parts: list[str]) -> str:
    """The longest text that all parts hold."""
    first = min(parts, key=len)
    return next((x for n in range(len(first), 2, -1) for k in range(len(first) - n + 1) if "\0" not in (x := first[k : k + n]) and all(x in p for p in parts)), "")


def literals(expression: str) -> list[str]:
    """Texts that stand in every match of an expression and the spaces around it. A part that may be left out brings the space beside it along, so words next to it keep theirs."""
    left = re.sub(r"[a-z0-9]\?|\x20\?", "\0", re.sub(r"\[[^]]*\](?:[+*?]|\{[0-9,]*\})?", "\0", f" {expression} "))
    while found := re.search(r"\(\?:([^()]*)\)(\??)", left):
        body, before, after = found[1].split("|"), left[: found.start()], left[found.end() :]
        if not found[2]:
            made = body[0] if len(body) == 1 else f"\0{_shared(body)}\0"
        elif before.endswith(" ") and all(x.endswith(" ") for x in body):
            made = "\0 "
        elif after.startswith(" ") and all(x.startswith(" ") for x in body):
            made = " \0"
        else:
            made = "\0"
        left = before + made + after
    return [x for x in left.split("\0") if x.strip()]


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, expression, label, priority, confidence), nearly 500; earlier ones come first within a priority. A keyword stands in every match of its own expression."""
    out = []
    for k, family in enumerate(FAMILIES):
        for part, form, priority, confidence in FORMS:
            for body in family[part]:
                if part == NAME and len(body) < 8 and priority == 50 and family[0] in ("mit", "isc"):
                    continue  # a bare word is no signature
                expression = form.format(f"(?:{body})").replace("V", VERSION)
                own = [x.strip() for x in literals(body.replace("V", VERSION)) if len(x.strip()) > 1]  # the words around a name are many families'
                listed = [x for x in literals(expression) if any(o in x for o in own)]
                keyword = max(listed, key=lambda x: (not any(x.strip().startswith(c) and len(x.strip()) <= len(c) + 1 for c in COMMON), len(x)))
                out.append((keyword, f"(?<= ){expression}(?= )", family[0], priority * 1000 - k, confidence))
    for k, (label, body, confidence) in enumerate(NOTICES):
        expression = body.replace("V", VERSION)
        out.append((max(literals(expression), key=len).strip(), f"(?<= ){expression}(?= )", label, 95_000 - k, confidence))
    return out


def _general() -> str:
    """An expression that every match of every rule holds: a text without it goes no further. Most of it is tried at the beginnings of words only."""
    anywhere, starts = ["licen", "gpl", "public domain", "creative"], []
    for keyword, expression, *_ in sorted(rules(), key=lambda r: len(r[0])):
        held = [keyword, *literals(expression[6:-5])]
        if not any(g in x for g in anywhere for x in held) and not any(f" {g}" in x for g in starts for x in held):
            longest = max(held, key=lambda x: (x.strip() != "under", len(x)))
            (starts if longest.startswith(" ") else anywhere).append(longest.strip())
    return f"{'|'.join(anywhere)}|(?<= )(?:{'|'.join(sorted(starts))})"


def _places(norm: Column, phrase: str) -> Column:
    """Word numbers at which a phrase stands."""
    gaps = F.split(norm, f"(?<= ){phrase}(?= )")
    words = F.transform(gaps, lambda g: F.length(g) - F.length(F.replace(g, F.lit(" "), F.lit(""))) - 1)
    k = len(phrase.split())
    begin = bind(words, lambda w: F.slice(F.zip_with(running_totals(F.transform(w, lambda x: x + k)), w, lambda n, x: (n + x).cast("int")), 1, F.size(w) - 1))
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), begin).otherwise(F.array().cast("array<int>"))


def _detections(norm: Column) -> Column:
    """All detections of the rules whose keyword occurs: (start, end, priority, label, confidence), characters of the spaced words."""
    listed = json.dumps([{"k": k, "e": e, "label": label, "p": p, "c": c} for k, e, label, p, c in rules()])
    table_ = F.from_json(F.lit(listed), "array<struct<k:string,e:string,label:string,p:int,c:double>>")  # folded to a literal
    kind = "array<struct<start:int,end:int,priority:int,label:string,confidence:double>>"

    def spans(r: Column) -> Column:
        chunks = F.regexp_extract_all(norm, F.concat(F.lit("(?s)\\G.*?"), r["e"]), F.lit(0))
        gaps = F.regexp_extract_all(norm, F.concat(F.lit("(?s)\\G(.*?)"), r["e"]), F.lit(1))
        both = F.arrays_zip(chunks.alias("a"), gaps.alias("b"))
        span = lambda x, n: F.struct((n + F.length(x["b"])).cast("int").alias("start"), (n + F.length(x["a"])).cast("int").alias("end"), r["p"].alias("priority"), r["label"].alias("label"), r["c"].alias("confidence"))
        return bind(both, lambda z: F.zip_with(z, running_totals(F.transform(z, lambda x: F.length(x["a"]))), span))

    run = F.flatten(F.transform(F.filter(table_, lambda r: F.contains(norm, r["k"])), spans))
    return F.when(norm.rlike(_general()), run).otherwise(F.array().cast(kind))


def _outermost(detections: Column) -> Column:
    """Without those inside another, and of equal ones only that of highest priority: sorted by start, then longest, then priority.

    In that order, a detection is inside another one just if an earlier one ends where it ends or later; the latest end so far is taken by runs of detections.
    """
    ordered = F.array_sort(F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("minus_end"), (-d["priority"]).alias("minus_priority"), d["label"].alias("label"), d["confidence"].alias("confidence"))))
    clear = lambda d, most: -d["minus_end"] > most
    kept = bind(ordered, lambda o: F.filter(F.zip_with(o, running_greatest(F.transform(o, lambda d: -d["minus_end"])), lambda d, most: F.when(clear(d, most), F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), (-d["minus_priority"]).alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence")))), lambda d: d.isNotNull()))
    return kept


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """df's columns and n_words, places (word numbers and labels of the base phrases), detections (of the rules, after suppression), labels and score.

    detections have start and end in characters of the text's words joined by single spaces (with one before the first). labels: sorted
    and distinct, of both. score: 1 where a base phrase or a full notice stands, else the highest confidence of a detection, else 0. A null text counts as
    empty and has no words and no labels; repeated rows and ties stay; an empty table gives an empty one; columns of df by the added names are replaced. No shuffle.
    """
    (norm,) = unused(df, "spaced_words_")
    rows = df.withColumn(norm, spaced_words(F.col(f"`{text}`").cast("string")))
    norm_ = F.col(norm)
    labelled = lambda label: lambda x: F.struct(x.alias("word"), F.lit(label).alias("label"))
    place = [F.transform(_places(norm_, phrase), labelled(label)) for phrase, label in BASE]
    rows = rows.withColumns({"n_words": count_words(norm_), "places": F.array_sort(F.concat(*place)), "detections": _detections(norm_)})
    rows = rows.drop(norm).withColumn("detections", _outermost(F.col("detections")))
    both = F.array_union(F.transform("places", lambda p: p["label"]), F.transform("detections", lambda d: d["label"]))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return rows.withColumns({"labels": F.array_sort(both), "score": F.when(F.size("places") > 0, 1.0).otherwise(best)})


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.transform("places", lambda p: p["word"].cast("bigint"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
