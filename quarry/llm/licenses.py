"""Licence scans by sentence rules, in DataFrame functions only.

A text is read twice, with sentences that end at line ends and with sentences that run over them. Its sentences are
normalised, brought to the form of known ones where they differ in a holder, a subject or the way a licence is mentioned,
and mapped to identifiers of known licence sentences; an SPDX expression gives one for each licence that it names. Both
readings are merged by place, and the sequence of identifiers is then matched against licence rules in their order. A rule that matches takes its sentences out of the
sequence, so what a longer rule has used can't also satisfy a shorter one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, lower-cased, with other characters as single spaces.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-line",
    "licensed under the apache license version 2 0 the license": "apache-line",
    "you may not use this file except in compliance with the license": "apache-comply",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-grant",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "apache license version 2 0": "apache-title",
    "released under the mit license": "mit-line",
    "licensed under the mit license": "mit-line",
    "this project is licensed under the mit license": "mit-line",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-asis",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liable",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this work is licensed under the gnu general public license version 3": "gpl3-line",
    "licensed under the gnu general public license version 3": "gpl3-line",
    "gnu general public license": "gpl-title",
    "version 3 29 june 2007": "gpl3-version",
    "version 2 june 1991": "gpl2-version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-line",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-line",
    "licensed under cc by nc 4 0": "cc-by-nc-line",
    "licensed under cc by sa 4 0": "cc-by-sa-line",
    "licensed under cc by 4 0": "cc-by-line",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-line",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-line",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-line",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license": "gpl2-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license": "gpl3-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version": "lgpl2-grant",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "version 3 19 november 2007": "agpl3-version",
    "version 2 1 february 1999": "lgpl21-version",
    "mozilla public license version 2 0": "mpl2-title",
    "eclipse public license v 2 0": "epl2-title",
    "eclipse public license v 1 0": "epl1-title",
    "boost software license version 1 0 august 17th 2003": "bsl-title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liable",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0-grant",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "do what the fuck you want to public license": "wtfpl-title",
    "cc0 1 0 universal": "cc0-title",
    "artistic license 2 0": "artistic2-title",
    "the artistic license 2 0": "artistic2-title",
    "sil open font license version 1 1": "ofl-title",
    "common development and distribution license cddl version 1 0": "cddl-title",
    "python software foundation license version 2": "psf-title",
    "postgresql license": "postgresql-title",
    "european union public license v 1 2": "eupl-title",
}

# Licences in the order in which their sequences are tried; whole texts come before single notices.
RULES: list[tuple[str, list[str]]] = [
    ("MIT", ["mit-grant", "mit-notice", "mit-asis", "mit-liable"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-grant", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-line", "apache-comply", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-line", "apache-comply"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-only", ["gpl2-only-grant", "gpl-warranty", "gpl-see"]),
    ("GPL-3.0-only", ["gpl3-only-grant", "gpl-warranty", "gpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant", "gpl-warranty", "lgpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant", "gpl-warranty", "lgpl-see"]),
    ("LGPL-2.0-or-later", ["lgpl2-grant", "gpl-warranty", "lgpl-see"]),
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-warranty", "agpl-see"]),
    ("AGPL-3.0", ["agpl-title", "agpl3-version"]),
    ("LGPL-3.0", ["lgpl-title", "gpl3-version"]),
    ("LGPL-2.1", ["lgpl-title", "lgpl21-version"]),
    ("GPL-3.0", ["gpl-title", "gpl3-version"]),
    ("GPL-2.0", ["gpl-title", "gpl2-version"]),
    ("MPL-2.0", ["mpl2-line", "mpl2-copy"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("MPL-2.0", ["mpl2-line"]),
    ("GPL-2.0-only", ["gpl2-only-grant"]),
    ("GPL-3.0-only", ["gpl3-only-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("LGPL-2.0-or-later", ["lgpl2-grant"]),
    ("BSL-1.0", ["bsl-title", "bsl-grant"]),
    ("BSL-1.0", ["bsl-title"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("Zlib", ["zlib-liable", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("WTFPL", ["wtfpl-title"]),
    ("MIT-0", ["mit0-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("EPL-2.0", ["epl2-title"]),
    ("EPL-1.0", ["epl1-title"]),
    ("CC0-1.0", ["cc0-title"]),
    ("Artistic-2.0", ["artistic2-title"]),
    ("OFL-1.1", ["ofl-title"]),
    ("CDDL-1.0", ["cddl-title"]),
    ("PSF-2.0", ["psf-title"]),
    ("PostgreSQL", ["postgresql-title"]),
    ("EUPL-1.2", ["eupl-title"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-line"]),
    ("MIT", ["mit-grant"]),
    ("Apache-2.0", ["apache-line"]),
    ("Apache-2.0", ["apache-title"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["mit-title"]),
    ("GPL-3.0", ["gpl3-line"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-line"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-line"]),
    ("CC-BY-4.0", ["cc-by-line"]),
]

# How licences are called where they are mentioned.
_CALLED: dict[str, list[str]] = {
    "MIT": ["mit", "expat"],
    "Apache-2.0": ["apache version 2 0", "apache license version 2 0", "apache license v2 0", "apache 2 0", "apache license 2 0", "asl 2 0"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gnu gpl version 2", "gpl v2", "gplv2", "gpl version 2"],
    "GPL-3.0": ["gnu general public license v3", "gnu gpl v3", "gnu gpl version 3", "gpl v3", "gplv3", "gpl version 3"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "gnu lgpl v2 1", "lgpl v2 1", "lgplv2 1", "lgpl version 2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lgpl v3", "lgpl v3", "lgplv3", "lgpl version 3"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu agpl v3", "agpl v3", "agplv3"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v2 0"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0", "epl 2 0"],
    "EPL-1.0": ["eclipse public license 1 0", "eclipse public license v 1 0", "eclipse public license version 1 0", "epl 1 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost"],
    "ISC": ["isc"],
    "Zlib": ["zlib"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl"],
    "CC0-1.0": ["cc0 1 0", "cc0", "creative commons cc0 1 0 universal", "cc0 1 0 universal"],
    "CC-BY-4.0": ["creative commons attribution 4 0 international"],
    "CC-BY-SA-4.0": ["creative commons attribution sharealike 4 0 international"],
    "CC-BY-NC-4.0": ["creative commons attribution noncommercial 4 0 international"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "cddl 1 0"],
    "PostgreSQL": ["postgresql"],
    "EUPL-1.2": ["eupl 1 2", "european union public license 1 2"],
    "NCSA": ["university of illinois ncsa open source"],
}

#: Forms of a normalised sentence: where the first pattern is found and the second isn't, what the third finds is replaced.
_NOT = r"(^| )(not|never|no|nor|isn|aren|instead|unless|without|rather)( |$)"
_FORMS = [
    # A holder's name, and the older order of the words.
    (r"^neither the names? of .+ may be used to endorse", "^$", r"^neither the names? of .+ may be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (r"^the names? of .+ may not be used to endorse", "^$", r"^the names? of .+ may not be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (r"^neither the name of the copyright holder .+ specific prior written permission", "^$", r"(prior written permission) .*$", r"\1"),
    # What the program calls itself.
    (r" is free software you can redistribute it and or modify it", "^$", r"^.* is free software", "this program is free software"),
    (r" is distributed in the hope that it will be useful", "^$", r"^.* is distributed in the hope", "this program is distributed in the hope"),
    # How a licence is mentioned.
    (r"(^| )(released|licensed|distributed|available|published|provided|redistributed) under ", _NOT, r"^(.* )?(released|licensed|distributed|available|published|provided|redistributed) under ((the|an?) )?(terms (and conditions )?of )?((the|an?) )?", "licensed under the "),
    (r"^licensed under the ", _NOT, r" (see|which|a copy|as described|as found|for more|for details|for further|the full text|in the license file|in the accompanying|please) .*$", ""),
    (r"^licensed under the .* license$", _NOT, r" license$", ""),
]


def form(sentence: str) -> str:
    """A normalised sentence in the form that the table of known ones has; ``_formed`` does the same to a column."""
    import re

    for has, hasnt, pattern, to in _FORMS:
        if re.search(has, sentence) and not re.search(hasnt, sentence):
            sentence = re.sub(pattern, to, sentence)
    return sentence


def _words(name: str) -> str:
    """An identifier as normalised; what belongs to its name is told from an "or" between names."""
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split()).replace(" or later", " orlater")


#: What an SPDX tag begins with. Tags name a licence by its identifier; a rule follows from each.
SPDX = "spdx license identifier "
_TAGGED = [*dict.fromkeys([*(name for name, _ in RULES), *_CALLED, *(f"{x}-{y}" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for y in ("only", "or-later"))])]
KNOWN = {
    **{form(f"licensed under the {called}{end}"): f"says-{name}" for name, all_ in _CALLED.items() for called in all_ for end in ("", " license")},
    **{form(sentence): id_ for sentence, id_ in SENTENCES.items()}, **{f"{SPDX}{_words(name)}": f"spdx-{name}" for name in _TAGGED},
}
ALL_RULES = [*RULES, *((name, [f"says-{name}"]) for name in _CALLED), *((name, [f"spdx-{name}"]) for name in _TAGGED)]


def _telling() -> list[str]:
    """Long words of which every known sentence has one: those that most of the sentences left hold, again and again."""
    left, out = set(KNOWN), []
    while left:
        words = sorted({w for s in left for w in s.split() if len(w) > 6})
        best = max(words, key=lambda w: (sum(w in s for s in left), w))
        out.append(best)
        left = {s for s in left if best not in s}
    return out


#: Any of these, too: mentions are brought to one form, whatever they say for "licensed".
TELLING = [*_telling(), "licence", "released", "available", "published", "provided"]

#: Ends of sentences, and ends of lines that are none.
_END, _LINE = "\x01", "\x02"
# What comments put before their lines.
_MARK = r"(?:#+|//+|\*+|;+|--+)"
#: Replacements, in their order, of a text in lower case: patterns without looking around, so that any engine reads them alike.
_STEPS = [
    (r"(^|[^\p{L}\p{N}])v\.([ \t\r\n])", r"\1v\2"),  # "v. 2.0" is no end
    (r"licence", "license"),
    (r"(^|[^\p{L}\p{N}])(inc|ltd|corp|co|univ|dept)\.([ \t\r\n,])", r"\1\2\3"),
    (_MARK + r"[ \t\r\f]*\n", r"\n"),  # a comment's empty lines are empty
    (r"\n[ \t\r\f]*\n[ \t\r\f]*" + _MARK + r"?[ \t]*(<?https?://)", r" \1"),  # an address after an empty line belongs to what names it
    (r"\n[ \t\r\f]*" + _MARK + r"?[ \t]*\(?[0-9]{1,2}[.)][ \t]", _END),  # numbers of a list
    (r"[.!?]([ \t\n\r\f]|$)", _END + r"\1"),
    (r"\n[ \t\r\f]*\n", _END),
    (r"\n", _LINE),
    (r"[^\p{L}\p{N}" + _END + _LINE + "]+", " "),
]


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{x}>" for x in ids)


def normalised(text: Column) -> Column:
    """A text's words in lower case by single spaces, with the ends of sentences and of lines."""
    low = F.lower(text)
    out, any_ = low, F.lit(False)
    for pattern, to in _STEPS:
        out = F.regexp_replace(out, pattern, "\n" if to == r"\n" else to.replace("\\", "$"))
    for word in TELLING:
        any_ = any_ | F.contains(low, F.lit(word))
    # A text without any of the words that known sentences can't do without has none of them.
    return F.when(any_, out).otherwise("")


def _step(has: str, hasnt: str, pattern: str, to: str):
    return lambda x: F.when(x.rlike(has) & ~x.rlike(hasnt), F.regexp_replace(x, pattern, to.replace("\\", "$"))).otherwise(x)


def _formed(sentence: Column) -> Column:
    """The sentence in the form of the known ones. Each step names the one before once, so the expression stays short."""
    out = F.array(sentence)
    for one in _FORMS:
        out = F.transform(out, _step(*one))
    return F.element_at(out, 1)


def _ids(sentence: Column, names: Column, tags: bool) -> Column:
    """The identifiers of a sentence: of an SPDX expression, which is one line, those of all licences that it names, without exceptions to them; else at most one."""
    s = F.trim(sentence)
    if not tags:
        return F.when(F.startswith(s, F.lit(SPDX)), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.try_element_at(names, _formed(s)))))
    named = F.split(F.regexp_replace(F.replace(F.substring(s, len(SPDX) + 1, 1 << 30), F.lit(" or later"), F.lit(" orlater")), " with [^\x01]*?( and | or |$)", "$1"), " (?:and|or) ")
    each = F.array_compact(F.transform(named, lambda x: F.try_element_at(names, F.concat(F.lit(SPDX), F.trim(x)))))
    return F.when(F.startswith(s, F.lit(SPDX)), each).otherwise(F.array_compact(F.array(F.try_element_at(names, _formed(s)))))


def _found(sentences: Column, tags: bool) -> Column:
    """The known ones of the sentences as ``(start, end, n, id)``; places count characters of words, so both readings share them."""
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    empty = F.array().cast("array<struct<start: bigint, end: bigint, n: int, id: string>>")

    def step(acc: Column, sentence: Column) -> Column:
        end = acc["at"] + F.length(F.replace(sentence, F.lit(" "), F.lit("")))
        known = F.transform(_ids(sentence, names, tags), lambda id_, n: F.struct(acc["at"].alias("start"), end.alias("end"), n.alias("n"), id_.alias("id")))
        return F.struct(end.alias("at"), F.when(F.trim(sentence) != "", F.concat(acc["out"], known)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sentences, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def apply_rules(sequence: Column) -> Column:
    """Licences whose rules match a sequence ``<id><id>``, in the order of the rules, each once."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_sequence(ids)).alias("ids")) for name, ids in ALL_RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))
    folded = F.aggregate(
        rules, start,
        lambda acc, rule: F.struct(
            F.replace(acc["rest"], rule["ids"], F.lit("|")).alias("rest"),
            F.when(F.contains(acc["rest"], rule["ids"]), F.concat(acc["found"], F.array(rule["name"]))).otherwise(acc["found"]).alias("found"),
        ),
    )
    return F.array_distinct(folded["found"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentences, licenses, n_sentences``: one row per row of ``docs``, without a shuffle.

    ``sentences`` are the known ones of both readings in the order of their places, a line within a longer known
    sentence left out; ``licenses`` the names found in them, comma-joined in rule order. Null and empty texts have
    empty strings and 0. Repeated rows stay; other columns aren't read; an empty table gives no rows.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), normalised(F.coalesce(F.col(text_col), F.lit(""))).alias("plain"))
    over = F.regexp_replace("plain", f"[ {_LINE}]+", " ")
    read = read.select("doc_id", _found(F.split("plain", f"[{_END}{_LINE}]"), True).alias("by_line"), _found(F.split(over, _END), False).alias("over"))
    apart = F.filter("by_line", lambda x: ~F.exists("over", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
    chosen = read.select("doc_id", F.transform(F.array_sort(F.concat("over", apart)), lambda x: x["id"]).alias("ids"))
    joined = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    found = F.when(F.size("ids") > 0, apply_rules(joined)).otherwise(F.array().cast("array<string>"))
    return chosen.select("doc_id", F.array_join("ids", ",").alias("sentences"), F.array_join(found, ",").alias("licenses"), F.size("ids").cast("long").alias("n_sentences"))


def oracle() -> str:
    """DuckDB SQL for ``scan_licenses`` over ``documents``: relations and windows instead of folds."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in KNOWN.items())
    plain = "lower(coalesce(text, ''))"
    for pattern, to in _STEPS:
        target = "chr(10)" if to == r"\n" else "'" + to.replace(_END, "' || chr(1) || '").replace(_LINE, "' || chr(2) || '") + "'"
        source = "'" + pattern.replace("'", "''").replace(_END, "\\x01").replace(_LINE, "\\x02") + "'"
        plain = f"regexp_replace({plain}, {source}, {target}, 'g')"
    parts = "SELECT rid, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT rid, {split} AS p FROM a)"
    formed = "s"
    for has, hasnt, pattern, to in _FORMS:
        formed = f"(CASE WHEN regexp_matches({formed}, '{has}') AND NOT regexp_matches({formed}, '{hasnt}') THEN regexp_replace({formed}, '{pattern}', '{to}') ELSE {formed} END)" if formed == "s" else f"(SELECT CASE WHEN regexp_matches(f, '{has}') AND NOT regexp_matches(f, '{hasnt}') THEN regexp_replace(f, '{pattern}', '{to}') ELSE f END FROM (SELECT {formed} AS f))"
    placed = "SELECT rid, trim(s) AS s, length(replace(s, ' ', '')) AS n, sum(length(replace(s, ' ', ''))) OVER (PARTITION BY rid ORDER BY i) AS place FROM ({parts})"
    tags = f"list_transform(regexp_split_to_array(regexp_replace(replace(substr(s, {len(SPDX) + 1}), ' or later', ' orlater'), ' with .*?( and | or |$)', '\\1', 'g'), ' (?:and|or) '), lambda t: '{SPDX}' || trim(t))"
    each = f"SELECT rid, place, n, unnest(CASE WHEN starts_with(s, '{SPDX}') THEN {tags} ELSE [{formed}] END) AS s, generate_subscripts(CASE WHEN starts_with(s, '{SPDX}') THEN {tags} ELSE [s] END, 1) AS m FROM ({placed}) WHERE s <> ''"
    reading = "SELECT x.rid, x.place - x.n AS start, x.place AS stop, x.m, k.id FROM (" + each + ") x JOIN k USING (s)"
    lines = reading.format(parts=parts.format(split="string_split_regex(plain, '[\\x01\\x02]')"))
    over = reading.format(parts=parts.format(split="string_split(regexp_replace(plain, '[ \\x02]+', ' ', 'g'), chr(1))")) + f" WHERE NOT starts_with(k.s, '{SPDX}')"
    steps, last = [], "c"
    for n, (name, rule) in enumerate(ALL_RULES):
        q = _sequence(rule)
        steps.append(f"r{n} AS (SELECT doc_id, ids, replace(rest, '{q}', '|') AS rest, CASE WHEN contains(rest, '{q}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{n}"
    return (
        f"WITH k(s, id) AS (VALUES {known}), a AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {plain} AS plain FROM documents), "
        f"l AS MATERIALIZED ({lines}), o AS MATERIALIZED ({over}), "
        "u AS (SELECT * FROM o UNION ALL SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.rid = l.rid AND o.start <= l.start AND l.stop <= o.stop)), "
        "b AS (SELECT rid, list(id ORDER BY start, stop, m, id) AS ids FROM u GROUP BY rid), "
        "c AS MATERIALIZED (SELECT doc_id, coalesce(ids, CAST([] AS VARCHAR[])) AS ids, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest, CAST([] AS VARCHAR[]) AS found FROM a LEFT JOIN b USING (rid)), "
        + ", ".join(steps)
        + f" SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentences, coalesce(array_to_string(found, ','), '') AS licenses, CAST(len(ids) AS BIGINT) AS n_sentences FROM {last}"
    )
