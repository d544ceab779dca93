"""Licence scans by sentence rules, with DataFrame functions only.

A text is normalised (lower case, letters and digits, single spaces) with its sentence ends kept as marks. Sentences known
from licences map to identifiers; the sequence of identifiers in a text is matched against ordered licence rules, longer
licences first, and each match uses up its sentences.

A known sentence begins and ends at a mark, but marks within it don't count: so it is read whole wherever it is wrapped,
in a comment of any kind, in capitals, and with the full stops of ``v. 2.0``. What a licence leaves open (who grants it,
the name of a program, quotes around a term) is written in one way first (``FORMS``), and references such as *released
under the X License* and SPDX tags become one sentence for each licence. Titles (*The MIT License*) are known and part of no
rule. Sentences that aren't known don't break a sequence; more than ``GAP`` of them in a row do. A sentence that names a licence but isn't known counts as unknown.

Defined cases: null and empty texts have no licence; *not licensed under X* is no reference; repeated rows are scanned
each; very long texts are scanned whole; an empty table gives an empty result; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import table

#: Sentences that may lie between two of one licence.
GAP = 3

# Sentences of published licences, normalised, and their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "Mit0Grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "except as contained in this notice the name of the copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization from the copyright holder": "X11Name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "NcsaGrant",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "AsfGrant",
    "the asf licenses this file to you under the apache license version 2 0": "AsfRef",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BsdAdvertising",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdDisclaimer",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BsdGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscDisclaimer",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "PostgresGrant",
    "this software is provided as is without any express or implied warranty": "ZlibWarranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "the origin of this software must not be misrepresented": "ZlibOrigin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "ZlibAltered",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseUse",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "Cc0Waiver",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WtfplCopy",
    "you just do what the fuck you want to": "WtfplRule",
    "as long as you retain this notice you can do whatever you want with this stuff": "BeerwareGrant",
    "this program is free software": "GnuFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2Terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "Gpl3Terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation": "LibraryTerms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AgplTerms",
    "either version 2 of the license or at your option any later version": "Version2Later",
    "either version 2 1 of the license or at your option any later version": "Version21Later",
    "either version 3 of the license or at your option any later version": "Version3Later",
    "version 2 of the license": "Version2Only",
    "version 3 of the license": "Version3Only",
    "version 2": "Version2Only",
    "version 3": "Version3Only",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "Mpl2Copy",
    "the contents of this file are subject to the mozilla public license version 1 1": "Mpl11Terms",
    "the contents of this file are subject to the terms of the common development and distribution license": "CddlTerms",
    "psf is making python available to licensee on an as is basis": "PsfBasis",
    "the copyright holders of the package may permit the redistribution of the package under terms of the artistic license 2 0": "ArtisticTerms",
}

# SPDX identifiers, and the names that references use, normalised.
NAMES = {
    "MIT": ["mit", "expat"], "MIT-0": ["mit no attribution", "mit 0"], "X11": ["x11"], "NCSA": ["university of illinois ncsa open source", "ncsa"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache license v2 0", "apache 2"], "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"], "BSD-4-Clause": ["bsd 4 clause", "original bsd"], "ISC": ["isc"], "0BSD": ["0bsd", "bsd zero clause", "zero clause bsd"],
    "Zlib": ["zlib"], "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software"], "Unlicense": ["unlicense"], "WTFPL": ["wtfpl", "do what the fuck you want to public"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal"], "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international"], "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0 unported"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international", "creative commons attribution share alike 4 0 international"], "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported", "creative commons attribution share alike 3 0 unported"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"], "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"], "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"],
    "GPL-2.0": ["gnu general public license version 2", "gpl version 2", "gplv2", "gpl v2", "gpl 2 0", "gnu gpl version 2", "gnu gpl v2"], "GPL-3.0": ["gnu general public license version 3", "gpl version 3", "gplv3", "gpl v3", "gpl 3 0", "gnu gpl version 3", "gnu gpl v3", "gnu general public license v3 0"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl version 2 1", "lgplv2 1", "lgpl v2 1", "lgpl 2 1"], "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl version 3", "lgplv3", "lgpl v3", "lgpl 3 0"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl version 3", "agplv3", "agpl v3", "agpl 3 0"], "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"], "MPL-1.1": ["mozilla public license version 1 1", "mpl 1 1"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "epl 1 0"], "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0"], "CDDL-1.0": ["common development and distribution license version 1 0", "cddl 1 0", "cddl"],
    "OFL-1.1": ["sil open font license version 1 1", "ofl 1 1"], "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"], "EUPL-1.2": ["european union public licence version 1 2", "eupl 1 2"], "Python-2.0": ["python software foundation license version 2", "psf", "python 2 0"], "PostgreSQL": ["postgresql"], "MS-PL": ["microsoft public", "ms pl"],
}

#: Licences and the sentences that they take, in order; earlier rules use their sentences up first.
RULES = [
    ("X11", ["MitGrant", "MitNotice", "MitWarranty", "X11Name"]),
    ("MIT", ["MitGrant", "MitNotice", "MitWarranty"]),
    ("MIT-0", ["Mit0Grant", "MitWarranty"]),
    ("NCSA", ["NcsaGrant"]),
    ("Apache-2.0", ["AsfGrant", "AsfRef", "ApacheUse", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("Apache-2.0", ["Ref-Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheBasis", "ApacheSee"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAdvertising", "BsdEndorse", "BsdDisclaimer"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdDisclaimer"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdDisclaimer"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-1-Clause", ["BsdGrant", "BsdSource", "BsdDisclaimer"]),
    ("ISC", ["IscGrant", "IscDisclaimer"]),
    ("ISC", ["IscGrant"]),
    ("0BSD", ["0BsdGrant", "IscDisclaimer"]),
    ("0BSD", ["0BsdGrant"]),
    ("PostgreSQL", ["PostgresGrant"]),
    ("Zlib", ["ZlibWarranty", "ZlibGrant", "ZlibOrigin", "ZlibAltered", "ZlibNotice"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("Unlicense", ["UnlicenseGrant", "UnlicenseUse"]),
    ("Unlicense", ["UnlicenseGrant"]),
    ("CC0-1.0", ["Cc0Waiver"]),
    ("WTFPL", ["WtfplCopy", "WtfplRule"]),
    ("Beerware", ["BeerwareGrant"]),
    ("GPL-2.0-or-later", ["GnuFree", "GplTerms", "Version2Later"]),
    ("GPL-3.0-or-later", ["GnuFree", "GplTerms", "Version3Later"]),
    ("GPL-2.0-only", ["GnuFree", "GplTerms", "Version2Only"]),
    ("GPL-3.0-only", ["GnuFree", "GplTerms", "Version3Only"]),
    ("GPL-2.0-only", ["GnuFree", "Gpl2Terms"]),
    ("GPL-3.0-only", ["GnuFree", "Gpl3Terms"]),
    ("LGPL-2.1-or-later", ["GnuFree", "LgplTerms", "Version21Later"]),
    ("LGPL-3.0-or-later", ["GnuFree", "LgplTerms", "Version3Later"]),
    ("LGPL-3.0-only", ["GnuFree", "LgplTerms", "Version3Only"]),
    ("LGPL-2.0-or-later", ["GnuFree", "LibraryTerms", "Version2Later"]),
    ("AGPL-3.0-or-later", ["GnuFree", "AgplTerms", "Version3Later"]),
    ("AGPL-3.0-only", ["GnuFree", "AgplTerms", "Version3Only"]),
    ("MPL-2.0", ["Mpl2Terms", "Mpl2Copy"]),
    ("MPL-2.0", ["Mpl2Terms"]),
    ("MPL-1.1", ["Mpl11Terms"]),
    ("CDDL-1.0", ["CddlTerms"]),
    ("Python-2.0", ["PsfBasis"]),
    ("Artistic-2.0", ["ArtisticTerms"]),
    *[(f"{x}-reference", [f"Ref-{x}"]) for x in NAMES],
    *[(f"{x}-or-later-reference", [f"Later-{x}"]) for x in NAMES if "GPL" in x],
    *[(f"{x}-only-reference", [f"Only-{x}"]) for x in NAMES if "GPL" in x],
]

#: Every known sentence has one of these; a text without them has none.
TRIGGERS = ["licens", "licenc", "permission", "permitted", "redistribut", "warrant", "unencumbered", "copyright", "do whatever", "spdx"]
#: Or a name right after one of these words.
REFERS = r"(?i)\b(?:under|by)\W+(?:(?:the|an?)\W+)?(?:(?:terms|conditions)\W+(?:and\W+conditions\W+)?of\W+(?:(?:the|an?)\W+)?)?(?:" + "|".join(sorted({n.split()[0] for names in NAMES.values() for n in names})) + ")"
#: What marks a sentence that isn't known as one about licences all the same.
UNKNOWN = "(^| )(licen[cs]e[ds]?|sublicen[cs]e) "

#: The end of a sentence in a normalised text. Between K and L stands a known sentence (the text is lower-case).
CUT = "␞"
_BETWEEN = f"[ {CUT}]"


def _spread(words: str) -> str:
    """A pattern for words with spaces or cuts between them."""
    return words.replace(" ", _BETWEEN)


#: A clause that begins like a known one and doesn't end like it: no rule goes over it to a shorter licence.
UNREAD = "neither the name of"


def _known() -> dict[str, str]:
    """Sentences and identifiers, with those of references and SPDX tags, which are made by rule."""
    known = SENTENCES | {UNREAD: "Unread"}
    for spdx, names in NAMES.items():
        norm = " ".join("".join(c if c.isalnum() else " " for c in spdx.lower()).split())
        for name in names:
            known[f"licensed under the {name}"] = f"Ref-{spdx}"
            for title in (f"{name} license", f"the {name} license", f"the {name} license {name}"):
                known[title] = f"Title-{spdx}"
        for suffix, kind in (("", "Ref"), (" only", "Only"), (" or later", "Later")):
            if not suffix or "GPL" in spdx:
                known[f"spdx license identifier {norm}{suffix}"] = f"{kind}-{spdx}"
                if suffix:
                    known[f"licensed under the {names[0]}{suffix}"] = f"{kind}-{spdx}"
    return known


KNOWN = _known()
_names = "|".join(_spread(x) for x in sorted({n for names in NAMES.values() for n in names}, key=len, reverse=True))
_TAG = "spdx license identifier "
_spdx = "|".join(_spread(k.removeprefix(_TAG)) for k in sorted((k for k in KNOWN if k.startswith(_TAG)), key=len, reverse=True))
#: Goes on where the last match ended, and not at the beginning of a text.
_NEXT = r"(?<=[a-z0-9])\G"
#: Stands for the beginning of a clause that names someone, while its end is looked for.
OPEN = "␟"


def _naming(start: str, end: str, by: str, unread: str) -> list[tuple[str, str]]:
    """Forms of a clause in which someone is named, in any number of words, up to the next clause of its kind."""
    return [(rf"{start}(?=[ {CUT}])", OPEN), (rf"{OPEN}[^{OPEN}]+?{_BETWEEN}{end}", by), (OPEN, unread)]


_verbs = _spread("(?:licensed|released|distributed|published|available|provided|offered|made available|dual licensed|covered|governed)")

#: Normalised texts with open places, and the one way in which they are written then.
FORMS = [
    # A reference is a sentence of its own, whatever stands around it.
    (rf"(?:(?<!not )\b{_verbs}{_BETWEEN}(?:under|by){_BETWEEN}(?:either{_BETWEEN})?(?:of{_BETWEEN})?(?:an?{_BETWEEN}|the{_BETWEEN})?|{_NEXT}(?:{_BETWEEN}at{_BETWEEN}your{_BETWEEN}option)?{_BETWEEN}(?:and|or|and{_BETWEEN}or){_BETWEEN}(?:under{_BETWEEN})?(?:an?{_BETWEEN}|the{_BETWEEN})?)(?:(?:terms|conditions|terms{_BETWEEN}and{_BETWEEN}conditions){_BETWEEN}of{_BETWEEN})?(?:an?{_BETWEEN}|the{_BETWEEN})?({_names})(?:{_BETWEEN}licen[cs]es?)?({_spread('(?: or later| only)')})?(?= |{CUT}|$)", f"{CUT}licensed under the $1$2{CUT}"),
    # Each operand of an expression is a tag.
    (rf"(?:\b{_spread(_TAG)}|{_NEXT}(?: with [a-z]+ exception(?: [0-9]+)*)? (?:and|or) )({_spdx})(?= |{CUT}|$)", f"{CUT}{_TAG}$1{CUT}"),
    (rf"(?:^|{CUT})[a-z0-9 ]+? is free software{_BETWEEN}you can", f"{CUT}this program is free software{CUT}you can"),
    (rf"free{_BETWEEN}software{_BETWEEN}foundation{_BETWEEN}(either{_BETWEEN}version|version{_BETWEEN}[23])", f"free software foundation{CUT}$1"),
    (rf"(either{_BETWEEN}version{_BETWEEN}[23](?:{_BETWEEN}1)?{_BETWEEN}of{_BETWEEN}the){_BETWEEN}(?:gnu{_BETWEEN})?(?:lesser{_BETWEEN}|affero{_BETWEEN})?(?:general{_BETWEEN}public{_BETWEEN})?license", "$1 license"),
    *_naming(_spread("this software is provided by"), _spread("as is and"), "this software is provided by the copyright holders and contributors as is and", "this software is provided by"),
    *_naming(_spread("neither the name") + f"s?{_BETWEEN}of", rf"nor{_BETWEEN}the{_BETWEEN}names{_BETWEEN}of{_BETWEEN}(?:its|their|other){_BETWEEN}contributors", "neither the name of the copyright holder nor the names of its contributors", f"{CUT}{UNREAD}{CUT}"),
    *_naming(_spread("to the extent possible under law"), rf"(?:has|have){_BETWEEN}waived", "to the extent possible under law the author has waived", "to the extent possible under law"),
    (rf"{_spread('permission to use copy modify')}{_BETWEEN}and{_BETWEEN}distribute{_BETWEEN}this{_BETWEEN}software{_BETWEEN}for", "permission to use copy modify and or distribute this software for"),
    # List numbers before a clause.
    (rf"{CUT}(?:[0-9]|[a-d]|[ivx]{{1,3}}){CUT}", CUT),
    (rf"{CUT}(?:[0-9]|[a-d]|[ivx]{{1,3}}) (?=redistributions|neither|all advertising|the origin|altered|this notice)", CUT),
]
_pattern = rf"(^|{CUT})({'|'.join(_spread(s) for s in sorted(KNOWN, key=len, reverse=True))})(?=$|{CUT})"


def _marked(text: Column) -> Column:
    """The normalised text, with its cuts, and known sentences between K and L."""
    plain = F.regexp_replace(F.translate(text, CUT, " "), r"(?i)\(the\s+\W{0,12}licen[cs]e\W{0,3}\)", " ")
    cut = F.regexp_replace(plain, r"([.!?;:])\s+|\r?\n[\s*#/;%-]*\n|\r?\n(?=[\s*#/;%-]*\p{Lu})|(?<=\s)https?://\S+|\((?:\w|\d{1,2})\)", f"$1 {CUT} ")
    norm = F.regexp_replace(F.regexp_replace(F.lower(cut), f"[^a-z0-9{CUT}]+", " "), f"(?: ?{CUT} ?)+", CUT)
    for pattern, by in FORMS:
        norm = F.regexp_replace(norm, pattern, by)
    norm = F.regexp_replace(F.regexp_replace(norm, f"(?: ?{CUT} ?)+", CUT), "^ | $", "")
    return F.regexp_replace(norm, _pattern, "$1K$2L")


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds licence_sentences (identifiers in order), licences (name:count, in the rules' order), n_licences, n_unknown."""
    trigger = F.lit(False)
    for word in TRIGGERS:
        trigger = trigger | F.lower(F.col(text)).contains(word)
    trigger = trigger | F.col(text).rlike(REFERS)
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    # Every second part is a known sentence; the others hold unknown ones.
    parts = F.split(F.when(F.coalesce(trigger, F.lit(False)), _marked(F.col(text))), "[KL]")
    docs = docs.withColumns({"_parts": parts})
    unknown = lambda s: F.concat(s, F.lit(" ")).rlike(UNKNOWN)
    other = lambda p: F.transform(F.filter(F.split(p, CUT), lambda s: s != ""), lambda s: F.when(unknown(s), F.lit("Unknown")).otherwise(F.lit("")))
    ids = F.flatten(F.transform("_parts", lambda p, i: F.when(i % 2 == 1, F.array(F.element_at(known, F.translate(p, CUT, " ")))).otherwise(other(p))))
    docs = docs.withColumn("_ids", ids)
    used = lambda x: (x["id"] != "") & (x["id"] != "Unknown") & ~x["id"].startswith("Title-")
    placed = F.filter(F.transform("_ids", lambda x, i: F.struct(i.alias("at"), x.alias("id"))), used)
    docs = docs.withColumn("_found", placed)
    # One string in which each identifier stands between spaces; too far apart, a bar stands between them.
    joined = F.aggregate(
        "_found",
        F.struct(F.lit(-1).alias("at"), F.lit("").alias("ids")),
        lambda acc, x: F.struct(x["at"].alias("at"), F.concat(acc["ids"], F.when((acc["at"] >= 0) & (x["at"] - acc["at"] > GAP + 1), F.lit(" |")).otherwise(F.lit("")), F.lit(" "), x["id"], F.lit(" ")).alias("ids")),
    )["ids"]
    # An unread clause clings to the sentence before it, so that no rule ends there.
    docs = docs.withColumn("_left", F.replace(joined, F.lit("  Unread "), F.lit("+Unread ")))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(sequence) + " ").alias("pattern")) for name, sequence in RULES])

    def apply(acc: Column, rule: Column) -> Column:
        gone = F.replace(acc["left"], rule["pattern"], F.lit(" . "))
        # A rule's matches shorten the string by a known number of characters each.
        n = ((F.length(acc["left"]) - F.length(gone)) / (F.length(rule["pattern"]) - 3)).cast("long")
        hits = F.array_append(acc["hits"], F.struct(rule["name"].alias("name"), n.alias("n")))
        met = acc["left"].contains(rule["pattern"])
        return F.struct(F.when(met, gone).otherwise(acc["left"]).alias("left"), F.when(met, hits).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(F.col("_left").alias("left"), F.array().cast("array<struct<name:string,n:bigint>>").alias("hits"))
    docs = docs.withColumn("_hits", F.when(F.col("_left") != "", F.aggregate(rules, start, apply)["hits"]))
    count = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda total, h: total + h["n"])
    of = lambda name: count(F.filter("_hits", lambda h: h["name"] == name))
    listed = F.array_join(F.transform(F.array_distinct(F.transform("_hits", lambda h: h["name"])), lambda name: F.concat(name, F.lit(":"), of(name).cast("string"))), ",")
    docs = docs.withColumns({"licences": F.coalesce(listed, F.lit("")), "n_licences": F.coalesce(count(F.col("_hits")), F.lit(0).cast("long"))})
    ordered = F.coalesce(F.array_join(F.filter("_ids", lambda x: x != ""), " "), F.lit(""))
    n_unknown = F.coalesce(F.size(F.filter("_ids", lambda x: x == "Unknown")), F.lit(0)).cast("long")
    return docs.withColumns({"licence_sentences": ordered, "n_unknown": n_unknown}).drop("_parts", "_ids", "_found", "_left", "_hits")


def op9_licence_rules(spark, sf_dir: str) -> DataFrame:
    docs = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "licences", "n_licences", "n_unknown", F.col("licence_sentences").alias("sentences"))


#: What the licence lines of the test documents mean, by hand: the SQL counts these lines and knows nothing of sentences and rules.
LINES = {
    "Licensed under the Apache License, Version 2.0.": ("Apache-2.0-reference", "Ref-Apache-2.0"),
    "Released under the MIT License.": ("MIT-reference", "Ref-MIT"),
    "Licensed under CC BY-NC 4.0.": ("CC-BY-NC-4.0-reference", "Ref-CC-BY-NC-4.0"),
    "This work is licensed under the GNU General Public License, version 3.": ("GPL-3.0-reference", "Ref-GPL-3.0"),
}


def _oracle() -> str:
    lines = "|".join(k.replace(".", "\\.") for k in LINES)
    order = {name: k for k, (name, _) in enumerate(RULES)}
    table_ = ", ".join(f"('{line}', '{name}', '{ident}', {order[name]})" for line, (name, ident) in LINES.items())
    return f"""WITH k(line, name, ident, place) AS (VALUES {table_}),
l AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{lines}'), []) AS found FROM documents),
u AS (SELECT r, unnest(found) AS line, unnest(range(len(found))) AS pos FROM l),
s AS (SELECT r, string_agg(ident, ' ' ORDER BY pos) AS sentences, count(*) AS n FROM u JOIN k USING (line) GROUP BY r),
c AS (SELECT r, string_agg(name || ':' || n, ',' ORDER BY place) AS licences FROM (SELECT r, name, place, count(*) AS n FROM u JOIN k USING (line) GROUP BY ALL) GROUP BY r)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n, 0)::BIGINT AS n_licences, 0::BIGINT AS n_unknown, coalesce(sentences, '') AS sentences FROM l LEFT JOIN s USING (r) LEFT JOIN c USING (r)"""


OP9_SQL = _oracle()
