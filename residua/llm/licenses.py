"""License scans by ordered signature rules, in SQL functions only.

Each rule is a hand-written regular expression with a label, a priority and keywords. A text
without any keyword of any rule is done after one look; else only the rules whose keyword
occurs are tried. Of two detections of which one's span contains the other's, the one of the
better priority stays (of equal ones the longer, then the earlier rule).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: label | priority (1 is best) | keywords, of which each match has one, by "; " | regular expression over the lower-cased text, white space folded to one blank.
RULES = r"""
gpl-3.0 | 1 | general public license | gnu general public license,? \(?(?:gpl\)?,? )?(?:version|v\.?) ?3(?:\.0)?
gpl-2.0 | 1 | general public license | gnu general public license,? \(?(?:gpl\)?,? )?(?:version|v\.?) ?2(?:\.0)?
gpl-1.0 | 1 | general public license | gnu general public license,? \(?(?:gpl\)?,? )?(?:version|v\.?) ?1(?:\.0)?
gpl-3.0-or-later | 1 | general public license | gnu general public license[^.]{0,80}either version 3 of the license,? or \(?at your option\)? any later version
gpl-2.0-or-later | 1 | general public license | gnu general public license[^.]{0,80}either version 2 of the license,? or \(?at your option\)? any later version
gpl | 3 | general public license | gnu general public license
gpl | 4 | general public license | (?<!lesser )(?<!affero )(?<!library )general public license
gpl-3.0 | 2 | gpl | \bgpl ?-?(?:version |v)?3(?:\.0)?(?:-only)?\b
gpl-2.0 | 2 | gpl | \bgpl ?-?(?:version |v)?2(?:\.0)?(?:-only)?\b
gpl-3.0-or-later | 1 | gpl | \bgpl ?-?(?:version |v)?3(?:\.0)?(?:\+| or later|-or-later)
gpl-2.0-or-later | 1 | gpl | \bgpl ?-?(?:version |v)?2(?:\.0)?(?:\+| or later|-or-later)
gpl | 5 | gpl | \b(?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl\b
gpl | 5 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl
gpl-3.0 | 3 | gnu.org | gnu\.org/licenses/gpl-3\.0
gpl-2.0 | 3 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-exception-classpath | 2 | classpath exception | (?:gnu )?classpath exception
gpl-exception-gcc | 2 | runtime library exception | gcc runtime library exception
gpl-exception-linking | 4 | linking exception | (?:special )?linking exception
lgpl-2.1 | 1 | lesser general public | gnu lesser general public license,? (?:version|v\.?) ?2\.1
lgpl-3.0 | 1 | lesser general public | gnu lesser general public license,? (?:version|v\.?) ?3(?:\.0)?
lgpl | 2 | lesser general public | (?:gnu )?lesser general public license
lgpl-2.0 | 1 | library general public | gnu library general public license,? (?:version|v\.?) ?2(?:\.0)?
lgpl | 2 | library general public | (?:gnu )?library general public license
lgpl-2.1 | 2 | lgpl | \blgpl ?-?(?:version |v)?2\.1(?:\+| or later|-or-later|-only)?
lgpl-3.0 | 2 | lgpl | \blgpl ?-?(?:version |v)?3(?:\.0)?(?:\+| or later|-or-later|-only)?
lgpl | 4 | lgpl | \blgpl\b
lgpl | 5 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl
agpl-3.0 | 1 | affero general public | gnu affero general public license,? (?:version|v\.?) ?3(?:\.0)?
agpl-1.0 | 1 | affero general public | affero general public license,? (?:version|v\.?) ?1(?:\.0)?
agpl | 2 | affero general public | (?:gnu )?affero general public license
agpl-3.0 | 2 | agpl | \bagpl ?-?(?:version |v)?3(?:\.0)?(?:\+| or later|-or-later|-only)?
agpl | 4 | agpl | \bagpl\b
agpl | 5 | gnu.org | gnu\.org/licenses/agpl
gfdl-1.3 | 1 | free documentation license | gnu free documentation license,? (?:version|v\.?) ?1\.3
gfdl-1.2 | 1 | free documentation license | gnu free documentation license,? (?:version|v\.?) ?1\.2
gfdl-1.1 | 1 | free documentation license | gnu free documentation license,? (?:version|v\.?) ?1\.1
gfdl | 2 | free documentation license | (?:gnu )?free documentation license
gfdl | 4 | gfdl | \bgfdl\b
gfdl | 5 | gnu.org | gnu\.org/(?:licenses|copyleft)/fdl
apache-2.0 | 1 | apache | apache (?:software )?license,? \(?(?:version|v\.?) ?2(?:\.0)?
apache-1.1 | 1 | apache | apache (?:software )?license,? \(?(?:version|v\.?) ?1\.1
apache-1.0 | 1 | apache | apache (?:software )?license,? \(?(?:version|v\.?) ?1\.0
apache | 3 | apache | apache (?:software )?license
apache-2.0 | 2 | apache | \bapache[ -]?(?:v)?2(?:\.0)?\b(?! http)
apache-2.0 | 3 | apache.org | apache\.org/licenses/license-2\.0
apache | 5 | apache.org | apache\.org/licenses
apache-2.0-llvm-exception | 1 | llvm exception; llvm-exception | (?:apache[ -](?:license )?(?:v)?2\.0 )?with llvm[ -]exceptions?
mit | 2 | mit licen | \b(?:the )?mit licen[sc]e\b
mit | 3 | under mit | \b(?:licensed|released|distributed|available) under mit\b
mit | 3 | under the mit | \b(?:licensed|released|distributed|available) under the mit\b
mit | 4 | mit-license | \bmit-licensed?\b
mit | 5 | opensource.org | opensource\.org/licenses?/mit
mit | 2 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit-0 | 1 | mit no attribution | mit no attribution(?: license)?
mit-0 | 1 | mit-0 | \bmit-0\b
mit-advertising | 1 | enlightenment; license with advertising | mit license with advertising|enlightenment license
x11 | 2 | x11 licen | \bx11 licen[sc]e\b
expat | 2 | expat licen | \bexpat licen[sc]e\b
isc | 2 | isc licen | \bisc licen[sc]e\b
isc | 3 | permission to use, copy | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
0bsd | 1 | 0bsd; clause bsd | \b0bsd\b|\bzero[ -]clause bsd\b
bsd-4-clause | 1 | bsd | \b(?:4|four)[ -]clause bsd\b|\bbsd[ -](?:4|four)[ -]clause\b|\boriginal bsd licen[sc]e\b
bsd-3-clause | 1 | bsd | \b(?:3|three)[ -]clause bsd\b|\bbsd[ -](?:3|three)[ -]clause\b|\b(?:new|modified|revised) bsd licen[sc]e\b
bsd-2-clause | 1 | bsd | \b(?:2|two)[ -]clause bsd\b|\bbsd[ -](?:2|two)[ -]clause\b|\bsimplified bsd licen[sc]e\b|\bfreebsd licen[sc]e\b
bsd-2-clause-patent | 1 | bsd | \bbsd[ -]2[ -]clause[ -](?:plus )?patent\b
bsd-3-clause-clear | 1 | clear bsd; bsd-3-clause-clear | \bclear bsd licen[sc]e\b|\bbsd-3-clause-clear\b
bsd | 3 | bsd | \bbsd(?:-style)? licen[sc]e\b
bsd | 4 | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause | 3 | neither the name | neither the name of [^.]{1,80} nor the names of its contributors may be used to endorse
bsd | 5 | opensource.org | opensource\.org/licenses?/bsd
mpl-2.0 | 1 | mozilla public | mozilla public license,? (?:version|v\.?) ?2(?:\.0)?
mpl-1.1 | 1 | mozilla public | mozilla public license,? (?:version|v\.?) ?1\.1
mpl-1.0 | 1 | mozilla public | mozilla public license,? (?:version|v\.?) ?1\.0
mpl | 2 | mozilla public | mozilla public license
mpl-2.0 | 2 | mpl | \bmpl ?-?(?:v)?2(?:\.0)?\b
mpl-1.1 | 2 | mpl | \bmpl ?-?(?:v)?1\.1\b
mpl-2.0 | 4 | mozilla.org | mozilla\.org/(?:en-us/)?mpl/2\.0
npl | 2 | netscape public | netscape public license
epl-2.0 | 1 | eclipse public | eclipse public license,? (?:- )?(?:version|v\.?) ?2(?:\.0)?
epl-1.0 | 1 | eclipse public | eclipse public license,? (?:- )?(?:version|v\.?) ?1(?:\.0)?
epl | 2 | eclipse public | eclipse public license
epl-2.0 | 2 | epl | \bepl ?-?(?:v)?2(?:\.0)?\b
epl-1.0 | 2 | epl | \bepl ?-?(?:v)?1(?:\.0)?\b
edl-1.0 | 2 | eclipse distribution | eclipse distribution license
cddl-1.0 | 1 | common development and distribution | common development and distribution license,? \(?(?:cddl\)?,? )?(?:version|v\.?)? ?1\.0
cddl-1.1 | 1 | common development and distribution | common development and distribution license,? \(?(?:cddl\)?,? )?(?:version|v\.?)? ?1\.1
cddl | 2 | common development and distribution | common development and distribution license
cddl | 4 | cddl | \bcddl\b
cpl-1.0 | 2 | common public license | common public license
ipl-1.0 | 2 | ibm public license | ibm public license
eupl-1.2 | 1 | european union public | european union public licen[sc]e,? (?:version|v\.?) ?1\.2
eupl-1.1 | 1 | european union public | european union public licen[sc]e,? (?:version|v\.?) ?1\.1
eupl | 2 | european union public | european union public licen[sc]e
eupl | 4 | eupl | \beupl\b
cecill | 2 | cecill | \bcecill(?:-[abc])?(?: (?:v|version )?\d(?:\.\d)?)?\b
osl-3.0 | 1 | open software license | open software license,? (?:version|v\.?)? ?3\.0
osl | 2 | open software license | open software license
afl-3.0 | 1 | academic free license | academic free license,? (?:version|v\.?)? ?3\.0
afl | 2 | academic free license | academic free license
artistic-2.0 | 1 | artistic license | (?:perl )?artistic license,? (?:version|v\.?)? ?2(?:\.0)?
artistic-1.0 | 1 | artistic license | (?:perl )?artistic license,? (?:version|v\.?)? ?1(?:\.0)?
artistic | 2 | artistic license | (?:perl )?artistic license
perl | 3 | same terms as perl | (?:under )?the same terms as perl(?: itself)?
python-2.0 | 2 | python software foundation | python software foundation license(?:,? version \d(?:\.\d)?)?
php-3.01 | 1 | php license | php license,? (?:version|v\.?)? ?3\.01
php | 2 | php license | \bphp license\b
ruby | 2 | ruby license | \bruby license\b
zlib | 2 | zlib | \bzlib(?:/libpng)? licen[sc]e\b
libpng | 2 | libpng | \blibpng licen[sc]e\b
zlib | 3 | provided 'as-is' | this software is provided 'as-is', without any express or implied warranty
boost-1.0 | 1 | boost software | boost software license,? (?:- )?(?:version|v\.?)? ?1\.0
boost | 2 | boost software | boost software license
boost-1.0 | 3 | boost.org | boost\.org/license_1_0
unlicense | 2 | unlicense | \b(?:the )?unlicense\b
unlicense | 3 | unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | 2 | wtfpl | \bwtfpl\b
wtfpl | 2 | you want to public | do what the f[u*][c*]k you want to public license
beerware | 2 | beer-ware; beerware | \bbeer-?ware license\b
postgresql | 2 | postgresql licen | \bpostgresql licen[sc]e\b
openssl | 2 | openssl licen | \bopenssl licen[sc]e\b
openssl | 3 | openssl project | software developed by the openssl project
ssleay | 2 | ssleay | \bssleay licen[sc]e\b
icu | 2 | icu license | \bicu license\b
unicode | 2 | unicode | \bunicode(?:, inc\.)? licen[sc]e(?: agreement)?\b
w3c | 2 | w3c | \bw3c software (?:notice and )?licen[sc]e\b
ncsa | 2 | ncsa | \b(?:university of illinois/)?ncsa(?: open source)? licen[sc]e\b
json | 2 | shall be used for good | the software shall be used for good, not evil
json | 3 | json license | \bjson license\b
vim | 2 | vim license | \bvim license\b
curl | 2 | curl license | \bcurl license\b
ofl-1.1 | 1 | open font license | (?:sil )?open font license,? (?:version|v\.?)? ?1\.1
ofl-1.0 | 1 | open font license | (?:sil )?open font license,? (?:version|v\.?)? ?1\.0
ofl | 2 | open font license | (?:sil )?open font license
ofl | 4 | scripts.sil.org | scripts\.sil\.org/ofl
bitstream-vera | 2 | bitstream vera | bitstream vera (?:fonts )?licen[sc]e
ubuntu-font | 2 | ubuntu font | ubuntu font licen[sc]e
lppl-1.3c | 1 | latex project public | latex project public license,? (?:version|v\.?)? ?1\.3c?
lppl | 2 | latex project public | latex project public license
ms-pl | 2 | microsoft public license | microsoft public license
ms-rl | 2 | microsoft reciprocal | microsoft reciprocal license
ms-pl | 4 | ms-pl | \bms-pl\b
apsl-2.0 | 2 | apple public source | apple public source license(?:,? version 2(?:\.0)?)?
qpl-1.0 | 2 | q public license | \bq public license\b
sleepycat | 2 | sleepycat | \bsleepycat license\b
zpl-2.1 | 2 | zope public | zope public license(?:,? (?:version|v\.?)? ?2\.1)?
erlang | 2 | erlang public | erlang public license
rpl-1.5 | 2 | reciprocal public | reciprocal public license
nasa-1.3 | 2 | nasa open source | nasa open source agreement
ecl-2.0 | 2 | educational community | educational community license(?:,? (?:version|v\.?)? ?2\.0)?
upl-1.0 | 2 | universal permissive | universal permissive license
mulan-psl-2.0 | 1 | mulan | mulan (?:permissive software license|psl),? ?(?:version|v\.?)? ?2
mulan-psl | 2 | mulan | mulan (?:permissive software license|psl)
blueoak-1.0.0 | 2 | blue oak | blue oak model license
hippocratic | 2 | hippocratic | hippocratic license
sspl-1.0 | 2 | server side public | server side public license
elastic-2.0 | 1 | elastic license | elastic license,? (?:version|v\.?)? ?2(?:\.0)?
elastic | 2 | elastic license | elastic license
busl-1.1 | 1 | business source | business source license,? (?:version|v\.?)? ?1\.1
busl | 2 | business source | business source license
commons-clause | 2 | commons clause | commons clause(?: license)?(?: condition)?
polyform | 2 | polyform | polyform (?:noncommercial|shield|perimeter|strict|small business|free trial|internal use) license
confluent | 2 | confluent community | confluent community license
redis-source | 2 | redis source | redis source available license
prosperity | 2 | prosperity public | prosperity public license
parity | 2 | parity public | parity public license
cc0-1.0 | 1 | cc0 | \bcc0(?:[ -](?:v|version )?1\.0)?(?: universal)?\b
cc0-1.0 | 2 | publicdomain/zero | creativecommons\.org/publicdomain/zero
cc-pdm | 2 | public domain mark | (?:creative commons )?public domain mark
cc-by-nc-nd | 1 | cc by-nc-nd; cc-by-nc-nd | \bcc[ -]by-nc-nd(?: \d\.\d)?
cc-by-nc-sa | 1 | cc by-nc-sa; cc-by-nc-sa | \bcc[ -]by-nc-sa(?: \d\.\d)?
cc-by-nc | 2 | cc by-nc; cc-by-nc | \bcc[ -]by-nc(?!-)(?: \d\.\d)?
cc-by-nd | 2 | cc by-nd; cc-by-nd | \bcc[ -]by-nd(?: \d\.\d)?
cc-by-sa | 2 | cc by-sa; cc-by-sa | \bcc[ -]by-sa(?: \d\.\d)?
cc-by-nc-nd | 1 | cc-by-nc-nd | \bcc-by-nc-nd(?:-\d\.\d)?
cc-by-nc-sa | 1 | cc-by-nc-sa | \bcc-by-nc-sa(?:-\d\.\d)?
cc-by-nc | 2 | cc-by-nc | \bcc-by-nc(?!-[sn])(?:-\d\.\d)?
cc-by-nd | 2 | cc-by-nd | \bcc-by-nd(?:-\d\.\d)?
cc-by-sa | 2 | cc-by-sa | \bcc-by-sa(?:-\d\.\d)?
cc-by-4.0 | 3 | cc by | \bcc by 4\.0
cc-by-3.0 | 3 | cc by | \bcc by 3\.0
cc-by-2.0 | 3 | cc by | \bcc by 2\.0
cc-by | 4 | cc by | \bcc by\b(?!-)
cc-by-4.0 | 3 | cc-by | \bcc-by-4\.0
cc-by | 4 | cc-by | \bcc-by\b(?!-(?:nc|nd|sa))
cc-by-nc-nd | 1 | creative commons | creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | 1 | creative commons | creative commons attribution[ -]non-?commercial[ -]share-?alike
cc-by-nc | 2 | creative commons | creative commons attribution[ -]non-?commercial
cc-by-nd | 2 | creative commons | creative commons attribution[ -]no-?deriv(?:ative)?s?(?: works)?
cc-by-sa | 2 | creative commons | creative commons attribution[ -]share-?alike
cc-by-4.0 | 2 | creative commons | creative commons attribution(?: international)? 4\.0
cc-by | 3 | creative commons | creative commons attribution(?: licen[sc]e)?
cc | 5 | creative commons | creative commons(?: licen[sc]e)?
cc-by-nc-nd | 1 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd
cc-by-nc-sa | 1 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa
cc-by-nc | 2 | creativecommons.org | creativecommons\.org/licenses/by-nc(?!-)
cc-by-nd | 2 | creativecommons.org | creativecommons\.org/licenses/by-nd
cc-by-sa | 2 | creativecommons.org | creativecommons\.org/licenses/by-sa
cc-by | 3 | creativecommons.org | creativecommons\.org/licenses/by(?!-)
odbl-1.0 | 2 | open database | open database license|open data commons open database
odc-by-1.0 | 2 | open data commons | open data commons attribution license
pddl-1.0 | 2 | open data commons | open data commons public domain dedication
ogl-3.0 | 2 | open government licen | open government licen[sc]e(?: v?3\.0)?
cdla-permissive | 2 | community data license | community data license agreement[ –-]*permissive
cdla-sharing | 2 | community data license | community data license agreement[ –-]*sharing
openrail | 2 | openrail; open rail | \b(?:bigscience |creativeml )?open ?rail(?:\+\+)?(?:-[msd])?(?: licen[sc]e)?\b
public-domain | 3 | public domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain | 5 | public domain | \bpublic domain\b
spdx-tag | 6 | spdx-license-identifier | spdx-license-identifier: ?[a-z0-9.+()-]+(?: (?:and|or|with) [a-z0-9.+()-]+)*
proprietary | 5 | all rights reserved | all rights reserved
proprietary | 4 | proprietary and confidential | proprietary and confidential
proprietary | 4 | unauthorized copying | unauthorized copying of this (?:file|document|software|work)[^.]{0,60} is strictly prohibited
free-unknown | 7 | licensed under | licensed under (?:the )?[a-z0-9 .-]{1,40}? licen[sc]e
copyright-notice | 7 | copyright | copyright (?:\(c\)|©)? ?(?:19|20)\d\d
"""

#: The phrases that always count, by words, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is not a word character: ASCII but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts of keywords; a text without any of them has no keyword. Keywords without one of these are added by gates().
_GATES = ("licen", "public", "gpl", "gnu.org", "apache", "mit-", "attribution", "bsd", "commons", "copyright", "permi", "redistribution", "zlib", "ssl", "clause")


def gates() -> list[str]:
    keys = {w for _, _, k, _ in rules() for w in keywords(k)}
    used = [g for g in _GATES if any(g in k for k in keys)]
    more = sorted(k for k in keys if not any(g in k for g in used))
    return used + [k for k in more if not any(o != k and o in k for o in more)]


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keywords, pattern) of each rule, in order."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ", 3)
        out.append((label, int(priority), keyword, pattern))
    return out


def keywords(key: str) -> list[str]:
    """The keywords of a rule."""
    return key.split("; ")


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOW)


def _found(text: Column, number: int, priority: int, pattern: str) -> Column:
    """An array of (start, stop, rule, priority) of all matches: the text is split at marks put around them."""
    parts = F.split(F.regexp_replace(text, "(" + pattern + ")", "\u0001$1\u0002"), "\u0001")
    # parts[0] is before the first match; each other part is a match, \u0002 and what follows
    step = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.struct(F.length(F.element_at(parts, 1)).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int,rule:int,priority:int>>)").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) - 1).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.instr(p, "\u0002") - 1).alias("stop"), F.lit(number).alias("rule"), F.lit(priority).alias("priority")))).alias("out"),
        ),
    )
    return step["out"]


def detections(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns of ``more``, found: array of (label, start, stop, priority) that stay, by place.

    Places are code points of the text with A-Z lower-cased and white space folded to one blank. Null and empty
    texts have none. Repeated rows get a result each.
    """
    all_rules = rules()
    none = F.expr("cast(array() as array<struct<label:string,start:int,stop:int,priority:int>>)")
    kinds = F.expr("cast(array() as array<struct<start:int,stop:int,rule:int,priority:int>>)")
    # the gate may let through more than has a keyword, never less
    low = docs.withColumn("__low", F.lower("text"))
    gate = F.lit(False)
    for g in gates():
        gate = gate | F.contains(F.col("__low"), F.lit(g.replace(" ", ""))) if g.strip() != g else gate | F.contains(F.col("__low"), F.lit(g.split(" ")[0]))
    src = low.withColumn("__open", gate).drop("__low")
    folded = F.regexp_replace(F.translate(lowered(F.col("text")), "\u0001\u0002", ""), r"\s+", " ")
    src = src.withColumn("__t", F.when(F.col("__open"), folded))
    by_key: dict[str, list[Column]] = {}
    for i, (_, priority, key, pattern) in enumerate(all_rules):
        by_key.setdefault(key, []).append(_found(F.col("__t"), i, priority, pattern))
    every = F.concat(*[F.when(reduce(or_, [F.contains(F.col("__t"), F.lit(w)) for w in keywords(k)]), F.concat(*v) if len(v) > 1 else v[0]).otherwise(kinds) for k, v in by_key.items()])
    src = src.withColumn("__all", F.when(F.col("__open"), every).otherwise(kinds))
    beats = lambda y, x: (y["start"] <= x["start"]) & (y["stop"] >= x["stop"]) & (F.struct(y["priority"], -(y["stop"] - y["start"]), y["rule"]) < F.struct(x["priority"], -(x["stop"] - x["start"]), x["rule"]))
    within = lambda y, x: (y["start"] >= x["start"]) & (y["stop"] <= x["stop"]) & (y["priority"] < x["priority"])
    # the check is within one document's detections
    stay = F.filter("__all", lambda x: ~F.exists("__all", lambda y: beats(y, x) | within(y, x)))
    label = F.array(*[F.lit(r[0]) for r in all_rules])
    named = F.transform(F.array_sort(stay), lambda x: F.struct(F.element_at(label, x["rule"] + 1).alias("label"), x["start"].alias("start"), x["stop"].alias("stop"), x["priority"].alias("priority")))
    return src.select("doc_id", *more, F.when(F.size("__all") > 0, named).otherwise(none).alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    Words are runs of ASCII letters (A-Z lower-cased) and digits and of all that is beyond ASCII. ``n_base`` counts the places
    where a phrase of BASE stands; the labels of the rules' detections come on top, so base labels always stay. The score is
    1 - 1 / 2^(detections + base places), halved at best for weak rules. Null and empty texts have no words and no labels.
    """
    src = C.texts(docs)
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace("text", _BETWEEN, " ")), F.lit(" "))
    hit = F.col("norm").rlike("(?i) (?:" + "|".join(p for p, _ in BASE) + ") ")
    src = src.select("doc_id", "text", norm.alias("norm")).withColumn("hit", hit)
    src = src.withColumn("n_words", F.when(F.col("norm") == "  ", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1).cast("long"))
    src = src.withColumn("norm", F.when(F.col("hit"), lowered(F.col("norm"))))
    cols, firsts, lasts, labels = [], [], [], []
    hit = F.col("hit")
    for phrase, label in BASE:
        k = phrase.count(" ") + 1
        # the blank after a place may be the one before the next
        double = F.regexp_replace("norm", " ", "  ")
        parts = F.split(double, " " + phrase.replace(" ", "  ") + " ", -1)
        n = F.when(F.contains("norm", F.lit(f" {phrase} ")), F.size(parts) - 1).otherwise(0)
        words = lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != ""))
        first = F.when(n > 0, words(F.element_at(parts, 1)))
        last = F.when(n > 0, F.col("n_words") - words(F.element_at(parts, -1)) - k)
        cols.append(n)
        firsts.append(first)
        lasts.append(last)
        labels.append(F.when(n > 0, F.lit(label)))
    out = detections(
        src.select(
            "doc_id", "text", "n_words", F.when(hit, sum(cols[1:], cols[0])).otherwise(0).cast("long").alias("n_base"),
            F.when(hit, F.least(*firsts)).cast("long").alias("first_word"), F.when(hit, F.greatest(*lasts)).cast("long").alias("last_word"),
            F.when(hit, F.array_sort(F.array_compact(F.array(*labels)))).otherwise(F.expr("cast(array() as array<string>)")).alias("base"),
        ),
        "n_words", "n_base", "first_word", "last_word", "base",
    )
    weak = F.aggregate("found", F.lit(1.0), lambda a, x: a * F.when(x["priority"] <= 4, F.lit(0.5)).otherwise(F.lit(0.75)))
    named = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda x: x["label"]))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(named, ",").alias("labels"),
        (F.lit(1.0) - weak * F.pow(F.lit(0.5), F.col("n_base"))).alias("score"), "found",
    )


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents", "doc_id", "text")).drop("found")
