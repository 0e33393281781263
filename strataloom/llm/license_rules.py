"""Signature rules of the license scan, most specific first.

A rule is written over words joined by single blanks, lower case, punctuation gone ("Version 2.0" reads
"version 2 0"). Each line below gives label | gate | priority | pattern. The gate is a literal that any match
contains; `{v}` stands for each of the versions that follow the pattern in brackets, with dots in the label and
blanks in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    gate: str
    priority: int
    pattern: re.Pattern


_LICENSE, _UNDER = r"(?:licen[sc]es?|licen[sc]ing)", r"(?:licensed|released|distributed|available|provided|covered|published) under (?:the )?(?:terms of (?:the )?)?"
_MACROS = {"LIC": _LICENSE, "UNDER": _UNDER, "V": r"(?:version |v ?|ver )?", "OR": r"or (?:\(?at your option\)? )?(?:any )?later(?: version)?"}

SIGNATURES = r"""
spdx:gpl-{v}-or-later | spdx | 100 | spdx license identifier gpl {v} (?:0 )?or later [1.0 2.0 3.0]
spdx:gpl-{v}-only | spdx | 100 | spdx license identifier gpl {v} (?:0 )?only [1.0 2.0 3.0]
spdx:lgpl-{v}-or-later | spdx | 100 | spdx license identifier lgpl {v} or later [2.0 2.1 3.0]
spdx:lgpl-{v}-only | spdx | 100 | spdx license identifier lgpl {v} only [2.0 2.1 3.0]
spdx:agpl-{v}-or-later | spdx | 100 | spdx license identifier agpl {v} or later [1.0 3.0]
spdx:agpl-{v}-only | spdx | 100 | spdx license identifier agpl {v} only [1.0 3.0]
spdx:apache-{v} | spdx | 100 | spdx license identifier apache {v} [1.0 1.1 2.0]
spdx:mpl-{v} | spdx | 100 | spdx license identifier mpl {v} [1.0 1.1 2.0]
spdx:epl-{v} | spdx | 100 | spdx license identifier epl {v} [1.0 2.0]
spdx:eupl-{v} | spdx | 100 | spdx license identifier eupl {v} [1.0 1.1 1.2]
spdx:cddl-{v} | spdx | 100 | spdx license identifier cddl {v} [1.0 1.1]
spdx:artistic-{v} | spdx | 100 | spdx license identifier artistic {v} [1.0 2.0]
spdx:bsd-{v}-clause | spdx | 100 | spdx license identifier bsd {v} clause [0 1 2 3 4]
spdx:cc-by-{v} | spdx | 100 | spdx license identifier cc by {v} [1.0 2.0 2.5 3.0 4.0]
spdx:cc-by-sa-{v} | spdx | 100 | spdx license identifier cc by sa {v} [1.0 2.0 2.5 3.0 4.0]
spdx:cc-by-nc-{v} | spdx | 100 | spdx license identifier cc by nc {v} [1.0 2.0 2.5 3.0 4.0]
spdx:cc-by-nd-{v} | spdx | 100 | spdx license identifier cc by nd {v} [1.0 2.0 2.5 3.0 4.0]
spdx:cc-by-nc-sa-{v} | spdx | 100 | spdx license identifier cc by nc sa {v} [1.0 2.0 2.5 3.0 4.0]
spdx:cc-by-nc-nd-{v} | spdx | 100 | spdx license identifier cc by nc nd {v} [1.0 2.0 2.5 3.0 4.0]
spdx:cc0-1.0 | spdx | 100 | spdx license identifier cc0 1 0
spdx:mit | spdx | 99 | spdx license identifier mit(?: 0)?
spdx:isc | spdx | 99 | spdx license identifier isc
spdx:zlib | spdx | 99 | spdx license identifier zlib
spdx:unlicense | spdx | 99 | spdx license identifier unlicense
spdx:wtfpl | spdx | 99 | spdx license identifier wtfpl
spdx:bsl-1.0 | spdx | 99 | spdx license identifier bsl 1 0
spdx:other | spdx | 40 | spdx license identifier \w+(?: \d+)*
agpl-{v}-or-later | affero | 95 | (?:gnu )?affero general public license <V>{v}(?: 0)? <OR> [1.0 3.0 1 3]
agpl-{v} | affero | 90 | (?:gnu )?affero general public license <V>{v} [1.0 3.0]
agpl-{v} | affero | 89 | (?:gnu )?affero general public license <V>{v} [1 3]
agpl | affero | 60 | (?:gnu )?affero general public license
lgpl-{v}-or-later | general public | 95 | (?:gnu )?(?:lesser|library) general public license <V>{v} <OR> [2.0 2.1 3.0 2 3]
lgpl-{v} | general public | 90 | (?:gnu )?(?:lesser|library) general public license <V>{v} [2.0 2.1 3.0]
lgpl-{v} | general public | 89 | (?:gnu )?(?:lesser|library) general public license <V>{v} [2 3]
lgpl | general public | 60 | (?:gnu )?(?:lesser|library) general public license
gpl-{v}-or-later | general public | 94 | (?:gnu )?general public license <V>{v} <OR> [1.0 2.0 3.0 1 2 3]
gpl-{v}-or-later | either version | 93 | general public license as published by the free software foundation either version {v} (?:of the license )?<OR> [1 2 3]
gpl-{v}-only | general public | 93 | (?:gnu )?general public license <V>{v} only [1.0 2.0 3.0 1 2 3]
gpl-{v} | general public | 90 | (?:gnu )?general public license <V>{v} [1.0 2.0 3.0]
gpl-{v} | general public | 89 | (?:gnu )?general public license <V>{v} [1 2 3]
gpl-classpath-exception | classpath | 92 | (?:gpl|general public license) (?:<V>2(?: 0)? )?with (?:the )?classpath exception
gpl-linking-exception | linking exception | 91 | (?:gpl|general public license) with (?:a )?linking exception
gpl | general public | 60 | (?:gnu )?general public license
gpl-{v}-or-later | gpl | 85 | gpl ?<V>{v} <OR> [2.0 3.0 2 3]
gpl-{v} | gpl | 80 | gnu gpl ?<V>{v} [1.0 2.0 3.0 1 2 3]
gplv{v} | gpl | 79 | gplv{v} [1 2 3]
lgplv{v} | lgpl | 80 | lgplv{v} [2 2.1 3]
agplv{v} | agpl | 80 | agplv{v} [1 3]
fdl-{v} | free documentation | 90 | (?:gnu )?free documentation license <V>{v} [1.1 1.2 1.3]
fdl | free documentation | 60 | (?:gnu )?free documentation license
apache-{v} | apache | 90 | <UNDER>apache (?:software )?license <V>{v} [1.0 1.1 2.0]
apache-{v} | apache | 88 | apache (?:software )?license <V>{v} [1.0 1.1 2.0]
apache-{v} | apache | 86 | apache <V>{v} license [1.0 1.1 2.0 2]
apache-2.0 | apache org licenses | 87 | (?:www )?apache org licenses license 2 0
apache | apache | 60 | apache (?:software )?license
mit | mit | 86 | <UNDER>mit license
mit | mit | 80 | (?:the )?mit license
mit | copies or substantial | 84 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | permission is hereby granted | 83 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0 | mit | 87 | mit no attribution
x11 | x11 | 80 | (?:mit )?x11 license
expat | expat | 80 | expat license
bsd-{v}-clause | bsd | 88 | <UNDER>(?:bsd {v} clause|{v} clause bsd) [0 1 2 3 4]
bsd-{v}-clause | bsd | 86 | (?:bsd {v} clause|{v} clause bsd)(?: license)? [0 1 2 3 4]
bsd-2-clause | bsd | 85 | simplified bsd license|two clause bsd
bsd-3-clause | bsd | 85 | (?:new|modified|revised) bsd license|three clause bsd
bsd-4-clause | bsd | 85 | original bsd license|four clause bsd
bsd | redistribution and use | 82 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse or promote | 83 | may be used to endorse or promote products derived from this software
bsd | bsd | 60 | bsd (?:style )?license
isc | isc | 80 | isc license
isc | purpose with or without fee | 82 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | zlib | 80 | zlib(?: libpng)? license
zlib | altered source versions | 82 | altered source versions must be plainly marked as such
bsl-{v} | boost | 85 | boost software license(?: <V>{v})? [1.0]
busl-{v} | business source | 85 | business source license(?: <V>{v})? [1.0 1.1]
mpl-{v}-no-copyleft-exception | mozilla | 91 | mozilla public license <V>{v} no copyleft exception [2.0]
mpl-{v}-no-copyleft-exception | incompatible with secondary | 91 | incompatible with secondary licenses as defined by the mozilla public license v {v} [2.0]
mpl-{v} | mozilla | 90 | mozilla public license <V>{v} [1.0 1.1 2.0]
mpl | mozilla | 60 | mozilla public license
mpl-2.0 | mozilla org mpl | 88 | mozilla org mpl 2 0
epl-{v} | eclipse | 90 | eclipse public license <V>{v} [1.0 2.0]
epl | eclipse | 60 | eclipse public license
edl-{v} | eclipse distribution | 90 | eclipse distribution license <V>{v} [1.0]
eupl-{v} | european union public | 90 | european union public licen[cs]e <V>{v} [1.0 1.1 1.2]
eupl | european union public | 60 | european union public licen[cs]e
cddl-{v} | common development | 90 | common development and distribution license <V>{v} [1.0 1.1]
cddl | common development | 60 | common development and distribution license
cpl-{v} | common public license | 88 | common public license <V>{v} [0.5 1.0]
ipl-{v} | ibm public | 88 | ibm public license <V>{v} [1.0]
osl-{v} | open software license | 88 | open software license <V>{v} [1.0 1.1 2.0 2.1 3.0]
afl-{v} | academic free | 88 | academic free license <V>{v} [1.1 1.2 2.0 2.1 3.0]
artistic-{v} | artistic | 88 | artistic license <V>{v} [1.0 2.0]
artistic | artistic | 60 | artistic license
ms-pl | microsoft public | 80 | microsoft public license
ms-rl | microsoft reciprocal | 80 | microsoft reciprocal license
python-{v} | python software foundation | 85 | python software foundation license <V>{v} [2]
python | python software foundation | 60 | python software foundation license
php-{v} | php license | 85 | php license <V>{v} [3.0 3.01]
ruby | ruby | 60 | ruby license
ofl-{v} | open font | 88 | (?:sil )?open font license <V>{v} [1.0 1.1]
ofl | open font | 60 | (?:sil )?open font license
odbl-{v} | open database | 88 | open database license <V>{v} [1.0]
odbl | open database | 60 | open database license
odc-by | open data commons attribution | 80 | open data commons attribution license
pddl | public domain dedication and license | 80 | (?:open data commons )?public domain dedication and license
cdla-permissive-{v} | community data | 85 | community data license agreement permissive <V>{v} [1.0 2.0]
cdla-sharing-{v} | community data | 85 | community data license agreement sharing <V>{v} [1.0]
etalab-{v} | etalab | 80 | licence ouverte <V>{v} etalab|etalab {v} [1.0 2.0]
ogl-{v} | open government | 85 | open government licen[cs]e <V>{v} [1.0 2.0 3.0]
upl-{v} | universal permissive | 85 | universal permissive license <V>{v} [1.0]
unlicense | unlicense | 80 | (?:the )?unlicense
unlicense | unencumbered | 82 | this is free and unencumbered software released into the public domain
wtfpl | wtf | 80 | wtfpl
wtfpl | fuck | 80 | do what the fuck you want to public license
beerware | beer | 80 | beer ?ware license
json | shall be used for good | 80 | the software shall be used for good not evil
cc0-{v} | cc0 | 90 | cc0(?: <V>{v})? [1.0]
cc0-1.0 | cc zero | 85 | cc zero
cc0-1.0 | creative commons | 85 | creative commons zero
cc-by-nc-sa-{v} | cc by | 92 | cc by nc sa {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nc-nd-{v} | cc by | 92 | cc by nc nd {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nc-{v} | cc by | 91 | cc by nc {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-sa-{v} | cc by | 91 | cc by sa {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nd-{v} | cc by | 91 | cc by nd {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-{v} | cc by | 90 | cc by {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nc-sa | cc by | 72 | cc by nc sa
cc-by-nc-nd | cc by | 72 | cc by nc nd
cc-by-nc | cc by | 71 | cc by nc
cc-by-sa | cc by | 71 | cc by sa
cc-by-nd | cc by | 71 | cc by nd
cc-by | cc by | 60 | cc by
cc-by-nc-sa-{v} | creative commons | 92 | creative commons attribution non ?commercial share ?alike {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nc-nd-{v} | creative commons | 92 | creative commons attribution non ?commercial no ?deriv(?:ative)?s {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nc-{v} | creative commons | 91 | creative commons attribution non ?commercial {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-sa-{v} | creative commons | 91 | creative commons attribution share ?alike {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nd-{v} | creative commons | 91 | creative commons attribution no ?deriv(?:ative)?s {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-{v} | creative commons | 90 | creative commons attribution {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nc-sa-{v} | creativecommons | 92 | creativecommons org licenses by nc sa {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nc-nd-{v} | creativecommons | 92 | creativecommons org licenses by nc nd {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nc-{v} | creativecommons | 91 | creativecommons org licenses by nc {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-sa-{v} | creativecommons | 91 | creativecommons org licenses by sa {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-nd-{v} | creativecommons | 91 | creativecommons org licenses by nd {v} [1.0 2.0 2.5 3.0 4.0]
cc-by-{v} | creativecommons | 90 | creativecommons org licenses by {v} [1.0 2.0 2.5 3.0 4.0]
cc-pdm-{v} | creativecommons | 90 | creativecommons org publicdomain mark {v} [1.0]
cc | creative commons | 50 | creative commons
public-domain | public domain | 70 | (?:is |are |released |placed |dedicated )?(?:in|into|to) the public domain
public-domain | public domain | 40 | public domain
reserved | reserved | 60 | all rights reserved
reserved | reserved | 58 | some rights reserved
reserved | vorbehalten | 58 | alle rechte vorbehalten
reserved | derechos | 58 | todos los derechos reservados
copyright | copyright | 30 | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*
proprietary | proprietary | 55 | (?:proprietary and confidential|confidential and proprietary|proprietary license)
no-redistribution | redistribut | 50 | (?:may not be|do not|no) redistribut(?:e|ed|ion)
noncommercial | commercial | 50 | (?:for )?non ?commercial (?:use|purposes) only
commercial | commercial license | 50 | commercial license(?: agreement)?
eula | end user | 50 | end user license agreement
permission-required | permission | 45 | (?:without|except with) (?:the )?(?:prior )?(?:express )?written permission
as-is | as is | 20 | (?:provided|distributed) (?:by the \w+(?: \w+)? )?as is
license-ref | see | 15 | see (?:the )?(?:license|licence|copying) (?:file|txt|md)
spdx:cecill-{v} | spdx | 100 | spdx license identifier cecill {v} [1.0 2.0 2.1]
spdx:lppl-{v} | spdx | 100 | spdx license identifier lppl {v}(?: \w)? [1.0 1.1 1.2 1.3]
spdx:ofl-{v} | spdx | 100 | spdx license identifier ofl {v} [1.0 1.1]
spdx:sspl-1.0 | spdx | 100 | spdx license identifier sspl 1 0
spdx:elastic-2.0 | spdx | 100 | spdx license identifier elastic 2 0
spdx:postgresql | spdx | 99 | spdx license identifier postgresql
spdx:ncsa | spdx | 99 | spdx license identifier ncsa
spdx:0bsd | spdx | 99 | spdx license identifier 0bsd
gcc-runtime-exception | runtime library exception | 92 | gcc runtime library exception(?: <V>3(?: \d)?)?
gpl-font-exception | font exception | 91 | (?:gpl|general public license) with (?:a |the )?font exception
bison-exception | skeleton | 90 | you may create a larger work that contains part or all of the bison parser skeleton
autoconf-exception | autoconf | 90 | (?:as a special exception .{0,80} )?configuration script generated by autoconf
llvm-exception | llvm exception | 92 | apache (?:license )?<V>2 0 with llvm exceptions?
commons-clause | commons clause | 90 | commons clause license condition(?: v ?1 0)?
elastic-{v} | elastic license | 88 | elastic license <V>{v} [2.0]
sspl-{v} | server side public | 88 | server side public license(?: <V>{v})? [1]
polyform-noncommercial-{v} | polyform | 88 | polyform noncommercial license(?: {v})? [1.0.0]
polyform-small-business-{v} | polyform | 88 | polyform small business license(?: {v})? [1.0.0]
cecill-{v} | cecill | 88 | cecill (?:free software license agreement )?<V>{v} [1.0 1.1 2.0 2.1]
cecill-b | cecill b | 89 | cecill b(?: free software license agreement)?
cecill-c | cecill c | 89 | cecill c(?: free software license agreement)?
cecill | cecill | 60 | cecill license
mulan-psl-{v} | mulan | 88 | mulan psl <V>{v} [1 2]
mulan-psl | mulan permissive | 80 | mulan permissive software license
blueoak-{v} | blue oak | 88 | blue oak model license(?: {v})? [1.0.0]
hippocratic-{v} | hippocratic | 88 | hippocratic license(?: <V>{v})? [1.2 2.1 3.0]
lppl-{v} | latex project | 90 | latex project public license <V>{v} [1.0 1.1 1.2 1.3]
lppl | latex project | 60 | latex project public license
zpl-{v} | zope public | 88 | zope public license(?: zpl)? <V>{v} [1.1 2.0 2.1]
w3c | w3c | 82 | w3c software (?:and document )?(?:notice and )?license
unicode | unicode | 80 | unicode (?:data files and software license|license agreement data files and software)
openssl | openssl | 80 | openssl license
openssl | openssl toolkit | 82 | this product includes software developed by the openssl project for use in the openssl toolkit
ncsa | university of illinois | 82 | university of illinois ncsa open source license
postgresql | postgresql | 80 | postgresql licen[cs]e
vim | vim license | 80 | vim license
sleepycat | sleepycat | 80 | sleepycat license
qpl-{v} | public license | 80 | q public license(?: <V>{v})? [1.0]
nasa-{v} | nasa open source | 85 | nasa open source agreement(?: <V>{v})? [1.3]
sun-public-{v} | sun public | 85 | sun public license(?: <V>{v})? [1.0]
cpal-{v} | common public attribution | 88 | common public attribution license(?: <V>{v})? [1.0]
rpl-{v} | reciprocal public | 88 | reciprocal public license(?: <V>{v})? [1.1 1.5]
rpsl-{v} | realnetworks | 85 | realnetworks public source license(?: <V>{v})? [1.0]
apsl-{v} | apple public source | 88 | apple public source license(?: <V>{v})? [1.0 1.1 1.2 2.0]
watcom-{v} | open watcom | 85 | sybase open watcom public license(?: <V>{v})? [1.0]
nokia | nokia open source | 80 | nokia open source license
intel | intel open source | 80 | intel open source license
openldap-{v} | openldap | 88 | openldap public license(?: <V>{v})? [2.7 2.8]
cern-ohl-{v}-s | cern | 90 | cern open hardware licen[cs]e <V>{v} strongly reciprocal [2]
cern-ohl-{v}-w | cern | 90 | cern open hardware licen[cs]e <V>{v} weakly reciprocal [2]
cern-ohl-{v}-p | cern | 90 | cern open hardware licen[cs]e <V>{v} permissive [2]
cern-ohl | cern | 60 | cern open hardware licen[cs]e
tapr-ohl | tapr | 80 | tapr open hardware license
solderpad | solderpad | 80 | solderpad hardware licen[cs]e
openrail-m | openrail | 85 | creativeml openrail m(?: license)?
bigscience-rail | bigscience | 85 | bigscience (?:bloom )?rail license(?: <V>1 0)?
llama-community | community license | 82 | llama (?:\d )?community license(?: agreement)?
cc-sampling-plus | sampling | 85 | creative commons sampling plus(?: 1 0)?
fdl-no-invariants | invariant sections | 91 | with no invariant sections(?: no)? (?:with no )?front cover texts
opl | open publication | 80 | open publication licen[cs]e
free-art-{v} | free art | 85 | free art license(?: <V>{v})? [1.2 1.3]
dsl | design science | 80 | design science license
datenlizenz-{v} | datenlizenz | 85 | datenlizenz deutschland (?:namensnennung |zero )?(?:version )?{v} [1.0 2.0]
crown-copyright | crown | 60 | crown copyright
ijg | independent jpeg | 80 | based in part on the work of the independent jpeg group
libtiff | libtiff | 80 | libtiff license
info-zip | info zip | 80 | info zip license
curl | curl license | 80 | curl license
xfree86 | xfree86 | 80 | xfree86 license(?: 1 \d)?
bitstream-vera | bitstream vera | 80 | bitstream vera fonts? (?:license|copyright)
arphic | arphic | 80 | arphic public license
aladdin | aladdin | 80 | aladdin free public license
eula | software license agreement | 48 | software license agreement
trial | evaluation | 45 | (?:for )?evaluation (?:use|purposes) only
academic | academic | 45 | (?:for )?academic (?:use|purposes) only
academic | educational | 45 | (?:for )?educational (?:use|purposes) only
attribution | credit | 20 | (?:appropriate|proper) credit must be given
no-warranty | warrant | 20 | without (?:any )?warranty of any kind
no-liability | liable | 20 | in no event shall the (?:authors?|copyright holders?)(?: or (?:authors?|copyright holders?))? be liable
licensed-under | licensed under | 10 | licensed under (?:the )?(?:\w+ ){0,4}license
"""


def _rules() -> tuple[Rule, ...]:
    out = []
    for line in filter(None, map(str.strip, SIGNATURES.splitlines())):
        label, gate, priority, pattern = (x.strip() for x in line.split(" | ", 3))
        versions = [None]
        if m := re.search(r" \[([\d. ]+)\]$", pattern):
            pattern, versions = pattern[: m.start()], m[1].split()
        for name, text in _MACROS.items():
            pattern = pattern.replace(f"<{name}>", text)
        for v in versions:
            text = pattern if v is None else pattern.replace("{v}", v.replace(".", " "))
            out.append(Rule(label if v is None else label.replace("{v}", v), gate, int(priority), re.compile(rf"(?<!\S)(?:{text})(?!\S)")))
    return tuple(out)


RULES = _rules()
