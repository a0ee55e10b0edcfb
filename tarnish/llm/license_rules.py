"""The signature rules, hand-written: label, priority, keyword and pattern, strongest first.

Patterns are matched against lower-case words with single spaces, so ``2.0`` reads ``2 0`` and an
address reads ``www apache org``. The keyword is part of every match of its pattern. Priority 1:
the license with its version or its own wording; 2: a named license without version; 3: a family;
4: words that only hint at a license.
"""

from __future__ import annotations

#: Weight of a match of each priority in the score.
WEIGHTS = {1: 0.95, 2: 0.85, 3: 0.6, 4: 0.3}

#: Stems that most keywords hold.
_STEMS = [
    "licen", "spdx", "copyright", "copyleft", "reserved", "gpl", "apache", "creative", "cc0", "cc by", "bsd", "mozilla",
    "mpl", "eclipse", "epl", "cddl", "domain", "unlicense", "warrant", "merchantab", "permission", "redistribut",
    "openrail", "ofl", "wtfpl", "zlib", "eupl", "odbl", "proprietary", "lizenz", "licence", "lgpl", "opensource", "open source",
]

_TABLE = """
mit|1|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|1|mit license|(?:released|licensed|distributed|available|provided|published|covered|issued)?(?: )?under(?: the)?(?: terms of the)? mit license
mit|1|spdx|spdx license identifier mit
mit|1|opensource org|opensource org licenses? mit(?: license)?(?: php| html)?
mit|1|mit license|the mit license mit
mit|2|mit license|mit license
mit|2|mit licen|mit licen[cs]ed
mit|2|expat license|expat license
mit|2|licen|licen[cs]e mit
mit-0|1|mit no attribution|mit no attribution(?: license)?
mit-0|1|spdx|spdx license identifier mit 0
x11|2|x11 license|x11 license
isc|1|permission to use copy modify|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|1|spdx|spdx license identifier isc
isc|2|isc license|isc license
isc|2|opensource org|opensource org licenses? isc
apache-2|1|apache license|(?:licen[cs]ed under (?:the )?)?apache license version 2(?: 0)?
apache-2|1|apache license|apache license 2 0
apache-2|1|apache|apache 2 0 license
apache-2|1|spdx|spdx license identifier apache 2 0
apache-2|1|apache org|apache org licenses license 2 0(?: txt| html)?
apache-2|1|apache|apache software license version 2(?: 0)?
apache-2|1|apache|apache licen[cs]e v ?2(?: 0)?
apache-2|1|apache|licen[cs]ed under apache 2(?: 0)?
apache-2|2|apache 2|apache 2(?: 0)?
apache-1-1|1|apache|apache software license version 1 1
apache-1-1|1|spdx|spdx license identifier apache 1 1
apache-1-0|1|apache|apache software license version 1 0
apache|2|apache license|apache license
apache|2|apache software license|apache software license
gpl-3-or-later|1|spdx|spdx license identifier gpl 3 0 (?:or later|plus)
gpl-3-or-later|1|general public license|gnu general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)? or (?:at your option )?any later version
gpl-3-or-later|1|gpl|gplv?3(?: 0)? or later
gpl-3|1|spdx|spdx license identifier gpl 3 0(?: only)?
gpl-3|1|general public license|(?:gnu )?general public license version 3
gpl-3|1|general public license|(?:gnu )?general public license v3(?: 0)?
gpl-3|1|gnu org|gnu org licenses gpl 3 0(?: html| txt)?
gpl-3|1|gpl|(?:gnu )?gpl ?v? ?3(?: 0)?
gpl-2-or-later|1|spdx|spdx license identifier gpl 2 0 (?:or later|plus)
gpl-2-or-later|1|general public license|gnu general public license(?: as published by the free software foundation)?(?: either)? version 2(?: of the license)? or (?:at your option )?any later version
gpl-2-or-later|1|gpl|gplv?2(?: 0)? or later
gpl-2|1|spdx|spdx license identifier gpl 2 0(?: only)?
gpl-2|1|general public license|(?:gnu )?general public license version 2
gpl-2|1|general public license|(?:gnu )?general public license v2(?: 0)?
gpl-2|1|gnu org|gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-2|1|gpl|(?:gnu )?gpl ?v? ?2(?: 0)?
gpl-1|1|general public license|(?:gnu )?general public license version 1
gpl-1|1|spdx|spdx license identifier gpl 1 0(?: only| or later)?
gpl-classpath|1|classpath exception|classpath exception(?: 2 0)?
gpl-gcc-exception|1|gcc runtime library exception|gcc runtime library exception
gpl|2|general public license|gnu general public license
gpl|2|gnu gpl|gnu gpl
gpl|3|general public license|general public license
gpl|3|gpl|gpl
gpl|3|gpled|gpled
gpl|3|gnu org|gnu org licenses(?: gpl)?
lgpl-3|1|spdx|spdx license identifier lgpl 3 0(?: only| or later| plus)?
lgpl-3|1|lesser general public license|(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
lgpl-3|1|lgpl|lgpl ?v? ?3(?: 0)?
lgpl-2-1|1|spdx|spdx license identifier lgpl 2 1(?: only| or later| plus)?
lgpl-2-1|1|lesser general public license|(?:gnu )?lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-2-1|1|lgpl|lgpl ?v? ?2 1
lgpl-2|1|library general public license|library general public license(?: version 2)?
lgpl-2|1|spdx|spdx license identifier lgpl 2 0(?: only| or later| plus)?
lgpl|2|lesser general public license|(?:gnu )?lesser general public license
lgpl|2|lgpl|(?:gnu )?lgpl
lgpl|2|gnu org|gnu org licenses lgpl(?: html| txt)?
agpl-3|1|spdx|spdx license identifier agpl 3 0(?: only| or later| plus)?
agpl-3|1|affero general public license|(?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)? version 3
agpl-3|1|agpl|agpl ?v? ?3(?: 0)?
agpl|2|affero general public license|(?:gnu )?affero general public license
agpl|2|agpl|(?:gnu )?agpl
agpl|2|gnu org|gnu org licenses agpl(?: html| txt)?
gfdl-1-3|1|free documentation license|gnu free documentation license version 1 3
gfdl-1-2|1|free documentation license|gnu free documentation license version 1 2
gfdl-1-3|1|spdx|spdx license identifier gfdl 1 3(?: only| or later)?
gfdl|2|free documentation license|(?:gnu )?free documentation license
bsd-3|1|spdx|spdx license identifier bsd 3 clause(?: clear)?
bsd-3|1|bsd|(?:new|revised|modified|3 clause|three clause) bsd(?: licen[cs]e)?
bsd-3|1|bsd 3 clause|bsd 3 clause(?: licen[cs]e)?
bsd-3|1|nor the names of|neither the name of [a-z0-9 ]{1,80}nor the names of its contributors may be used to endorse or promote products
bsd-3|1|opensource org|opensource org licenses? bsd 3 clause
bsd-2|1|spdx|spdx license identifier bsd 2 clause(?: patent)?
bsd-2|1|bsd|(?:simplified|2 clause|two clause|freebsd) bsd(?: licen[cs]e)?
bsd-2|1|bsd 2 clause|bsd 2 clause(?: licen[cs]e)?
bsd-2|1|opensource org|opensource org licenses? bsd 2 clause
bsd-4|1|bsd 4 clause|bsd 4 clause(?: licen[cs]e)?
bsd-4|1|bsd|(?:original|4 clause|four clause|old) bsd(?: licen[cs]e)?
bsd-4|1|advertising materials|all advertising materials mentioning features or use of this software must display
bsd-4|1|spdx|spdx license identifier bsd 4 clause(?: uc)?
0bsd|1|spdx|spdx license identifier 0bsd
0bsd|1|bsd|zero clause bsd(?: licen[cs]e)?
bsd|2|redistribution and use in source and binary forms|redistribution and use in source and binary forms with or without modification are permitted
bsd|2|bsd licen|bsd licen[cs]ed?
bsd|2|bsd style|bsd style licen[cs]e
bsd|3|bsd|under(?: the)? bsd
mpl-2|1|mozilla public license|mozilla public license(?: v| version)? ?2(?: 0)?
mpl-2|1|spdx|spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2|1|mpl|mpl ?v? ?2(?: 0)?
mpl-2|1|mozilla org|mozilla org mpl 2 0
mpl-1-1|1|mozilla public license|mozilla public license(?: v| version)? ?1 1
mpl-1-1|1|spdx|spdx license identifier mpl 1 1
mpl-1-1|1|mpl|mpl ?v? ?1 1
mpl-1-0|1|mozilla public license|mozilla public license(?: v| version)? ?1 0
mpl|2|mozilla public license|mozilla public license
mpl|2|mozilla org|mozilla org mpl
epl-2|1|eclipse public license|eclipse public license(?: v| version)? ?2(?: 0)?
epl-2|1|spdx|spdx license identifier epl 2 0
epl-2|1|epl|epl ?v? ?2(?: 0)?
epl-1|1|eclipse public license|eclipse public license(?: v| version)? ?1(?: 0)?
epl-1|1|spdx|spdx license identifier epl 1 0
epl-1|1|epl|epl ?v? ?1(?: 0)?
epl|2|eclipse public license|eclipse public license
epl|2|eclipse org|eclipse org legal epl(?: v10| v20| 2 0)?(?: html)?
edl|1|eclipse distribution license|eclipse distribution license(?: v| version)?(?: 1 0)?
cddl-1|1|common development and distribution license|common development and distribution license(?: v| version)?(?: 1 [01])?
cddl-1|1|cddl|cddl ?v?(?: 1 [01])?
cddl-1|1|spdx|spdx license identifier cddl 1 [01]
cpl-1|1|common public license|common public license(?: v| version)?(?: 1 0)?
ibm-public|1|ibm public license|ibm public license(?: v| version)?(?: 1 0)?
artistic-2|1|artistic license|artistic license(?: v| version)? ?2(?: 0)?
artistic-2|1|spdx|spdx license identifier artistic 2 0
artistic-1|1|spdx|spdx license identifier artistic 1 0(?: perl)?
artistic|2|artistic license|artistic license
perl|1|same terms as perl|under the same terms as perl(?: itself)?
boost-1|1|boost software license|boost software license(?: v| version)?(?: 1 0)?
boost-1|1|spdx|spdx license identifier bsl 1 0
boost-1|1|boost org|boost org license 1 0 txt
zlib|1|spdx|spdx license identifier zlib
zlib|1|zlib|zlib (?:libpng )?licen[cs]e
libpng|1|libpng licen|libpng licen[cs]e(?: version 2)?
libpng|1|png reference library|png reference library licen[cs]e(?: version 2)?
unlicense|1|spdx|spdx license identifier unlicense
unlicense|1|unencumbered software released into the public domain|this is free and unencumbered software released into the public domain
unlicense|1|unlicense|(?:the unlicense|unlicense org)
wtfpl|1|do what the fuck you want to public license|do what the fuck you want to public license
wtfpl|1|wtfpl|wtfpl
beerware|1|beer ware license|the beer ware license
beerware|2|beerware licen|beerware licen[cs]e
python-2|1|python software foundation license|python software foundation license(?: version 2)?
python-2|1|spdx|spdx license identifier psf 2 0
python-2|2|psf license|psf license(?: agreement)?
ruby|1|ruby license|under the ruby license
php-3|1|php license|php license(?: v| version)?(?: 3(?: 0)?(?: 0?1)?)?
openssl|1|openssl license|openssl license
openldap|1|openldap public license|openldap public license(?: version 2 8)?
postgresql|1|postgresql license|postgresql license
postgresql|1|spdx|spdx license identifier postgresql
curl|1|spdx|spdx license identifier curl
ncsa|1|university of illinois|university of illinois(?: ncsa)? open source license
ncsa|1|spdx|spdx license identifier ncsa
ms-pl|1|microsoft public license|microsoft public license(?: ms pl)?
ms-pl|1|spdx|spdx license identifier ms pl
ms-rl|1|microsoft reciprocal license|microsoft reciprocal license(?: ms rl)?
osl-3|1|open software license|open software license(?: v| version)? ?3(?: 0)?
osl|2|open software license|open software license
afl-3|1|academic free license|academic free license(?: v| version)? ?3(?: 0)?
afl|2|academic free license|academic free license
ecl-2|1|educational community license|educational community license(?: v| version)?(?: 2 0)?
eupl-1-2|1|eupl|eupl(?: v| version)? ?1 2
eupl-1-1|1|eupl|eupl(?: v| version)? ?1 1
eupl|2|european union public licence|european union public licence
eupl|2|european union public license|european union public license
cecill|1|cecill|cecill (?:b |c )?(?:licen[cs]e|2 1|2 0)
cecill|1|spdx|spdx license identifier cecill(?: b| c)?(?: 2 [01])?
mulan-2|1|mulan psl|mulan psl ?v2 licen[cs]e
upl-1|1|universal permissive license|universal permissive license(?: v| version)?(?: 1 0)?
qpl|1|q public license|q public license(?: version 1 0)?
sil-ofl|1|sil open font license|sil open font license(?: v| version)?(?: 1 [01])?
sil-ofl|1|spdx|spdx license identifier ofl 1 1(?: rfn| no rfn)?
sil-ofl|2|open font license|open font license
vim|1|vim license|under the vim license
tcl|1|tcl license|tcl license
sleepycat|1|sleepycat|sleepycat (?:public )?license
w3c|1|w3c software|w3c software (?:notice and license|and document license|license)
unicode|1|unicode license agreement|unicode license agreement
intel|1|intel open source license|intel open source license
apsl-2|1|apple public source license|apple public source license(?: version 2 0)?
sun-isl|1|sun industry standards source license|sun industry standards source license
netscape|1|netscape public license|netscape public license(?: version 1 [01])?
lucent|1|lucent public license|lucent public license(?: version 1 0 2)?
zpl|1|zope public license|zope public license(?: zpl)?(?: version 2 [01])?
elastic-2|1|elastic license|elastic license(?: v| version)?(?: 2 0)?
sspl-1|1|server side public license|server side public license(?: v| version)?(?: 1)?
busl-1-1|1|business source license|business source license(?: v| version)?(?: 1 1)?
commons-clause|1|commons clause|commons clause (?:license )?condition
polyform-nc|1|polyform noncommercial license|polyform noncommercial license(?: 1 0 0)?
parity|1|parity public license|parity public license(?: 7 0 0)?
prosperity|1|prosperity public license|prosperity public license(?: 3 0 0)?
hippocratic|1|hippocratic license|hippocratic license(?: 2 1| 3 0)?
openrail-m|1|openrail m|(?:creativeml |bigscience |bigcode )?openrail m
openrail|2|openrail|openrail(?: licen[cs]e)?
rail|2|responsible ai license|responsible ai licenses?
community-model|2|community license agreement|community license agreement
cc0|1|spdx|spdx license identifier cc0 1 0
cc0|1|cc0|cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0|1|creativecommons org|creativecommons org publicdomain zero(?: 1 0)?
cc0|1|creative commons zero|creative commons zero(?: licen[cs]e)?
cc-pdm|1|creativecommons org|creativecommons org publicdomain mark(?: 1 0)?
cc-by-nc-nd|1|cc by nc nd|cc by nc nd(?: [1-4] 0)?
cc-by-nc-nd|1|creativecommons org|creativecommons org licenses by nc nd(?: [1-4] 0)?
cc-by-nc-nd|1|creative commons|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] 0)?
cc-by-nc-sa|1|cc by nc sa|cc by nc sa(?: [1-4] 0)?
cc-by-nc-sa|1|creativecommons org|creativecommons org licenses by nc sa(?: [1-4] 0)?
cc-by-nc-sa|1|creative commons|creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?
cc-by-nc|1|cc by nc|cc by nc [1-4] 0
cc-by-nc|2|cc by nc|cc by nc
cc-by-nc|2|creativecommons org|creativecommons org licenses by nc(?: [1-4] 0)?
cc-by-nc|2|creative commons|creative commons attribution non ?commercial(?: [1-4] 0)?
cc-by-nd|1|cc by nd|cc by nd(?: [1-4] 0)?
cc-by-nd|1|creativecommons org|creativecommons org licenses by nd(?: [1-4] 0)?
cc-by-nd|1|creative commons|creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] 0)?
cc-by-sa|1|cc by sa|cc by sa(?: [1-4] 0)?
cc-by-sa|1|creativecommons org|creativecommons org licenses by sa(?: [1-4] 0)?
cc-by-sa|1|creative commons|creative commons attribution share ?alike(?: [1-4] 0)?
cc-by|2|cc by|cc by [1-4] 0
cc-by|3|creativecommons org|creativecommons org licenses by(?: [1-4] 0)?
cc-by|3|creative commons|creative commons attribution(?: [1-4] 0)?
creative-commons|4|creative commons|creative commons(?: licen[cs]es?)?
creative-commons|4|creativecommons org|creativecommons org
odbl-1|1|open database license|open (?:data commons )?open database license(?: v1 0)?
odbl-1|2|odbl|odbl(?: 1 0)?
odc-by-1|1|open data commons attribution license|open data commons attribution license(?: v1 0)?
odc-by-1|1|odc by|odc by(?: 1 0)? licen[cs]e
pddl-1|1|public domain dedication and license|public domain dedication and license(?: v?1 0)?
ogl-uk-3|1|open government licence|open government licence(?: v| version)?(?: 3 0)?
etalab-2|1|licence ouverte|licence ouverte(?: open licence)?(?: 2 0)?
dl-de-by-2|1|datenlizenz deutschland|datenlizenz deutschland(?: namensnennung| zero)?(?: 2 0)?
cdla-permissive|1|community data license agreement|community data license agreement permissive(?: 1 0| 2 0)?
cdla-sharing|1|community data license agreement|community data license agreement sharing(?: 1 0)?
public-domain|2|public domain|(?:released|dedicated|placed|donated)(?: in| into| to)(?: the)? public domain
public-domain|3|public domain|in the public domain
all-rights-reserved|2|all rights reserved|all rights reserved
proprietary|2|proprietary and confidential|proprietary and confidential
proprietary|2|proprietary licen|proprietary licen[cs]e
proprietary|3|commercial license|commercial license(?: agreement)?
proprietary|3|end user license agreement|end user license agreement
copyright-notice|4|copyright|copyright (?:c )?(?:19|20)[0-9]{2}
warranty-disclaimer|4|without warrant|without warrant(?:y|ies)(?: of any kind| or conditions of any kind)?
warranty-disclaimer|4|merchantability|merchantability(?: and| or) fitness for a particular purpose
unknown-license|4|licensed under|licensed under
unknown-license|4|license agreement|license agreement
unknown-license|4|spdx license identifier|spdx license identifier
copyleft|4|copyleft|copyleft
open-source|4|open source licen|open source licen[cs]es?
"""

RULES = [(label, int(priority), keyword, pattern) for label, priority, keyword, pattern in (line.split("|", 3) for line in _TABLE.strip().splitlines())]

#: Every keyword holds one of these: a text without any of them cannot match a rule.
STEMS = [*_STEMS, *sorted({keyword for _, _, keyword, _ in RULES if not any(stem in keyword for stem in _STEMS)})]
