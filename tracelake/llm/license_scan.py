"""License scans: ordered signature rules over normalised words.

A text becomes lower-case words joined by single spaces, so a signature is a regex over words.
An Aho-Corasick automaton over the rules' keywords tells which rules can match at all; detections
are then taken by rule priority, and one that lies within a kept detection of the same or a higher
priority is suppressed. The base phrases are always kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from tracelake.llm.common import map_texts

#: Phrases that always count, with their labels.
BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; the others become spaces.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Rule(NamedTuple):
    label: str
    priority: int  # higher goes first
    keywords: tuple[str, ...]  # at least one of these stands in every text that the regex matches
    pattern: re.Pattern
    confidence: float


#: Hand-written regexes of names in words, by label, with keywords of which every match has one (parted by |), and the SPDX identifier in words.
FAMILIES = {
    "apache-1.1": (r"apache (?:software )?license (?:version |v)?1 1", "apache", "apache 1 1"),
    "apache-2.0": (r"apache (?:software )?license (?:version |v)?2(?: 0)?", "apache", "apache 2 0"),
    "gpl-1.0": (r"(?:gnu )?(?:general public license|gpl) (?:version |v)?1(?: 0)?", "gpl|general public", "gpl 1 0"),
    "gpl-2.0": (r"(?:gnu )?(?:general public license|gpl) (?:version |v)?2(?: 0)?", "gpl|general public", "gpl 2 0"),
    "gpl-3.0": (r"(?:gnu )?(?:general public license|gpl) (?:version |v)?3(?: 0)?", "gpl|general public", "gpl 3 0"),
    "lgpl-2.0": (r"(?:gnu )?(?:library general public license|lgpl) (?:version |v)?2(?: 0)?", "lgpl|general public", "lgpl 2 0"),
    "lgpl-2.1": (r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v)?2 1", "lgpl|general public", "lgpl 2 1"),
    "lgpl-3.0": (r"(?:gnu )?(?:lesser general public license|lgpl) (?:version |v)?3(?: 0)?", "lgpl|general public", "lgpl 3 0"),
    "agpl-3.0": (r"(?:gnu )?(?:affero general public license|agpl) (?:version |v)?3(?: 0)?", "agpl|general public", "agpl 3 0"),
    "mpl-1.1": (r"(?:mozilla public license|mpl) (?:version |v)?1 1", "mpl|mozilla", "mpl 1 1"),
    "mpl-2.0": (r"(?:mozilla public license|mpl) (?:version |v)?2(?: 0)?", "mpl|mozilla", "mpl 2 0"),
    "epl-1.0": (r"(?:eclipse public license|epl) (?:version |v)?1(?: 0)?", "epl|eclipse", "epl 1 0"),
    "epl-2.0": (r"(?:eclipse public license|epl) (?:version |v)?2(?: 0)?", "epl|eclipse", "epl 2 0"),
    "cddl-1.0": (r"common development and distribution license(?: (?:version |v)?1(?: 0)?)?", "common development", "cddl 1 0"),
    "cpl-1.0": (r"common public license(?: (?:version |v)?1(?: 0)?)?", "common public", "cpl 1 0"),
    "bsd-2-clause": (r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd", "bsd 2 clause"),
    "bsd-3-clause": (r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd", "bsd 3 clause"),
    "bsd-4-clause": (r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd", "bsd 4 clause"),
    "bsd-0-clause": (r"(?:zero clause bsd|0bsd|bsd zero clause)(?: license)?", "bsd", "0bsd"),
    "isc": (r"isc license", "isc", "isc"),
    "x11": (r"x11 license", "x11", "x11"),
    "mit-0": (r"mit no attribution(?: license)?", "mit", "mit 0"),
    "expat": (r"expat license", "expat", "expat"),
    "zlib": (r"(?:zlib|libpng|zlib libpng) license", "zlib|libpng", "zlib"),
    "boost-1.0": (r"boost software license(?: (?:version |v)?1(?: 0)?)?", "boost", "bsl 1 0"),
    "unlicense": (r"the unlicense", "unlicense", "unlicense"),
    "wtfpl": (r"do what the f[a-z]* you want to public license", "do what", "wtfpl"),
    "cc0-1.0": (r"(?:cc0|creative commons zero)(?: (?:version |v)?1(?: 0)?)?(?: universal)?", "cc|creative commons", "cc0 1 0"),
    "cc-by": (r"(?:creative commons attribution|cc by)(?: [1-4] 0)?(?: international| unported)?", "cc|creative commons", "cc by 4 0"),
    "cc-by-sa": (r"(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] 0)?(?: international| unported)?", "cc|creative commons", "cc by sa 4 0"),
    "cc-by-nd": (r"(?:creative commons attribution no ?deriv(?:ative|s|atives)|cc by nd)(?: [1-4] 0)?(?: international| unported)?", "cc|creative commons", "cc by nd 4 0"),
    "cc-by-nc": (r"(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] 0)?(?: international| unported)?", "cc|creative commons", "cc by nc 4 0"),
    "cc-by-nc-sa": (r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] 0)?(?: international| unported)?", "cc|creative commons", "cc by nc sa 4 0"),
    "cc-by-nc-nd": (r"(?:creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)|cc by nc nd)(?: [1-4] 0)?(?: international| unported)?", "cc|creative commons", "cc by nc nd 4 0"),
    "gfdl": (r"gnu free documentation license(?: (?:version |v)?1 [1-3])?", "free documentation", "gfdl 1 3"),
    "artistic-1.0": (r"artistic license (?:version |v)?1(?: 0)?", "artistic", "artistic 1 0"),
    "artistic-2.0": (r"artistic license (?:version |v)?2(?: 0)?", "artistic", "artistic 2 0"),
    "python-2.0": (r"(?:python software foundation|psf) license(?: (?:version |v)?2(?: 0)?)?", "psf|python software", "python 2 0"),
    "php-3.01": (r"php license(?: (?:version |v)?3 0?1)?", "php", "php 3 01"),
    "ruby": (r"ruby license", "ruby", "ruby"),
    "openssl": (r"openssl license", "openssl", "openssl"),
    "postgresql": (r"postgresql license", "postgresql", "postgresql"),
    "curl": (r"curl license", "curl", "curl"),
    "ofl-1.1": (r"(?:sil )?open font license(?: (?:version |v)?1 1)?", "open font", "ofl 1 1"),
    "eupl-1.2": (r"european union public licen[cs]e(?: (?:version |v)?1 2)?", "european union", "eupl 1 2"),
    "osl-3.0": (r"open software license(?: (?:version |v)?3(?: 0)?)?", "open software", "osl 3 0"),
    "afl-3.0": (r"academic free license(?: (?:version |v)?3(?: 0)?)?", "academic free", "afl 3 0"),
    "ecl-2.0": (r"educational community license(?: (?:version |v)?2(?: 0)?)?", "educational community", "ecl 2 0"),
    "ms-pl": (r"microsoft public license", "microsoft public", "ms pl"),
    "ms-rl": (r"microsoft reciprocal license", "microsoft reciprocal", "ms rl"),
    "ncsa": (r"(?:university of illinois )?ncsa(?: open source)? license", "ncsa", "ncsa"),
    "upl-1.0": (r"universal permissive license(?: (?:version |v)?1(?: 0)?)?", "universal permissive", "upl 1 0"),
    "odbl-1.0": (r"open (?:data commons open )?database license", "database license", "odbl 1 0"),
    "pddl-1.0": (r"public domain dedication and license", "public domain", "pddl 1 0"),
    "sspl-1.0": (r"server side public license", "server side", "sspl 1 0"),
    "busl-1.1": (r"business source license(?: (?:version |v)?1 1)?", "business source", "busl 1 1"),
    "elastic-2.0": (r"elastic license(?: (?:version |v)?2(?: 0)?)?", "elastic", "elastic 2 0"),
    "qpl-1.0": (r"q public license", "q public", "qpl 1 0"),
    "ipl-1.0": (r"ibm public license", "ibm public", "ipl 1 0"),
    "apsl-2.0": (r"apple public source license", "apple public", "apsl 2 0"),
    "vim": (r"vim license", "vim", "vim"),
    "beerware": (r"beer ?ware license", "beer", "beerware"),
}

#: What ends the clause on names; any number of words stands before it, up to the next such clause, so that a scan stays linear.
_PROMOTE = "may be used to endorse or promote products"

#: Hand-written signatures of license texts, notices and clues, a line each: label, priority, keyword, regex over words, confidence.
SIGNATURES = r"""
# Permissive texts.
mit|90|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy of this software|0.99
mit|88|shall be included in all copies|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software|0.95
mit|86|to deal in the software|to deal in the software without restriction including without limitation|0.95
mit|60|authors or copyright holders be liable|in no event shall the authors or copyright holders be liable for any claim|0.85
mit|75|mit|(?:released|distributed|licensed|available|provided|published|covered) under (?:the )?(?:terms of (?:the )?)?mit(?: license)?|0.95
mit|100|spdx license identifier|spdx license identifier mit(?! (?:0|no))|1.0
mit|58|mit|mit (?:style|like|type|compatible) license|0.7
x11|89|except as contained in this notice|except as contained in this notice the names? of|0.9
x11|70|x consortium|the x consortium be liable|0.9
expat|60|mit|mit expat(?: license)?|0.8
curl|91|name of a copyright holder shall|except as contained in this notice the name of a copyright holder shall not be used in advertising|0.95
json|92|used for good|the software shall be used for good not evil|0.99
ncsa|91|to deal with the software|to deal with the software without restriction including without limitation|0.97
upl-1.0|91|associated documentation and or data|any person obtaining a copy of this software associated documentation and or data|0.98
isc|90|permission to use copy modify|permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted|0.95
isc|70|this permission notice appear|the above copyright notice and this permission notice appear in all copies|0.8
hpnd|89|without fee is hereby granted|permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted|0.95
ntp|89|with or without fee is hereby granted|permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted|0.95
postgresql|92|without a written agreement|for any purpose without fee and without a written agreement is hereby granted|0.98
libtiff|90|distribute and sell this software|permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee|0.95
tcl|90|hereby grant permission to use|the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose|0.97
bsd-2-clause|85|redistribution and use in source|redistribution and use in source and binary forms with or without modification are permitted|0.9
bsd-2-clause|80|redistributions of source code must retain|redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer|0.9
bsd-2-clause|79|redistributions in binary form must|redistributions in binary form must reproduce the above copyright notice|0.85
bsd-4-clause|88|all advertising materials|all advertising materials mentioning features or use of this software|0.9
bsd-3-clause-clear|91|no express or implied licenses|no express or implied licenses to any party s patent rights are granted by this license|0.97
bsd-2-clause-patent|91|each copyright holder and contributor|each copyright holder and contributor hereby grants to those receiving rights under this license|0.97
bsd|55|copyright holders and contributors as is|this software is provided by the copyright holders and contributors as is|0.8
bsd|55|regents|this software is provided by the regents and contributors as is|0.85
bsd|52|regents of the university|the regents of the university of california|0.5
bsd|45|bsd|bsd (?:style )?license|0.7
bsd|46|bsd|(?:released|distributed|licensed|available) under (?:the )?(?:terms of (?:the )?)?bsd|0.75
freebsd-doc|85|redistribution and use in source|redistribution and use in source sgml docbook and compiled forms|0.95
apache-2.0|90|you may not use this file except|you may not use this file except in compliance with the license|0.9
apache-2.0|92|www apache org licenses|www apache org licenses license 2 0|0.99
apache-2.0|91|apache software foundation|licensed to the apache software foundation asf under one or more contributor license agreements|0.99
apache-2.0|84|software distributed under the license|software distributed under the license is distributed on an as is basis|0.85
apache-2.0|93|january 2004|apache license version 2 0 january 2004|0.99
apache-2.0|83|grant of patent license|grant of patent license subject to the terms and conditions of this license each contributor hereby grants|0.95
apache-1.0|92|apache group|software developed by the apache group for use in the apache http server project|0.98
apache-1.1|91|apache software foundation|this product includes software developed by the apache software foundation|0.9
apache-1.1|90|apache software foundation|the names apache and apache software foundation must not be used|0.95
zlib|85|provided as is without any express|this software is provided as is without any express or implied warranty in no event will the authors|0.9
zlib|86|origin of this software|the origin of this software must not be misrepresented|0.9
zlib|80|altered source versions|altered source versions must be plainly marked as such|0.85
libpng|88|png reference library|the png reference library is supplied as is|0.98
libpng|87|origin of this source code|the origin of this source code must not be misrepresented|0.95
bzip2|70|libbzip2|bzip2 and libbzip2|0.6
boost-1.0|90|permission is hereby granted|permission is hereby granted free of charge to any person or organization obtaining a copy of the software|0.99
boost-1.0|92|17th august 2003|boost software license version 1 0 17th august 2003|0.99
boost-1.0|92|august 17th 2003|boost software license version 1 0 august 17th 2003|0.99
python-2.0|90|psf license agreement|psf license agreement for python|0.98
python-2.0|88|python software foundation|python software foundation license version 2|0.97
cnri-python|90|cnri|cnri (?:open source )?license agreement|0.95
beopen-python|90|beopen|beopen python open source license agreement|0.97
php-3.01|90|php license|this source file is subject to version 3 01 of the php license|0.99
php-3.0|90|php license|this source file is subject to version 3 0 of the php license|0.98
php-3.01|70|includes php|this product includes php (?:software )?freely available from|0.8
zend-2.0|90|zend license|this source file is subject to version 2 00 of the zend license|0.98
openssl|91|openssl project|software developed by the openssl project for use in the openssl toolkit|0.98
ssleay|91|eric young|this product includes (?:cryptographic )?software written by eric young|0.97
ssleay|80|publically available version|the license and distribution terms for any publically available version or derivative of this code cannot be changed|0.95
w3c|88|w3c|w3c software (?:notice and )?license|0.9
w3c|86|obtaining using and or copying this work|by obtaining using and or copying this work you|0.9
icu|88|icu|icu license icu 1 8 1 and later|0.97
unicode|90|unicode|unicode inc license agreement data files and software|0.98
unicode|85|unicode|unicode (?:license v3|terms of use)|0.8
ftl|88|freetype|the freetype project license|0.95
ftl|80|freetype|portions of this software are copyright (?:c )?(?:[0-9]+ )?the freetype project|0.9
ijg|88|independent jpeg group|based in part on the work of the independent jpeg group|0.95
info-zip|90|info zip|for the purposes of this copyright and license info zip is defined as|0.98
zpl-2.1|85|zope|zope public license(?: zpl)?(?: version)?(?: 2 1)?|0.9
blessing|92|good and not evil|may you do good and not evil|0.97
blessing|92|find forgiveness|may you find forgiveness for yourself and forgive others|0.99
beerware|85|beer in return|you can buy me a beer in return|0.9
beerware|84|whatever you want with this stuff|as long as you retain this notice you can do whatever you want with this stuff|0.97
wtfpl|85|do what the|you just do what the f[a-z]* you want to|0.9
wtfpl|90|verbatim or modified copies|everyone is permitted to copy and distribute verbatim or modified copies of this license document|0.97
unlicense|90|released into the public domain|free and unencumbered software released into the public domain|0.99
unlicense|88|compile sell or distribute|anyone is free to copy modify publish use compile sell or distribute this software|0.97
unlicense|87|dedicate any and all copyright|dedicate any and all copyright interest in the software to the public domain|0.95
public-domain|55|public domain|(?:is|placed|released|dedicated) (?:in|into|to) the public domain|0.8
public-domain|56|disclaim|(?:hereby )?disclaims? (?:all )?copyright (?:to|in|on) this (?:source code|software|work)|0.8
cc0-1.0|90|to the extent possible under law|to the extent possible under law|0.8
cc0-1.0|92|waived all copyright|waived all copyright and related or neighboring rights|0.98
cc0-1.0|91|cc0|cc0 1 0 universal|0.98
blueoak-1.0|85|blue oak|blue oak model license(?: (?:version )?1 0 0)?|0.95
# Copyleft texts.
gpl|70|free software you can redistribute|(?:this|it) (?:program |library )?is free software you can redistribute it and or modify|0.9
gpl-or-later|86|any later version|either version [23](?: of the license)? or at your option any later version|0.9
gpl|88|published by the free software foundation|gnu general public license as published by the free software foundation|0.97
gpl|72|copy of the gnu general public license|you should have received a copy of the gnu general public license along with|0.9
gpl-1.0|93|february 1989|gnu general public license version 1 february 1989|0.99
gpl-2.0|93|june 1991|gnu general public license version 2 june 1991|0.99
gpl-3.0|93|29 june 2007|gnu general public license version 3 29 june 2007|0.99
gpl-2.0-only|87|version 2|(?:only version 2|version 2 only|version 2 of the license only)|0.8
gpl-2.0|75|gpl|gpl ?v2(?: 0)?|0.8
gpl-3.0|75|gpl|gpl ?v3(?: 0)?|0.8
gpl|40|gnu gpl|(?:the )?gnu gpl|0.6
fsf-text|50|changing it is not allowed|everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed|0.7
gpl|73|www gnu org|www gnu org licenses gpl(?: html| 2 0| 3 0)?|0.85
lgpl|74|www gnu org|www gnu org licenses lgpl(?: html| 2 1| 3 0)?|0.85
agpl-3.0|74|www gnu org|www gnu org licenses agpl(?: html| 3 0)?|0.85
classpath-exception|92|making a combined work|linking this library statically or dynamically with other modules is making a combined work|0.98
gcc-exception|90|gcc|gcc runtime library exception|0.95
autoconf-exception|92|autoconf|configuration script generated by autoconf|0.95
bison-exception|92|bison parser skeleton|contains part or all of the bison parser skeleton|0.97
font-exception|91|document which uses this font|if you create a document which uses this font|0.95
openssl-exception|91|openssl library|link the code of portions of this program with the openssl library|0.95
gpl-exception|60|as a special exception|as a special exception|0.6
lgpl-2.1|93|february 1999|gnu lesser general public license version 2 1 february 1999|0.99
lgpl-2.0|94|library general public license|gnu library general public license version 2 june 1991|0.99
lgpl-3.0|94|29 june 2007|gnu lesser general public license version 3 29 june 2007|0.99
lgpl|89|lesser general public license|gnu lesser general public license as published by the free software foundation|0.97
lgpl|88|library general public license|gnu library general public license as published by the free software foundation|0.97
lgpl|76|copy of the gnu|you should have received a copy of the gnu (?:lesser|library) general public license|0.92
lgpl|48|lesser general public license|(?:gnu )?lesser general public license|0.75
agpl-3.0|94|19 november 2007|gnu affero general public license version 3 19 november 2007|0.99
agpl|89|affero general public license|gnu affero general public license as published by the free software foundation|0.97
agpl|76|affero general public license|you should have received a copy of the gnu affero general public license|0.92
agpl-3.0|85|remote network interaction|remote network interaction use with the gnu general public license|0.97
agpl|48|affero general public license|(?:gnu )?affero general public license|0.75
gfdl|90|free documentation license|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license|0.99
gfdl|85|invariant sections|with no invariant sections no front cover texts and no back cover texts|0.95
mpl-2.0|90|this source code form is subject|this source code form is subject to the terms of the mozilla public license v 2 0|0.99
mpl-2.0|88|copy of the mpl|if a copy of the mpl was not distributed with this file you can obtain one at|0.98
mpl-2.0|84|secondary licenses|incompatible with secondary licenses|0.9
mpl-1.1|91|mozilla public license|the contents of this file are subject to the mozilla public license version 1 1|0.99
mpl-1.0|91|mozilla public license|the contents of this file are subject to the mozilla public license version 1 0|0.99
mpl|46|mozilla public license|mozilla public license|0.7
npl-1.1|91|netscape public license|the contents of this file are subject to the netscape public license|0.98
dual|50|alternatively the contents of this file|alternatively the contents of this file may be used under the terms of|0.6
epl-2.0|92|eclipse public license|made available under the terms of the eclipse public license (?:v |version )?2 0|0.99
epl-1.0|92|eclipse public license|made available under the terms of the eclipse public license (?:v |version )?1 0|0.99
epl|90|eclipse public license|provided under the terms of this eclipse public license agreement|0.95
cpl-1.0|91|common public license|provided under the terms of this common public license|0.98
ipl-1.0|91|ibm public license|provided under the terms of this ibm public license|0.98
cddl-1.0|91|common development and distribution|the contents of this file are subject to the terms of the common development and distribution license|0.98
cddl-1.0|85|cddl header|include this cddl header notice in each file|0.95
eupl-1.2|85|eupl|licensed under the eupl(?: version)?(?: 1 2)?|0.95
eupl|90|eupl|this european union public licence the eupl applies to the work|0.99
osl-3.0|88|open software license|licensed under the open software license version 3 0|0.98
afl-3.0|88|academic free license|licensed under the academic free license version 3 0|0.98
ecl-2.0|88|educational community license|licensed under the educational community license version 2 0|0.98
artistic-1.0|90|semblance of artistic control|the copyright holder maintains some semblance of artistic control|0.98
artistic-2.0|90|given free software package|this license establishes the terms under which a given free software package may be copied|0.98
perl|80|same terms as perl|under the same terms as perl(?: itself)?|0.9
apsl-2.0|91|apple public source license|original code and or modifications of original code as defined in and that are subject to the apple public source license|0.98
sleepycat|90|db software|how to obtain complete source code for the db software|0.97
qpl-1.0|88|q public license|the q public license version 1 0|0.97
vim|85|charityware|vim is charityware|0.97
rpl-1.5|85|reciprocal public license|(?:the )?reciprocal public license(?: version)?(?: 1 [15])?|0.9
cecill|85|cecill|cecill(?: [bc])?(?: free software)? license(?: agreement)?|0.9
cecill|88|contrat est une licence|ce contrat est une licence de logiciel libre|0.97
lppl|86|latex project public license|(?:the )?latex project public license(?: version)?(?: 1 3[ac]?)?|0.95
lppl|90|latex project public license|distributed and or modified under the conditions of the latex project public license|0.98
sspl-1.0|93|october 16 2018|server side public license version 1 october 16 2018|0.99
sspl-1.0|88|service source code|make the service source code available|0.9
parity-7.0|85|parity public license|(?:the )?parity public license(?: 7 0 0)?|0.95
nasa-1.3|85|nasa open source|nasa open source agreement(?: version)?(?: 1 3)?|0.95
ms-rl|84|you accept this license|this license governs use of the accompanying software if you use the software you accept this license|0.85
# Works, fonts and data.
cc|80|licensed under a creative commons|this work is licensed under a creative commons|0.9
cc-by|56|creativecommons org licenses|creativecommons org licenses by(?! (?:nc|nd|sa))|0.9
cc-by-sa|57|creativecommons org licenses|creativecommons org licenses by sa|0.95
cc-by-nd|57|creativecommons org licenses|creativecommons org licenses by nd|0.95
cc-by-nc|57|creativecommons org licenses|creativecommons org licenses by nc(?! (?:nd|sa))|0.95
cc-by-nc-sa|58|creativecommons org licenses|creativecommons org licenses by nc sa|0.95
cc-by-nc-nd|58|creativecommons org licenses|creativecommons org licenses by nc nd|0.95
cc0-1.0|58|creativecommons org publicdomain|creativecommons org publicdomain zero|0.97
public-domain|57|creativecommons org publicdomain|creativecommons org publicdomain mark|0.9
cc-by|70|attribution 4 0|attribution 4 0 international|0.9
cc-by-sa|70|sharealike 4 0|attribution sharealike 4 0 international|0.95
cc-by-sa|70|sharealike 3 0|attribution sharealike 3 0 unported|0.95
cc|60|cannot revoke these freedoms|the licensor cannot revoke these freedoms as long as you follow the license terms|0.9
cc|60|redistribute the material|copy and redistribute the material in any medium or format|0.85
cc-by-nc|62|material for commercial purposes|you may not use the material for commercial purposes|0.9
cc-by-sa|62|contributions under the same license|you must distribute your contributions under the same license|0.9
cc-by-nd|62|distribute the modified material|you may not distribute the modified material|0.9
cc|45|creative commons|creative commons(?: license)?|0.6
ofl-1.1|91|open font license|this font software is licensed under the sil open font license|0.99
ofl-1.1|85|font software|neither the font software nor any of its individual components|0.97
ofl-1.1|60|reserved font name|reserved font names?|0.85
ubuntu-font|85|ubuntu font|ubuntu font licen[cs]e(?: version)?(?: 1 0)?|0.95
ipa-font|85|ipa font|ipa font license(?: agreement)?(?: v1 0)?|0.95
bitstream-vera|85|bitstream vera|bitstream vera is a trademark of bitstream inc|0.95
odbl-1.0|90|open database license|made available under the open database license|0.97
odbl-1.0|80|database contents license|licensed under the database contents license|0.9
odc-by-1.0|85|open data commons attribution|open data commons attribution license|0.95
ogl-uk|85|open government|open government licen[cs]e(?: v)?(?: ?[123](?: 0)?)?|0.9
ogl-1.0a|85|open game license|open game license(?: version)?(?: 1 0a)?|0.95
lgpllr|95|linguistic resources|lesser general public license for linguistic resources|0.97
# Terms with limits on use.
busl-1.1|90|non production use|make non production use of the licensed work|0.98
busl-1.1|80|change date|effective on the change date|0.85
elastic-2.0|90|hosted or managed service|you may not provide the software to third parties as a hosted or managed service|0.98
commons-clause|90|commons clause|commons clause(?: license condition)?|0.95
commons-clause|88|right to sell the software|does not grant to you the right to sell the software|0.97
polyform|85|polyform|polyform (?:noncommercial|small business|free trial|internal use|perimeter|shield|strict) license(?: 1 0 [01])?|0.97
confluent|85|confluent community|confluent community license(?: agreement)?|0.97
prosperity|85|prosperity public|(?:the )?prosperity public license(?: 3 0 0)?|0.97
hippocratic|85|hippocratic|hippocratic license(?: (?:version )?[23] [01])?|0.95
openrail|85|rail|(?:creativeml |bigscience |bigcode )?open ?rail(?: ?\+{0,2}[ms])? license|0.9
llama|86|llama|llama (?:2 |3 |3 [123] |4 )?community license(?: agreement)?|0.97
gemma|86|gemma|gemma terms of use|0.95
ms-lpl|85|microsoft limited|microsoft limited public license|0.95
ms-terms|80|microsoft software license|microsoft software license terms|0.95
nvidia|80|nvidia|nvidia (?:software|source code|cuda|omniverse) license(?: agreement)?|0.9
intel|80|intel|intel (?:open source|simplified software) license|0.9
oracle-bcl|85|binary code license|(?:oracle|sun(?: microsystems inc)?) binary code license agreement|0.97
oracle-otn|85|oracle technology network|oracle technology network license agreement|0.97
oracle-nftc|85|no fee terms|oracle no fee terms and conditions|0.97
sissl|85|sun industry|sun industry standards source license|0.97
adobe|80|adobe systems|adobe systems incorporated(?: s)? source code license(?: agreement)?|0.95
ibm|70|licensed materials|licensed materials property of ibm|0.95
us-government|60|government users restricted|(?:us |u s )?government users restricted rights|0.8
noncommercial|65|only|for (?:academic|research|non ?commercial|evaluation|educational|personal)(?: (?:and|or) (?:academic|research|non ?commercial|evaluation|educational|personal))? (?:use|purposes?) only|0.8
noncommercial|62|free for|free for (?:personal|private|non ?commercial|educational|academic) use|0.75
shareware|60|shareware|shareware|0.6
freeware|60|freeware|freeware|0.6
commercial|50|commercial license|commercial license(?: agreement)?|0.6
eula|60|end user license agreement|end user license agreement|0.8
proprietary|40|all rights reserved|all rights reserved|0.4
proprietary|60|proprietary and confidential|proprietary and confidential|0.8
proprietary|62|is strictly prohibited|unauthorized (?:copying|use|distribution|reproduction) (?:of this (?:file|software|document|work) )?(?:via any medium )?is strictly prohibited|0.9
proprietary|61|proprietary|(?:confidential and )?proprietary (?:information|property) of|0.8
proprietary|55|internal use only|for internal use only|0.7
proprietary|54|not for|not for (?:re)?distribution|0.6
proprietary|45|trade secret|trade secrets?|0.4
publication|55|may be reproduced|no part of this (?:publication|book|document|work|report) may be reproduced|0.8
dual|52|dual|dual(?:ly)? licensed under|0.8
file-reference|35|see|see (?:the )?(?:file )?(?:license|copying|copyright|notice)(?: file| txt| md)? for (?:more )?(?:details|information|the full)|0.5
no-warranty|30|without warrant|without warrant(?:y|ies) (?:of any kind|or conditions)|0.3
no-warranty|31|merchantability|implied warrant(?:y|ies) of merchantability|0.4
patent|40|patent|patents? pending|0.3
copyright|20|copyright|copyright (?:c )?(?:19|20)[0-9]{2}|0.2
"""
#: Signatures with their own parts.
_PARTS = (("bsd-3-clause", 88, "neither the name", rf"neither the names? of (?:(?!{_PROMOTE}(?![^ ])|neither the names? of )[^ ]++ )++{_PROMOTE}", 0.9),)


def _signatures() -> list[tuple[str, int, str, str, float]]:
    """Lines of SIGNATURES; a regex may hold the mark that parts their fields."""
    out = list(_PARTS)
    for line in SIGNATURES.strip().split("\n"):
        if not line.startswith("#"):
            label, priority, key, rest = line.split("|", 3)
            regex, sure = rest.rsplit("|", 1)
            out.append((label, int(priority), key, regex, float(sure)))
    return out


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, by falling priority and then in the order above."""
    whole = lambda regex: re.compile(rf"(?<![^ ]){regex}(?![^ ])".encode())
    made = [Rule(label, priority, (key,), whole(regex), sure) for label, priority, key, regex, sure in _signatures()]
    for label, (name, keys, spdx) in FAMILIES.items():
        made.append(Rule(label, 80, tuple(keys.split("|")), whole(f"(?:released|distributed|licensed|available|provided|published|covered) under (?:the )?(?:terms of (?:the )?)?(?:{name})"), 0.95))
        made.append(Rule(label, 50, tuple(keys.split("|")), whole(f"(?:the )?(?:{name})(?: as published by the free software foundation)?"), 0.8))
        made.append(Rule(label, 100, ("spdx license identifier",), whole(f"spdx license identifier {spdx}(?: only| or later)?"), 1.0))
    return tuple(sorted(made, key=lambda r: -r.priority))


@cache
def _automaton() -> ahocorasick.Automaton:
    """Finds keywords; each gives its rules' places in rules()."""
    by_key: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for key in r.keywords:
            by_key.setdefault(key, []).append(i)
    found = ahocorasick.Automaton()
    for key, which in by_key.items():
        found.add_word(key, (key, tuple(which)))
    found.make_automaton()
    return found


def detect(norm: bytes) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) in normalised words that no kept detection of at least their priority contains."""
    text = norm.decode("latin-1")
    keys = {key: which for _, (key, which) in _automaton().iter(text)}
    possible = sorted({i for which in keys.values() for i in which})
    every = [(r.priority, m.start(), m.end(), i) for i in possible for r in (rules()[i],) for m in r.pattern.finditer(norm) if m.end() > m.start()]
    every.sort(key=lambda d: (-d[0], d[1] - d[2], d[1], d[3]))
    starts: list[int] = []  # of kept intervals none of which lies within another: their ends rise too
    ends: list[int] = []
    kept = []
    for _, a, b, i in every:
        at = bisect_right(starts, a) - 1
        if at >= 0 and ends[at] >= b:
            continue
        kept.append((a, b, rules()[i]))
        low, high = bisect_left(starts, a), bisect_right(ends, b)
        if low <= high:
            starts[low:high], ends[low:high] = [a], [b]
        else:
            starts.insert(low, a)
            ends.insert(low, b)
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def scan_text(text: str) -> dict:
    """n_words, base places and detections of one text; starts and ends count words."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    norm = b" ".join(words)
    at, labels = [], []
    for phrase, label in BASE:
        if phrase in norm:
            padded, need = b" " + norm + b" ", b" " + phrase + b" "
            k = padded.find(need)
            before, last = 0, 0
            while k >= 0:
                before += norm.count(b" ", last, k)
                last = k
                at.append(before)
                labels.append(label)
                k = padded.find(need, k + 1)
    found = detect(norm)
    spans, last, before = [], 0, 0
    for a, b, r in found:
        before += norm.count(b" ", last, a)
        last = a
        spans.append({"start": before, "end": before + norm.count(b" ", a, b) + 1, "label": r.label, "priority": r.priority, "confidence": r.confidence})
    return {"n_words": len(words), "base_at": at, "base_labels": sorted(set(labels)), "detections": spans}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,priority:int,confidence:double>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs with SCHEMA: base places, all labels, the highest confidence, and the detections kept.

    A null or empty text has no words, no labels and score 0; repeated rows get equal results;
    extra columns are left out. Whole texts only: a match may stand anywhere.
    """

    def work(ids: list, texts: list) -> dict:
        got = [scan_text(t) for t in texts]
        return {
            "doc_id": ids,
            "n_words": [g["n_words"] for g in got],
            "n_base": [len(g["base_at"]) for g in got],
            "first_word": [min(g["base_at"], default=None) for g in got],
            "last_word": [max(g["base_at"], default=None) for g in got],
            "base_labels": [",".join(g["base_labels"]) for g in got],
            "labels": [",".join(sorted({*g["base_labels"], *(d["label"] for d in g["detections"])})) for g in got],
            "score": [max([0.7 * bool(g["base_at"]), *(d["confidence"] for d in g["detections"])]) for g in got],
            "detections": [g["detections"] for g in got],
        }

    return map_texts(docs, work, SCHEMA, doc_id, text)
