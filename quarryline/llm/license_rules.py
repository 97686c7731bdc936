"""Signature rules of license statements.

One rule a line: label | priority | keyword | regular expression.  Patterns
are matched against a text's lower-cased words, joined by single spaces, and
always match whole words.  The keyword stands in every match; a pattern is
tried only where its keyword occurs.  Of overlapping detections the priority
decides: 5 exact identifiers, 4 sentences of the license text, 3 notices that
name a license and its version, 2 names, 1 mentions.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    keyword: str
    pattern: str


_TEXT = r"""
mit|5|spdx license identifier mit|spdx license identifier mit
mit|4|permission is hereby granted free of charge|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit|4|without restriction including|deal in the software without restriction including without limitation the rights
mit|4|above copyright notice and this permission notice|the above copyright notice and this permission notice shall be included in all copies
mit|3|mit license|(?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit license
mit|3|mit license|(?:the )?mit license mit
mit|3|mit license|license mit license
mit|2|mit license|mit license
mit|2|mit licence|mit licence
mit|2|expat license|expat license
mit|2|mit licensed|mit licensed
mit|1|opensource org licenses mit|opensource org licenses mit(?: license)?
mit-0|5|spdx license identifier mit 0|spdx license identifier mit 0
mit-0|3|mit no attribution|mit no attribution(?: license)?
x11|3|x11 license|(?:mit )?x11 license
x11|4|x consortium|except as contained in this notice the name of the x consortium shall not be used
apache-2.0|5|spdx license identifier apache 2|spdx license identifier apache 2 0
apache-2.0|3|apache license version 2|(?:the )?apache license version 2(?: 0)?
apache-2.0|3|apache license 2|(?:the )?apache license 2(?: 0)?
apache-2.0|3|apache license v2|(?:the )?apache license v2(?: 0)?
apache-2.0|3|apache 2|(?:licensed|released|distributed|available) under (?:the )?apache 2(?: 0)?(?: license)?
apache-2.0|2|apache 2|apache 2(?: 0)? license
apache-2.0|2|apache v2|apache v2(?: 0)?(?: license)?
apache-2.0|1|apache org licenses license 2|(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0|4|you may not use this file except|you may not use this file except in compliance with the license
apache-2.0|4|distributed under the license is distributed on an|distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0|4|contributor license agreements|licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0|4|terms and conditions for use reproduction|terms and conditions for use reproduction and distribution 1 definitions
apache-1.1|5|spdx license identifier apache 1 1|spdx license identifier apache 1 1
apache-1.1|3|apache software license|apache software license version 1 1
apache-1.0|5|spdx license identifier apache 1 0|spdx license identifier apache 1 0
apache-1.1|4|this product includes software developed by the apache|this product includes software developed by the apache (?:group|software foundation)
apache|2|apache license|apache license
apache|2|apache licence|apache licence
apache|2|apache licensed|apache licensed
apache|1|apache public license|apache public license
gpl-2.0|5|spdx license identifier gpl 2|spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later|5|or later|spdx license identifier gpl 2 0 or later
gpl-3.0|5|spdx license identifier gpl 3|spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later|5|or later|spdx license identifier gpl 3 0 or later
gpl-1.0|5|spdx license identifier gpl 1|spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0|3|general public license version 2|(?:gnu )?general public license version 2(?: 0)?(?: june 1991)?
gpl-3.0|3|general public license version 3|(?:gnu )?general public license version 3(?: 0)?(?: 29 june 2007)?
gpl-2.0|3|general public license v2|(?:gnu )?general public license v2(?: 0)?
gpl-3.0|3|general public license v3|(?:gnu )?general public license v3(?: 0)?
gpl-1.0|3|general public license version 1|(?:gnu )?general public license version 1(?: 0)?
gpl-2.0-or-later|4|either version 2 of the license|either version 2 of the license or at your option any later version
gpl-3.0-or-later|4|either version 3 of the license|either version 3 of the license or at your option any later version
gpl|4|under the terms of the gnu general public license|redistribute it and or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?
gpl|4|received a copy of the gnu general public license|you should have received a copy of the gnu general public license along with this (?:program|software|file|library|package)
gpl|4|the licenses for most software|the licenses for most software are designed to take away your freedom to share and change it
gpl|4|everyone is permitted to copy|everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl|2|general public license|(?:gnu )?general public license
gpl|2|general public licence|(?:gnu )?general public licence
gpl|2|gnu gpl|gnu gpl
gpl-2.0|2|gplv2|gplv2
gpl-3.0|2|gplv3|gplv3
gpl-2.0|2|gpl v2|(?:gnu )?gpl v2(?: 0)?
gpl-3.0|2|gpl v3|(?:gnu )?gpl v3(?: 0)?
gpl-2.0|2|gpl version 2|(?:gnu )?gpl version 2(?: 0)?
gpl-3.0|2|gpl version 3|(?:gnu )?gpl version 3(?: 0)?
gpl|1|gnu org licenses gpl|(?:www )?gnu org licenses gpl(?: html| txt)?
gpl|1|gpl license|gpl licensed?
gpl-2.0-classpath|3|classpath exception|(?:gpl 2 0 )?(?:with )?(?:the )?classpath exception(?: 2 0)?
gpl-3.0-gcc|3|gcc runtime library exception|gcc runtime library exception(?: version 3 1)?
gpl-bison|3|bison exception|(?:with )?(?:the )?bison exception(?: 2 2)?
lgpl-2.0|5|spdx license identifier lgpl 2 0|spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1|5|spdx license identifier lgpl 2 1|spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0|5|spdx license identifier lgpl 3|spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.0|3|library general public license|(?:gnu )?library general public license(?: version 2(?: 0)?)?
lgpl-2.1|3|lesser general public license version 2|(?:gnu )?lesser general public license version 2(?: 1)?(?: february 1999)?
lgpl-3.0|3|lesser general public license version 3|(?:gnu )?lesser general public license version 3(?: 0)?
lgpl|3|lesser general public license|(?:gnu )?lesser general public license
lgpl|3|lesser general public licence|(?:gnu )?lesser general public licence
lgpl|4|received a copy of the gnu lesser|you should have received a copy of the gnu lesser general public license along with this (?:program|software|file|library)
lgpl-2.1|2|lgplv2|lgplv2(?: 1)?
lgpl-3.0|2|lgplv3|lgplv3
lgpl-2.1|2|lgpl 2 1|(?:gnu )?lgpl 2 1
lgpl-3.0|2|lgpl 3|(?:gnu )?lgpl 3(?: 0)?
lgpl|2|gnu lgpl|gnu lgpl
lgpl|1|gnu org licenses lgpl|(?:www )?gnu org licenses lgpl(?: html| txt)?
agpl-3.0|5|spdx license identifier agpl 3|spdx license identifier agpl 3 0(?: only| or later)?
agpl-1.0|5|spdx license identifier agpl 1|spdx license identifier agpl 1 0(?: only| or later)?
agpl-3.0|3|affero general public license version 3|(?:gnu )?affero general public license version 3(?: 0)?
agpl|3|affero general public license|(?:gnu )?affero general public license
agpl-3.0|4|received a copy of the gnu affero|you should have received a copy of the gnu affero general public license along with this (?:program|software)
agpl-3.0|2|agplv3|agplv3
agpl|2|affero gpl|(?:gnu )?affero gpl
agpl|1|gnu org licenses agpl|(?:www )?gnu org licenses agpl(?: html| 3 0 html)?
gfdl-1.1|5|spdx license identifier gfdl 1 1|spdx license identifier gfdl 1 1(?: only| or later)?
gfdl-1.2|5|spdx license identifier gfdl 1 2|spdx license identifier gfdl 1 2(?: only| or later)?
gfdl-1.3|5|spdx license identifier gfdl 1 3|spdx license identifier gfdl 1 3(?: only| or later)?
gfdl|3|free documentation license|(?:gnu )?free documentation license(?: version 1 [123])?
gfdl|4|no invariant sections|with no invariant sections no front cover texts and no back cover texts
bsd-2-clause|5|spdx license identifier bsd 2|spdx license identifier bsd 2 clause(?: patent| views)?
bsd-3-clause|5|spdx license identifier bsd 3|spdx license identifier bsd 3 clause(?: clear| lbnl)?
bsd-4-clause|5|spdx license identifier bsd 4|spdx license identifier bsd 4 clause
0bsd|5|spdx license identifier 0bsd|spdx license identifier 0bsd
bsd-3-clause|3|bsd 3 clause|bsd 3 clause(?: license)?
bsd-3-clause|3|3 clause bsd|3 clause bsd(?: license)?
bsd-2-clause|3|bsd 2 clause|bsd 2 clause(?: license)?
bsd-2-clause|3|2 clause bsd|2 clause bsd(?: license)?
bsd-4-clause|3|4 clause bsd|4 clause bsd(?: license)?
bsd-2-clause|3|simplified bsd|simplified bsd license
bsd-2-clause|3|freebsd license|freebsd license
bsd-3-clause|3|new bsd license|new bsd license
bsd-3-clause|3|modified bsd|modified bsd license
bsd-3-clause|3|revised bsd|revised bsd license
bsd-4-clause|3|original bsd license|original bsd license
0bsd|3|zero clause bsd|(?:bsd )?zero clause bsd(?: license)?
bsd|2|bsd license|bsd license
bsd|2|bsd licence|bsd licence
bsd|2|bsd style license|bsd style licensed?
bsd|4|redistribution and use in source and binary forms|redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause|4|to endorse or promote products|(?:neither )?the names? of .{1,120}? (?:nor the names of its contributors )?may (?:not )?be used to endorse or promote products derived from this software
bsd-4-clause|4|all advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd|4|redistributions of source code must retain|redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd|1|opensource org licenses bsd|opensource org licenses bsd(?: license| 3 clause| 2 clause)?
isc|5|spdx license identifier isc|spdx license identifier isc
isc|3|isc license|(?:the )?isc licensed?
isc|3|isc licence|(?:the )?isc licence
isc|4|for any purpose with or without fee|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd|5|spdx license identifier hpnd|spdx license identifier hpnd
hpnd|4|is hereby granted without fee|permission to use copy modify and distribute this software and its documentation for any purpose is hereby granted without fee
mpl-1.0|5|spdx license identifier mpl 1 0|spdx license identifier mpl 1 0
mpl-1.1|5|spdx license identifier mpl 1 1|spdx license identifier mpl 1 1
mpl-2.0|5|spdx license identifier mpl 2|spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-1.1|3|mozilla public license version 1|mozilla public license version 1 [01]
mpl-2.0|3|mozilla public license v|mozilla public license v(?:ersion)? 2(?: 0)?
mpl-2.0|3|mozilla public license 2|mozilla public license 2(?: 0)?
mpl|2|mozilla public license|mozilla public license
mpl|2|mozilla public licence|mozilla public licence
mpl-2.0|4|subject to the terms of the mozilla|this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1|4|contents of this file are subject to the mozilla|the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0|1|mozilla org mpl 2|(?:www )?mozilla org mpl 2 0
npl-1.1|3|netscape public license|netscape public license(?: version 1 [01])?
epl-1.0|5|spdx license identifier epl 1|spdx license identifier epl 1 0
epl-2.0|5|spdx license identifier epl 2|spdx license identifier epl 2 0
epl-1.0|3|eclipse public license v|eclipse public license v(?:ersion)? 1(?: 0)?
epl-1.0|3|eclipse public license 1|eclipse public license 1(?: 0)?
epl-2.0|3|eclipse public license 2|eclipse public license 2(?: 0)?
epl-2.0|3|eclipse public license v|eclipse public license v(?:ersion)? 2(?: 0)?
epl|2|eclipse public license|eclipse public license
epl-1.0|3|eclipse distribution license|eclipse distribution license(?: v(?:ersion)? 1(?: 0)?)?
epl|1|eclipse org legal epl|(?:www )?eclipse org legal epl(?: v10| v20| 2 0)?(?: html)?
cpl-1.0|5|spdx license identifier cpl|spdx license identifier cpl 1 0
cpl-1.0|3|common public license|common public license(?: version 1(?: 0)?)?
ipl-1.0|3|ibm public license|ibm public license(?: version 1(?: 0)?)?
cddl-1.0|5|spdx license identifier cddl 1 0|spdx license identifier cddl 1 0
cddl-1.1|5|spdx license identifier cddl 1 1|spdx license identifier cddl 1 1
cddl|3|common development and distribution license|common development and distribution license(?: cddl)?(?: version 1(?: [01])?)?
cpal-1.0|3|common public attribution license|common public attribution license(?: version 1(?: 0)?)?
eupl-1.1|5|spdx license identifier eupl 1 1|spdx license identifier eupl 1 1
eupl-1.2|5|spdx license identifier eupl 1 2|spdx license identifier eupl 1 2
eupl|3|european union public licen|european union public licen[cs]e(?: v(?:ersion)? ?1 ?[12]?)?
cecill-2.1|5|spdx license identifier cecill|spdx license identifier cecill(?: [bc]| 2 [01])?
cecill|3|cecill|cecill(?: [bc])? licen[cs]e(?: agreement)?
cc0-1.0|5|spdx license identifier cc0|spdx license identifier cc0 1 0
cc0-1.0|3|creative commons zero|creative commons zero(?: v?1 0)?(?: universal)?
cc0-1.0|3|cc0 1 0|cc0 1 0(?: universal)?
cc0-1.0|1|publicdomain zero|creativecommons org publicdomain zero 1 0
cc-by-4.0|5|spdx license identifier cc by 4|spdx license identifier cc by 4 0
cc-by-3.0|5|spdx license identifier cc by 3|spdx license identifier cc by 3 0
cc-by-sa-4.0|5|spdx license identifier cc by sa 4|spdx license identifier cc by sa 4 0
cc-by-sa-3.0|5|spdx license identifier cc by sa 3|spdx license identifier cc by sa 3 0
cc-by-nc-4.0|5|spdx license identifier cc by nc 4|spdx license identifier cc by nc 4 0
cc-by-nd-4.0|5|spdx license identifier cc by nd 4|spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0|5|spdx license identifier cc by nc sa|spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0|5|spdx license identifier cc by nc nd|spdx license identifier cc by nc nd 4 0
cc-by-4.0|3|creative commons attribution 4|creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-3.0|3|creative commons attribution 3|creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa-4.0|3|attribution sharealike 4|(?:creative commons )?attribution sharealike 4 0(?: international)?(?: license)?
cc-by-sa-3.0|3|attribution sharealike 3|(?:creative commons )?attribution sharealike 3 0(?: unported)?(?: license)?
cc-by-nc-4.0|3|attribution noncommercial 4|(?:creative commons )?attribution noncommercial 4 0(?: international)?(?: license)?
cc-by-nc-3.0|3|attribution noncommercial 3|(?:creative commons )?attribution noncommercial 3 0(?: unported)?(?: license)?
cc-by-nd-4.0|3|attribution noderivatives 4|(?:creative commons )?attribution noderivatives 4 0(?: international)?(?: license)?
cc-by-nc-sa-4.0|3|attribution noncommercial sharealike 4|(?:creative commons )?attribution noncommercial sharealike 4 0(?: international)?(?: license)?
cc-by-nc-nd-4.0|3|attribution noncommercial noderivatives 4|(?:creative commons )?attribution noncommercial noderivatives 4 0(?: international)?(?: license)?
cc-by|2|cc by|cc by(?: [234] [05])?
cc-by-sa|2|cc by sa|cc by sa(?: [234] [05])?
cc-by-nc|2|cc by nc|cc by nc(?: [234] [05])?
cc-by-nd|2|cc by nd|cc by nd(?: [234] [05])?
cc-by-nc-sa|2|cc by nc sa|cc by nc sa(?: [234] [05])?
cc-by-nc-nd|2|cc by nc nd|cc by nc nd(?: [234] [05])?
cc|1|creative commons license|(?:a )?creative commons license
cc|1|creativecommons org licenses|creativecommons org licenses by(?: nc)?(?: sa| nd)?(?: [234] [05])?
unlicense|5|spdx license identifier unlicense|spdx license identifier unlicense
unlicense|4|free and unencumbered software|this is free and unencumbered software released into the public domain
unlicense|2|the unlicense|the unlicense(?: license)?
unlicense|1|unlicense org|(?:www )?unlicense org
public-domain|2|released into the public domain|(?:is |are |been |hereby )*released into the public domain
public-domain|2|in the public domain|(?:is|are|placed) in the public domain
public-domain|2|dedicated to the public domain|dedicated to the public domain
wtfpl|5|spdx license identifier wtfpl|spdx license identifier wtfpl
wtfpl|3|do what the fuck you want to|do what the fuck you want to public license(?: version 2)?
wtfpl|2|wtfpl|wtfpl(?: license| version 2)?
zlib|5|spdx license identifier zlib|spdx license identifier zlib(?: acknowledgement)?
zlib|3|zlib license|(?:the )?zlib licensed?
zlib|3|zlib libpng|zlib libpng license
zlib|4|origin of this software must not be misrepresented|the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib|4|altered source versions|altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng|3|libpng license|libpng license(?: version 2)?
libpng|3|png reference library license|png reference library license(?: version 2)?
bsl-1.0|5|spdx license identifier bsl 1 0|spdx license identifier bsl 1 0
bsl-1.0|3|boost software license|boost software license(?: version 1(?: 0)?)?
bsl-1.0|1|boost org license 1|(?:www )?boost org license 1 0 txt
busl-1.1|5|spdx license identifier busl|spdx license identifier busl 1 1
busl-1.1|3|business source license|business source license(?: 1 1)?
sspl-1.0|3|server side public license|server side public license(?: v(?:ersion)? ?1)?
elastic-2.0|3|elastic license|elastic license(?: v?2(?: 0)?)?
artistic-1.0|5|spdx license identifier artistic 1|spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2.0|5|spdx license identifier artistic 2|spdx license identifier artistic 2 0
artistic-2.0|3|artistic license|(?:the )?artistic license (?:version )?2(?: 0)?
artistic|2|artistic license|(?:the )?artistic license
perl|3|same terms as perl|(?:under )?the same terms as perl itself
python-2.0|5|spdx license identifier python 2|spdx license identifier python 2 0(?: 1)?
psf-2.0|5|spdx license identifier psf|spdx license identifier psf 2 0
python|3|python software foundation license|python software foundation license(?: version 2)?
python|2|psf license|psf license(?: agreement)?
ruby|5|spdx license identifier ruby|spdx license identifier ruby
ruby|3|ruby license|(?:the )?ruby license
php-3.01|5|spdx license identifier php|spdx license identifier php 3 0(?:1)?
php-3.01|3|php license|(?:the )?php license(?: version 3 0 ?1?)?
postgresql|5|spdx license identifier postgresql|spdx license identifier postgresql
postgresql|3|postgresql licen|(?:the )?postgresql licen[cs]e
ofl-1.1|5|spdx license identifier ofl|spdx license identifier ofl 1 [01](?: rfn| no rfn)?
ofl-1.1|3|sil open font license|sil open font license(?: version)?(?: 1 1)?
ofl-1.1|2|open font license|open font license(?: version)?(?: 1 1)?
ncsa|5|spdx license identifier ncsa|spdx license identifier ncsa
ncsa|3|ncsa open source license|(?:university of illinois )?ncsa open source license
ecl-2.0|3|educational community license|educational community license(?: version 2(?: 0)?)?
afl-3.0|3|academic free license|academic free license(?: v(?:ersion)?)?(?: ?[123] [01])?
osl-3.0|3|open software license|open software license(?: v(?:ersion)?)?(?: ?[123] [01])?
odbl-1.0|3|database license|open (?:data commons )?(?:open )?database license(?: v?1 0)?
odc-by-1.0|3|open data commons attribution|open data commons attribution license(?: v?1 0)?
pddl-1.0|3|public domain dedication and license|(?:open data commons )?public domain dedication and license
ms-pl|3|microsoft public license|microsoft public license(?: ms pl)?
ms-rl|3|microsoft reciprocal license|microsoft reciprocal license(?: ms rl)?
openssl|3|openssl license|(?:the )?openssl license
openssl|4|openssl project for use in the openssl|developed by the openssl project for use in the openssl toolkit
curl|3|curl license|(?:the )?curl license
vim|3|vim license|(?:the )?vim license
upl-1.0|3|universal permissive license|universal permissive license(?: v(?:ersion)? 1 0)?
mulan-2.0|3|mulan psl|mulan psl v?2(?: 0)?
qpl-1.0|3|q public license|q public license(?: version 1(?: 0)?)?
lppl-1.3c|3|latex project public license|latex project public license(?: (?:version|v) ?1 3[abc]?)?
w3c|3|w3c software|w3c software (?:notice and|and notice and document) license
unicode|3|unicode license|unicode license(?: agreement)?(?: v3)?
unicode|3|unicode inc license|unicode inc license(?: agreement)?(?: v3)?
unicode|4|unicode data files|copy of the unicode data files and any associated documentation
json|4|the software shall be used for good not evil|the software shall be used for good not evil
beerware|3|beer ware license|(?:the )?beer ware license(?: revision 42)?
beerware|3|beerware license|(?:the )?beerware license(?: revision 42)?
jpeg|4|independent jpeg group|this software is based in part on the work of the independent jpeg group
proprietary|2|all rights reserved|(?:copyright )?[^ ]* ?all rights reserved
proprietary|3|confidential and proprietary|(?:this (?:file|software|document) is )?confidential and proprietary
proprietary|3|strictly prohibited|unauthorized (?:copying|use|distribution) .{0,80}?is strictly prohibited
proprietary|3|end user license agreement|end user license agreement(?: eula)?
no-warranty|1|without warranty of any kind|(?:provided )?(?:as is )?without warranty of any kind(?: either)?(?: express(?:ed)? or implied)?
no-warranty|1|merchantability or fitness|(?:implied )?warranty of merchantability or fitness for a particular purpose
no-warranty|1|in no event shall|in no event shall the (?:authors?|copyright (?:holders?|owners?)|regents) (?:or contributors |or copyright holders )*be liable
llama|3|community license|llama [23](?: 1)? community license(?: agreement)?
openrail|3|openrail|(?:creativeml |bigscience )?openrail(?: m)?(?: license)?
openrail|3|open rail|(?:creativeml |bigscience )?open rail(?: m)?(?: license)?
"""

RULES = [Rule(i, *(f(x) for f, x in zip((str, int, str, str), line.split("|", 3), strict=True))) for i, line in enumerate(_TEXT.strip().splitlines())]
"""All rules; their order breaks ties of priority."""

#: Every keyword contains one of these, so a text without any of them needs no further look.
GATES = ["licen", "gpl", "gnu", "bsd", "apache", "public domain", "publicdomain", "permission", "permitted", "redistribution", "creative commons", "cc by", "cc0", "attribution", "rights reserved", "warrant", "merchantability", "in no event", "do what the", "wtfpl", "without fee", "without restriction", "x consortium", "you may not use", "or later", "exception", "mozilla", "cecill", "zlib", "altered source", "misrepresented", "openssl", "unicode", "independent jpeg", "invariant sections", "good not evil", "confidential", "prohibited", "openrail", "open rail", "mulan psl", "conditions for use", "advertising materials", "endorse", "w3c software", "encumbered", "same terms as", "eclipse org"]
