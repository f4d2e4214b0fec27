"""Signatures of licence texts, notices, tags and addresses: fixed values, written by hand.

One to a line: label | priority | certainty | keyword | regex over normalised text (lower-case words joined by single
spaces). Priorities: 1 machine-readable tags, 2 sentences of a licence's own text, 3 standard notices, 4 addresses
of licences, 6 families without a version, 7 general terms, 8 mere traces.
"""

from __future__ import annotations

TABLE = """
mit | 2 | 0.95 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 2 | 0.9 | above copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 3 | 0.85 | software is provided | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | 4 | 0.9 | opensource | (?:https? )?(?:www )?opensource org licenses? mit(?: license)?
mit-0 | 1 | 1.0 | spdx | spdx license identifier mit 0
mit-0 | 3 | 0.9 | no attribution | mit no attribution
x11 | 2 | 0.9 | x consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
hpnd | 2 | 0.9 | permission | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
isc | 2 | 0.95 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 2 | 0.95 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd | 2 | 0.85 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | 2 | 0.9 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software
bsd-3-clause | 2 | 0.95 | neither the name | neither the (?:name|names) of (?:the )?(?:copyright holder|[a-z0-9 ]{1,60}) nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | 2 | 0.95 | all advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause-clear | 2 | 0.95 | no express | no express or implied licenses to any party s patent rights are granted by this license
bsd | 3 | 0.8 | bsd style | (?:use|governed) [a-z0-9 ]{0,40}bsd style licen[cs]e that can be found in the license file
bsd | 4 | 0.85 | opensource | (?:https? )?(?:www )?opensource org licenses? bsd(?: license| 2 clause| 3 clause)?
apache-2 | 2 | 0.95 | terms and conditions | apache license version 2 0 january 2004
apache-2 | 3 | 0.95 | licensed under the apache | licensed under the apache license version 2 0 the license you may not use this (?:file|work|product|software) except in compliance with the license
apache-2 | 3 | 0.9 | you may obtain | you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0
apache-2 | 4 | 0.9 | apache org | (?:https? )?(?:www )?apache org licenses license 2 0(?: html| txt)?
apache-2 | 3 | 0.85 | unless required | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 | 2 | 0.95 | apache software | this product includes software developed by the apache (?:software foundation|group)
apache-2 | 2 | 0.9 | contributor | licensed to the apache software foundation asf under one or more contributor license agreements
gpl-2 | 2 | 0.95 | general public license | gnu general public license version 2 june 1991
gpl-3 | 2 | 0.95 | general public license | gnu general public license version 3 29 june 2007
lgpl-2.1 | 2 | 0.95 | lesser general | gnu lesser general public license version 2 1 february 1999
lgpl-3 | 2 | 0.95 | lesser general | gnu lesser general public license version 3 29 june 2007
lgpl-2 | 2 | 0.95 | library general | gnu library general public license version 2 june 1991
agpl-3 | 2 | 0.95 | affero | gnu affero general public license version 3 19 november 2007
gfdl | 2 | 0.95 | free documentation | gnu free documentation license version 1 [1-3] (?:march 2000|november 2002|3 november 2008)
gpl-2-or-later | 3 | 0.95 | version 2 of the license | either version 2 of the license or at your option any later version
gpl-3-or-later | 3 | 0.95 | version 3 of the license | either version 3 of the license or at your option any later version
lgpl-2.1-or-later | 3 | 0.95 | version 2 1 of the license | either version 2 1 of the license or at your option any later version
gpl | 3 | 0.9 | free software | this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser |library |affero )?general public license as published by the free software foundation
gpl | 3 | 0.85 | you should have received | you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library|file|software)
gpl-2-only | 1 | 1.0 | spdx | spdx license identifier gpl 2 0 only
gpl-2-or-later | 1 | 1.0 | spdx | spdx license identifier gpl 2 0 or later
gpl-3-only | 1 | 1.0 | spdx | spdx license identifier gpl 3 0 only
gpl-3-or-later | 1 | 1.0 | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.1-only | 1 | 1.0 | spdx | spdx license identifier lgpl 2 1 only
lgpl-2.1-or-later | 1 | 1.0 | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3-only | 1 | 1.0 | spdx | spdx license identifier lgpl 3 0 only
agpl-3-only | 1 | 1.0 | spdx | spdx license identifier agpl 3 0 only
agpl-3-or-later | 1 | 1.0 | spdx | spdx license identifier agpl 3 0 or later
bsd-2-clause | 1 | 1.0 | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | 1 | 1.0 | spdx | spdx license identifier bsd 3 clause
apache-2 | 1 | 1.0 | spdx | spdx license identifier apache 2 0
gpl-2-linux-syscall | 1 | 1.0 | spdx | spdx license identifier gpl 2 0 with linux syscall note
gpl-classpath | 1 | 1.0 | classpath | gpl 2 0 with classpath exception 2 0
dual-apache-mit | 1 | 1.0 | spdx | spdx license identifier (?:apache 2 0 or mit|mit or apache 2 0)
gpl-3 | 4 | 0.9 | gnu org | (?:https? )?(?:www )?gnu org licenses gpl 3 0
gpl-2 | 4 | 0.9 | gnu org | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0
agpl-3 | 4 | 0.9 | gnu org | (?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?
lgpl | 4 | 0.85 | gnu org | (?:https? )?(?:www )?gnu org licenses lgpl
mpl-2 | 2 | 0.95 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 4 | 0.9 | mozilla org | (?:https? )?(?:www )?mozilla org (?:en us )?mpl 2 0
mpl-1.1 | 2 | 0.95 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
tri-mpl-gpl-lgpl | 3 | 0.9 | alternatively | alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later
epl-1 | 2 | 0.95 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2 | 2 | 0.95 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl | 4 | 0.85 | eclipse org | (?:https? )?(?:www )?eclipse org legal epl
cddl-1 | 2 | 0.95 | common development | the contents of this file are subject to the terms of the common development and distribution license
cpl-1 | 2 | 0.9 | common public | common public license v(?:ersion )?1 0
ipl-1 | 2 | 0.9 | ibm public | ibm public license version 1 0
zlib | 2 | 0.95 | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 2 | 0.9 | this software is provided | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | 2 | 0.9 | libpng | libpng versions [0-9 ]{1,20}are copyright
bsl-1 | 2 | 0.95 | boost | boost software license version 1 0 august 17th 2003
bsl-1 | 3 | 0.9 | boost | distributed under the boost software license version 1 0
unlicense | 2 | 0.95 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 4 | 0.85 | unlicense org | (?:https? )?unlicense org
wtfpl | 2 | 0.95 | want to public license | do what the f[a-z]* you want to public license
beerware | 2 | 0.95 | buy me a beer | you can buy me a beer in return
artistic-2 | 2 | 0.95 | artistic | the artistic license 2 0 copyright
perl | 3 | 0.85 | same terms | under the same terms as perl itself
psf-2 | 2 | 0.95 | python software | python software foundation license version 2
ofl-1.1 | 2 | 0.95 | sil open | this font software is licensed under the sil open font license version 1 1
ncsa | 2 | 0.95 | deal with the software | to deal with the software without restriction
postgresql | 2 | 0.9 | written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl | 2 | 0.95 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
php-3 | 2 | 0.95 | php software | this product includes php software freely available from
w3c | 2 | 0.9 | copyright holders | this work is being provided by the copyright holders under the following license
curl | 2 | 0.9 | permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
unicode | 2 | 0.95 | unicode data | to deal in the data files or software without restriction
icu | 2 | 0.9 | icu license | icu license icu 1 8 1 and later
json | 2 | 0.95 | used for good | the software shall be used for good not evil
cc0 | 2 | 0.95 | cc0 | to the extent possible under law [a-z0-9 ]{1,60} has waived all copyright and related or neighboring rights
cc0 | 4 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
cc-by | 4 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by [1-4] [05]
cc-by-sa | 4 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by sa [1-4] [05]
cc-by-nc | 4 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc [1-4] [05]
cc-by-nd | 4 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | 4 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 4 | 0.9 | creativecommons | (?:https? )?(?:www )?creativecommons org licenses by nc nd [1-4] [05]
cc-by-sa-4 | 2 | 0.95 | international public | creative commons attribution sharealike 4 0 international public license
cc-by-4 | 2 | 0.95 | international public | creative commons attribution 4 0 international public license
cc-by-nc-4 | 2 | 0.95 | international public | creative commons attribution noncommercial 4 0 international public license
public-domain-mark | 4 | 0.85 | creativecommons | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
odbl | 4 | 0.9 | opendatacommons | (?:https? )?(?:www )?opendatacommons org licenses odbl
ogl-uk | 3 | 0.9 | open government | contains public sector information licensed under the open government licence(?: v[123] 0)?
ogl-uk | 7 | 0.7 | open government | open government licen[cs]e
eupl-1.2 | 2 | 0.95 | eupl | licensed under the eupl(?: version 1 2| v 1 2)?
cecill-b | 2 | 0.9 | cecill | cecill b
cecill-c | 2 | 0.9 | cecill | cecill c
mulan-psl-2 | 2 | 0.95 | mulan | mulan (?:psl|permissive software license) v(?:ersion )?2
ms-pl | 2 | 0.9 | microsoft public | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | 2 | 0.9 | microsoft reciprocal | microsoft reciprocal license
sspl-1 | 2 | 0.95 | server side | server side public license(?: version 1| vl)?
elastic-2 | 2 | 0.95 | elastic license | elastic license(?: version)? 2 0
bsl-1.1 | 2 | 0.95 | business source | business source license 1 1
commons-clause | 2 | 0.95 | commons clause | commons clause license condition v1 0
polyform | 2 | 0.9 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) license 1 0 [01]
parity | 2 | 0.9 | parity public | the parity public license(?: [67] 0 0)?
blueoak-1 | 2 | 0.95 | blue oak | blue oak model license(?: version)? 1 0 0
hippocratic | 2 | 0.9 | hippocratic | hippocratic license(?: version)?(?: [123] [01])?
openrail | 2 | 0.9 | openrail | (?:creativeml |bigscience )?open ?rail(?: m| s)?(?: license)?
rail | 2 | 0.9 | responsible ai | responsible ai licen[cs]e
llama-community | 2 | 0.9 | community license | (?:llama|meta llama) [0-9 ]{0,4}community license agreement
cdla-permissive-2 | 2 | 0.95 | community data | community data license agreement permissive version 2 0
cdla-sharing-1 | 2 | 0.95 | community data | community data license agreement sharing version 1 0
vim | 2 | 0.95 | versions of vim | you may distribute modified versions of vim under
ruby | 3 | 0.85 | same terms | under the same terms as ruby
gpl | 6 | 0.8 | general public license | gnu general public licen[cs]e
lgpl | 6 | 0.8 | general public license | gnu (?:lesser|library) general public licen[cs]e
agpl | 6 | 0.8 | general public license | gnu affero general public licen[cs]e
creative-commons | 6 | 0.6 | creative commons | creative commons(?: licen[cs]e)?
apache | 6 | 0.7 | apache | apache licen[cs]e
bsd | 6 | 0.7 | bsd | bsd licen[cs]e
public-domain | 6 | 0.7 | public domain | (?:released into|placed in|dedicated to|in) the public domain
proprietary | 6 | 0.7 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 6 | 0.75 | unauthorized | unauthorized (?:copying|reproduction|distribution) of this (?:file|software|document|work) (?:via any medium )?is strictly prohibited
proprietary | 6 | 0.7 | express written | may not be (?:reproduced|copied|distributed) [a-z0-9 ]{0,60}without the (?:prior )?(?:express )?written (?:permission|consent)
evaluation-only | 6 | 0.7 | evaluation purposes | for evaluation purposes only
non-commercial | 7 | 0.6 | commercial use | (?:for )?non ?commercial use only
personal-use | 7 | 0.6 | personal use | for personal use only
all-rights-reserved | 7 | 0.6 | all rights reserved | all rights reserved
copyright | 8 | 0.5 | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
copyleft | 8 | 0.4 | copyleft | copyleft
"""


def table() -> list[tuple[str, int, float, str, str]]:
    """label, priority, certainty, keyword, regex."""
    out = []
    for line in TABLE.strip().splitlines():
        label, priority, certainty, keyword, regex = (x.strip() for x in line.split(" | "))
        out.append((label, int(priority), float(certainty), keyword, regex))
    return out
