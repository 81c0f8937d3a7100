"""Signature rules for licence texts, notices and tags.

A line is: label | priority | keyword | pattern. Patterns see the words of a text in lower case, one blank between two
words; a keyword is a part of every text that the pattern matches. Higher priorities win over lower ones
inside the same words. Priorities: 90 whole grants, 80 clauses, 70 names with version, 60 notices, 50 names, 40 tags, 20 hints.
"""

RULES = """
mit | 95 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | 85 | copies or substantial portions of the software | the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | 80 | without restriction including without limitation the rights | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | 62 | mit license | (licensed|released|distributed|available|published|covered|provided) under (the )?(terms of (the )?)?mit license
mit | 55 | mit license | the mit license( mit)?
mit | 52 | expat license | expat license
mit | 50 | mit licen | mit licen[sc]ed?
mit | 41 | license mit | license mit
mit-0 | 90 | mit no attribution | mit no attribution
x11 | 72 | x11 license | x11 license
x11 | 82 | x consortium | except as contained in this notice the name of the x consortium shall not be used
isc | 92 | permission to use copy modify and | permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | 72 | isc license | isc license
0bsd | 91 | with or without fee is hereby granted the software | permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
0bsd | 71 | zero clause bsd | (bsd )?zero clause bsd
0bsd | 73 | 0bsd | 0bsd( license)?
bsd | 80 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | 82 | redistributions in binary form | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer( \\S+){0,3} redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 84 | endorse or promote products derived | neither the name of( \\S+){1,12} nor the names of (its|their|other) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 86 | all advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-2-clause | 72 | bsd 2 clause | bsd 2 clause( simplified)?( license)?
bsd-3-clause | 72 | bsd 3 clause | bsd 3 clause( new or revised)?( license)?
bsd-4-clause | 72 | bsd 4 clause | bsd 4 clause( original or old)?( license)?
bsd-2-clause | 71 | 2 clause bsd | 2 clause bsd( license)?
bsd-3-clause | 71 | 3 clause bsd | 3 clause bsd( license)?
bsd-4-clause | 71 | 4 clause bsd | 4 clause bsd( license)?
bsd-2-clause | 70 | simplified bsd | simplified bsd license
bsd-3-clause | 70 | bsd license | (new|modified|revised) bsd license
bsd-2-clause | 70 | freebsd license | freebsd license
bsd | 62 | bsd style | bsd style license
bsd | 51 | bsd licen | bsd licen[sc]ed?
apache-2 | 95 | apache license version 2 0 january 2004 | apache license version 2 0 january 2004
apache-2 | 90 | you may not use this file except in compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 75 | apache license version 2 | apache license version 2( 0)?
apache-2 | 74 | apache software license version 2 | apache software license version 2( 0)?
apache-2 | 72 | apache 2 | apache 2( 0)? licen[sc]ed?
apache-2 | 71 | apache license | apache license v?2( 0)?
apache-2 | 70 | apache license v2 | apache license v2( 0)?
apache-2 | 66 | apache org licenses license 2 | apache org licenses license 2( 0)?
apache-2 | 45 | license apache 2 | license apache 2( 0)?
apache-1.1 | 73 | apache software license version 1 1 | apache software license version 1 1
apache-1.0 | 73 | apache group for use in the apache | this product includes software developed by the apache group for use in the apache http server project
apache | 50 | apache licen | apache licen[sc]ed?
gpl-3 | 95 | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl-2 | 95 | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-1 | 95 | gnu general public license version 1 february 1989 | gnu general public license version 1 february 1989
gpl-3 | 90 | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or( at your option)? any later version
gpl-2 | 90 | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or( at your option)? any later version
gpl-3 | 85 | general public license version 3 | gnu general public license version 3( only)?
gpl-2 | 85 | general public license version 2 | gnu general public license version 2( only)?
gpl-3 | 75 | general public license v3 | (gnu )?general public license v3( 0)?
gpl-2 | 75 | general public license v2 | (gnu )?general public license v2( 0)?
gpl-3 | 72 | gpl v3 | gpl v3( 0)?( or later)?
gpl-2 | 72 | gpl v2 | gpl v2( 0)?( or later)?
gpl-3 | 72 | gplv3 | gplv3( or later)?
gpl-2 | 72 | gplv2 | gplv2( or later)?
gpl-3 | 70 | gpl 3 | gpl 3( 0)?( only| or later)?
gpl-2 | 70 | gpl 2 | gpl 2( 0)?( only| or later)?
gpl | 60 | gnu general public licen | gnu general public licen[sc]e
gpl | 50 | gnu gpl | gnu gpl
gpl | 58 | under the gpl | (licensed|released|distributed|available) under the gpl
lgpl-3 | 95 | lesser general public license version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007
lgpl-2.1 | 95 | lesser general public license version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-2 | 95 | library general public license version 2 june 1991 | gnu library general public license version 2 june 1991
lgpl-3 | 86 | lesser general public license | lesser general public license( as published by the free software foundation either)? version 3
lgpl-2.1 | 86 | lesser general public license | lesser general public license( as published by the free software foundation either)? version 2 1
lgpl-2 | 86 | library general public license | library general public license( as published by the free software foundation either)? version 2
lgpl-3 | 72 | lgpl | lgpl ?v?3( 0)?( only| or later)?
lgpl-2.1 | 73 | lgpl | lgpl ?v?2 1( only| or later)?
lgpl-2 | 72 | lgpl | lgpl ?v?2( 0)?( only| or later)?
lgpl | 60 | lesser general public licen | gnu lesser general public licen[sc]e
lgpl | 60 | library general public licen | gnu library general public licen[sc]e
agpl-3 | 95 | affero general public license version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
agpl-3 | 88 | affero general public license | affero general public license( as published by the free software foundation either)? version 3
agpl-3 | 73 | agpl | agpl ?v?3( 0)?( only| or later)?
agpl-1 | 88 | affero general public license version 1 | affero general public license version 1
agpl | 61 | affero general public licen | (gnu )?affero general public licen[sc]e
gfdl-1.3 | 86 | free documentation license version 1 3 | gnu free documentation license version 1 3
gfdl-1.2 | 86 | free documentation license version 1 2 | gnu free documentation license version 1 2
gfdl-1.1 | 86 | free documentation license version 1 1 | gnu free documentation license version 1 1
gfdl | 60 | free documentation license | gnu free documentation license
gfdl | 50 | gfdl | gfdl( 1 [123])?
mpl-2 | 90 | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 | 80 | mozilla public license | mozilla public license (version |v ?)?2( 0)?
mpl-1.1 | 81 | mozilla public license | mozilla public license (version |v ?)?1 1
mpl-1.0 | 81 | mozilla public license | mozilla public license (version |v ?)?1 0
mpl | 60 | mozilla public licen | mozilla public licen[sc]e
mpl-2 | 70 | mpl 2 | mpl 2( 0)?
mpl-1.1 | 70 | mpl 1 1 | mpl 1 1
epl-2 | 80 | eclipse public license | eclipse public license (version |v ?)?2( 0)?
epl-1 | 80 | eclipse public license | eclipse public license (version |v ?)?1( 0)?
epl | 60 | eclipse public licen | eclipse public licen[sc]e
epl-2 | 70 | epl 2 | epl 2( 0)?
epl-1 | 70 | epl 1 0 | epl 1 0
cddl-1.1 | 80 | common development and distribution license | common development and distribution license( cddl)? version 1 1
cddl-1.0 | 79 | common development and distribution license | common development and distribution license( cddl)? version 1 0
cddl | 60 | common development and distribution licen | common development and distribution licen[sc]e
cpl-1.0 | 76 | common public license version 1 0 | common public license version 1 0
cpl | 60 | common public license | common public license
ipl-1.0 | 76 | ibm public license | ibm public license( version 1 0)?
artistic-2 | 78 | artistic license 2 0 | (the )?artistic license 2 0
artistic-1 | 77 | artistic license 1 0 | (the )?artistic license 1 0
artistic | 60 | artistic license | (the )?artistic license
perl | 75 | same terms as perl itself | under the same terms as perl itself
python | 76 | python software foundation license | python software foundation license( version 2)?
python | 74 | psf license agreement | psf license agreement for python
ruby | 70 | ruby license | ruby license
php | 76 | php license version 3 | php license version 3( 01)?
zlib | 92 | this software is provided as is without any express | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone
zlib | 84 | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 72 | zlib license | zlib license
zlib-libpng | 74 | zlib libpng license | zlib libpng license
libpng | 72 | libpng license | libpng license
bsl-1.0 | 92 | boost software license version 1 0 17 | boost software license version 1 0 17 august( 17)? 2003
bsl-1.0 | 78 | boost software license | boost software license( version)? 1 0
bsl-1.0 | 60 | boost software license | boost software license
busl-1.1 | 78 | business source license 1 1 | business source license 1 1
sspl-1.0 | 78 | server side public license | server side public license( version 1| v 1)?
elastic-2.0 | 78 | elastic license 2 0 | elastic license 2 0
elastic | 60 | elastic license | elastic license
commons-clause | 78 | commons clause | commons clause license condition v1 0
unlicense | 92 | this is free and unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 72 | the unlicense | the unlicense
unlicense | 66 | unlicense org | unlicense org
wtfpl | 90 | do what the fuck you want to public license | do what the fuck you want to public license( version 2)?
wtfpl | 70 | wtfpl | wtfpl
cc0-1.0 | 92 | cc0 1 0 universal | (creative commons )?cc0 1 0 universal( public domain dedication)?
cc0-1.0 | 72 | cc0 | (creative commons )?cc0( 1 0)?
cc0-1.0 | 76 | publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0
cc-by-nc-nd-4.0 | 84 | attribution noncommercial noderivatives 4 0 | (creative commons )?attribution noncommercial noderivatives 4 0 international
cc-by-nc-sa-4.0 | 84 | attribution noncommercial sharealike 4 0 | (creative commons )?attribution noncommercial sharealike 4 0 international
cc-by-nc-4.0 | 83 | attribution noncommercial 4 0 | (creative commons )?attribution noncommercial 4 0 international
cc-by-nd-4.0 | 83 | attribution noderivatives 4 0 | (creative commons )?attribution noderivatives 4 0 international
cc-by-sa-4.0 | 83 | attribution sharealike 4 0 | (creative commons )?attribution sharealike 4 0 international
cc-by-4.0 | 82 | attribution 4 0 international | (creative commons )?attribution 4 0 international
cc-by-nc-nd-3.0 | 84 | attribution noncommercial noderivs 3 0 | (creative commons )?attribution noncommercial noderivs 3 0( unported)?
cc-by-nc-sa-3.0 | 84 | attribution noncommercial sharealike 3 0 | (creative commons )?attribution noncommercial sharealike 3 0( unported)?
cc-by-nc-3.0 | 83 | attribution noncommercial 3 0 | (creative commons )?attribution noncommercial 3 0( unported)?
cc-by-nd-3.0 | 83 | attribution noderivs 3 0 | (creative commons )?attribution noderivs 3 0( unported)?
cc-by-sa-3.0 | 83 | attribution sharealike 3 0 | (creative commons )?attribution sharealike 3 0( unported)?
cc-by-3.0 | 82 | attribution 3 0 | (creative commons )?attribution 3 0( unported)?
cc-by-nc-nd | 76 | cc by nc nd | cc by nc nd( [1234] [05])?
cc-by-nc-sa | 76 | cc by nc sa | cc by nc sa( [1234] [05])?
cc-by-nc | 74 | cc by nc | cc by nc( [1234] [05])?
cc-by-nd | 74 | cc by nd | cc by nd( [1234] [05])?
cc-by-sa | 74 | cc by sa | cc by sa( [1234] [05])?
cc-by | 70 | cc by | cc by [1234] [05]
cc-by-nc-nd | 77 | licenses by nc nd | creativecommons org licenses by nc nd( [1234] [05])?
cc-by-nc-sa | 77 | licenses by nc sa | creativecommons org licenses by nc sa( [1234] [05])?
cc-by-nc | 75 | licenses by nc | creativecommons org licenses by nc( [1234] [05])?
cc-by-nd | 75 | licenses by nd | creativecommons org licenses by nd( [1234] [05])?
cc-by-sa | 75 | licenses by sa | creativecommons org licenses by sa( [1234] [05])?
cc-by | 71 | licenses by | creativecommons org licenses by [1234] [05]
cc-by-sa | 64 | attribution share | creative commons attribution share ?alike( license)?
cc-by-nc | 64 | attribution non | creative commons attribution non ?commercial( license)?
cc-by | 60 | creative commons attribution | creative commons attribution license
cc | 50 | creative commons licen | creative commons licen[sc]ed?
odbl-1.0 | 78 | open database license | open (data commons open )?database license( odbl)?( v?1 0)?
odc-by-1.0 | 78 | open data commons attribution license | open data commons attribution license( v?1 0)?
pddl-1.0 | 78 | public domain dedication and licen | (open data commons )?public domain dedication and licen[sc]e( pddl)?
ogl-3.0 | 78 | open government licence | open government licence( v?3 0)?
cdla-permissive | 78 | community data license agreement permissive | community data license agreement permissive( version)?( [12] 0)?
cdla-sharing | 78 | community data license agreement sharing | community data license agreement sharing( version)?( 1 0)?
etalab-2.0 | 76 | licence ouverte | licence ouverte( open licence)?( version 2 0)?
dl-de-by-2.0 | 76 | datenlizenz deutschland namensnennung | datenlizenz deutschland namensnennung version 2 0
ofl-1.1 | 88 | sil open font license | (the )?sil open font license( version 1 1)?
ofl-1.1 | 70 | open font license | open font license( version 1 1)?
ofl-1.0 | 89 | sil open font license version 1 0 | sil open font license version 1 0
ubuntu-font-1.0 | 78 | ubuntu font licence | ubuntu font licence( version 1 0)?
eupl-1.2 | 80 | european union public licence | european union public licence( version| v)? 1 2
eupl-1.1 | 80 | european union public licence | european union public licence( version| v)? 1 1
eupl | 60 | european union public licen | european union public licen[sc]e
cecill-2.1 | 78 | cecill | cecill( free software license agreement)?( version)? 2 1
cecill-b | 77 | cecill b | cecill b( free software license agreement)?
cecill-c | 77 | cecill c | cecill c( free software license agreement)?
cecill | 60 | cecill | cecill( free software license agreement)?
osl-3.0 | 78 | open software license | open software license( version| v)? 3 0
afl-3.0 | 78 | academic free license | academic free license( version| v)? 3 0
afl-2.1 | 78 | academic free license | academic free license( version| v)? 2 1
ms-pl | 78 | microsoft public license | microsoft public license( ms pl)?
ms-rl | 78 | microsoft reciprocal license | microsoft reciprocal license( ms rl)?
ncsa | 78 | university of illinois ncsa | university of illinois ncsa open source license
unicode | 78 | unicode license agreement | unicode license agreement data files and software
icu | 76 | icu license | icu license( icu 1 8 1 and later)?
curl | 76 | curl license | curl license
openssl | 84 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 72 | openssl license | openssl license
ssleay | 80 | cryptographic software written by eric young | this product includes cryptographic software written by eric young
postgresql | 78 | postgresql license | postgresql license
vim | 76 | vim license | vim license
w3c | 78 | w3c software notice and | w3c software notice and( document)? license
beerware | 84 | beer ware license | the beer ware license( revision 42)?
beerware | 80 | buy me a beer in return | you can buy me a beer in return
json | 84 | shall be used for good not evil | the software shall be used for good not evil
blueoak-1.0 | 78 | blue oak model license | blue oak model license( 1 0 0)?
upl-1.0 | 78 | universal permissive license | universal permissive license( v| version)?( 1 0)?
mulan-2 | 78 | mulan psl v2 | mulan psl v2
mulan-2 | 79 | mulan permissive software license | mulan permissive software license( version 2| v2)?
polyform-nc | 78 | polyform noncommercial license | polyform noncommercial license( 1 0 0)?
polyform-sb | 78 | polyform small business license | polyform small business license( 1 0 0)?
nposl-3.0 | 78 | non profit open software license | non profit open software license( 3 0)?
rpl-1.5 | 78 | reciprocal public license | reciprocal public license( 1 5)?
qpl-1.0 | 78 | q public license | q public license( version 1 0)?
sleepycat | 78 | sleepycat | sleepycat( public)? license
watcom-1.0 | 78 | sybase open watcom public license | sybase open watcom public license( version 1 0)?
apsl-2.0 | 78 | apple public source license | apple public source license( version)?( 2 0)?
intel | 76 | intel open source license | intel open source license
nvidia | 70 | nvidia software license agreement | nvidia software license agreement
oracle-bcl | 76 | binary code license agreement | (sun microsystems inc |oracle )?binary code license agreement
openrail-m | 78 | openrail m | (creativeml |bigscience )?openrail m( license)?
openrail | 70 | open rail | open rail( m| d| s)? license
rail | 74 | responsible ai license | responsible ai license
llama | 76 | community license agreement | llama ([234]( [123])? )?community license agreement
gemma | 74 | gemma terms of use | gemma terms of use
falcon | 74 | falcon | falcon( 180b)? (tii|llm) license
public-domain | 72 | dedicated to the public domain | (is|are|been|hereby) dedicated to the public domain
public-domain | 70 | in the public domain | (is|are|placed|released) in the public domain
public-domain | 68 | released into the public domain | released into the public domain
public-domain | 66 | no known copyright restrictions | no known copyright restrictions
proprietary | 64 | proprietary and confidential | proprietary and confidential
proprietary | 64 | unauthorized copying | unauthorized copying of this file( via any medium)? is strictly prohibited
proprietary | 60 | may not be reproduced | may not be reproduced( \\S+){0,12} without( the)?( prior)?( express)? written permission
proprietary | 58 | trade secret | (confidential|contains)( \\S+){0,4} trade secrets?
all-rights-reserved | 40 | all rights reserved | all rights reserved
non-commercial | 56 | non commercial use only | (for )?(personal and )?non commercial use only
non-commercial | 56 | noncommercial use only | (for )?noncommercial use only
non-commercial | 54 | commercial use is | commercial use is( strictly)? prohibited
research-only | 56 | research purposes only | (academic |scientific )?research purposes only
research-only | 54 | research use only | (for )?(academic )?research use only
no-derivatives | 54 | no derivative works | no derivative works( are)?( permitted| allowed)?
tdm-reserved | 58 | text and data mining | (reserves?|reserved|prohibited|opts? out)( \\S+){0,6} text and data mining
tdm-reserved | 58 | train artificial intelligence | may not be used to train artificial intelligence
tdm-reserved | 57 | training of ai | (not|prohibited)( \\S+){0,6} training of ai( systems| models)?
licence-hint | 20 | see the license file | see the license file( for details)?
licence-hint | 20 | see license | see license( txt| md)? (for|in)
licence-hint | 22 | this file is part of | this file is part of( \\S+){1,6} licensed under
licence-hint | 21 | open source licen | open source licen[sc]ed?
licence-hint | 20 | permissive licen | permissive licen[sc]ed?
licence-hint | 20 | dual licensed | dual licensed( under)?
licence-hint | 20 | copyleft | copyleft
"""

#: Identifiers whose tag ("SPDX-License-Identifier: X", "License: X") is a rule of its own; label as the tag spells it.
TAGS = """
MIT MIT-0 ISC 0BSD X11 Zlib BSL-1.0 Unlicense WTFPL NCSA PostgreSQL curl OpenSSL Vim Beerware JSON UPL-1.0 Python-2.0 PHP-3.01
Apache-1.0 Apache-1.1 Apache-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause
GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only
LGPL-3.0-or-later AGPL-1.0-only AGPL-3.0-only AGPL-3.0-or-later GFDL-1.1-only GFDL-1.2-only GFDL-1.3-only MPL-1.0 MPL-1.1 MPL-2.0
EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 IPL-1.0 Artistic-1.0 Artistic-2.0 EUPL-1.1 EUPL-1.2 OSL-3.0 AFL-2.1 AFL-3.0 MS-PL MS-RL
CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0
ODbL-1.0 ODC-By-1.0 PDDL-1.0 OFL-1.0 OFL-1.1 CECILL-2.1 SSPL-1.0 BUSL-1.1 Elastic-2.0 MulanPSL-2.0 BlueOak-1.0.0
"""
