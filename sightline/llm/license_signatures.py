"""Hand-written signatures of licence texts, file notices, metadata and addresses: ``label | weight | pattern``.

Patterns are over lower-case words joined by single blanks; punctuation and hyphens are blanks, too.
"""

SIGNATURES = r"""
mit | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 0.95 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit | 0.9 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 0.8 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | 0.9 | use of this source code is governed by an mit style licen[cs]e
mit | 0.9 | opensource org licen[cs]es mit(?: licen[cs]e)?(?: php| html)?
mit | 0.8 | licen[cs]ed mit
mit | 0.8 | mit licen[cs]e copyright c
mit | 0.8 | spdx mit
mit | 0.7 | see (?:the )?mit licen[cs]e (?:file|txt|for)
mit-0 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-advertising | 0.9 | except as contained in this notice the name s? ?of the above copyright holders shall not be used in advertising
x11 | 0.9 | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | 0.8 | x window system is a trademark of x consortium
mit-feh | 0.8 | acknowledgement shall be given in the documentation materials and software packages that this software was used
curl | 0.9 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.9 | the software is provided as is and (?:isc|the author) disclaims all warranties with regard to this software
isc | 0.8 | in no event shall (?:isc|the author) be liable for any special direct indirect or consequential damages
isc | 0.9 | opensource org licen[cs]es isc
0bsd | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
hpnd | 0.8 | both that (?:the )?copyright notice and this permission notice appear in supporting documentation
bsd | 1.0 | redistribution and use in source and binary forms with or without modification are permitted
bsd | 0.9 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 0.9 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | 0.8 | this software is provided by the (?:copyright holders?|regents|author|project)(?: and contributors)? as is and any express or implied warranties
bsd | 0.8 | in no event shall the (?:copyright (?:holder|owner)|regents|author)s?(?: or contributors)? be liable for any direct indirect incidental special exemplary
bsd | 0.9 | use of this source code is governed by a bsd style licen[cs]e
bsd-3-clause | 1.0 | neither the name of .{1,120}? may be used to endorse or promote products
bsd-3-clause | 0.9 | names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 0.9 | opensource org licen[cs]es bsd 3 clause
bsd-2-clause | 0.9 | opensource org licen[cs]es bsd 2 clause
bsd-2-clause | 0.8 | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted
bsd-4-clause | 0.95 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-clear | 0.95 | no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e
bsd-patent | 0.9 | subject to the terms and conditions of this licen[cs]e each copyright holder and contributor hereby grants to those receiving rights under this licen[cs]e a perpetual
bsd-nuclear | 0.9 | you acknowledge that this software is not designed (?:licen[cs]ed )?or intended for use in the design construction operation or maintenance of any nuclear facility
bsd-source-code | 0.7 | bsd source code attribution
apache-2 | 1.0 | licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache-2 | 0.9 | you may obtain a copy of the licen[cs]e at (?:http |https )?(?:www )?apache org licen[cs]es licen[cs]e 2 0
apache-2 | 0.9 | apache org licen[cs]es licen[cs]e 2 0
apache-2 | 0.8 | unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache-2 | 0.8 | see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e
apache-2 | 0.9 | apache licen[cs]e version 2 0 january 2004
apache-2 | 0.9 | terms and conditions for use reproduction and distribution 1 definitions licen[cs]e shall mean
apache-2 | 0.9 | opensource org licen[cs]es apache 2 0
apache-2 | 0.8 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e
apache-1.1 | 0.95 | this product includes software developed by the apache software foundation
apache-1.1 | 0.9 | the names apache and apache software foundation must not be used to endorse or promote products
apache-1.0 | 0.9 | this product includes software developed by the apache group
apache | 0.8 | licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements
gpl | 1.0 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl | 0.95 | is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation
gpl-2.0 | 0.95 | gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e
gpl-2.0 | 0.9 | gnu general public licen[cs]e version 2 june 1991
gpl-2.0 | 0.9 | gnu org licen[cs]es (?:old licen[cs]es )?gpl 2 0
gpl-2.0 | 0.8 | gplv2 (?:only|or later)
gpl-2.0 | 0.8 | module licen[cs]e gpl v2
gpl-2.0 | 0.8 | gnu general public licen[cs]e v2
gpl-3.0 | 0.95 | gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e
gpl-3.0 | 0.9 | gnu general public licen[cs]e version 3 29 june 2007
gpl-3.0 | 0.9 | gnu org licen[cs]es gpl 3 0
gpl-3.0 | 0.8 | gplv3 (?:only|or later)
gpl-3.0 | 0.8 | gnu general public licen[cs]e v3
gpl | 0.8 | you should have received a copy of the gnu general public licen[cs]e along with this program
gpl | 0.8 | gnu org licen[cs]es gpl
gpl | 0.8 | module licen[cs]e (?:dual mit gpl|gpl)
gpl | 0.7 | covered by the gnu gpl
gpl | 0.7 | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
gpl-classpath-exception | 0.95 | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-classpath-exception | 0.9 | classpath exception
gpl-font-exception | 0.9 | as a special exception if you create a document which uses this font
gpl-gcc-exception | 0.9 | gcc runtime library exception
gpl-bison-exception | 0.9 | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
gpl-autoconf-exception | 0.9 | as a special exception to the gnu general public licen[cs]e if you distribute this file as part of a program that contains a configuration script generated by autoconf
gpl-linking-exception | 0.8 | linking exception
gpl-syscall-note | 0.9 | linux syscall note
lgpl | 0.95 | is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e
lgpl-2.0 | 0.95 | under the terms of the gnu library general public licen[cs]e as published by the free software foundation
lgpl-2.1 | 0.95 | gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1
lgpl-2.1 | 0.9 | gnu lesser general public licen[cs]e version 2 1 february 1999
lgpl-2.1 | 0.9 | gnu org licen[cs]es (?:old licen[cs]es )?lgpl 2 1
lgpl-3.0 | 0.95 | gnu lesser general public licen[cs]e as published by the free software foundation either version 3
lgpl-3.0 | 0.9 | gnu org licen[cs]es lgpl 3 0
lgpl | 0.8 | you should have received a copy of the gnu lesser general public licen[cs]e
lgpl | 0.8 | gnu org licen[cs]es lgpl
agpl-3.0 | 0.95 | under the terms of the gnu affero general public licen[cs]e as published by the free software foundation
agpl-3.0 | 0.9 | gnu affero general public licen[cs]e version 3 19 november 2007
agpl-3.0 | 0.9 | gnu org licen[cs]es agpl
agpl | 0.8 | you should have received a copy of the gnu affero general public licen[cs]e
gfdl | 0.95 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl | 0.8 | with no invariant sections no front cover texts and no back cover texts
gfdl | 0.8 | gnu org licen[cs]es fdl
fsf-unlimited | 0.9 | this file is free software the free software foundation gives unlimited permission to copy and or distribute it
fsf-all-permissive | 0.95 | copying and distribution of this file with or without modification are permitted in any medium without royalty
mpl-2.0 | 1.0 | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2.0 | 0.95 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | 0.9 | mozilla org mpl 2 0
mpl-2.0 | 0.8 | incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e
mpl-1.1 | 0.95 | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-1.1 | 0.9 | mozilla org mpl mpl 1 1
mpl-1.0 | 0.95 | the contents of this file are subject to the mozilla public licen[cs]e version 1 0
mpl | 0.8 | software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind either express or implied see the licen[cs]e for the specific language governing rights
mpl-gpl-lgpl | 0.9 | mpl 1 1 gpl 2 0 lgpl 2 1
npl | 0.9 | netscape public licen[cs]e
epl-1.0 | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0
epl-2.0 | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v )?2 0
epl-1.0 | 0.9 | eclipse org legal epl v10
epl-2.0 | 0.9 | eclipse org legal epl (?:v20|2 0)
epl | 0.7 | the accompanying program is provided under the terms of this eclipse public licen[cs]e
edl-1.0 | 0.9 | eclipse distribution licen[cs]e
cpl-1.0 | 0.9 | the accompanying program is provided under the terms of this common public licen[cs]e
ipl-1.0 | 0.9 | ibm public licen[cs]e
cddl-1.0 | 0.9 | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl-1.0 | 0.8 | when distributing covered code include this cddl header
cddl-1.1 | 0.9 | cddl gpl v2 with classpath exception
eupl | 0.9 | licen[cs]ed under the eupl
eupl-1.2 | 0.9 | this european union public licen[cs]e the eupl applies to the work
cecill-2.1 | 0.95 | this software is governed by the cecill licen[cs]e under french law
cecill | 0.8 | ce logiciel est regi par la licence cecill
artistic-1.0 | 0.9 | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | 0.9 | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed preamble this licen[cs]e establishes the terms
perl | 0.95 | under the same terms as perl itself
perl | 0.8 | either the gnu general public licen[cs]e or the artistic licen[cs]e
zlib | 1.0 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 0.9 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 0.9 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | 0.95 | the origin of this source code must not be misrepresented
libpng | 0.9 | the png reference library is supplied as is
bsl-1.0 | 0.95 | distributed under the boost software licen[cs]e version 1 0
bsl-1.0 | 0.95 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
bsl-1.0 | 0.9 | boost org licen[cs]e 1 0 txt
unlicense | 1.0 | free and unencumbered software released into the public domain
unlicense | 0.95 | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 0.9 | unlicense org
wtfpl | 0.95 | everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed as long as the name is changed
wtfpl | 0.9 | 0 you just do what the \w+ you want to
beerware | 0.95 | if we meet some day and you think this stuff is worth it you can buy me a beer
beerware | 0.9 | beer ?ware licen[cs]e
json | 0.95 | the software shall be used for good not evil
postgresql | 0.95 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql | 0.9 | postgresql database management system
psf-2.0 | 0.95 | psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e
psf-2.0 | 0.9 | python software foundation licen[cs]e
psf-2.0 | 0.8 | psf licen[cs]e agreement
cnri-python | 0.9 | cnri hereby grants licensee a nonexclusive royalty free
ruby | 0.95 | you may redistribute this software under (?:the )?ruby s licen[cs]e
ruby | 0.9 | same terms as ruby itself
php-3.01 | 0.95 | this source file is subject to version 3 01 of the php licen[cs]e
php-3.0 | 0.95 | this source file is subject to version 3 0 of the php licen[cs]e
php-3.01 | 0.9 | php net licen[cs]e 3 01 txt
zend-2.0 | 0.9 | this source file is subject to version 2 00 of the zend licen[cs]e
openssl | 0.95 | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 0.95 | this product includes cryptographic software written by eric young
openssl | 0.9 | licen[cs]ed under the openssl licen[cs]e
ncsa | 0.95 | to deal with the software without restriction including without limitation the rights to use copy modify
ncsa | 0.9 | llvm release licen[cs]e
llvm-exception | 0.9 | llvm exceptions
ms-pl | 0.95 | this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
ms-pl | 0.9 | opensource org licen[cs]es ms pl
ms-rl | 0.9 | reciprocal grants for any file you distribute that contains code from the software
ms-lpl | 0.9 | microsoft limited public licen[cs]e
ms-eula | 0.8 | microsoft software licen[cs]e terms
apsl-2.0 | 0.95 | this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[cs]e
apple-sample | 0.9 | apple grants you a personal non exclusive licen[cs]e under apple s copyrights in this original apple software
sgi-b-2.0 | 0.9 | sgi free software licen[cs]e b
w3c | 0.95 | w3c software notice and licen[cs]e
w3c | 0.9 | w3c document licen[cs]e
unicode-dfs | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
icu | 0.9 | icu licen[cs]e icu 1 8 1 and later
ijg | 0.95 | this software is based in part on the work of the independent jpeg group
ftl | 0.95 | the freetype project licen[cs]e
ftl | 0.9 | portions of this software are copyright .{1,60}? the freetype project
tcl | 0.95 | the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation
info-zip | 0.9 | info zip licen[cs]e
bzip2 | 0.8 | bzip2 licen[cs]e
vim | 0.9 | vim licen[cs]e
naist | 0.8 | nara institute of science and technology
ofl-1.1 | 0.95 | this font software is licen[cs]ed under the sil open font licen[cs]e
ofl-1.1 | 0.9 | scripts sil org ofl
ofl-1.1 | 0.8 | with reserved font name
ubuntu-font | 0.9 | ubuntu font licen[cs]e
bitstream-vera | 0.9 | bitstream vera is a trademark of bitstream inc
odbl-1.0 | 0.95 | this .{1,60}? is made available under the open database licen[cs]e
odbl-1.0 | 0.9 | opendatacommons org licen[cs]es odbl
odc-by-1.0 | 0.9 | opendatacommons org licen[cs]es by
pddl-1.0 | 0.9 | opendatacommons org licen[cs]es pddl
cdla-permissive | 0.9 | community data licen[cs]e agreement permissive
cdla-sharing | 0.9 | community data licen[cs]e agreement sharing
ogl-uk | 0.9 | open government licen[cs]e
ogl-uk | 0.9 | contains public sector information licen[cs]ed under the open government licen[cs]e
etalab-2.0 | 0.9 | licence ouverte
dl-de-by-2.0 | 0.9 | datenlizenz deutschland namensnennung
cc0-1.0 | 0.95 | to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights
cc0-1.0 | 0.95 | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | 0.9 | creativecommons org publicdomain zero
cc-pdm | 0.9 | creativecommons org publicdomain mark
cc-by | 0.9 | creativecommons org licen[cs]es by \d 0
cc-by-sa | 0.9 | creativecommons org licen[cs]es by sa
cc-by-nd | 0.9 | creativecommons org licen[cs]es by nd
cc-by-nc | 0.9 | creativecommons org licen[cs]es by nc \d 0
cc-by-nc-sa | 0.9 | creativecommons org licen[cs]es by nc sa
cc-by-nc-nd | 0.9 | creativecommons org licen[cs]es by nc nd
cc-by | 0.8 | this work is licen[cs]ed under a creative commons attribution \d 0
cc-by-sa | 0.85 | text is available under the creative commons attribution sharealike
cc-by-nc | 0.8 | for non commercial use only under (?:a )?creative commons
cc | 0.6 | creative commons
cc | 0.6 | some rights reserved
sspl-1.0 | 0.95 | if you make the functionality of the program or a modified version available to third parties as a service
sspl-1.0 | 0.9 | server side public licen[cs]e version 1
busl-1.1 | 0.95 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[cs]ed work
busl-1.1 | 0.9 | change licen[cs]e apache licen[cs]e version 2 0
elastic-2.0 | 0.95 | you may not provide the software to third parties as a hosted or managed service
commons-clause | 0.95 | the licen[cs]e does not grant to you the right to sell the software
commons-clause | 0.9 | commons clause licen[cs]e condition
polyform | 0.9 | polyform (?:noncommercial|small business|shield|internal use|strict) licen[cs]e
confluent | 0.9 | confluent community licen[cs]e
timescale | 0.8 | timescale licen[cs]e
redis-sal | 0.9 | redis source available licen[cs]e
llama | 0.9 | llama \d(?: \d)? community licen[cs]e
openrail | 0.9 | open ?rail(?: m)? licen[cs]e
openrail | 0.9 | creativeml open rail m
gemma | 0.8 | gemma terms of use
osl-3.0 | 0.95 | licen[cs]ed under the open software licen[cs]e version 3 0
afl-3.0 | 0.95 | licen[cs]ed under the academic free licen[cs]e version 3 0
ecl-2.0 | 0.9 | educational community licen[cs]e
upl-1.0 | 0.9 | universal permissive licen[cs]e
mulan-psl-2.0 | 0.95 | licen[cs]ed under mulan psl v2
mulan-psl-2.0 | 0.9 | mulan permissive software licen[cs]e
blueoak-1.0 | 0.95 | this licen[cs]e gives everyone as much permission to work with this software as possible
parity | 0.8 | the parity public licen[cs]e
hippocratic | 0.9 | hippocratic licen[cs]e
anti-996 | 0.9 | anti 996 licen[cs]e
qpl-1.0 | 0.9 | q public licen[cs]e
sleepycat | 0.9 | sleepycat licen[cs]e
sleepycat | 0.85 | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
watcom | 0.8 | sybase open watcom public licen[cs]e
lppl | 0.95 | this work may be distributed and or modified under the conditions of the latex project public licen[cs]e
lppl | 0.9 | latex project public licen[cs]e
nasa | 0.9 | nasa open source agreement
us-government | 0.8 | pursuant to title 17 section 105 of the united states code this software is not subject to copyright protection
us-government | 0.8 | this is a work of the u s government
public-domain | 0.7 | (?:in|into|to) the public domain
public-domain | 0.85 | this (?:file|code|software|work) (?:is|has been) (?:placed )?in the public domain
public-domain | 0.8 | the author disclaims copyright to this source code
public-domain | 0.8 | no copyright is claimed
proprietary | 0.6 | all rights reserved
proprietary | 0.8 | proprietary and confidential
proprietary | 0.85 | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 0.8 | this software is the confidential and proprietary information of
proprietary | 0.8 | may not be reproduced (?:or transmitted )?in any form (?:or by any means )?without (?:the )?(?:prior )?written permission
proprietary | 0.8 | this end user licen[cs]e agreement
proprietary | 0.7 | for internal use only
proprietary | 0.7 | trade secret
proprietary | 0.7 | licen[cs]ed not sold
dual | 0.7 | dual licen[cs]ed under
dual | 0.7 | at your option any later version
permissive | 0.6 | free for personal and commercial use
noncommercial | 0.7 | for non commercial (?:use|purposes) only
noncommercial | 0.7 | free for non commercial use
research-only | 0.7 | for (?:academic|research) (?:use|purposes) only
arr-press | 0.6 | reprinted with permission
"""
