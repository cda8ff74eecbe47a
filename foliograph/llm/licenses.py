"""Licence scans by ordered signature rules.

Every text is read as words (letters A-Z lowered; runs of ASCII letters, digits and all other code
points above U+007F). A signature is a regular expression over the words joined by single spaces;
its gates are words of which every match contains one, and only rules with a gate among the text's
words run, around its places. Detections are settled in order of priority, then length, then place: one that lies inside a
settled detection is dropped. The places of the base phrases are always reported, and their labels
always stay.

The 309 signatures (identifier tags, grants, titles, addresses and sentences of the licence texts) are
written out below.

Null or empty text: no words, no places, empty labels, score 0. Repeated rows are scanned each.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from foliograph.llm.common import chunks, utf8

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Abbreviations in the signatures.
MACROS = {
    "{L}": "licen[cs]e",
    "{v}": "(?:version |v ?)",
    "{under}": "(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?",
}
#: Label | priority | signature, a regular expression over words.
SIGNATURES = r"""
mit | 99 | spdx license identifier (?:mit|expat)
mit | 95 | {under}(?:mit|expat)(?: {L})?
mit | 92 | (?:the )?(?:mit|expat)(?: x11)?(?: style)? {L}
mit | 97 | opensource org licen[cs]es? mit
mit | 85 | permission is hereby granted free of charge to any person obtaining a copy
mit | 84 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit-0 | 99 | spdx license identifier mit 0
mit-0 | 93 | mit no attribution(?: {L})?|mit 0 {L}
mit-modern | 99 | spdx license identifier mit (?:modern variant|advertising|cmu|feh|enna)
apache-1 | 99 | spdx license identifier apache 1 [01]
apache-1 | 93 | apache (?:software )?{L} {v}?1(?: [01])?
apache-1 | 95 | {under}apache (?:software )?(?:{L} )?{v}?1 [01]
apache-2 | 99 | spdx license identifier apache 2 0
apache-2 | 95 | {under}apache(?: software)?(?: {L})?(?: {v})? ?2(?: 0)?(?: {L})?
apache-2 | 92 | (?:the )?apache(?: software)?(?: {L})? {v}?2(?: 0)?(?: {L})?
apache-2 | 91 | apache2(?: 0)?(?: {L})?|asl ?2(?: 0)?
apache-2 | 97 | apache org licen[cs]es? license 2 0
apache-2 | 97 | opensource org licen[cs]es? apache 2 0
apache-2 | 85 | unless required by applicable law or agreed to in writing software distributed under the license
apache-2 | 84 | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-any | 70 | (?:the )?apache(?: software)? {L}
bsd-0 | 99 | spdx license identifier 0bsd
bsd-0 | 93 | (?:0bsd|zero clause bsd|bsd zero clause|0 clause bsd)(?: {L})?
bsd-1 | 99 | spdx license identifier bsd 1 clause
bsd-1 | 93 | (?:bsd 1 clause|(?:1|one) clause bsd)(?: {L})?
bsd-2 | 99 | spdx license identifier bsd 2 clause(?: patent| views| freebsd)?
bsd-2 | 95 | {under}(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: {L})?
bsd-2 | 92 | (?:the )?(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: {L})?
bsd-2 | 97 | opensource org licen[cs]es? bsd 2 clause
bsd-2 | 83 | redistribution and use in source and binary forms with or without modification
bsd-3 | 99 | spdx license identifier bsd 3 clause(?: clear| attribution| lbnl| modification)?
bsd-3 | 95 | {under}(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: {L})?
bsd-3 | 92 | (?:the )?(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: {L})?
bsd-3 | 97 | opensource org licen[cs]es? bsd 3 clause
bsd-3 | 85 | neither the name of (?:\S+ ){1,12}nor the names of its contributors
bsd-4 | 99 | spdx license identifier bsd 4 clause(?: uc| shortened)?
bsd-4 | 93 | (?:the )?(?:bsd 4 clause|(?:4|four) clause bsd|original bsd|old bsd)(?: {L})?
bsd-4 | 86 | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd-any | 90 | (?:the )?bsd(?: style)? {L}
bsd-any | 94 | {under}bsd(?: style)? {L}
bsd-protection | 99 | spdx license identifier bsd protection
gpl-1 | 99 | spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 | 92 | gnu general public {L} {v}?1(?: 0)?|gplv1
gpl-2 | 99 | spdx license identifier gpl 2 0(?: only| or later)?(?: with [a-z]+ exception(?: [0-9] [0-9])?)?
gpl-2 | 95 | {under}(?:gnu )?(?:gpl|general public {L}(?: gpl)?)(?: {v}?| ?v)2(?: 0)?(?: or later)?(?: {L})?
gpl-2 | 93 | (?:the )?gnu general public {L} (?:gpl )?{v}?2(?: 0)?
gpl-2 | 91 | gpl ?v ?2(?: 0)?(?: only| or later)?|gpl 2(?: 0)? {L}
gpl-2 | 97 | gnu org licen[cs]es? (?:old licenses )?gpl 2 0
gpl-2 | 88 | free software foundation either version 2 of the license or at your option any later version
gpl-3 | 99 | spdx license identifier gpl 3 0(?: only| or later)?(?: with [a-z]+ exception(?: [0-9] [0-9])?)?
gpl-3 | 95 | {under}(?:gnu )?(?:gpl|general public {L}(?: gpl)?)(?: {v}?| ?v)3(?: 0)?(?: or later)?(?: {L})?
gpl-3 | 93 | (?:the )?gnu general public {L} (?:gpl )?{v}?3(?: 0)?
gpl-3 | 91 | gpl ?v ?3(?: 0)?(?: only| or later)?|gpl 3(?: 0)? {L}
gpl-3 | 97 | gnu org licen[cs]es? gpl 3 0
gpl-3 | 88 | free software foundation either version 3 of the license or at your option any later version
gpl-any | 75 | (?:the )?gnu general public {L}|gnu gpl|(?:the )?gpl {L}
gpl-any | 94 | {under}(?:gnu )?(?:gpl|general public {L})
gpl-any | 97 | gnu org licen[cs]es? gpl
gpl-any | 80 | this program is free software you can redistribute it and or modify it
gpl-any | 81 | you should have received a copy of the gnu general public license along with this program
lgpl-2 | 99 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 | 92 | gnu library general public {L}(?: {v}?2(?: 0)?)?|lgpl ?v ?2 0
lgpl-2.1 | 99 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | 95 | {under}(?:gnu )?(?:lgpl|lesser general public {L}(?: lgpl)?)(?: {v}?| ?v)2 1(?: {L})?
lgpl-2.1 | 93 | (?:the )?gnu lesser general public {L} (?:lgpl )?{v}?2 1
lgpl-2.1 | 91 | lgpl ?v? ?2 1(?: only| or later)?(?: {L})?
lgpl-2.1 | 97 | gnu org licen[cs]es? (?:old licenses )?lgpl 2 1
lgpl-3 | 99 | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | 95 | {under}(?:gnu )?(?:lgpl|lesser general public {L}(?: lgpl)?)(?: {v}?| ?v)3(?: 0)?(?: {L})?
lgpl-3 | 93 | (?:the )?gnu lesser general public {L} (?:lgpl )?{v}?3(?: 0)?
lgpl-3 | 91 | lgpl ?v ?3(?: 0)?(?: only| or later)?(?: {L})?
lgpl-3 | 97 | gnu org licen[cs]es? lgpl 3 0
lgpl-any | 75 | (?:the )?gnu lesser general public {L}|gnu lgpl|(?:the )?lgpl {L}
lgpl-any | 94 | {under}(?:gnu )?(?:lgpl|lesser general public {L})
lgpl-any | 97 | gnu org licen[cs]es? lgpl
lgpl-any | 80 | this library is free software you can redistribute it and or modify it
agpl-1 | 99 | spdx license identifier agpl 1 0(?: only| or later)?
agpl-1 | 92 | affero general public {L} {v}?1(?: 0)?
agpl-3 | 99 | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | 95 | {under}(?:gnu )?(?:agpl|affero general public {L})(?: ?{v}?3(?: 0)?)?
agpl-3 | 92 | (?:the )?(?:gnu )?affero general public {L}(?: (?:agpl )?{v}?3(?: 0)?)?
agpl-3 | 91 | agpl ?v? ?3(?: 0)?(?: only| or later)?(?: {L})?|agpl {L}
agpl-3 | 97 | gnu org licen[cs]es? agpl(?: 3 0)?
gfdl-1 | 99 | spdx license identifier gfdl 1 [123](?: invariants| no invariants)?(?: only| or later)?
gfdl-1 | 92 | (?:the )?gnu free documentation {L}(?: {v}?1 [123])?|gfdl(?: 1 [123])?
gfdl-1 | 97 | gnu org licen[cs]es? fdl(?: 1 [123])?
gfdl-1 | 85 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1 | 99 | spdx license identifier mpl 1 0
mpl-1 | 92 | mozilla public {L} {v}?1 0
mpl-1.1 | 99 | spdx license identifier mpl 1 1
mpl-1.1 | 92 | (?:the )?mozilla public {L} {v}?1 1|mpl ?v? ?1 1
mpl-1.1 | 97 | mozilla org mpl mpl 1 1
mpl-2 | 99 | spdx license identifier mpl 2 0(?: no copyleft exception)?
mpl-2 | 95 | {under}(?:mpl|mozilla public {L})(?: ?{v}?2(?: 0)?)?
mpl-2 | 92 | (?:the )?mozilla public {L}(?: (?:mpl )?{v}?2(?: 0)?)?
mpl-2 | 91 | mpl ?v? ?2(?: 0)?(?: {L})?|mpl {L}
mpl-2 | 97 | mozilla org (?:en us )?mpl 2 0
mpl-2 | 88 | this source code form is subject to the terms of the mozilla public license v 2 0
epl-1 | 99 | spdx license identifier epl 1 0
epl-1 | 95 | {under}(?:epl|eclipse public {L}) {v}?1(?: 0)?
epl-1 | 92 | (?:the )?eclipse public {L} {v}?1(?: 0)?|epl ?v? ?1(?: 0)
epl-1 | 97 | eclipse org legal epl v10
epl-2 | 99 | spdx license identifier epl 2 0
epl-2 | 95 | {under}(?:epl|eclipse public {L}) {v}?2(?: 0)?
epl-2 | 92 | (?:the )?eclipse public {L} {v}?2(?: 0)?|epl ?v? ?2(?: 0)
epl-2 | 97 | eclipse org legal epl (?:2 0|v20)
epl-any | 75 | (?:the )?eclipse public {L}
edl-1 | 92 | (?:the )?eclipse distribution {L}(?: {v}?1(?: 0)?)?
cddl-1 | 99 | spdx license identifier cddl 1 [01]
cddl-1 | 95 | {under}(?:cddl|common development and distribution {L})
cddl-1 | 92 | (?:the )?common development and distribution {L}(?: {v}?1 [01])?
cddl-1 | 91 | cddl(?: {v}?1 [01])?(?: {L})?
cpl-1 | 99 | spdx license identifier cpl 1 0
cpl-1 | 92 | (?:the )?common public {L}(?: {v}?1(?: 0)?)?
cpal-1 | 99 | spdx license identifier cpal 1 0
cpal-1 | 92 | common public attribution {L}(?: {v}?1(?: 0)?)?
ipl-1 | 99 | spdx license identifier ipl 1 0
ipl-1 | 92 | (?:the )?ibm public {L}(?: {v}?1(?: 0)?)?
eupl-1.1 | 99 | spdx license identifier eupl 1 1
eupl-1.1 | 93 | eupl ?v? ?1 1|european union public {L} {v}?1 1
eupl-1.2 | 99 | spdx license identifier eupl 1 2
eupl-1.2 | 95 | {under}(?:eupl|european union public {L})(?: {v}?1 2)?
eupl-1.2 | 92 | (?:the )?european union public {L}(?: {v}?1 2)?
eupl-1.2 | 91 | eupl ?v? ?1 2|eupl {L}
cecill-2 | 99 | spdx license identifier cecill (?:2 [01]|b|c)
cecill-2 | 92 | cecill(?: (?:b|c))?(?: free software)? {L}(?: agreement)?
isc | 99 | spdx license identifier isc
isc | 95 | {under}isc(?: {L})?
isc | 92 | (?:the )?isc {L}|internet (?:systems|software) consortium {L}
isc | 97 | opensource org licen[cs]es? isc
isc | 85 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | 99 | spdx license identifier zlib(?: acknowledgement)?
zlib | 92 | (?:the )?zlib(?: libpng)? {L}
zlib | 85 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng | 99 | spdx license identifier libpng(?: 2 0)?
libpng | 92 | (?:the )?(?:png reference library|libpng) {L}
bsl-1 | 99 | spdx license identifier bsl 1 0
bsl-1 | 95 | {under}boost(?: software)?(?: {L})?
bsl-1 | 92 | (?:the )?boost software {L}(?: {v}?1(?: 0)?)?
bsl-1 | 97 | boost org license 1 0 txt
unlicense | 99 | spdx license identifier unlicense
unlicense | 92 | the unlicense|unlicense {L}
unlicense | 95 | {under}unlicense
unlicense | 97 | unlicense org
unlicense | 85 | this is free and unencumbered software released into the public domain
wtfpl | 99 | spdx license identifier wtfpl
wtfpl | 92 | (?:the )?wtfpl(?: {v}?2)?(?: {L})?|do what the fuck you want to public {L}
wtfpl | 97 | wtfpl net
artistic-1 | 99 | spdx license identifier artistic 1 0(?: cl8| perl)?
artistic-1 | 92 | artistic {L} {v}?1(?: 0)?
artistic-2 | 99 | spdx license identifier artistic 2 0
artistic-2 | 92 | (?:the )?artistic(?: {L})? {v}?2(?: 0)?(?: {L})?
artistic-2 | 97 | opensource org licen[cs]es? artistic {L} 2 0
artistic-any | 75 | (?:the )?(?:perl )?artistic {L}
perl | 90 | same terms as perl itself
python-2 | 99 | spdx license identifier (?:python 2 0(?: 1)?|psf 2 0)
python-2 | 92 | (?:the )?(?:python software foundation|psf|python) {L}(?: agreement)?(?: {v}?2)?
cnri-python | 99 | spdx license identifier cnri python(?: gpl compatible)?
php-3 | 99 | spdx license identifier php 3 0(?: ?1)?
php-3 | 92 | (?:the )?php {L}(?: {v}?3 01?)?
zend-2 | 99 | spdx license identifier zend 2 0
zend-2 | 92 | (?:the )?zend(?: engine)? {L}
ruby | 99 | spdx license identifier ruby
ruby | 92 | (?:the )?ruby {L}|same terms as ruby itself
openssl | 99 | spdx license identifier openssl(?: standalone)?
openssl | 92 | (?:the )?openssl {L}
openssl | 86 | this product includes software developed by the openssl project
ssleay | 86 | this product includes cryptographic software written by eric young
postgresql | 99 | spdx license identifier postgresql
postgresql | 92 | (?:the )?postgresql {L}
ms-pl | 99 | spdx license identifier ms pl
ms-pl | 92 | (?:the )?microsoft public {L}|ms pl {L}
ms-rl | 99 | spdx license identifier ms rl
ms-rl | 92 | (?:the )?microsoft reciprocal {L}|ms rl {L}
ms-lpl | 92 | (?:the )?microsoft limited public {L}
ofl-1.0 | 99 | spdx license identifier ofl 1 0(?: no rfn| rfn)?
ofl-1.1 | 99 | spdx license identifier ofl 1 1(?: no rfn| rfn)?
ofl-1.1 | 95 | {under}(?:sil )?(?:ofl|open font {L})(?: {v}?1 1)?
ofl-1.1 | 92 | (?:the )?(?:sil )?open font {L}(?: {v}?1 1)?|sil ofl(?: 1 1)?
ofl-1.1 | 97 | scripts sil org ofl
ncsa | 99 | spdx license identifier ncsa
ncsa | 92 | university of illinois(?: ncsa)?(?: open source)? {L}|ncsa(?: open source)? {L}
afl-3 | 99 | spdx license identifier afl (?:1 [12]|2 [01]|3 0)
afl-3 | 92 | (?:the )?academic free(?: {L})?(?: {v}?3(?: 0)?)?
osl-3 | 99 | spdx license identifier osl (?:1 [01]|2 [01]|3 0)
osl-3 | 92 | (?:the )?open software {L}(?: {v}?3(?: 0)?)?
qpl-1 | 99 | spdx license identifier qpl 1 0
qpl-1 | 92 | (?:the )?q public {L}
sleepycat | 99 | spdx license identifier sleepycat
sleepycat | 92 | (?:the )?sleepycat(?: public)? {L}
spl-1 | 99 | spdx license identifier spl 1 0
spl-1 | 92 | (?:the )?sun public {L}(?: {v}?1 0)?
sissl | 92 | sun industry standards source {L}
w3c | 99 | spdx license identifier w3c(?: 19980720| 20150513)?
w3c | 92 | (?:the )?w3c software(?: notice)?(?: and(?: document)?)?(?: notice and)? {L}
upl-1 | 99 | spdx license identifier upl 1 0
upl-1 | 92 | (?:the )?universal permissive {L}(?: {v}?1(?: 0)?)?
vim | 99 | spdx license identifier vim
vim | 92 | (?:the )?vim {L}
x11 | 99 | spdx license identifier x11(?: distribute modifications variant)?
x11 | 92 | (?:the )?(?:x11|x consortium) {L}
x11 | 85 | except as contained in this notice the name of the x consortium shall not be used
hpnd | 99 | spdx license identifier hpnd(?: sell variant)?
hpnd | 92 | historical permission notice and disclaimer(?: {L})?
curl | 99 | spdx license identifier curl
curl | 92 | (?:the )?curl {L}
ecl-2 | 99 | spdx license identifier ecl 2 0
ecl-2 | 92 | (?:the )?educational community {L}(?: {v}?2(?: 0)?)?
ijg | 99 | spdx license identifier ijg
ijg | 88 | this software is based in part on the work of the independent jpeg group
json | 99 | spdx license identifier json
json | 92 | (?:the )?json {L}
json | 88 | the software shall be used for good not evil
beerware | 99 | spdx license identifier beerware
beerware | 92 | (?:the )?beer ?ware {L}
tcl | 99 | spdx license identifier tcl
tcl | 92 | (?:the )?tcl(?: tk)? {L}
unicode | 99 | spdx license identifier unicode (?:dfs 201[56]|3 0|tou)
unicode | 92 | (?:the )?unicode(?: inc)? {L}(?: agreement)?(?: v3)?
icu | 99 | spdx license identifier icu
icu | 92 | (?:the )?icu {L}
freetype | 99 | spdx license identifier ftl
freetype | 92 | (?:the )?freetype(?: project)? {L}
imagemagick | 99 | spdx license identifier imagemagick
imagemagick | 92 | (?:the )?imagemagick {L}
info-zip | 92 | (?:the )?info zip {L}
bzip2 | 99 | spdx license identifier bzip2 1 0 [56]
bzip2 | 92 | (?:the )?bzip2 {L}
xfree86 | 92 | (?:the )?xfree86(?: project)? {L}(?: 1 1)?
naist-2003 | 92 | (?:the )?naist(?: 2003)? {L}
mulan-2 | 99 | spdx license identifier mulanpsl 2 0
mulan-2 | 92 | mulan (?:psl|permissive software {L})(?: ?{v}?2)?
nist | 92 | nist (?:software|public domain notice)(?: {L})?
bsl-1.1 | 99 | spdx license identifier busl 1 1
bsl-1.1 | 92 | (?:the )?business source {L}(?: {v}?1 1)?|busl ?1 ?1
sspl-1 | 99 | spdx license identifier sspl 1 0
sspl-1 | 92 | (?:the )?server side public {L}(?: {v}?1)?|sspl {L}
elastic-2 | 99 | spdx license identifier elastic 2 0
elastic-2 | 92 | (?:the )?elastic {L}(?: {v}?2(?: 0)?)?
commons-clause | 92 | (?:the )?commons clause(?: {L})?(?: condition)?
commons-clause | 93 | commons clause {L} condition {v}?1 0
polyform | 99 | spdx license identifier polyform (?:noncommercial|small business) 1 0 0
polyform | 92 | polyform (?:noncommercial|small business|shield|perimeter|strict|free trial)(?: {L})?(?: 1 0 0)?
hippocratic | 99 | spdx license identifier hippocratic 2 1
hippocratic | 92 | (?:the )?hippocratic {L}(?: {v}?[123](?: [01])?)?
prosperity | 92 | (?:the )?prosperity public {L}(?: 3 0 0)?
parity | 92 | (?:the )?parity public {L}(?: 7 0 0)?
blueoak-1 | 99 | spdx license identifier blueoak 1 0 0
blueoak-1 | 92 | blue oak model {L}(?: 1 0 0)?
cc0-1 | 99 | spdx license identifier cc0 1 0
cc0-1 | 95 | {under}(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?
cc0-1 | 92 | cc0(?: 1 0)?(?: universal)? {L}|cc0 1 0(?: universal)?|creative commons zero(?: {L})?
cc0-1 | 97 | creativecommons org publicdomain zero 1 0
cc0-1 | 86 | the person who associated a work with this deed has dedicated the work to the public domain
cc-pdm | 97 | creativecommons org publicdomain mark 1 0
cc-by | 99 | spdx license identifier cc by [1-4] [05]
cc-by | 95 | {under}(?:a )?(?:cc by|creative commons attribution) (?:[1-4] [05](?: international| unported)?|{L})
cc-by | 92 | creative commons attribution(?= [1-4] | international|$| {L})(?: [1-4] [05])?(?: international| unported)?(?: public)?(?: {L})?
cc-by | 91 | cc by(?: [1-4] [05]| {L})
cc-by | 97 | creativecommons org licen[cs]es? by [1-4] [05]
cc-by-sa | 99 | spdx license identifier cc by sa [1-4] [05]
cc-by-sa | 95 | {under}(?:a )?(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?(?: international| unported)?(?: {L})?
cc-by-sa | 92 | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: public)?(?: {L})?
cc-by-sa | 91 | cc by sa(?: [1-4] [05]| {L})?
cc-by-sa | 97 | creativecommons org licen[cs]es? by sa [1-4] [05]
cc-by-nd | 99 | spdx license identifier cc by nd [1-4] [05]
cc-by-nd | 92 | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?(?: {L})?
cc-by-nd | 91 | cc by nd(?: [1-4] [05]| {L})?
cc-by-nd | 97 | creativecommons org licen[cs]es? by nd [1-4] [05]
cc-by-nc | 99 | spdx license identifier cc by nc [1-4] [05]
cc-by-nc | 92 | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: {L})?
cc-by-nc | 91 | cc by nc(?: [1-4] [05]| {L})
cc-by-nc | 97 | creativecommons org licen[cs]es? by nc [1-4] [05]
cc-by-nc-sa | 99 | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-sa | 92 | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: {L})?
cc-by-nc-sa | 91 | cc by nc sa(?: [1-4] [05]| {L})?
cc-by-nc-sa | 97 | creativecommons org licen[cs]es? by nc sa [1-4] [05]
cc-by-nc-nd | 99 | spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-nd | 92 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?(?: {L})?
cc-by-nc-nd | 91 | cc by nc nd(?: [1-4] [05]| {L})?
cc-by-nc-nd | 97 | creativecommons org licen[cs]es? by nc nd [1-4] [05]
cc-any | 70 | (?:a )?creative commons {L}
cc-any | 96 | creativecommons org licen[cs]es
pddl-1 | 99 | spdx license identifier pddl 1 0
pddl-1 | 92 | open data commons public domain dedication(?: and)?(?: {L})?|pddl {L}
pddl-1 | 97 | opendatacommons org licen[cs]es? pddl
odbl-1 | 99 | spdx license identifier odbl 1 0
odbl-1 | 92 | (?:the )?(?:open data commons )?open database {L}|odbl(?: 1 0)?
odbl-1 | 97 | opendatacommons org licen[cs]es? odbl
odc-by-1 | 99 | spdx license identifier odc by 1 0
odc-by-1 | 92 | (?:the )?open data commons attribution(?: {L})?|odc by(?: 1 0)?
odc-by-1 | 97 | opendatacommons org licen[cs]es? by
cdla-permissive | 99 | spdx license identifier cdla permissive [12] 0
cdla-permissive | 92 | community data {L} agreement permissive(?: {v}?[12] 0)?
cdla-sharing | 99 | spdx license identifier cdla sharing 1 0
cdla-sharing | 92 | community data {L} agreement sharing(?: {v}?1 0)?
ogl-3 | 99 | spdx license identifier ogl uk [123] 0
ogl-3 | 92 | (?:the )?open government {L}(?: {v}?[123](?: 0)?)?
etalab-2 | 92 | etalab(?: open)? {L}(?: 2 0)?|licence ouverte(?: etalab)?(?: 2 0)?
openrail | 92 | (?:the )?(?:creativeml )?openrail(?: ?m)?(?: {L})?|responsible ai {L}
openrail | 91 | bigscience(?: bloom)? rail(?: 1 0)?(?: {L})?
llama | 92 | (?:the )?(?:meta )?llama [234](?: [1-9])? community {L}(?: agreement)?
gemma | 92 | gemma (?:terms of use|{L})
public-domain | 60 | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 59 | this work is in the public domain|no rights reserved
all-rights-reserved | 60 | all rights reserved
proprietary | 60 | proprietary and confidential|confidential and proprietary
proprietary | 61 | unauthorized copying of this file(?: via any medium)?(?: is strictly prohibited)?
proprietary | 58 | (?:may|must) not be (?:reproduced|copied|redistributed) (?:\S+ ){0,8}without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)
"""


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int  # of 100; also the detection's confidence in per cent
    gate: str
    pattern: re.Pattern


def _signatures() -> list[Signature]:
    out = []
    for line in SIGNATURES.strip().split("\n"):
        label, priority, pattern = line.split(" | ", 2)
        gates = _gates(pattern)
        for macro, text in MACROS.items():
            pattern = pattern.replace(macro, text)
        compiled = re.compile(rf"(?:(?<= )|\A)(?:{pattern})(?= |\Z)")
        out += [Signature(label, int(priority), gate, compiled) for gate in gates]
    return out


def _expansions(pattern: str) -> list[str]:
    """The texts that a pattern without optional groups and repetition matches; of a range its ends."""
    if m := re.search(r"\(\?:([^()]*)\)", pattern):
        return [x for way in m[1].split("|") for x in _expansions(pattern[: m.start()] + way + pattern[m.end() :])]
    if "|" in pattern:
        return [x for way in pattern.split("|") for x in _expansions(way)]
    if m := re.search(r"\[([^]]*)\](\??)", pattern):
        ways = [*m[1].replace("-", ""), *([""] if m[2] else [])]
    elif m := re.search(r"(.)\?", pattern):
        ways = [m[1], ""]
    else:
        return [pattern]
    return [x for way in ways for x in _expansions(pattern[: m.start()] + way + pattern[m.end() :])]


def _gates(pattern: str) -> list[str]:
    """Words of which every match of a signature holds one, as few and as long as may be. What may be missing from a match
    cannot be a gate; a grant of a licence with a short name is told by its verb."""
    core = pattern.replace("{under}", "").replace("{L}", MACROS["{L}"]).replace("{v}", "(?:v)")
    core = re.sub(r"\(\?=[^()]*\)", "", core)
    # Whole words that may be missing go; letters that may be missing are one way of two.
    while (shorter := re.sub(r"\(\?:([^()]*)\)(?:\?|\{[^}]*\})", lambda m: "" if m[1][0] == " " or m[1][-1] == " " else f"(?:{m[1]}|)", core)) != core:
        core = shorter
    left, out = [x.split() for x in _expansions(core)], []
    while left:
        words = [w for x in left for w in x]
        out.append(max(words, key=lambda w: (len(w) > 3, sum(w in x for x in left), w == "license", len(w), -words.index(w))))
        left = [x for x in left if out[-1] not in x]
    if "{under}" in pattern and min(map(len, out)) < 4:
        return "licensed released distributed available".split()
    return out


#: No match is longer in words.
REACH = 32
_rules: dict[bytes, list[Signature]] = {}
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def rules() -> dict[bytes, list[Signature]]:
    """The signatures by gate."""
    if not _rules:
        for s in _signatures():
            _rules.setdefault(s.gate.encode(), []).append(s)
    return _rules


def normalized(text: bytes) -> bytes:
    return b" ".join(text.translate(_FOLD).split())


def places(words: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase starts."""
    padded, wanted = b" " + words + b" ", b" " + phrase + b" "
    found, at, seen, number = [], padded.find(wanted), 0, 0
    while at >= 0:
        number += padded.count(b" ", seen, at)
        seen = at
        found.append(number)
        at = padded.find(wanted, at + 1)
    return found


def detect(words: bytes) -> list[tuple[int, int, str, int]]:
    """Settled detections as (first word, one past the last, label, priority), in place order. A signature is looked for
    around its gate's places only: REACH words hold any match on either side."""
    every = words.split()
    by_gate = rules()
    known = by_gate.keys() & set(every)
    if not known:
        return []
    at: dict[bytes, list[list[int]]] = {}
    for i, w in enumerate(every):
        if w in known:
            own = at.setdefault(w, [])
            if own and i - REACH <= own[-1][1]:
                own[-1][1] = i + REACH + 1
            else:
                own.append([max(0, i - REACH), i + REACH + 1])
    found = set()
    for gate, windows in at.items():
        for a, b in windows:
            line = b" ".join(every[a:b]).decode()
            for s in by_gate[gate]:
                for m in s.pattern.finditer(line):
                    start = a + line.count(" ", 0, m.start())
                    found.add((start, start + m[0].count(" ") + 1, s.label, s.priority))
    return settled(found)


def settled(found: set[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Detections in place order without those that lie inside one of higher priority (of equal priority: a longer one,
    else the one before it or the lesser label). ``ends`` is a tree of greatest ends by start, so n take n log n steps."""
    place = {a: i for i, a in enumerate(sorted({d[0] for d in found}), 1)}
    ends = [0] * (len(place) + 1)
    out = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
        i, furthest = place[d[0]], 0
        while i:
            furthest = max(furthest, ends[i])
            i &= i - 1
        if furthest < d[1]:
            out.append(d)
            i = place[d[0]]
            while i < len(ends):
                ends[i] = max(ends[i], d[1])
                i += i & -i
    return sorted(out)


def scan_text(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    words = normalized(text)
    n = words.count(b" ") + 1 if words else 0
    base = [(p, label) for phrase, label in BASE.items() for p in places(words, phrase.encode())]
    found = detect(words)
    base_labels = {label for _, label in base}
    at = [p for p, _ in base]
    doubt = 1.0
    for d in found:
        doubt *= 1 - d[3] / 100
    if base:
        doubt = min(doubt, 0.05)
    labels = base_labels | {d[2] for d in found}
    spans = ";".join(f"{a}-{b}:{label}" for a, b, label, _ in found)
    return n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(1 - doubt, 6), spans


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections
    (``first-end:label`` by word numbers) of every document."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    df = docs.select(doc_id, text)
    ddl = f"{doc_id} {df.schema[doc_id].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, 8 << 20):
                rows = [scan_text(t) for t in utf8(part.column(text))]
                columns = zip(*rows, strict=True) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([part.column(doc_id), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[doc_id, *names])

    return df.mapInArrow(run, ddl)
