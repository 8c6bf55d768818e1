"""Signature rules: label | keyword | regular expression, on ASCII-lower-cased text; a blank stands for white space.

Three tables by priority: exact identifiers and addresses, names of licences, and general clues. A rule is tried
only on texts that contain its keyword, so every text that the expression matches must contain it: a keyword holds no
blank (the expression takes any white space there) and stands in each alternative; else the rule is split.
"""

from __future__ import annotations

#: What any text must contain to be looked at; every keyword of a rule holds one of them.
GATES = ("licen", "copyright", "spdx", "gpl", "domain", "warrant", "permission", "redistribut", "creative", "cc", "copyleft", "(c)", "source", "rights", "unlicense", "gnu.org", "wtfpl", "bitstream", "gemma", "datenlizenz")

IDENTIFIERS = r"""
apache-2.0 | licen | (?:www\.)?apache\.org/licenses/license-2\.0
apache-1.1 | licen | (?:www\.)?apache\.org/licenses/license-1\.1
gpl-3.0 | licen | gnu\.org/licenses/(?:old-licenses/)?gpl-3\.0
gpl-2.0 | licen | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl | gnu.org | gnu\.org/(?:licenses|copyleft)/gpl\b
lgpl-3.0 | licen | gnu\.org/licenses/(?:old-licenses/)?lgpl-3\.0
lgpl-2.1 | licen | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl | gnu.org | gnu\.org/(?:licenses|copyleft)/lesser\b
agpl-3.0 | licen | gnu\.org/licenses/agpl(?:-3\.0)?
gfdl | gnu.org | gnu\.org/(?:licenses|copyleft)/fdl
mit | licen | opensource\.org/licenses?/mit\b
bsd-3-clause | licen | opensource\.org/licenses?/bsd-3-clause
bsd-2-clause | licen | opensource\.org/licenses?/bsd-2-clause
bsd | licen | opensource\.org/licenses?/bsd-license
isc | licen | opensource\.org/licenses?/isc
mpl-2.0 | licen | opensource\.org/licenses?/mpl-2\.0
epl-1.0 | licen | opensource\.org/licenses?/epl-1\.0
artistic-2.0 | licen | opensource\.org/licenses?/artistic-(?:license-)?2\.0
zlib | licen | opensource\.org/licenses?/zlib
ms-pl | licen | opensource\.org/licenses?/ms-pl
afl-3.0 | licen | opensource\.org/licenses?/afl-3\.0
osl-3.0 | licen | opensource\.org/licenses?/osl-3\.0
ofl-1.1 | licen | opensource\.org/licenses?/ofl-1\.1
boost-1.0 | licen | (?:www\.)?boost\.org/license_1_0
epl-2.0 | licen | eclipse\.org/legal/epl-(?:v20|2\.0)[^ ]*licen[cs]e?
mpl-2.0 | licen | (?:the )?terms of the mozilla public license,? v\. ?2\.0
ofl-1.1 | licen | scripts\.sil\.org/ofl[^ ]* licen
cc0-1.0 | creative | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm | creative | creativecommons\.org/publicdomain/mark/1\.0
cc-by-nc-nd | creative | creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
cc-by-nc-sa | creative | creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
cc-by-nc | creative | creativecommons\.org/licenses/by-nc/[1-4]\.[05]
cc-by-nd | creative | creativecommons\.org/licenses/by-nd/[1-4]\.[05]
cc-by-sa | creative | creativecommons\.org/licenses/by-sa/[1-4]\.[05]
cc-by | creative | creativecommons\.org/licenses/by/[1-4]\.[05]
unlicense | unlicense | (?:www\.)?unlicense\.org
"""

NAMES = r"""
gpl-1.0 | licen | gnu general public license,? (?:as published by the free software foundation[;,] (?:either )?)?\(?(?:version|v\.?) ?1(?:\.0)?\b
gpl-2.0 | licen | gnu general public license,? (?:as published by the free software foundation[;,] (?:either )?)?\(?(?:version|v\.?) ?2(?:\.0)?\b
gpl-3.0 | licen | gnu general public license,? (?:as published by the free software foundation[;,] (?:either )?)?\(?(?:version|v\.?) ?3(?:\.0)?\b
gpl | licen | gnu general public licen[cs]e
gpl | gpl | \bgnu gpl\b
gpl-2.0 | gpl | \bgpl(?: |-|,)?(?:version |v\.? ?)?2(?:\.0)?(?:\+|\b)
gpl-3.0 | gpl | \bgpl(?: |-|,)?(?:version |v\.? ?)?3(?:\.0)?(?:\+|\b)
gpl | gpl | \b(?:under|with|of) the gpl\b
lgpl-2.0 | licen | gnu library general public licen[cs]e
lgpl-2.1 | licen | gnu lesser general public license,? (?:as published by the free software foundation[;,] (?:either )?)?\(?(?:version|v\.?) ?2\.1\b
lgpl-3.0 | licen | gnu lesser general public license,? (?:as published by the free software foundation[;,] (?:either )?)?\(?(?:version|v\.?) ?3(?:\.0)?\b
lgpl | licen | gnu lesser general public licen[cs]e
lgpl-2.1 | gpl | \blgpl(?: |-)?(?:version |v\.? ?)?2\.1(?:\+|\b)
lgpl-3.0 | gpl | \blgpl(?: |-)?(?:version |v\.? ?)?3(?:\.0)?(?:\+|\b)
lgpl | gpl | \b(?:gnu|under the|the) lgpl\b
agpl-3.0 | licen | gnu affero general public license,? (?:as published by the free software foundation[;,] (?:either )?)?\(?(?:version|v\.?) ?3(?:\.0)?\b
agpl | licen | (?:gnu )?affero general public licen[cs]e
agpl-3.0 | gpl | \bagpl(?: |-)?(?:version |v\.? ?)?3(?:\.0)?(?:\+|\b)
gfdl | licen | gnu free documentation licen[cs]e
apache-2.0 | licen | apache (?:software )?licen[cs]e,? \(?(?:version|v\.?) ?2(?:\.0)?\b
apache-1.1 | licen | apache (?:software )?licen[cs]e,? \(?(?:version|v\.?) ?1\.1\b
apache-1.0 | licen | apache (?:software )?licen[cs]e,? \(?(?:version|v\.?) ?1\.0\b
apache-2.0 | licen | apache[- ]2(?:\.0)? licen[cs]e
apache | licen | apache (?:software )?licen[cs]e
mit | licen | \bmit licen[cs]e\b
mit | licen | \bthe mit(?:/x11| \(expat\)|/expat)? licen[cs]e
mit | licen | licensed under (?:the )?(?:terms of (?:the )?)?mit\b
mit-x11 | licen | \bx11 licen[cs]e\b
expat | licen | \bexpat licen[cs]e\b
mit | permission | permission is hereby granted, free of charge, to any person obtaining a copy
mit-0 | licen | \bmit no attribution licen[cs]e|mit-0 licen[cs]e
bsd-0-clause | licen | \b(?:zero[- ]clause bsd|0-?bsd|bsd zero[- ]clause) licen[cs]e
bsd-2-clause | licen | \b(?:2|two)[- ]clause bsd licen[cs]e
bsd-2-clause | licen | \bbsd (?:2|two)[- ]clause (?:"simplified" )?licen[cs]e
bsd-2-clause | licen | \bsimplified bsd licen[cs]e
bsd-2-clause | licen | \bfreebsd licen[cs]e
bsd-3-clause | licen | \b(?:3|three)[- ]clause bsd licen[cs]e
bsd-3-clause | licen | \bbsd (?:3|three)[- ]clause (?:"new" or "revised" )?licen[cs]e
bsd-3-clause | licen | \b(?:new|revised|modified) bsd licen[cs]e
bsd-4-clause | licen | \b(?:4|four)[- ]clause bsd licen[cs]e
bsd-4-clause | licen | \b(?:original|old) bsd licen[cs]e
bsd | licen | \bbsd(?:-style)? licen[cs]e
bsd | redistribut | redistributions? and use in source and binary forms, with or without modification, are permitted
bsd-3-clause | permission | endorse or promote products derived from this software without specific prior written permission
isc | licen | \bisc licen[cs]e
isc | permission | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
mpl-1.0 | licen | mozilla public licen[cs]e,? \(?(?:version|v\.?) ?1\.0\b
mpl-1.1 | licen | mozilla public licen[cs]e,? \(?(?:version|v\.?) ?1\.1\b
mpl-2.0 | licen | mozilla public licen[cs]e,? \(?(?:version|v\.?) ?2(?:\.0)?\b
mpl | licen | mozilla public licen[cs]e
epl-1.0 | licen | eclipse public licen[cs]e,? (?:-|\(?(?:version|v\.?))? ?1(?:\.0)?\b
epl-2.0 | licen | eclipse public licen[cs]e,? (?:-|\(?(?:version|v\.?))? ?2(?:\.0)?\b
epl | licen | eclipse public licen[cs]e
edl-1.0 | licen | eclipse distribution licen[cs]e
cddl-1.0 | licen | common development and distribution licen[cs]e,? \(?(?:version|v\.?)? ?1\.0\b
cddl-1.1 | licen | common development and distribution licen[cs]e,? \(?(?:version|v\.?)? ?1\.1\b
cddl | licen | common development and distribution licen[cs]e
cpl-1.0 | licen | common public licen[cs]e
cpal-1.0 | licen | common public attribution licen[cs]e
ipl-1.0 | licen | ibm public licen[cs]e
spl-1.0 | licen | sun public licen[cs]e
npl | licen | netscape public licen[cs]e
qpl-1.0 | licen | \bq public licen[cs]e|\bqpl licen[cs]e
apsl-2.0 | licen | apple public source licen[cs]e
artistic-1.0 | licen | artistic licen[cs]e,? \(?(?:version|v\.?)? ?1\.0\b
artistic-2.0 | licen | artistic licen[cs]e,? \(?(?:version|v\.?)? ?2(?:\.0)?\b
artistic | licen | \bartistic licen[cs]e
perl | licen | same terms as perl(?: itself)?[^.]{0,80}licen[cs]e
boost-1.0 | licen | boost software licen[cs]e
zlib | licen | \bzlib(?:/libpng)? licen[cs]e
libpng | licen | \b(?:png reference library|libpng) licen[cs]e
curl | licen | \bcurl licen[cs]e
openssl | licen | \bopenssl licen[cs]e
ssleay | licen | \b(?:original )?ssleay licen[cs]e
php-3.01 | licen | \bphp licen[cs]e
python-2.0 | licen | python software foundation licen[cs]e|\bpsf licen[cs]e
ruby | licen | \bruby(?:'s)? licen[cs]e
postgresql | licen | \bpostgresql licen[cs]e
unicode | licen | \bunicode(?: data files and software)? licen[cs]e
icu | licen | \bicu licen[cs]e
w3c | licen | \bw3c (?:software (?:notice and )?)?licen[cs]e
wtfpl | wtfpl | \bwtfpl
wtfpl | licen | \bdo what the f\S+ you want to public licen[cs]e
unlicense | licen | \bthe unlicense\b
beerware | licen | \bbeer-?ware licen[cs]e
ofl-1.1 | licen | \bsil open font licen[cs]e
ofl-1.1 | licen | \bopen font licen[cs]e
bitstream-vera | bitstream | \bbitstream vera (?:fonts? )?(?:copyright|licen[cs]e)
upl-1.0 | licen | universal permissive licen[cs]e
ncsa | licen | university of illinois/?\S* (?:open source )?licen[cs]e
ecl-2.0 | licen | educational community licen[cs]e
afl | licen | academic free licen[cs]e
osl | licen | open software licen[cs]e
eupl-1.1 | licen | european union public licen[cs]e,? \(?(?:version|v\.?) ?1\.1\b
eupl-1.2 | licen | european union public licen[cs]e,? \(?(?:version|v\.?) ?1\.2\b
eupl | licen | european union public licen[cs]e
cecill | licen | \bcecill(?:-[abc])? (?:free software )?licen[cs]e
ms-pl | licen | microsoft public licen[cs]e
ms-rl | licen | microsoft reciprocal licen[cs]e
ms-lpl | licen | microsoft limited public licen[cs]e
oclc-2.0 | licen | oclc research public licen[cs]e
lppl-1.3 | licen | latex project public licen[cs]e
intel | licen | intel open source licen[cs]e
nokia | licen | nokia open source licen[cs]e
real | licen | realnetworks public source licen[cs]e
sleepycat | licen | \bsleepycat (?:public )?licen[cs]e
vovida | licen | vovida software licen[cs]e
watcom | licen | sybase open watcom public licen[cs]e
xnet | licen | \bx\.?net licen[cs]e
zpl | licen | zope public licen[cs]e
fair | licen | \bfair licen[cs]e
hpnd | permission | historical permission notice
miros | licen | \bmiros licen[cs]e
motosoto | licen | motosoto (?:open source )?licen[cs]e
nasa-1.3 | licen | nasa open source agreement[^.]{0,40}licen|nasa open source licen[cs]e
naumen | licen | naumen public licen[cs]e
ngpl | licen | nethack general public licen[cs]e
ntp | licen | \bntp licen[cs]e
rpl-1.5 | licen | reciprocal public licen[cs]e
rpsl | licen | ricoh source code public licen[cs]e
sissl | licen | sun industry standards source licen[cs]e
simple-2.0 | licen | simple public licen[cs]e
entessa | licen | entessa public licen[cs]e
eiffel | licen | eiffel forum licen[cs]e
frameworx | licen | frameworx (?:open )?licen[cs]e
jabber | licen | jabber open source licen[cs]e
json | licen | \bjson licen[cs]e
ijg | licen | independent jpeg group(?:'s)? licen[cs]e
imagemagick | licen | \bimagemagick licen[cs]e
tcl | licen | \btcl(?:/tk)? licen[cs]e
vim | licen | \bvim licen[cs]e
wxwindows | licen | wxwindows library licen[cs]e
mulan-2.0 | licen | mulan permissive software licen[cs]e
blueoak-1.0 | licen | blue oak model licen[cs]e
polyform | licen | polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter) licen[cs]e
parity | licen | parity public licen[cs]e
sspl-1.0 | licen | server side public licen[cs]e
busl-1.1 | licen | business source licen[cs]e
elastic-2.0 | licen | elastic licen[cs]e
confluent | licen | confluent community licen[cs]e
commons-clause | licen | commons clause(?:" )? licen[cs]e
redis-source | licen | redis source available licen[cs]e
timescale | licen | timescale licen[cs]e
openrail | licen | \b(?:creativeml )?open ?rail(?:-?\+?\+?m)? licen[cs]e
llama | licen | llama [234](?:\.\d)? community licen[cs]e
gemma | gemma | gemma (?:terms of use|licen[cs]e)
cc0-1.0 | creative | creative commons (?:zero|cc0)(?: 1\.0)?
cc0-1.0 | cc | \bcc0(?:[- ]1\.0)?\b
cc-by-nc-nd | cc | \bcc[- ]by[- ]nc[- ]nd(?:[- ][1-4]\.[05])?\b
cc-by-nc-sa | cc | \bcc[- ]by[- ]nc[- ]sa(?:[- ][1-4]\.[05])?\b
cc-by-nc | cc | \bcc[- ]by[- ]nc(?:[- ][1-4]\.[05])?\b
cc-by-nd | cc | \bcc[- ]by[- ]nd(?:[- ][1-4]\.[05])?\b
cc-by-sa | cc | \bcc[- ]by[- ]sa(?:[- ][1-4]\.[05])?\b
cc-by | cc | \bcc[- ]by(?:[- ][1-4]\.[05])?\b
cc-by-nc-nd | creative | creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s?
cc-by-nc-sa | creative | creative commons attribution[- ]non-?commercial[- ]share-?alike
cc-by-nc | creative | creative commons attribution[- ]non-?commercial
cc-by-nd | creative | creative commons attribution[- ]no-?deriv(?:ative)?s?
cc-by-sa | creative | creative commons attribution[- ]share-?alike
cc-by | creative | creative commons attribution(?: [1-4]\.[05])?(?: (?:international|unported|generic))? licen[cs]e
odbl | licen | open (?:data commons open )?database licen[cs]e
odc-by | licen | open data commons attribution licen[cs]e
pddl | licen | public domain dedication and licen[cs]e
ogl-uk | licen | open government licen[cs]e
etalab | licen | (?:licence ouverte|open licen[cs]e)[ /]+(?:etalab|2\.0)
dl-de-by | datenlizenz | datenlizenz deutschland
gpl-fr | licen | licence publique g\S+ ?n\S*rale gnu
"""

CLUES = r"""
public-domain | domain | \b(?:in|into|to) the public domain\b
public-domain | domain | \breleased? (?:in|into|to) the public domain
all-rights-reserved | rights | \ball rights reserved\b
copyright-notice | copyright | \bcopyright (?:\(c\)|©)? ?(?:19|20)\d\d\b
copyright-notice | (c) | \(c\) (?:copyright )?(?:19|20)\d\d\b
warranty-disclaimer | warrant | \bwithout (?:any )?warranty of any kind
warranty-disclaimer | warrant | \bprovided "?as is"?,? without (?:any )?(?:express(?:ed)? or implied )?warrant(?:y|ies)
warranty-disclaimer | warrant | \bimplied warranties of merchantability
licence-mention | licen | \blicensed under (?:the )?(?:terms|conditions)\b
licence-mention | licen | \bdistributed under (?:the )?(?:terms|conditions) of\b[^.]{0,80}licen[cs]e
licence-mention | licen | \bsee (?:the )?(?:file )?licen[cs]e(?:\.txt|\.md)?\b
licence-mention | licen | \bsubject to the (?:following|terms of)[^.]{0,40}licen[cs]e
copyleft | copyleft | \bcopyleft\b
open-source | source | \bopen source (?:software|initiative)\b
proprietary | licen | \bproprietary licen[cs]e\b
proprietary | licen | \bend[- ]user licen[cs]e agreement\b
commercial-licence | licen | \bcommercial licen[cs]e\b
no-redistribution | redistribut | \b(?:may|must) not be redistributed\b
permission-required | permission | \bwithout (?:the )?(?:prior )?(?:written )?permission of\b
"""


def rows() -> list[tuple[int, str, int, float, str, str]]:
    """(rule number, label, priority, confidence, keyword, regular expression)."""
    out = []
    for priority, confidence, table in ((3, 1.0, IDENTIFIERS), (2, 0.9, NAMES), (1, 0.5, CLUES)):
        for line in table.strip().splitlines():
            label, keyword, pattern = line.split(" | ", 2)
            out.append((label, priority, confidence, keyword, pattern.replace(" ", r"\s+")))
    # The standard tag names its licence itself: one rule per label of the tables.
    for label in sorted({label for label, priority, *_ in out if priority > 1}):
        tag = label.replace(".", r"\.").replace("boost", "bsl")
        out.append((label, 3, 1.0, "spdx", rf"spdx-license-identifier:\s*{tag}(?:-only|-or-later|\+)?(?![\w.-])"))
    return [(i, *rule) for i, rule in enumerate(out)]
