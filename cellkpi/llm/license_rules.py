"""Signatures of licenses: label, level and pattern, in order.

A pattern is matched from its first word on, against lower-case words (digits, letters a to z and
whatever is not ASCII) joined by single blanks: ``Apache-2.0`` reads ``apache 2 0``, and a URL reads as
its words. The first word is plain text: it is the keyword that gates the rule. Repetitions are bounded,
so that no match is longer than ``SPAN`` words.

Level 3 is a grant, a tag or a URL that can hardly mean anything else, 2 a license named with its
version or in full, 1 a mention. ``W`` stands for a few words of any kind, shortest first.
"""

from __future__ import annotations

from dataclasses import dataclass

SPAN = 40
WEIGHTS = {3: 1.0, 2: 0.8, 1: 0.4}
BASE_WEIGHT = 0.5

# The phrases whose places are counted, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Written by hand from the licenses' own names, headers, tags and addresses.
SIGNATURES = """
apache-2.0 3 spdx license identifier apache 2 0
apache-1.1 3 spdx license identifier apache 1 1
apache-1.0 3 spdx license identifier apache 1 0
mit 3 spdx license identifier mit
mit-0 3 spdx license identifier mit 0
bsd-2-clause 3 spdx license identifier bsd 2 clause
bsd-3-clause 3 spdx license identifier bsd 3 clause
bsd-4-clause 3 spdx license identifier bsd 4 clause
bsd-0-clause 3 spdx license identifier 0bsd
gpl-1.0 3 spdx license identifier gpl 1 0( only| or later)?
gpl-2.0-only 3 spdx license identifier gpl 2 0( only)?
gpl-2.0-or-later 3 spdx license identifier gpl 2 0 or later
gpl-3.0-only 3 spdx license identifier gpl 3 0( only)?
gpl-3.0-or-later 3 spdx license identifier gpl 3 0 or later
lgpl-2.0 3 spdx license identifier lgpl 2 0( only| or later)?
lgpl-2.1 3 spdx license identifier lgpl 2 1( only| or later)?
lgpl-3.0 3 spdx license identifier lgpl 3 0( only| or later)?
agpl-3.0 3 spdx license identifier agpl 3 0( only| or later)?
gfdl-1.3 3 spdx license identifier gfdl 1 3( only| or later)?
mpl-1.1 3 spdx license identifier mpl 1 1
mpl-2.0 3 spdx license identifier mpl 2 0
epl-1.0 3 spdx license identifier epl 1 0
epl-2.0 3 spdx license identifier epl 2 0
cddl-1.0 3 spdx license identifier cddl 1 0
cddl-1.1 3 spdx license identifier cddl 1 1
isc 3 spdx license identifier isc
zlib 3 spdx license identifier zlib
unlicense 3 spdx license identifier unlicense
wtfpl 3 spdx license identifier wtfpl
bsl-1.0 3 spdx license identifier bsl 1 0
artistic-2.0 3 spdx license identifier artistic 2 0
cc0-1.0 3 spdx license identifier cc0 1 0
cc-by-4.0 3 spdx license identifier cc by 4 0
cc-by-sa-4.0 3 spdx license identifier cc by sa 4 0
cc-by-nc-4.0 3 spdx license identifier cc by nc 4 0
cc-by-nd-4.0 3 spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 3 spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 3 spdx license identifier cc by nc nd 4 0
eupl-1.2 3 spdx license identifier eupl 1 2
ofl-1.1 3 spdx license identifier ofl 1 1
postgresql 3 spdx license identifier postgresql
python-2.0 3 spdx license identifier (python 2 0|psf 2 0)
spdx-tag 1 spdx license identifier [^ ]+
apache-2.0 3 www apache org licenses license 2 0( txt| html)?
apache-2.0 3 apache org licenses license 2 0( txt| html)?
apache-1.1 3 apache org licenses license 1 1( txt)?
mit 3 opensource org licenses? mit( license)?( php| html)?
bsd-2-clause 3 opensource org licenses? bsd 2 clause
bsd-3-clause 3 opensource org licenses? bsd 3 clause
isc 3 opensource org licenses? isc( license)?
mpl-2.0 3 opensource org licenses? mpl 2 0
gpl-2.0 3 opensource org licenses? gpl 2 0
gpl-3.0 3 opensource org licenses? gpl 3 0
lgpl-3.0 3 opensource org licenses? lgpl 3 0
agpl-3.0 3 opensource org licenses? agpl 3 0
zlib 3 opensource org licenses? zlib
artistic-2.0 3 opensource org licenses? artistic 2 0
mpl-2.0 3 mozilla org mpl 2 0
mpl-1.1 3 mozilla org mpl (mpl )?1 1( html)?
gpl 3 gnu org licenses gpl( html| txt)?
gpl-2.0 3 gnu org licenses (old licenses )?gpl 2 0( html| txt| en html)?
gpl-3.0 3 gnu org licenses gpl 3 0( html| txt| en html)?
lgpl 3 gnu org licenses lgpl( html| txt)?
lgpl-2.1 3 gnu org licenses (old licenses )?lgpl 2 1( html| txt| en html)?
lgpl-3.0 3 gnu org licenses lgpl 3 0( html| txt| en html)?
agpl-3.0 3 gnu org licenses agpl( 3 0)?( html| txt| en html)?
gfdl 3 gnu org licenses fdl( 1 [123])?( html| txt| en html)?
gnu-licenses 1 gnu org licenses
epl-1.0 3 eclipse org legal epl v10( html)?
epl-2.0 3 eclipse org legal epl 2 0( html)?
unlicense 3 unlicense org
wtfpl 3 wtfpl net
bsl-1.0 3 boost org license 1 0( txt)?
eupl 3 joinup ec europa eu (software page|collection eupl)( eupl)?
ofl-1.1 3 scripts sil org ofl
cc-by-1.0 3 creativecommons org licenses by 1 0
cc-by-2.0 3 creativecommons org licenses by 2 0
cc-by-2.5 3 creativecommons org licenses by 2 5
cc-by-3.0 3 creativecommons org licenses by 3 0
cc-by-4.0 3 creativecommons org licenses by 4 0
cc-by-sa-2.0 3 creativecommons org licenses by sa 2 0
cc-by-sa-2.5 3 creativecommons org licenses by sa 2 5
cc-by-sa-3.0 3 creativecommons org licenses by sa 3 0
cc-by-sa-4.0 3 creativecommons org licenses by sa 4 0
cc-by-nc-2.0 3 creativecommons org licenses by nc 2 0
cc-by-nc-3.0 3 creativecommons org licenses by nc 3 0
cc-by-nc-4.0 3 creativecommons org licenses by nc 4 0
cc-by-nd-3.0 3 creativecommons org licenses by nd 3 0
cc-by-nd-4.0 3 creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 3 creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 3 creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0 3 creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 3 creativecommons org licenses by nc nd 4 0
cc0-1.0 3 creativecommons org publicdomain zero 1 0
public-domain-mark 3 creativecommons org publicdomain mark 1 0
cc 2 creativecommons org licenses
apache-2.0 3 licensed under the apache license( version| v)? ?2( 0)?
apache-2.0 3 licensed to the apache software foundation asf under one or more contributor license agreements
mit 3 licensed under the( terms of the)? mit license
mit 3 released under the( terms of the)? mit license
mit 3 distributed under the( terms of the)? mit license
bsd 3 licensed under the( terms of the)? bsd license
bsd 3 released under the( terms of the)? bsd license
bsd-2-clause 3 licensed under the (bsd 2 clause|2 clause bsd|simplified bsd) license
bsd-3-clause 3 licensed under the (bsd 3 clause|3 clause bsd|new bsd|modified bsd) license
gpl-2.0 3 licensed under the( terms of the)? (gnu )?(gpl|general public license)( version| v)? ?2( 0)?
gpl-3.0 3 licensed under the( terms of the)? (gnu )?(gpl|general public license)( version| v)? ?3( 0)?
gpl-2.0 3 released under the( terms of the)? (gnu )?(gpl|general public license)( version| v)? ?2( 0)?
gpl-3.0 3 released under the( terms of the)? (gnu )?(gpl|general public license)( version| v)? ?3( 0)?
lgpl-2.1 3 licensed under the( terms of the)? (gnu )?(lgpl|lesser general public license)( version| v)? ?2 1
lgpl-3.0 3 licensed under the( terms of the)? (gnu )?(lgpl|lesser general public license)( version| v)? ?3( 0)?
agpl-3.0 3 licensed under the( terms of the)? (gnu )?(agpl|affero general public license)( version| v)? ?3( 0)?
mpl-2.0 3 licensed under the( terms of the)? (mpl|mozilla public license)( version| v)? ?2( 0)?
epl 3 licensed under the( terms of the)? eclipse public license
cc 2 licensed under a creative commons
cc-by-nc-4.0 3 licensed under( a)? cc by nc 4 0
cc-by-nc-3.0 3 licensed under( a)? cc by nc 3 0
cc-by-nc-sa-4.0 3 licensed under( a)? cc by nc sa 4 0
cc-by-nc-nd-4.0 3 licensed under( a)? cc by nc nd 4 0
cc-by-sa-4.0 3 licensed under( a)? cc by sa 4 0
cc-by-sa-3.0 3 licensed under( a)? cc by sa 3 0
cc-by-nd-4.0 3 licensed under( a)? cc by nd 4 0
cc-by-4.0 3 licensed under( a)? cc by 4 0
cc-by-3.0 3 licensed under( a)? cc by 3 0
licensed 1 licensed under the( [^ ]+){1,6}? license
released 1 released under the( [^ ]+){1,6}? license
distributed 1 distributed under the( terms of the)?( [^ ]+){1,6}? license
apache-2.0 2 apache (software )?license( version| v)? ?2( 0)?
apache-2.0 2 apache license 2 0
apache-2.0 2 apache 2 0( license)?
apache-2.0 2 apache2( 0)? license
apache-1.1 2 apache (software )?license( version| v)? ?1 1
apache-1.0 2 apache (software )?license( version| v)? ?1 0
apache 1 apache (software |public )?license
mit 2 mit license
mit 2 mit licensed
mit 2 mit x11 license
mit 2 mit expat license
x11 2 x11 license
expat 2 expat license
bsd-2-clause 2 bsd 2 clause( simplified)?( license)?
bsd-3-clause 2 bsd 3 clause( new| revised| modified)?( license)?
bsd-4-clause 2 bsd 4 clause( original)?( license)?
bsd-2-clause 2 simplified bsd license
bsd-3-clause 2 new bsd license
bsd-3-clause 2 modified bsd license
bsd-3-clause 2 revised bsd license
bsd 1 bsd( style)? license
gpl-1.0 2 gnu general public license( [^ ]+){0,6}? (version|v) ?1( 0)?
gpl-2.0 2 gnu general public license( as published by the free software foundation)?( either| only)?( version| v) ?2( 0)?
gpl-3.0 2 gnu general public license( as published by the free software foundation)?( either| only)?( version| v) ?3( 0)?
gpl-2.0-or-later 3 gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later 3 gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0 2 gnu gpl( version| v)? ?2( 0)?
gpl-3.0 2 gnu gpl( version| v)? ?3( 0)?
gpl 1 gnu gpl
gpl 1 gnu general public license
gpl-2.0 2 general public license( version| v) ?2( 0)?
gpl-3.0 2 general public license( version| v) ?3( 0)?
gpl-2.0 2 gpl( version| v)? ?2( 0)?( only)?
gpl-2.0-or-later 2 gpl( version| v)? ?2( 0)? or later
gpl-3.0 2 gpl( version| v)? ?3( 0)?( only)?
gpl-3.0-or-later 2 gpl( version| v)? ?3( 0)? or later
gpl-2.0 2 gplv2( only)?
gpl-2.0-or-later 2 gplv2 or later
gpl-3.0 2 gplv3( only)?
gpl-3.0-or-later 2 gplv3 or later
gpl 1 gpl (licensed|license|compatible)
lgpl-2.0 2 gnu (library|lesser) general public license( version| v) ?2( 0)?
lgpl-2.1 2 gnu lesser general public license( [^ ]+){0,8}? (version|v) ?2 1
lgpl-3.0 2 gnu lesser general public license( [^ ]+){0,8}? (version|v) ?3( 0)?
lgpl 1 gnu (lesser|library) general public license
lgpl 1 lesser general public license
lgpl-2.1 2 lgpl( version| v)? ?2 1
lgpl-2.1 2 lgplv2 1
lgpl-3.0 2 lgpl( version| v)? ?3( 0)?
lgpl-3.0 2 lgplv3
lgpl 1 lgpl
agpl-3.0 2 gnu affero general public license( [^ ]+){0,8}? (version|v) ?3( 0)?
agpl 1 gnu affero general public license
agpl 1 affero general public license
agpl-3.0 2 agpl( version| v)? ?3( 0)?
agpl-3.0 2 agplv3
gfdl-1.2 2 gnu free documentation license( version| v)? ?1 2
gfdl-1.3 2 gnu free documentation license( version| v)? ?1 3
gfdl 1 gnu free documentation license
mpl-1.0 2 mozilla public license( version| v)? ?1 0
mpl-1.1 2 mozilla public license( version| v)? ?1 1
mpl-2.0 2 mozilla public license( version| v)? ?2( 0)?
mpl 1 mozilla public license
mpl-2.0 2 mpl( version| v)? ?2 0
epl-1.0 2 eclipse public license( version| v)? ?1 0
epl-2.0 2 eclipse public license( version| v)? ?2 0
epl 1 eclipse public license
edl 2 eclipse distribution license( version| v)?( 1 0)?
cddl-1.0 2 common development and distribution license( cddl)?( version| v)? ?1 0
cddl 1 common development and distribution license
cpl-1.0 2 common public license( version| v)? ?1 0
cpl 1 common public license
ipl-1.0 2 ibm public license( version| v)?( 1 0)?
isc 2 isc license
zlib 2 zlib( libpng)? license
wtfpl 2 fuck you want to public license
wtfpl 2 wtfpl
unlicense 3 unencumbered software released into the public domain
unlicense 2 unlicense
public-domain 2 released into the public domain
public-domain 2 dedicated to the public domain
public-domain 1 public domain
bsl-1.0 2 boost software license( version| v)?( 1 0)?
busl-1.1 2 business source license( version| v)?( 1 1)?
sspl-1.0 2 server side public license( version| v)?( 1( 0)?)?
elastic-2.0 2 elastic license( version| v)?( 2( 0)?)?
artistic-1.0 2 artistic license( version| v)? ?1 0
artistic-2.0 2 artistic license( version| v)? ?2 0
artistic 1 artistic license
psf-2.0 2 python software foundation license( version| v)?( 2)?
php-3.0 2 php license( version| v)? ?3( 0| 01)?
ruby 2 ruby license
postgresql 2 postgresql license
openssl 2 openssl license
ncsa 2 university of illinois (ncsa )?open source license
eupl-1.1 2 european union public licen[cs]e( version| v)? ?1 1
eupl-1.2 2 european union public licen[cs]e( version| v)? ?1 2
eupl 1 european union public licen[cs]e
cecill 2 cecill( free software license)?( agreement)?
ms-pl 2 microsoft public license( ms pl)?
ms-rl 2 microsoft reciprocal license( ms rl)?
odbl-1.0 2 open (data commons open )?database license( odbl)?( v1 0| 1 0)?
odc-by 2 open data commons attribution license
pddl 2 open data commons public domain dedication
ogl 2 open government licen[cs]e( version| v)?( [123]( 0)?)?
ofl-1.1 2 sil open font license( version| v)?( 1 1)?
ofl-1.1 2 open font license( version| v)? ?1 1
openrail 2 openrail( m)?( license)?
openrail 2 bigscience (open )?rail license
llama-community 2 llama [23]( [123])? community license( agreement)?
cc0-1.0 2 cc0( 1 0)?( universal)?
cc0-1.0 2 creative commons zero( v| version)?( 1 0)?
cc-by-nc-nd-4.0 2 creative commons attribution noncommercial noderiv(ative)?s 4 0
cc-by-nc-sa-4.0 2 creative commons attribution noncommercial sharealike 4 0
cc-by-nc-4.0 2 creative commons attribution non ?commercial 4 0
cc-by-nd-4.0 2 creative commons attribution no ?derivatives 4 0
cc-by-sa-4.0 2 creative commons attribution share ?alike 4 0
cc-by-sa-3.0 2 creative commons attribution share ?alike 3 0
cc-by-4.0 2 creative commons attribution 4 0
cc-by-3.0 2 creative commons attribution 3 0
cc-by 1 creative commons attribution( [^ ]+){0,2} licen[cs]e
cc 1 creative commons( [^ ]+){0,4}? licen[cs]e
cc-by-nc-nd-4.0 2 cc by nc nd 4 0
cc-by-nc-nd-3.0 2 cc by nc nd 3 0
cc-by-nc-nd 2 cc by nc nd
cc-by-nc-sa-4.0 2 cc by nc sa 4 0
cc-by-nc-sa-3.0 2 cc by nc sa 3 0
cc-by-nc-sa 2 cc by nc sa
cc-by-nc-4.0 2 cc by nc 4 0
cc-by-nc-3.0 2 cc by nc 3 0
cc-by-nc 2 cc by nc
cc-by-nd-4.0 2 cc by nd 4 0
cc-by-nd 2 cc by nd
cc-by-sa-4.0 2 cc by sa 4 0
cc-by-sa-3.0 2 cc by sa 3 0
cc-by-sa 2 cc by sa
cc-by-4.0 2 cc by 4 0
cc-by-3.0 2 cc by 3 0
mit 3 permission is hereby granted free of charge to any person obtaining a copy of this software( and associated documentation files( the software)?)? to deal in the software without restriction
mit 3 permission is hereby granted free of charge to any person obtaining a copy
isc 3 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd 3 permission to use copy modify( and)? distribute( and sell)? this software and its documentation for any purpose( is hereby granted)? without fee
bsd 3 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd 2 redistributions of source code must retain the above copyright notice
bsd-3-clause 3 neither the name of( [^ ]+){1,12}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause 3 advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment
gpl 3 redistribute it and or modify it under the terms of the gnu general public license
lgpl 3 redistribute it and or modify it under the terms of the gnu lesser general public license
agpl 3 redistribute it and or modify it under the terms of the gnu affero general public license
zlib 3 altered source versions must be plainly marked as such and must not be misrepresented as being the original software
mpl-2.0 3 subject to the terms of the mozilla public license v 2 0
mpl-1.1 3 subject to the mozilla public license version 1 1
apache-2.0 3 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
warranty-disclaimer 2 provided as is without warranty of any kind express or implied
warranty-disclaimer 2 without warranties or conditions of any kind either express or implied
warranty-disclaimer 1 without any warranty without even the implied warranty
copyright 1 copyright( c)?( ©)? (19|20)[0-9]{2}( (19|20)[0-9]{2})?
copyright 1 © (19|20)[0-9]{2}
proprietary 2 proprietary and confidential
proprietary 2 unauthorized (copying|reproduction|distribution)( [^ ]+){0,8}? (is )?(strictly )?prohibited
no-commercial-use 2 noncommercial( [^ ]+){0,3}? use only
no-commercial-use 2 non commercial( [^ ]+){0,3}? use only
no-commercial-use 2 personal( [^ ]+){0,3}? use only
no-reuse 2 reproduced( [^ ]+){0,6}? without( [^ ]+){0,3}? permission
permission-required 2 reproduced (here )?(with|by) (kind )?permission
"""


@dataclass(frozen=True)
class Signature:
    label: str
    level: int
    keyword: str
    pattern: str


def parse(lines: str) -> list[Signature]:
    found = []
    for line in lines.strip().split("\n"):
        label, level, pattern = line.split(" ", 2)
        keyword = pattern.partition(" ")[0]
        # An option may follow the keyword at once: "spam( eggs)? ..."
        found.append(Signature(label, int(level), keyword.partition("(")[0], pattern))
    return found


SIGNATURE_LIST = parse(SIGNATURES)
