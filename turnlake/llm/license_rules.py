"""Signatures of licences, as patterns over lower-case words with one space between.

Names of licences come in three forms; notices, headers and bodies are written one
by one. Labels follow the SPDX list where it has the licence.
"""

from __future__ import annotations

import re

#: label: (keyword, name as a pattern over words)
NAMES = {
    "GPL-1.0": ("general public", "gnu general public licen[cs]e (?:version |v )?1(?: 0)?"),
    "GPL-2.0": ("general public", "(?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)?"),
    "GPL-3.0": ("general public", "(?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)?"),
    "GPL": ("general public", "(?:gnu )?general public licen[cs]e"),
    "LGPL-2.0": ("general public", "gnu library general public licen[cs]e(?: (?:version |v )?2(?: 0)?)?"),
    "LGPL-2.1": ("general public", "(?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1"),
    "LGPL-3.0": ("general public", "(?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)?"),
    "LGPL": ("general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    "AGPL-3.0": ("affero", "(?:gnu )?affero general public licen[cs]e(?: (?:version |v )?3(?: 0)?)?"),
    "GFDL-1.3": ("free documentation", "(?:gnu )?free documentation licen[cs]e (?:version |v )?1 3"),
    "GFDL": ("free documentation", "(?:gnu )?free documentation licen[cs]e"),
    "Apache-1.0": ("apache", "apache (?:software )?licen[cs]e (?:version |v )?1 0"),
    "Apache-1.1": ("apache", "apache (?:software )?licen[cs]e (?:version |v )?1 1"),
    "Apache-2.0": ("apache", "apache (?:software )?licen[cs]e (?:version |v )?2(?: 0)?"),
    "Apache": ("apache", "apache (?:software )?licen[cs]e"),
    "MIT": ("mit", "mit (?:x11 |expat )?licen[cs]e"),
    "MIT-0": ("mit", "mit (?:no attribution|0) licen[cs]e"),
    "X11": ("x11", "x11 licen[cs]e"),
    "Expat": ("expat", "expat licen[cs]e"),
    "ISC": ("isc", "isc licen[cs]e"),
    "BSD-2-Clause": ("bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?"),
    "BSD-3-Clause": ("bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?"),
    "BSD-4-Clause": ("bsd", "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?"),
    "BSD": ("bsd", "bsd (?:style )?licen[cs]e"),
    "0BSD": ("bsd", "(?:0bsd|zero clause bsd|bsd zero clause)(?: licen[cs]e)?"),
    "MPL-1.1": ("mozilla", "mozilla public licen[cs]e (?:version |v )?1 [01]"),
    "MPL-2.0": ("mozilla", "mozilla public licen[cs]e (?:version |v )?2(?: 0)?"),
    "MPL": ("mozilla", "mozilla public licen[cs]e"),
    "EPL-1.0": ("eclipse", "eclipse public licen[cs]e (?:version |v )?1(?: 0)?"),
    "EPL-2.0": ("eclipse", "eclipse public licen[cs]e (?:version |v )?2(?: 0)?"),
    "EDL-1.0": ("eclipse", "eclipse distribution licen[cs]e(?: (?:version |v )?1(?: 0)?)?"),
    "CDDL-1.0": ("development and distribution", "common development and distribution licen[cs]e(?: (?:version |v )?1 [01])?"),
    "CPL-1.0": ("common public", "common public licen[cs]e(?: (?:version |v )?1(?: 0)?)?"),
    "IPL-1.0": ("ibm public", "ibm public licen[cs]e(?: (?:version |v )?1(?: 0)?)?"),
    "EUPL-1.2": ("european union public", "european union public licen[cs]e(?: (?:version |v )?1 [012])?"),
    "CECILL-2.1": ("cecill", "cecill(?: (?:free software )?licen[cs]e)?(?: (?:version |v )?2(?: [01])?)?"),
    "Artistic-2.0": ("artistic", "artistic licen[cs]e (?:version )?2(?: 0)?"),
    "Artistic-1.0": ("artistic", "artistic licen[cs]e(?: (?:version )?1(?: 0)?)?"),
    "BSL-1.0": ("boost", "boost software licen[cs]e(?: (?:version )?1(?: 0)?)?"),
    "BUSL-1.1": ("business source", "business source licen[cs]e(?: (?:version )?1 1)?"),
    "SSPL-1.0": ("server side public", "server side public licen[cs]e(?: (?:version |v )?1)?"),
    "Elastic-2.0": ("elastic", "elastic licen[cs]e(?: (?:version )?2(?: 0)?)?"),
    "Zlib": ("zlib", "zlib(?: libpng)? licen[cs]e"),
    "Unlicense": ("unlicense", "(?:the )?unlicense"),
    "WTFPL": ("fuck", "do what the fuck you want to public licen[cs]e"),
    "CC0-1.0": ("cc0", "cc0(?: 1 0)?(?: universal)?"),
    "CC-BY": ("cc", "cc by(?: [1234] [05])?(?: international| unported)?"),
    "CC-BY-SA": ("cc", "cc by sa(?: [1234] [05])?(?: international| unported)?"),
    "CC-BY-NC": ("cc", "cc by nc(?: [1234] [05])?(?: international| unported)?"),
    "CC-BY-ND": ("cc", "cc by nd(?: [1234] [05])?(?: international| unported)?"),
    "CC-BY-NC-SA": ("cc", "cc by nc sa(?: [1234] [05])?(?: international| unported)?"),
    "CC-BY-NC-ND": ("cc", "cc by nc nd(?: [1234] [05])?(?: international| unported)?"),
    "CC-BY-4.0": ("creative commons", "creative commons attribution(?: 4 0)?(?: international)?(?: public)?(?: licen[cs]e)?"),
    "CC-BY-SA-4.0": ("creative commons", "creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: public)?(?: licen[cs]e)?"),
    "CC-BY-NC-4.0": ("creative commons", "creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: public)?(?: licen[cs]e)?"),
    "CC-BY-ND-4.0": ("creative commons", "creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported)?(?: public)?(?: licen[cs]e)?"),
    "CC-BY-NC-SA-4.0": ("creative commons", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?(?: public)?(?: licen[cs]e)?"),
    "CC-BY-NC-ND-4.0": ("creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported)?(?: public)?(?: licen[cs]e)?"),
    "Creative-Commons": ("creative commons", "creative commons(?: licen[cs]e)?"),
    "OpenSSL": ("openssl", "openssl licen[cs]e"),
    "PSF-2.0": ("python", "(?:python software foundation|psf) licen[cs]e(?: (?:version )?2)?"),
    "PHP-3.01": ("php", "php licen[cs]e(?: (?:version )?3 0[01]?)?"),
    "Ruby": ("ruby", "ruby(?: s)? licen[cs]e"),
    "Vim": ("vim", "vim licen[cs]e"),
    "PostgreSQL": ("postgresql", "postgresql licen[cs]e"),
    "NCSA": ("illinois", "university of illinois ncsa open source licen[cs]e"),
    "AFL-3.0": ("academic free", "academic free licen[cs]e(?: (?:version |v )?[123](?: [01])?)?"),
    "OSL-3.0": ("open software", "open software licen[cs]e(?: (?:version |v )?[123](?: [01])?)?"),
    "OFL-1.1": ("open font", "(?:sil )?open font licen[cs]e(?: (?:version )?1 [01])?"),
    "ODbL-1.0": ("open database", "open (?:data commons open )?database licen[cs]e(?: (?:odbl )?(?:v )?1 0)?"),
    "ODC-By-1.0": ("open data commons", "open data commons attribution licen[cs]e"),
    "PDDL-1.0": ("public domain dedication", "public domain dedication and licen[cs]e"),
    "MS-PL": ("microsoft public", "microsoft public licen[cs]e"),
    "MS-RL": ("microsoft reciprocal", "microsoft reciprocal licen[cs]e"),
    "UPL-1.0": ("universal permissive", "universal permissive licen[cs]e(?: (?:version |v )?1 0)?"),
    "OpenRAIL": ("rail", "(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?"),
}

#: Forms of a name: (pattern with the name as N, priority, weight); the lower priority wins.
FORMS = (
    (r"(?:licen[cs]ed|released|distributed|published|redistributed|sublicen[cs]ed|available|provided|covered|governed) (?:only )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?N", 2, 0.95),
    (r"(?:see|read|refer to|subject to|according to|in accordance with|compliance with|terms of|conditions of|copy of|text of) (?:the )?N", 3, 0.9),
    (r"N", 4, 0.8),
)

#: Identifiers of the SPDX list that notices use.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.0", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0",
    "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0",
    "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "Elastic-2.0", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "HPND", "IPL-1.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL",
    "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "OpenSSL", "PHP-3.01", "PSF-2.0", "PostgreSQL", "Python-2.0",
    "Ruby", "SSPL-1.0", "UPL-1.0", "Unlicense", "Vim", "WTFPL", "X11", "Zlib",
)

#: Notices, headers, short forms and bodies: (label, keyword, pattern, priority, weight).
NOTICES = (
    # headers of the GNU family
    ("GPL-2.0-or-later", "free software", r"(?:this (?:program|library|file)|[^ ]+) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version", 0, 1.0),
    ("GPL-3.0-or-later", "free software", r"(?:this (?:program|library|file)|[^ ]+) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version", 0, 1.0),
    ("GPL-2.0-only", "free software", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license (?:version 2 )?as published by the free software foundation(?: version 2(?: of the license)?)?", 1, 0.95),
    ("LGPL-2.1-or-later", "free software", r"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version", 0, 1.0),
    ("LGPL-3.0-or-later", "free software", r"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version", 0, 1.0),
    ("AGPL-3.0-or-later", "free software", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version", 0, 1.0),
    ("GPL", "free software", r"(?:this (?:program|library|file)|[^ ]+) is free software you (?:can|may) redistribute it and or modify it(?: under the terms of the gnu general public license)?", 3, 0.85),
    ("GPL", "without any warranty", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", 3, 0.85),
    ("GPL", "you should have received a copy", r"you should have received a copy of the gnu general public license along with this (?:program|library|file|package)", 2, 0.95),
    ("LGPL", "you should have received a copy", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|file|package)", 2, 0.95),
    ("AGPL-3.0", "you should have received a copy", r"you should have received a copy of the gnu affero general public license along with this (?:program|library|file|package)", 2, 0.95),
    ("GPL", "copyleft", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed(?: .{0,60}copyleft)?", 2, 0.9),
    ("GPL-2.0", "june 1991", r"gnu general public license version 2 june 1991", 0, 1.0),
    ("GPL-3.0", "29 june 2007", r"gnu general public license version 3 29 june 2007", 0, 1.0),
    ("LGPL-2.1", "february 1999", r"gnu lesser general public license version 2 1 february 1999", 0, 1.0),
    ("LGPL-3.0", "29 june 2007", r"gnu lesser general public license version 3 29 june 2007", 0, 1.0),
    ("AGPL-3.0", "19 november 2007", r"gnu affero general public license version 3 19 november 2007", 0, 1.0),
    ("GPL", "freedom to share", r"the licenses for most software are designed to take away your freedom to share and change it", 2, 0.95),
    ("GPL-3.0", "free copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 1, 1.0),
    ("GPL-2.0-with-classpath-exception", "special exception", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", 1, 1.0),
    ("GFDL", "permission is granted", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1, 1.0),
    # short forms of the GNU family
    ("GPL-1.0", "gpl", r"(?:gnu )?gpl ?v? ?1(?: 0)?", 4, 0.8),
    ("GPL-2.0", "gpl", r"(?:gnu )?gpl ?v? ?2(?: 0)?", 4, 0.8),
    ("GPL-2.0-or-later", "gpl", r"(?:gnu )?gpl ?v? ?2(?: 0)? (?:or later|plus|or any later version|or newer)", 3, 0.85),
    ("GPL-2.0-only", "gpl", r"(?:gnu )?gpl ?v? ?2(?: 0)? only", 3, 0.85),
    ("GPL-3.0", "gpl", r"(?:gnu )?gpl ?v? ?3(?: 0)?", 4, 0.8),
    ("GPL-3.0-or-later", "gpl", r"(?:gnu )?gpl ?v? ?3(?: 0)? (?:or later|plus|or any later version|or newer)", 3, 0.85),
    ("GPL-3.0-only", "gpl", r"(?:gnu )?gpl ?v? ?3(?: 0)? only", 3, 0.85),
    ("GPL-2.0", "gpl", r"gnu gpl version 2(?: 0)?", 3, 0.85),
    ("GPL-3.0", "gpl", r"gnu gpl version 3(?: 0)?", 3, 0.85),
    ("GPL", "gpl", r"(?:gnu gpl|gpl licen[cs]e|gpl compatible|gpled|under the gpl)", 4, 0.75),
    ("LGPL-2.1", "lgpl", r"(?:gnu )?lgpl ?v? ?2 1(?: (?:only|or later))?", 4, 0.8),
    ("LGPL-2.0", "lgpl", r"(?:gnu )?lgpl ?v? ?2(?: 0)?(?: (?:only|or later))?", 5, 0.75),
    ("LGPL-3.0", "lgpl", r"(?:gnu )?lgpl ?v? ?3(?: 0)?(?: (?:only|or later))?", 4, 0.8),
    ("LGPL", "lgpl", r"(?:gnu )?lgpl", 5, 0.7),
    ("AGPL-3.0", "agpl", r"(?:gnu )?agpl(?: ?v? ?3(?: 0)?)?(?: (?:only|or later))?", 4, 0.8),
    # Apache
    ("Apache-2.0", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0, 1.0),
    ("Apache-2.0", "apache", r"you may obtain a copy of the license at https? www apache org licenses license 2 0", 1, 1.0),
    ("Apache-2.0", "apache", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: (?:txt|html))?", 2, 0.95),
    ("Apache-2.0", "as is basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", 2, 0.95),
    ("Apache-2.0", "apache license version 2 0", r"apache license version 2 0 january 2004", 0, 1.0),
    ("Apache-2.0", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution 1 definitions", 2, 0.95),
    ("Apache-2.0", "patent license", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?(?:copyright|patent) license", 2, 0.95),
    ("Apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 2, 0.9),
    ("Apache-2.0", "apache", r"apache (?:v ?)?2 0(?: licen[cs]ed?)?", 4, 0.8),
    ("Apache-2.0", "asl", r"asl ?2(?: 0)?", 5, 0.7),
    # MIT and its relatives
    ("MIT", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1, 1.0),
    ("MIT", "sublicense", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 2, 0.95),
    ("MIT", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.95),
    ("MIT", "noninfringement", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 3, 0.85),
    ("MIT", "opensource org", r"(?:https? )?(?:www )?opensource org licenses? mit(?: license)?", 2, 0.95),
    ("MIT", "mit", r"licen[cs]ed under (?:the )?(?:terms of )?(?:the )?mit", 3, 0.9),
    ("MIT", "mit", r"licen[cs]e mit", 4, 0.8),
    ("MIT-0", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .{0,260}to do so the software is provided", 0, 1.0),
    ("ISC", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 1, 1.0),
    ("0BSD", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 1, 1.0),
    ("ISC", "author disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software", 3, 0.85),
    ("HPND", "hereby granted", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 1, 0.95),
    ("X11", "advertising or otherwise", r"except as contained in this notice the name of .{1,80}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 1, 1.0),
    ("Zlib", "implied warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 1, 1.0),
    ("Zlib", "must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1, 1.0),
    ("BSL-1.0", "boost", r"boost software license version 1 0 august 17th 2003", 0, 1.0),
    ("BSL-1.0", "permission is hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1, 1.0),
    ("PostgreSQL", "written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 0, 1.0),
    ("NCSA", "illinois", r"developed by .{1,80}university of illinois", 3, 0.85),
    # BSD
    ("BSD", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 2, 0.95),
    ("BSD", "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3, 0.9),
    ("BSD", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", 3, 0.9),
    ("BSD-3-Clause", "endorse or promote", r"neither the name of .{1,100}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission", 1, 1.0),
    ("BSD-3-Clause", "endorse or promote", r"(?:the )?names? of .{1,100}may not be used to endorse or promote products derived from this software without specific prior written permission", 2, 0.95),
    ("BSD-4-Clause", "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 1, 1.0),
    ("BSD", "merchantability", r"this software is provided by (?:the )?.{1,80}as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", 3, 0.9),
    ("BSD-3-Clause-Clear", "patent rights", r"no express or implied licenses to any party s patent rights are granted by this license", 1, 1.0),
    ("BSD", "bsd", r"(?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?bsd", 3, 0.9),
    ("BSD-3-Clause", "bsd", r"use of this source code is governed by a bsd style licen[cs]e that can be found in the license file", 1, 1.0),
    # Mozilla, Eclipse, Sun and others
    ("MPL-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0, 1.0),
    ("MPL-2.0", "mozilla org", r"if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0", 1, 1.0),
    ("MPL-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 0, 1.0),
    ("MPL-2.0", "mpl", r"mpl ?v? ?2(?: 0)?", 4, 0.8),
    ("MPL-1.1", "mpl", r"mpl ?v? ?1 1", 4, 0.8),
    ("EPL-1.0", "eclipse", r"made available under the terms of the eclipse public license v ?1 0", 1, 1.0),
    ("EPL-2.0", "eclipse", r"made available under the terms of the eclipse public license (?:v )?2 0", 1, 1.0),
    ("EPL-2.0", "epl", r"epl ?v? ?2(?: 0)?", 4, 0.8),
    ("EPL-1.0", "epl", r"epl ?v? ?1(?: 0)?", 4, 0.8),
    ("CDDL-1.0", "cddl", r"cddl(?: ?v? ?1 [01])?", 4, 0.8),
    ("CDDL-1.0", "development and distribution", r"the contents of this file are subject to the terms of the common development and distribution license", 0, 1.0),
    ("EUPL-1.2", "eupl", r"licensed under the eupl(?: version 1 [012])?", 2, 0.95),
    ("EUPL-1.2", "eupl", r"eupl(?: v? ?1 [012])?", 4, 0.8),
    ("Artistic-2.0", "artistic", r"you may distribute (?:it |this )?under the terms of (?:either )?the artistic license", 2, 0.9),
    ("Perl-5", "perl", r"(?:same terms as|under the same terms as) perl(?: itself)?", 2, 0.95),
    ("PSF-2.0", "python", r"python software foundation license version 2", 1, 1.0),
    ("PHP-3.01", "php", r"this source file is subject to version 3 01? of the php license", 0, 1.0),
    ("OpenSSL", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", 1, 1.0),
    ("Vim", "charityware", r"vim is charityware", 2, 0.9),
    ("OFL-1.1", "sil", r"this font software is licensed under the sil open font license version 1 1", 0, 1.0),
    ("Elastic-2.0", "hosted or managed", r"you may not provide the software to third parties as a hosted or managed service", 1, 1.0),
    ("SSPL-1.0", "sspl", r"sspl(?: ?v? ?1)?", 4, 0.8),
    ("BUSL-1.1", "anniversary", r"on the change date or the fourth anniversary of the first publicly available distribution", 1, 1.0),
    ("Commons-Clause", "commons clause", r"commons clause(?: licen[cs]e condition)?(?: v?1 0)?", 2, 0.95),
    ("OpenRAIL", "use based restrictions", r"use based restrictions as referenced in paragraph 5", 1, 1.0),
    ("Llama-Community", "llama", r"llama [234](?: [0123])? community licen[cs]e(?: agreement)?", 1, 0.95),
    # public domain, Creative Commons
    ("Unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 0, 1.0),
    ("Unlicense", "unlicense org", r"(?:https? )?unlicense org", 2, 0.95),
    ("CC0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights", 1, 1.0),
    ("CC0-1.0", "creativecommons org", r"(?:https? )?(?:www )?creativecommons org publicdomain zero 1 0", 1, 1.0),
    ("CC-BY", "creativecommons org", r"(?:https? )?(?:www )?creativecommons org licen[cs]es by [1234] [05]", 1, 1.0),
    ("CC-BY-SA", "creativecommons org", r"(?:https? )?(?:www )?creativecommons org licen[cs]es by sa [1234] [05]", 1, 1.0),
    ("CC-BY-NC", "creativecommons org", r"(?:https? )?(?:www )?creativecommons org licen[cs]es by nc [1234] [05]", 1, 1.0),
    ("CC-BY-ND", "creativecommons org", r"(?:https? )?(?:www )?creativecommons org licen[cs]es by nd [1234] [05]", 1, 1.0),
    ("CC-BY-NC-SA", "creativecommons org", r"(?:https? )?(?:www )?creativecommons org licen[cs]es by nc sa [1234] [05]", 1, 1.0),
    ("CC-BY-NC-ND", "creativecommons org", r"(?:https? )?(?:www )?creativecommons org licen[cs]es by nc nd [1234] [05]", 1, 1.0),
    ("CC-BY-SA", "sharealike", r"attribution sharealike(?: [1234] [05])?(?: international| unported)?", 4, 0.8),
    ("CC-BY-NC", "noncommercial", r"attribution noncommercial(?: [1234] [05])?(?: international| unported)?", 5, 0.75),
    ("CC-BY-NC-SA", "noncommercial", r"attribution noncommercial sharealike(?: [1234] [05])?(?: international| unported)?", 4, 0.8),
    ("CC-BY-NC-ND", "noncommercial", r"attribution noncommercial noderiv(?:ative)?s(?: [1234] [05])?(?: international| unported)?", 4, 0.8),
    ("Creative-Commons", "creative commons", r"this work is licensed under a creative commons", 3, 0.85),
    ("Public-Domain", "public domain", r"(?:released|placed|dedicated|is|are|works?) (?:in |into |to )?the public domain", 3, 0.8),
    ("Public-Domain", "public domain", r"(?:author|authors|i) (?:hereby )?(?:disclaims?|dedicates?|places?|releases?) .{0,60}public domain", 3, 0.85),
    ("Public-Domain", "no copyright", r"no copyright is claimed", 3, 0.8),
    # what reserves
    ("Proprietary", "all rights reserved", r"all rights reserved", 6, 0.5),
    ("Proprietary", "proprietary", r"(?:this (?:software|document|file) is )?(?:confidential and proprietary|proprietary and confidential)", 4, 0.8),
    ("Proprietary", "permission", r"(?:may not|must not|shall not) be (?:copied|reproduced|distributed)(?: [^ ]+){0,8} without (?:the )?(?:express |prior |written )*permission", 3, 0.85),
    ("Proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)(?: [^ ]+){0,8} is strictly prohibited", 3, 0.85),
    ("Proprietary", "end user license agreement", r"end user license agreement", 4, 0.75),
    # notices that name no licence
    ("Unknown", "license file", r"see (?:the )?license file (?:in the project root )?for (?:more |full |further )?(?:license )?(?:information|details)", 5, 0.6),
    ("Unknown", "license terms", r"(?:see|for) license terms", 6, 0.5),
)


def spdx_words(identifier: str) -> str:
    """An identifier as it looks among words: lower case, a space for each sign."""
    return "".join(c if c.isalnum() else " " for c in identifier.lower())


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(number, label, keyword, pattern over whole words, priority, weight), in order."""
    made = list(NOTICES)
    made += [(name, "spdx", f"spdx licen[cs]e identifier {spdx_words(name)}", 0, 1.0) for name in SPDX]
    made += [(label, keyword, form.replace("N", f"(?:{name})"), priority, weight) for label, (keyword, name) in NAMES.items() for form, priority, weight in FORMS]
    return [(n, label, keyword, f"(?<![^ ])(?:{pattern})(?![^ ])", priority, weight) for n, (label, keyword, pattern, priority, weight) in enumerate(made)]


def gate(keyword: str, pattern: str) -> str:
    """A word, or a part of one, that stands in every text with the keyword and a match of the pattern."""
    before = ""
    while before != pattern:  # optional parts go, and choices that do not all speak of a licence
        before = pattern
        pattern = re.sub(r"\(\?:([^()]*)\)([?{]?)", lambda m: "" if m[2] else "licen" if all("licen" in x for x in m[1].split("|")) else "", pattern, count=1)
    return "licen" if "licen" in pattern else max(reversed(keyword.split()), key=len)


def gates(base: list[str]) -> list[str]:
    """One of these stands in any text, lower-cased, that has one of the base phrases or a match of a rule."""
    made = list(NOTICES) + [(name, "spdx", "", 0, 0) for name in SPDX] + [(label, keyword, name, 0, 0) for label, (keyword, name) in NAMES.items()]
    found = {gate(keyword, pattern) for _, keyword, pattern, _, _ in made} | {"licen" if "licen" in phrase else max(phrase.split(), key=len) for phrase in base}
    return sorted(x for x in found if not any(y in x for y in found - {x}))
