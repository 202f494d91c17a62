"""License scan by ordered signature rules, in DataFrame functions only.

Texts are reduced to lower-case words with one space between them. A keyword prefilter decides which
texts, and which rules of a text, are looked at; each rule is a regular expression with a priority.
Of the detections of a text, one is suppressed if another of the same or a higher priority contains
its interval. Nothing is shuffled: each row is decided by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and their labels that every result must have.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: How a grant begins; stands for {under} in the rules.
UNDER = r"(?:(?:licensed|released|distributed|published|provided|available|redistributed|licen[sc]e|use|permitted)(?: to you)? under|governed by|covered by|subject to|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"

#: Signatures in normalised words: priority, label, expression. Of two detections the containing one of the same or a higher priority stays.
RULES = (
    # --- identifiers, as normalised words
    (90, "apache-1.0", r"spdx license identifier apache 1 0"),
    (90, "apache-1.1", r"spdx license identifier apache 1 1"),
    (90, "apache-2.0", r"spdx license identifier apache 2 0"),
    (90, "mit", r"spdx license identifier mit"),
    (90, "mit-0", r"spdx license identifier mit 0"),
    (90, "x11", r"spdx license identifier x11"),
    (90, "isc", r"spdx license identifier isc"),
    (90, "0bsd", r"spdx license identifier 0bsd"),
    (90, "bsd-2-clause", r"spdx license identifier bsd 2 clause"),
    (90, "bsd-3-clause", r"spdx license identifier bsd 3 clause"),
    (90, "bsd-3-clause-clear", r"spdx license identifier bsd 3 clause clear"),
    (90, "bsd-4-clause", r"spdx license identifier bsd 4 clause"),
    (90, "gpl-1.0", r"spdx license identifier gpl 1 0(?: only| or later)?"),
    (90, "gpl-2.0", r"spdx license identifier gpl 2 0(?: only| or later)?"),
    (90, "gpl-3.0", r"spdx license identifier gpl 3 0(?: only| or later)?"),
    (90, "lgpl-2.0", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    (90, "lgpl-2.1", r"spdx license identifier lgpl 2 1(?: only| or later)?"),
    (90, "lgpl-3.0", r"spdx license identifier lgpl 3 0(?: only| or later)?"),
    (90, "agpl-3.0", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    (90, "gfdl-1.2", r"spdx license identifier gfdl 1 2(?: only| or later)?"),
    (90, "gfdl-1.3", r"spdx license identifier gfdl 1 3(?: only| or later)?"),
    (90, "mpl-1.1", r"spdx license identifier mpl 1 1"),
    (90, "mpl-2.0", r"spdx license identifier mpl 2 0(?: no copyleft exception)?"),
    (90, "epl-1.0", r"spdx license identifier epl 1 0"),
    (90, "epl-2.0", r"spdx license identifier epl 2 0"),
    (90, "cddl-1.0", r"spdx license identifier cddl 1 0"),
    (90, "cddl-1.1", r"spdx license identifier cddl 1 1"),
    (90, "cpl-1.0", r"spdx license identifier cpl 1 0"),
    (90, "eupl-1.1", r"spdx license identifier eupl 1 1"),
    (90, "eupl-1.2", r"spdx license identifier eupl 1 2"),
    (90, "artistic-1.0", r"spdx license identifier artistic 1 0(?: perl)?"),
    (90, "artistic-2.0", r"spdx license identifier artistic 2 0"),
    (90, "cc0-1.0", r"spdx license identifier cc0 1 0"),
    (90, "cc-by-2.0", r"spdx license identifier cc by 2 0"),
    (90, "cc-by-3.0", r"spdx license identifier cc by 3 0"),
    (90, "cc-by-4.0", r"spdx license identifier cc by 4 0"),
    (90, "cc-by-sa-3.0", r"spdx license identifier cc by sa 3 0"),
    (90, "cc-by-sa-4.0", r"spdx license identifier cc by sa 4 0"),
    (90, "cc-by-nc-4.0", r"spdx license identifier cc by nc 4 0"),
    (90, "cc-by-nd-4.0", r"spdx license identifier cc by nd 4 0"),
    (90, "cc-by-nc-sa-4.0", r"spdx license identifier cc by nc sa 4 0"),
    (90, "cc-by-nc-nd-4.0", r"spdx license identifier cc by nc nd 4 0"),
    (90, "unlicense", r"spdx license identifier unlicense"),
    (90, "wtfpl", r"spdx license identifier wtfpl"),
    (90, "zlib", r"spdx license identifier zlib"),
    (90, "bsl-1.0", r"spdx license identifier bsl 1 0"),
    (90, "psf-2.0", r"spdx license identifier (?:psf|python) 2 0"),
    (90, "ofl-1.1", r"spdx license identifier ofl 1 1(?: rfn| no rfn)?"),
    (90, "odbl-1.0", r"spdx license identifier odbl 1 0"),
    (90, "ms-pl", r"spdx license identifier ms pl"),
    (90, "ms-rl", r"spdx license identifier ms rl"),
    (90, "postgresql", r"spdx license identifier postgresql"),
    (90, "openssl", r"spdx license identifier openssl"),
    (90, "ncsa", r"spdx license identifier ncsa"),
    (90, "afl-3.0", r"spdx license identifier afl 3 0"),
    (90, "osl-3.0", r"spdx license identifier osl 3 0"),
    (90, "vim", r"spdx license identifier vim"),
    (90, "curl", r"spdx license identifier curl"),
    (90, "libpng", r"spdx license identifier libpng(?: 2 0)?"),
    (90, "upl-1.0", r"spdx license identifier upl 1 0"),
    (90, "blueoak-1.0.0", r"spdx license identifier blueoak 1 0 0"),
    (90, "busl-1.1", r"spdx license identifier busl 1 1"),
    # --- grants that name a version
    (80, "apache-1.1", r"{under}apache (?:software )?license(?: version)? 1 1"),
    (80, "apache-2.0", r"{under}apache (?:software )?(?:license )?(?:v|version )?2(?: 0)?(?: license)?"),
    (80, "gpl-2.0", r"{under}(?:gnu )?gpl ?(?:v|version )?2(?: 0)?(?: or later| license)?"),
    (80, "gpl-3.0", r"{under}(?:gnu )?gpl ?(?:v|version )?3(?: 0)?(?: or later| license)?"),
    (80, "gpl-2.0", r"{under}(?:gnu )?general public license (?:v|version )?2(?: 0)?(?: or later)?"),
    (80, "gpl-3.0", r"{under}(?:gnu )?general public license (?:v|version )?3(?: 0)?(?: or later)?"),
    (80, "lgpl-2.1", r"{under}(?:gnu )?lgpl ?(?:v|version )?2 1(?: or later| license)?"),
    (80, "lgpl-3.0", r"{under}(?:gnu )?lgpl ?(?:v|version )?3(?: 0)?(?: or later| license)?"),
    (80, "lgpl-2.1", r"{under}(?:gnu )?lesser general public license (?:v|version )?2 1"),
    (80, "lgpl-3.0", r"{under}(?:gnu )?lesser general public license (?:v|version )?3(?: 0)?"),
    (80, "agpl-3.0", r"{under}(?:gnu )?agpl ?(?:v|version )?3(?: 0)?(?: license)?"),
    (80, "agpl-3.0", r"{under}(?:gnu )?affero general public license (?:v|version )?3(?: 0)?"),
    (80, "mpl-1.1", r"{under}(?:mozilla public license|mpl) (?:v|version )?1 1"),
    (80, "mpl-2.0", r"{under}(?:mozilla public license|mpl) (?:v|version )?2(?: 0)?"),
    (80, "epl-1.0", r"{under}(?:eclipse public license|epl) (?:v|version )?1(?: 0)?"),
    (80, "epl-2.0", r"{under}(?:eclipse public license|epl) (?:v|version )?2(?: 0)?"),
    (80, "eupl-1.2", r"{under}(?:european union public licen[sc]e|eupl) (?:v|version )?1 2"),
    (80, "artistic-2.0", r"{under}artistic license (?:v|version )?2(?: 0)?"),
    (80, "cc-by-3.0", r"{under}(?:cc by|creative commons attribution) 3 0(?: unported| international)?(?: licen[sc]e)?"),
    (80, "cc-by-4.0", r"{under}(?:cc by|creative commons attribution) 4 0(?: unported| international)?(?: licen[sc]e)?"),
    (80, "cc-by-sa-3.0", r"{under}(?:cc by sa|creative commons attribution share ?alike) 3 0(?: unported| international)?(?: licen[sc]e)?"),
    (80, "cc-by-sa-4.0", r"{under}(?:cc by sa|creative commons attribution share ?alike) 4 0(?: unported| international)?(?: licen[sc]e)?"),
    (80, "cc-by-nc-4.0", r"{under}(?:cc by nc|creative commons attribution non ?commercial) 4 0(?: international)?(?: licen[sc]e)?"),
    (80, "cc-by-nd-4.0", r"{under}(?:cc by nd|creative commons attribution no ?deriv(?:s|atives)) 4 0(?: international)?(?: licen[sc]e)?"),
    (80, "cc-by-nc-sa-4.0", r"{under}(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0(?: international)?(?: licen[sc]e)?"),
    (80, "cc-by-nc-nd-4.0", r"{under}(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives)) 4 0(?: international)?(?: licen[sc]e)?"),
    (80, "cc0-1.0", r"{under}(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: licen[sc]e)?"),
    # --- grants that name no version
    (70, "apache", r"{under}apache(?: software)?(?: licen[sc]e)?"),
    (70, "mit", r"{under}(?:mit|expat|massachusetts institute of technology)(?: licen[sc]e)?"),
    (70, "x11", r"{under}x11(?: licen[sc]e)?"),
    (70, "isc", r"{under}(?:isc|internet systems consortium)(?: licen[sc]e)?"),
    (70, "0bsd", r"{under}(?:0bsd|zero clause bsd)(?: licen[sc]e)?"),
    (70, "bsd-2-clause", r"{under}(?:(?:2|two) clause bsd|simplified bsd|freebsd|bsd (?:2|two) clause)(?: licen[sc]e)?"),
    (70, "bsd-3-clause", r"{under}(?:(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd (?:3|three) clause)(?: licen[sc]e)?"),
    (70, "bsd-4-clause", r"{under}(?:(?:4|four) clause bsd|original bsd|bsd (?:4|four) clause)(?: licen[sc]e)?"),
    (70, "bsd", r"{under}(?:bsd|berkeley software distribution)(?: style)?(?: licen[sc]e)?"),
    (70, "gpl", r"{under}(?:gnu )?(?:gpl|general public)(?: licen[sc]e)?"),
    (70, "lgpl", r"{under}(?:gnu )?(?:lgpl|(?:lesser|library) general public)(?: licen[sc]e)?"),
    (70, "agpl", r"{under}(?:gnu )?(?:agpl|affero general public)(?: licen[sc]e)?"),
    (70, "gfdl", r"{under}(?:gnu )?(?:gfdl|free documentation)(?: licen[sc]e)?"),
    (70, "mpl", r"{under}(?:mozilla public|mpl)(?: licen[sc]e)?"),
    (70, "epl", r"{under}(?:eclipse public|epl)(?: licen[sc]e)?"),
    (70, "cddl-1.0", r"{under}(?:common development and distribution|cddl)(?: licen[sc]e)?"),
    (70, "cpl-1.0", r"{under}(?:common public|cpl)(?: licen[sc]e)?"),
    (70, "eupl", r"{under}(?:european union public|eupl)(?: licen[sc]e)?"),
    (70, "artistic", r"{under}(?:perl )?artistic(?: licen[sc]e)?"),
    (70, "cc-by", r"{under}(?:cc by|creative commons attribution)(?: licen[sc]e)?"),
    (70, "cc-by-sa", r"{under}(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)?"),
    (70, "cc-by-nc", r"{under}(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)?"),
    (70, "cc-by-nd", r"{under}(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: licen[sc]e)?"),
    (70, "creative-commons", r"{under}creative commons(?: licen[sc]e)?"),
    (70, "unlicense", r"{under}unlicense"),
    (70, "wtfpl", r"{under}(?:wtfpl|do what the fuck you want to public)(?: licen[sc]e)?"),
    (70, "zlib", r"{under}zlib(?: libpng)?(?: licen[sc]e)?"),
    (70, "bsl-1.0", r"{under}boost software(?: licen[sc]e)?"),
    (70, "psf-2.0", r"{under}(?:psf|python software foundation)(?: licen[sc]e)?"),
    (70, "ofl-1.1", r"{under}(?:sil )?open font(?: licen[sc]e)?"),
    (70, "odbl-1.0", r"{under}(?:open database|open data commons|odbl)(?: licen[sc]e)?"),
    (70, "ms-pl", r"{under}(?:microsoft public|ms pl)(?: licen[sc]e)?"),
    (70, "ms-rl", r"{under}(?:microsoft reciprocal|ms rl)(?: licen[sc]e)?"),
    (70, "postgresql", r"{under}postgresql(?: licen[sc]e)?"),
    (70, "openssl", r"{under}openssl(?: licen[sc]e)?"),
    (70, "ncsa", r"{under}(?:university of illinois(?: ncsa)?(?: open source)?|ncsa(?: open source)?)(?: licen[sc]e)?"),
    (70, "afl-3.0", r"{under}(?:academic free|afl)(?: licen[sc]e)?"),
    (70, "osl-3.0", r"{under}(?:open software|osl)(?: licen[sc]e)?"),
    (70, "upl-1.0", r"{under}(?:universal permissive|upl)(?: licen[sc]e)?"),
    (70, "busl-1.1", r"{under}(?:business source|busl)(?: licen[sc]e)?"),
    (70, "same-terms", r"(?:under the same terms as|same license as) (?:perl|python|ruby|java) itself"),
    # --- names with a version
    (60, "apache-1.1", r"apache (?:software )?license(?: version)? 1 1"),
    (60, "apache-2.0", r"apache (?:software )?license (?:v|version )?2(?: 0)?"),
    (60, "gpl-1.0", r"(?:gnu )?general public license (?:v|version )?1(?: 0)?"),
    (60, "gpl-2.0", r"(?:gnu )?general public license (?:v|version )?2(?: 0)?"),
    (60, "gpl-3.0", r"(?:gnu )?general public license (?:v|version )?3(?: 0)?"),
    (60, "gpl-2.0", r"gpl ?v?2(?: 0)? licen[sc]ed?"),
    (60, "gpl-3.0", r"gpl ?v?3(?: 0)? licen[sc]ed?"),
    (60, "gpl-2.0", r"licen[sc]e gpl ?v?2(?: 0)?"),
    (60, "gpl-3.0", r"licen[sc]e gpl ?v?3(?: 0)?"),
    (60, "lgpl-2.1", r"(?:gnu )?lesser general public license (?:v|version )?2 1"),
    (60, "lgpl-3.0", r"(?:gnu )?lesser general public license (?:v|version )?3(?: 0)?"),
    (60, "lgpl-2.1", r"lgpl ?v?2 1 licen[sc]ed?"),
    (60, "lgpl-3.0", r"lgpl ?v?3(?: 0)? licen[sc]ed?"),
    (60, "agpl-3.0", r"(?:gnu )?affero general public license (?:v|version )?3(?: 0)?"),
    (60, "agpl-3.0", r"agpl ?v?3(?: 0)? licen[sc]ed?"),
    (60, "gfdl-1.2", r"(?:gnu )?free documentation license (?:v|version )?1 2"),
    (60, "gfdl-1.3", r"(?:gnu )?free documentation license (?:v|version )?1 3"),
    (60, "mpl-1.1", r"mozilla public license (?:v|version )?1 1"),
    (60, "mpl-2.0", r"mozilla public license (?:v|version )?2(?: 0)?"),
    (60, "epl-1.0", r"eclipse public license (?:v|version )?1(?: 0)?"),
    (60, "epl-2.0", r"eclipse public license (?:v|version )?2(?: 0)?"),
    (60, "eupl-1.2", r"european union public licen[sc]e (?:v|version )?1 2"),
    (60, "artistic-1.0", r"artistic license (?:v|version )?1(?: 0)?"),
    (60, "artistic-2.0", r"artistic license (?:v|version )?2(?: 0)?"),
    (60, "cc0-1.0", r"cc0 1 0 universal(?: public domain dedication)?"),
    (60, "cc-by-2.0", r"(?:cc by|creative commons attribution) 2 0(?: generic)?"),
    (60, "cc-by-3.0", r"(?:cc by|creative commons attribution) 3 0(?: unported)?"),
    (60, "cc-by-4.0", r"(?:cc by|creative commons attribution) 4 0(?: international)?"),
    (60, "cc-by-sa-3.0", r"(?:cc by sa|creative commons attribution share ?alike) 3 0(?: unported)?"),
    (60, "cc-by-sa-4.0", r"(?:cc by sa|creative commons attribution share ?alike) 4 0(?: international)?"),
    (60, "cc-by-nc-4.0", r"(?:cc by nc|creative commons attribution non ?commercial) 4 0(?: international)?"),
    (60, "cc-by-nd-4.0", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives)) 4 0(?: international)?"),
    (60, "cc-by-nc-sa-4.0", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0(?: international)?"),
    (60, "cc-by-nc-nd-4.0", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives)) 4 0(?: international)?"),
    (60, "bsl-1.0", r"boost software license version 1 0"),
    (60, "ofl-1.1", r"open font license version 1 1"),
    (60, "cddl-1.0", r"common development and distribution license(?: version)? 1 0"),
    (60, "psf-2.0", r"python software foundation license version 2"),
    (60, "osl-3.0", r"open software license(?: version)? 3 0"),
    (60, "upl-1.0", r"universal permissive license(?: version)? 1 0"),
    (60, "busl-1.1", r"business source license(?: version)? 1 1"),
    # --- names
    (50, "apache", r"apache (?:software )?licen[sc]ed?"),
    (50, "mit", r"(?:mit|expat|massachusetts institute of technology) licen[sc]ed?"),
    (50, "mit", r"licen[sc]e(?: is)? mit"),
    (50, "x11", r"x11 licen[sc]ed?"),
    (50, "isc", r"(?:isc|internet systems consortium) licen[sc]ed?"),
    (50, "0bsd", r"(?:0bsd|zero clause bsd) licen[sc]ed?"),
    (50, "bsd-2-clause", r"(?:(?:2|two) clause bsd|simplified bsd|freebsd|bsd (?:2|two) clause) licen[sc]ed?"),
    (50, "bsd-3-clause", r"(?:(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd (?:3|three) clause) licen[sc]ed?"),
    (50, "bsd-4-clause", r"(?:(?:4|four) clause bsd|original bsd|bsd (?:4|four) clause) licen[sc]ed?"),
    (50, "bsd", r"(?:bsd(?: style)?|berkeley software distribution) licen[sc]ed?"),
    (50, "bsd", r"licen[sc]e(?: is)? bsd"),
    (50, "gpl", r"(?:gnu )?(?:gpl|general public) licen[sc]ed?"),
    (50, "gpl", r"licen[sc]e(?: is)? (?:gnu )?gpl"),
    (50, "lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public) licen[sc]ed?"),
    (50, "agpl", r"(?:gnu )?(?:agpl|affero general public) licen[sc]ed?"),
    (50, "gfdl", r"(?:gnu )?(?:gfdl|free documentation) licen[sc]e"),
    (50, "mpl", r"(?:mozilla public|mpl) licen[sc]ed?"),
    (50, "epl", r"(?:eclipse public|epl) licen[sc]ed?"),
    (50, "cddl-1.0", r"(?:common development and distribution|cddl) licen[sc]ed?"),
    (50, "cpl-1.0", r"(?:common public|cpl) licen[sc]ed?"),
    (50, "eupl", r"european union public licen[sc]e"),
    (50, "artistic", r"artistic licen[sc]e"),
    (50, "cc-by", r"creative commons attribution licen[sc]e"),
    (50, "cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: licen[sc]e)?"),
    (50, "cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: licen[sc]e)?"),
    (50, "cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))(?: licen[sc]e)?"),
    (50, "creative-commons", r"creative commons licen[sc]ed?"),
    (50, "wtfpl", r"(?:wtfpl|do what the fuck you want to public) licen[sc]e"),
    (50, "zlib", r"zlib(?: libpng)? licen[sc]ed?"),
    (50, "bsl-1.0", r"boost(?: software)? licen[sc]ed?"),
    (50, "psf-2.0", r"(?:psf|python software foundation) licen[sc]ed?"),
    (50, "ofl-1.1", r"(?:sil )?open font licen[sc]e"),
    (50, "odbl-1.0", r"(?:open database|open data commons) licen[sc]e"),
    (50, "ms-pl", r"(?:microsoft public|ms pl) licen[sc]e"),
    (50, "ms-rl", r"(?:microsoft reciprocal|ms rl) licen[sc]e"),
    (50, "postgresql", r"postgresql licen[sc]ed?"),
    (50, "openssl", r"openssl licen[sc]ed?"),
    (50, "ncsa", r"(?:university of illinois(?: ncsa)?(?: open source)?|ncsa(?: open source)?) licen[sc]ed?"),
    (50, "afl-3.0", r"academic free licen[sc]e"),
    (50, "osl-3.0", r"open software licen[sc]e"),
    (50, "vim", r"vim licen[sc]e"),
    (50, "curl", r"curl licen[sc]e"),
    (50, "libpng", r"libpng licen[sc]e"),
    (50, "upl-1.0", r"universal permissive licen[sc]e"),
    (50, "blueoak-1.0.0", r"blue oak model licen[sc]e"),
    (50, "busl-1.1", r"business source licen[sc]e"),
    (50, "beerware", r"beer ?ware licen[sc]e"),
    (50, "json", r"json licen[sc]e"),
    (50, "php", r"php licen[sc]e"),
    (50, "ruby", r"ruby licen[sc]e"),
    (50, "w3c", r"w3c software(?: notice and)? licen[sc]e"),
    (50, "unicode", r"unicode(?: inc)? licen[sc]e(?: agreement)?"),
    # --- sentences of license texts
    (45, "mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    (45, "isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (45, "bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    (45, "bsd-3-clause", r"neither the name of .{1,80} nor the names of its contributors may be used"),
    (45, "bsd-4-clause", r"all advertising materials mentioning features or use of this software"),
    (45, "apache-2.0", r"you may not use this file except in compliance with the license"),
    (45, "apache-2.0", r"licensed to the apache software foundation asf under one"),
    (45, "gpl", r"this program is free software you can redistribute it and or modify it"),
    (45, "lgpl", r"this library is free software you can redistribute it and or modify it"),
    (45, "gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    (45, "mpl", r"this source code form is subject to the terms of the mozilla public license"),
    (45, "epl", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    (45, "zlib", r"this software is provided as is without any express or implied warranty"),
    (45, "unlicense", r"this is free and unencumbered software released into the public domain"),
    (45, "wtfpl", r"everyone is permitted to copy and distribute verbatim or modified"),
    (45, "cc0-1.0", r"(?:to the extent possible under law|has waived all copyright and related or neighboring rights)"),
    (45, "json", r"the software shall be used for good not evil"),
    (45, "bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    # --- notices
    (40, "reserved", r"(?:all|some) rights (?:are )?reserved"),
    (40, "reserved", r"reserves all rights"),
    (40, "cc-by", r"cc by"),
    (40, "public-domain", r"(?:released|dedicated|placed|is|are) (?:in|into|to) the public domain"),
    (30, "public-domain", r"public domain"),
    (30, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    (20, "copyright", r"copyright(?:ed)? (?:by|holders?|notice|owner)"),
    (30, "no-warranty", r"(?:without|no) (?:any )?warrant(?:y|ies)(?: of any kind)?"),
    (30, "as-is", r"(?:provided|distributed|licensed) (?:on an )?as is"),
    (30, "proprietary", r"proprietary (?:and confidential|licen[sc]e|software)"),
    (30, "non-commercial", r"(?:non ?commercial|not for commercial) use(?: only)?"),
    (30, "no-redistribution", r"(?:may not be|not to be) (?:reproduced|redistributed|copied)"),
    (20, "redistribution", r"redistribution and use in source and binary forms"),
    (20, "permission", r"permission is hereby granted free of charge"),
    (20, "trade-secret", r"(?:trade secrets?|confidential information) of"),
)

#: A text without any of these matches no rule.
GATES = ("licen", " under", "governed by", "covered by", "subject to", "according to", "reserved ", "reserves all rights", "public domain", "copyright", "warrant", "as is ", "proprietary", "commercial", "redistribut", "reproduced", "copied", "trade secret", "confidential", "cc by", "cc0 1 0", "creative commons", "permission", "permitted", "free software", "advertising materials", "names of its contributors", "for good not evil", "without express or implied")


def _needed(parsed, run: str = "") -> list[tuple[str, ...]]:
    """Sets of strings; every match of a parsed expression, behind `run`, holds a string of each set."""
    sets: list[tuple[str, ...]] = []
    for op, value in [*parsed, ("END", None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name == "BRANCH":
            ways = [_best(_needed(branch, run)) for branch in value[1]]
            sets += [tuple(dict.fromkeys(x for w in ways for x in w))] if all(ways) else []
        elif name == "SUBPATTERN":
            sets += _needed(value[3], run)
        else:
            sets += [(run,)] if run else []
            if name == "MAX_REPEAT" and value[0] > 0:
                sets += _needed(value[2])
        run = ""
    return sets


def _best(sets: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The set whose shortest string has the most letters, those of "license" aside."""
    letters = lambda x: sum(map(str.isalpha, x.replace("license", "").replace("licen", "").replace("spdx  identifier", ""))) + 0.1 * len(x)
    return max(sets, key=lambda s: (min(map(letters, s)), -len(s)), default=())


def keywords(expression: str) -> tuple[str, ...]:
    """The keyword gate of a rule, read off its expression without the grant before it: one string for each way to match."""
    return tuple(sorted(_best(_needed(re._parser.parse(f" {expression.removeprefix('{under}')} ")))))


def gated(expression: str) -> bool:
    """Whether each match of an expression holds one of GATES."""
    return any(all(any(g in x for g in GATES) for x in s) for s in _needed(re._parser.parse(f" {expression.replace('{under}', UNDER)} ")))


def rules() -> list[tuple[tuple[str, ...], str, str, int]]:
    """(keywords, expression, label, priority) in order of falling priority. Every match has one of the keywords."""
    made = [(keywords(e), f"(?<= )(?:{e.replace('{under}', UNDER)})(?= )", label, priority) for priority, label, e in RULES]
    return sorted(made, key=lambda r: -r[3])


def _count(words: Column) -> Column:
    """Spaces of a string."""
    return F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))


def _detections(norm: Column) -> Column:
    """Array of (start, end, priority, label) of the rules of which the text has a keyword."""
    by_key: dict[tuple[str, ...], list] = {}
    for key, expression, label, priority in rules():
        by_key.setdefault(key, []).append(F.struct(F.lit(expression).alias("rx"), F.lit(label).alias("label"), F.lit(priority).alias("priority")))
    keyed = F.array(*[F.struct(F.array(*map(F.lit, k)).alias("keys"), F.array(*rs).alias("rules")) for k, rs in by_key.items()])

    def places(rule: Column) -> Column:
        gaps = F.transform(F.split(norm, rule["rx"]), lambda g: F.length(g))
        found = F.transform(F.regexp_extract_all(norm, rule["rx"], F.lit(0)), lambda m: F.length(m))
        pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            return F.when(x["hit"].isNull(), acc).otherwise(F.struct((begin + x["hit"]).alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), (begin + x["hit"]).alias("end"))).alias("out")))

        spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["label"].alias("label")))

    present = F.flatten(F.transform(F.filter(keyed, lambda k: F.exists(k["keys"], lambda key: F.contains(norm, key))), lambda k: k["rules"]))
    return F.flatten(F.transform(F.filter(present, lambda r: F.regexp_like(norm, r["rx"])), places))


def _survivors(found: Column) -> Column:
    """(labels, top): what is left after suppression. In order of start, an interval is contained in an earlier one that ends no sooner."""
    levels = sorted({p for *_, p in rules()})
    ends = F.struct(*[F.lit(-1).alias(f"p{p}") for p in levels])  # furthest end so far of detections of priority p or higher
    start = F.struct(ends.alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("top"))

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        reach = F.lit(-1)
        for p in levels:
            reach = F.when(priority == p, acc["ends"][f"p{p}"]).otherwise(reach)
        grown = F.struct(*[F.when(priority >= p, F.greatest(acc["ends"][f"p{p}"], end)).otherwise(acc["ends"][f"p{p}"]).alias(f"p{p}") for p in levels])
        kept = F.struct(grown.alias("ends"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.greatest(acc["top"], priority).alias("top"))
        return F.when(reach >= end, acc).otherwise(kept)

    return F.aggregate(F.array_sort(found), start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["top"].alias("top")))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): word count, base phrases and where they stand, labels, score.

    A null or empty text has no words, labels '' and score 0; its first and last word are null. Rows
    are decided one by one, so repeated rows, null ids and ties of priority need no rule of their
    own, except that of two detections over the same interval the label that sorts first stays.
    """
    base = "(?<= )(?:" + "|".join(p for p, _ in BASE_PHRASES) + ")(?= )"
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    df = docs.select(F.col("doc_id"), F.concat(F.lit(" "), words, F.lit(" ")).alias("norm"))
    norm = F.col("norm")
    has = {p: F.contains(norm, F.lit(f" {p} ")) for p, _ in BASE_PHRASES}
    any_base = has[BASE_PHRASES[0][0]] | has[BASE_PHRASES[1][0]] | has[BASE_PHRASES[2][0]]
    gate = F.lit(False)
    for g in GATES:
        gate = gate | F.contains(norm, F.lit(g))
    df = df.select(
        "doc_id",
        "norm",
        F.when(norm == "  ", F.lit(0)).otherwise(_count(norm) - 1).cast("bigint").alias("n_words"),
        F.when(any_base, F.split(norm, base)).alias("pieces"),
        F.concat_ws(",", *[F.when(has[p], F.lit(x)) for p, x in sorted(BASE_PHRASES, key=lambda b: b[1])]).alias("base_labels"),
        F.when(gate, _survivors(_detections(norm))).alias("found"),
    )
    last = F.element_at("pieces", -1)
    before_last = F.substring(norm, F.lit(1), F.length(norm) - F.length(last))
    size = F.lit(0)
    for p, _ in BASE_PHRASES:
        size = F.when(F.endswith(before_last, F.lit(f" {p}")), F.lit(p.count(" ") + 1)).otherwise(size)
    labels = F.array_sort(F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.coalesce("found.labels", F.array().cast("array<string>"))))
    return df.select(
        "doc_id",
        "n_words",
        F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.size("pieces") - 1).cast("bigint").alias("n_base"),
        F.when(F.col("pieces").isNotNull(), _count(F.element_at("pieces", 1)) - 1).cast("bigint").alias("first_word"),
        F.when(F.col("pieces").isNotNull(), F.col("n_words") - (_count(last) - 1) - size).cast("bigint").alias("last_word"),
        "base_labels",
        F.concat_ws(",", labels).alias("labels"),
        F.round(F.greatest(F.coalesce("found.top", F.lit(0)), F.when(F.col("base_labels") != "", F.lit(40)).otherwise(0)) / 100, 2).cast("double").alias("score"),
    )
