"""License scans by ordered signature rules, in DataFrame expressions only.

A text is cut into lower-cased words. Keywords gate the scan: first a text has to hold one of a few words, then a rule is
tried only where its first word stands. A rule is a regular expression over the next words, joined by blanks. Where detections
overlap, the one of better priority stays if it contains the other; within one priority the longer one stays.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmeter.llm.common import set_aside

#: Label, SPDX identifiers, patterns of the name over words joined by blanks, first words of these names.
FAMILIES = [
    ("mit", ["MIT", "MIT-0"], ["mit license", "mit licence", "expat license"], ["mit", "expat"]),
    ("apache-2.0", ["Apache-2.0"], ["apache (?:software )?license(?: version)? 2 0", "apache 2 0 license"], ["apache"]),
    ("apache-1.1", ["Apache-1.1"], ["apache (?:software )?license(?: version)? 1 1"], ["apache"]),
    ("apache", [], ["apache (?:software )?licen[sc]e"], ["apache"]),
    ("agpl-3.0", ["AGPL-3.0-only", "AGPL-3.0-or-later"], ["(?:gnu )?affero general public licen[sc]e(?: version)?(?:(?: v ?| )3)?", "agpl ?v?3"], ["gnu", "affero", "agpl", "agplv3", "agpl3"]),
    ("lgpl-3.0", ["LGPL-3.0-only", "LGPL-3.0-or-later"], ["(?:gnu )?lesser general public licen[sc]e(?: version)?(?: v ?| )3", "lgpl ?v?3"], ["gnu", "lesser", "lgpl", "lgplv3", "lgpl3"]),
    ("lgpl-2.1", ["LGPL-2.1-only", "LGPL-2.1-or-later"], ["(?:gnu )?lesser general public licen[sc]e(?: version)?(?: v ?| )2 1", "lgpl ?v?2 1"], ["gnu", "lesser", "lgpl", "lgplv2", "lgpl2"]),
    ("lgpl", [], ["(?:gnu )?(?:lesser|library) general public licen[sc]e"], ["gnu", "lesser", "library"]),
    ("gpl-3.0", ["GPL-3.0-only", "GPL-3.0-or-later"], ["(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)?(?: v ?| )3", "gpl ?v?3"], ["gnu", "general", "gpl", "gplv3", "gpl3"]),
    ("gpl-2.0", ["GPL-2.0-only", "GPL-2.0-or-later"], ["(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)?(?: v ?| )2", "gpl ?v?2"], ["gnu", "general", "gpl", "gplv2", "gpl2"]),
    ("gpl", [], ["(?:gnu )?general public licen[sc]e", "gnu gpl"], ["gnu", "general"]),
    ("bsd-3-clause", ["BSD-3-Clause"], ["(?:new|modified|revised) bsd licen[sc]e", "bsd 3 clause(?: licen[sc]e)?", "3 clause bsd licen[sc]e"], ["new", "modified", "revised", "bsd", "3"]),
    ("bsd-2-clause", ["BSD-2-Clause"], ["(?:simplified|freebsd) bsd licen[sc]e", "bsd 2 clause(?: licen[sc]e)?", "2 clause bsd licen[sc]e"], ["simplified", "freebsd", "bsd", "2"]),
    ("bsd", ["0BSD"], ["bsd(?: style)? licen[sc]e"], ["bsd"]),
    ("isc", ["ISC"], ["isc licen[sc]e"], ["isc"]),
    ("mpl-2.0", ["MPL-2.0"], ["mozilla public licen[sc]e(?: version)?(?: v ?| )2 0", "mpl 2 0"], ["mozilla", "mpl"]),
    ("mpl-1.1", ["MPL-1.1"], ["mozilla public licen[sc]e(?: version)?(?: v ?| )1 1", "mpl 1 1"], ["mozilla", "mpl"]),
    ("mpl", [], ["mozilla public licen[sc]e"], ["mozilla"]),
    ("epl-2.0", ["EPL-2.0"], ["eclipse public licen[sc]e(?: version)?(?: v ?| )2(?: 0)?"], ["eclipse"]),
    ("epl-1.0", ["EPL-1.0"], ["eclipse public licen[sc]e(?: version)?(?: v ?| )1(?: 0)?"], ["eclipse"]),
    ("cddl-1.0", ["CDDL-1.0"], ["common development and distribution licen[sc]e"], ["common"]),
    ("cpl-1.0", ["CPL-1.0"], ["common public licen[sc]e"], ["common"]),
    ("eupl-1.2", ["EUPL-1.2"], ["european union public licen[sc]e"], ["european"]),
    ("cecill-2.1", ["CECILL-2.1"], ["cecill(?: free software)? licen[sc]e"], ["cecill"]),
    ("artistic-2.0", ["Artistic-2.0"], ["artistic licen[sc]e(?: version)? 2 0"], ["artistic"]),
    ("artistic", ["Artistic-1.0"], ["artistic licen[sc]e"], ["artistic"]),
    ("zlib", ["Zlib"], ["zlib(?: libpng)? licen[sc]e"], ["zlib"]),
    ("libpng", ["libpng-2.0"], ["libpng licen[sc]e"], ["libpng"]),
    ("bsl-1.0", ["BSL-1.0"], ["boost software licen[sc]e"], ["boost"]),
    ("busl-1.1", ["BUSL-1.1"], ["business source licen[sc]e"], ["business"]),
    ("sspl-1.0", ["SSPL-1.0"], ["server side public licen[sc]e"], ["server"]),
    ("elastic-2.0", ["Elastic-2.0"], ["elastic licen[sc]e"], ["elastic"]),
    ("wtfpl", ["WTFPL"], ["do what the fuck you want to public licen[sc]e", "wtfpl"], ["do", "wtfpl"]),
    ("unlicense", ["Unlicense"], ["the unlicense", "unlicense"], ["the", "unlicense"]),
    ("cc0-1.0", ["CC0-1.0"], ["cc0(?: 1 0)?", "creative commons zero"], ["cc0", "creative"]),
    ("cc-by-4.0", ["CC-BY-4.0"], ["cc by 4 0", "creative commons attribution 4 0"], ["cc", "creative"]),
    ("cc-by-3.0", ["CC-BY-3.0"], ["cc by 3 0", "creative commons attribution 3 0"], ["cc", "creative"]),
    ("cc-by-sa-4.0", ["CC-BY-SA-4.0"], ["cc by sa 4 0", "creative commons attribution share ?alike 4 0"], ["cc", "creative"]),
    ("cc-by-sa-3.0", ["CC-BY-SA-3.0"], ["cc by sa 3 0", "creative commons attribution share ?alike 3 0"], ["cc", "creative"]),
    ("cc-by-nc-4.0", ["CC-BY-NC-4.0"], ["cc by nc 4 0", "creative commons attribution non ?commercial 4 0"], ["cc", "creative"]),
    ("cc-by-nc-sa-4.0", ["CC-BY-NC-SA-4.0"], ["cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0"], ["cc", "creative"]),
    ("cc-by-nd-4.0", ["CC-BY-ND-4.0"], ["cc by nd 4 0", "creative commons attribution no ?deriv(?:ative)?s 4 0"], ["cc", "creative"]),
    ("cc", [], ["creative commons licen[sc]e", "creative commons attribution"], ["creative"]),
    ("public-domain", ["PDDL-1.0"], ["public domain"], ["public"]),
    ("ofl-1.1", ["OFL-1.1"], ["sil open font licen[sc]e", "open font licen[sc]e"], ["sil", "open"]),
    ("odbl-1.0", ["ODbL-1.0"], ["open database licen[sc]e"], ["open"]),
    ("osl-3.0", ["OSL-3.0"], ["open software licen[sc]e"], ["open"]),
    ("afl-3.0", ["AFL-3.0"], ["academic free licen[sc]e"], ["academic"]),
    ("psf-2.0", ["PSF-2.0", "Python-2.0"], ["python software foundation licen[sc]e"], ["python"]),
    ("php-3.01", ["PHP-3.01"], ["php licen[sc]e"], ["php"]),
    ("ruby", ["Ruby"], ["ruby licen[sc]e"], ["ruby"]),
    ("x11", ["X11"], ["x11 licen[sc]e"], ["x11"]),
    ("ncsa", ["NCSA"], ["university of illinois ncsa open source licen[sc]e"], ["university"]),
    ("ms-pl", ["MS-PL"], ["microsoft public licen[sc]e"], ["microsoft"]),
    ("ms-rl", ["MS-RL"], ["microsoft reciprocal licen[sc]e"], ["microsoft"]),
    ("proprietary", [], ["all rights reserved", "proprietary licen[sc]e"], ["all", "proprietary"]),
]
#: Phrases whose places are counted, as words, and their labels.
BASE = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
NOTICE_WORDS = ["licensed", "licenced", "released", "distributed", "available", "provided", "published", "covered"]
BASE_SCORE = 0.6
#: Sentences of licenses, notices and headers. Label, priority, score, pattern over words joined by blanks; a
#: pattern begins with a plain word.
SIGNATURES = [
    ("mit", 1, 0.95, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, 0.85, "copies or substantial portions of the software"),
    ("mit", 2, 0.9, "sublicense and or sell copies of the software"),
    ("mit", 2, 0.8, "deal in the software without restriction including without limitation the rights"),
    ("mit-0", 1, 0.9, "mit no attribution"),
    ("x11", 1, 0.9, "except as contained in this notice the name of the x consortium"),
    ("isc", 1, 0.95, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 1, 0.9, "fee is hereby granted the software is provided as is and the author disclaims"),
    ("hpnd", 1, 0.9, "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation"),
    ("hpnd", 2, 0.8, "permission notice appear in supporting documentation"),
    ("ntp", 1, 0.9, "makes no representations about the suitability (?:of )?this software for any purpose"),
    ("bsd", 1, 0.9, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, 0.85, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 2, 0.85, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 1, 0.9, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-3-clause", 1, 0.9, "nor the names of its contributors may be used"),
    ("bsd-4-clause", 1, 0.9, "advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause", 1, 0.85, "bsd style license that can be found in the license file"),
    ("bsd-3-clause-clear", 1, 0.9, "no express or implied licenses to any party s patent rights are granted"),
    ("bsd-2-clause-patent", 1, 0.9, "bsd 2 clause plus patent"),
    ("bsd-protection", 1, 0.85, "bsd protection licen[sc]e"),
    ("apache-2.0", 1, 0.95, "licensed under the apache license version 2 0(?: the license)?"),
    ("apache-2.0", 2, 0.9, "you may not use this file except in compliance with the license"),
    ("apache-2.0", 1, 0.95, "www apache org licenses license 2 0"),
    ("apache-2.0", 2, 0.85, "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2.0", 2, 0.85, "grant of patent license subject to the terms and conditions of this license"),
    ("apache-2.0", 2, 0.85, "grant of copyright license subject to the terms and conditions of this license"),
    ("apache-2.0", 2, 0.8, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 1, 0.9, "includes software developed by the apache software foundation"),
    ("apache-1.0", 1, 0.9, "software developed by the apache group"),
    ("ecl-2.0", 1, 0.9, "educational community license version 2 0"),
    ("gpl-2.0", 1, 0.95, "under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2"),
    ("gpl-3.0", 1, 0.95, "under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3"),
    ("gpl-2.0", 1, 0.95, "under the terms of the gnu general public licen[sc]e as published by the free software foundation version 2"),
    ("gpl-3.0", 1, 0.95, "under the terms of the gnu general public licen[sc]e as published by the free software foundation version 3"),
    ("gpl", 2, 0.85, "received a copy of the gnu general public licen[sc]e along with"),
    ("gpl", 2, 0.8, "see the gnu general public licen[sc]e for more details"),
    ("gpl-2.0", 2, 0.9, "gnu general public license version 2 june 1991"),
    ("gpl-3.0", 2, 0.9, "gnu general public license version 3 29 june 2007"),
    ("gpl-1.0", 2, 0.9, "gnu general public license version 1 february 1989"),
    ("gpl", 2, 0.85, "free copyleft license for software and other kinds of works"),
    ("gpl", 2, 0.8, "freedom to share and change"),
    ("gpl-classpath", 1, 0.9, "linking this library statically or dynamically with other modules"),
    ("gpl-classpath", 1, 0.9, "classpath exception(?: to the gpl)?"),
    ("gpl-font", 1, 0.9, "font exception"),
    ("gcc-exception", 1, 0.9, "gcc runtime library exception"),
    ("autoconf-exception", 1, 0.9, "autoconf configure script exception"),
    ("lgpl-2.1", 1, 0.95, "under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", 1, 0.95, "under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3"),
    ("lgpl-2.0", 1, 0.95, "under the terms of the gnu library general public licen[sc]e as published by the free software foundation"),
    ("lgpl", 2, 0.85, "received a copy of the gnu lesser general public licen[sc]e along with"),
    ("lgpl-2.1", 2, 0.9, "gnu lesser general public license version 2 1 february 1999"),
    ("agpl-3.0", 1, 0.95, "under the terms of the gnu affero general public licen[sc]e as published by"),
    ("agpl-3.0", 2, 0.85, "received a copy of the gnu affero general public licen[sc]e along with"),
    ("agpl-3.0", 2, 0.85, "users interacting with it remotely through a computer network"),
    ("gfdl", 1, 0.9, "gnu free documentation licen[sc]e"),
    ("gfdl", 2, 0.85, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 1, 0.95, "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 2, 0.9, "copy of the mpl was not distributed with this file"),
    ("mpl-2.0", 1, 0.9, "mozilla org mpl 2 0"),
    ("mpl-1.1", 1, 0.95, "subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 2, 0.9, "incompatible with secondary licenses as defined by the mozilla public license"),
    ("npl-1.1", 1, 0.9, "netscape public licen[sc]e(?: version)?(?: 1 1)?"),
    ("epl-1.0", 1, 0.95, "eclipse public license v1 0"),
    ("epl-2.0", 1, 0.95, "eclipse public license 2 0 which is available at"),
    ("epl-1.0", 1, 0.9, "www eclipse org legal epl v10"),
    ("edl-1.0", 1, 0.9, "eclipse distribution licen[sc]e(?:(?: v ?| )1 0)?"),
    ("cddl-1.0", 2, 0.9, "common development and distribution license cddl version 1 0"),
    ("cddl-1.1", 1, 0.9, "cddl 1 1"),
    ("cpal-1.0", 1, 0.9, "common public attribution licen[sc]e"),
    ("ipl-1.0", 1, 0.9, "ibm public licen[sc]e"),
    ("apsl-2.0", 1, 0.9, "apple public source licen[sc]e"),
    ("eupl-1.2", 1, 0.95, "licensed under the eupl(?: version)?(?: v ?| )1 2"),
    ("eupl-1.1", 1, 0.95, "licensed under the eupl(?: version)?(?: v ?| )1 1"),
    ("cecill-b", 1, 0.9, "cecill b(?: free software)?(?: licen[sc]e)?"),
    ("cecill-c", 1, 0.9, "cecill c(?: free software)?(?: licen[sc]e)?"),
    ("zlib", 1, 0.95, "use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", 2, 0.85, "altered source versions must be plainly marked as such"),
    ("zlib", 2, 0.85, "origin of this software must not be misrepresented"),
    ("bsl-1.0", 1, 0.95, "boost software license version 1 0"),
    ("bsl-1.0", 2, 0.9, "person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", 1, 0.95, "free and unencumbered software released into the public domain"),
    ("unlicense", 2, 0.85, "free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", 1, 0.95, "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", 1, 0.9, "cc0 1 0 universal"),
    ("cc0-1.0", 2, 0.85, "waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", 1, 0.95, "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 1, 0.95, "creativecommons org licenses by 3 0"),
    ("cc-by-2.0", 1, 0.95, "creativecommons org licenses by 2 [05]"),
    ("cc-by-sa-4.0", 1, 0.95, "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 1, 0.95, "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", 1, 0.95, "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", 1, 0.95, "creativecommons org licenses by nc sa [34] 0"),
    ("cc-by-nc-nd-4.0", 1, 0.95, "creativecommons org licenses by nc nd [34] 0"),
    ("cc-by-nd-4.0", 1, 0.95, "creativecommons org licenses by nd [34] 0"),
    ("public-domain", 1, 0.9, "dedicated to the public domain"),
    ("public-domain", 1, 0.9, "placed in the public domain"),
    ("public-domain", 2, 0.85, "public domain mark 1 0"),
    ("pddl-1.0", 1, 0.9, "public domain dedication and licen[sc]e"),
    ("odc-by-1.0", 1, 0.9, "open data commons attribution licen[sc]e"),
    ("odbl-1.0", 1, 0.9, "open data commons open database licen[sc]e"),
    ("ogl-uk-3.0", 1, 0.9, "open government licen[sc]e(?: v ?| )3 0"),
    ("ogl", 2, 0.85, "open government licen[sc]e"),
    ("cdla-permissive", 1, 0.9, "community data license agreement permissive"),
    ("cdla-sharing", 1, 0.9, "community data license agreement sharing"),
    ("ofl-1.1", 1, 0.95, "sil open font license version 1 1"),
    ("ofl-1.1", 2, 0.85, "with reserved font name"),
    ("artistic-1.0", 1, 0.9, "same terms as perl(?: 5)?(?: itself)?"),
    ("artistic-2.0", 2, 0.85, "copyright holder of the package"),
    ("beerware", 1, 0.9, "beer ware licen[sc]e"),
    ("beerware", 1, 0.9, "buy me a beer in return"),
    ("json", 1, 0.95, "software shall be used for good not evil"),
    ("vim", 1, 0.9, "vim licen[sc]e"),
    ("openssl", 1, 0.9, "developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 2, 0.85, "openssl licen[sc]e"),
    ("ssleay", 1, 0.9, "cryptographic software written by eric young"),
    ("curl", 2, 0.85, "curl licen[sc]e"),
    ("icu", 1, 0.9, "unicode inc license agreement data files and software"),
    ("unicode-3.0", 2, 0.9, "unicode license v3"),
    ("psf-2.0", 1, 0.9, "psf license agreement for python"),
    ("postgresql", 1, 0.9, "postgresql licen[sc]e"),
    ("postgresql", 2, 0.85, "without fee and without a written agreement is hereby granted"),
    ("w3c", 1, 0.9, "w3c software notice and licen[sc]e"),
    ("zpl-2.1", 1, 0.9, "zope public licen[sc]e(?: zpl)?(?: version)?(?: 2 1)?"),
    ("qpl-1.0", 1, 0.9, "q public licen[sc]e"),
    ("ms-lpl", 1, 0.9, "microsoft limited public licen[sc]e"),
    ("mulan-psl-2.0", 1, 0.95, "mulan psl ?v?2"),
    ("mulan-psl-1.0", 2, 0.9, "mulan permissive software licen[sc]e"),
    ("blueoak-1.0.0", 1, 0.9, "blue oak model licen[sc]e"),
    ("upl-1.0", 1, 0.9, "universal permissive licen[sc]e"),
    ("polyform-noncommercial", 1, 0.9, "polyform noncommercial licen[sc]e"),
    ("polyform-shield", 1, 0.9, "polyform shield licen[sc]e"),
    ("commons-clause", 1, 0.9, "commons clause(?: license condition)?(?: v1 0)?"),
    ("busl-1.1", 1, 0.95, "change license (?:gpl|apache|mpl)"),
    ("elastic-2.0", 2, 0.9, "provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", 2, 0.85, "making the functionality of the program or modified version available to third parties as a service"),
    ("openrail", 1, 0.9, "openrail(?: m| s)?(?: licen[sc]e)?"),
    ("llama", 1, 0.9, "llama 2 community license agreement"),
    ("llama", 1, 0.9, "llama 3 community license agreement"),
    ("gemma", 1, 0.85, "gemma terms of use"),
    ("bigscience-rail", 1, 0.9, "bigscience (?:bloom )?rail licen[sc]e"),
    ("dual", 3, 0.7, "dual licensed under"),
    ("dual", 3, 0.7, "any later version at your option"),
    ("warranty", 4, 0.6, "provided as is without warranty of any kind"),
    ("warranty", 4, 0.6, "without even the implied warranty of merchantability"),
    ("warranty", 4, 0.6, "implied warranties of merchantability and fitness for a particular purpose"),
    ("warranty", 4, 0.55, "be liable for any (?:claim damages or other liability|direct indirect incidental special)"),
    ("proprietary", 1, 0.9, "confidential and proprietary"),
    ("proprietary", 1, 0.9, "unpublished proprietary (?:trade secret|source code)"),
    ("proprietary", 2, 0.85, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 2, 0.85, "end user licen[sc]e agreement"),
    ("proprietary", 2, 0.8, "not for redistribution"),
    ("proprietary", 2, 0.8, "internal use only"),
    ("proprietary", 2, 0.8, "reproduced or transmitted in any form without prior written"),
    ("non-commercial", 2, 0.8, "non commercial use only"),
    ("non-commercial", 2, 0.8, "research purposes only"),
]


def words_at_most(pattern: str) -> int:
    """The most words that a pattern over words joined by blanks can cover: blanks of its longest alternative, plus one."""
    open_groups, k = [[0]], 0
    while k < len(pattern):
        if pattern.startswith("(?:", k):
            open_groups.append([0])
            k += 2
        elif pattern[k] == "|":
            open_groups[-1].append(0)
        elif pattern[k] == ")":
            inner = max(open_groups.pop())
            open_groups[-1][-1] += inner
        elif pattern[k] == " ":
            open_groups[-1][-1] += 1
        k += 1
    return max(open_groups[0]) + 1


def rules() -> list[tuple[int, float, str, str, list[str]]]:
    """(priority, score, label, pattern over words joined by blanks, first words) of every rule, in order."""
    out = [(priority, score, label, pattern, [pattern.split(" ")[0].split("(")[0]]) for label, priority, score, pattern in SIGNATURES]
    spdx_words = lambda i: " ".join(re.split("[^0-9a-z]+", i.lower()))
    for label, ids, names, firsts in FAMILIES:
        name = "(?:" + "|".join(names) + ")"
        for i in sorted(ids, key=len, reverse=True):
            out.append((0, 1.0, label, f"spdx license identifier {spdx_words(i)}", ["spdx"]))
            out.append((1, 0.9, label, f"spdx org licenses {spdx_words(i)}", ["spdx"]))
        out.append((1, 0.95, label, f"(?:{'|'.join(NOTICE_WORDS)}) under (?:an? |the )?(?:terms (?:and conditions )?of (?:an? |the )?)?{name}", NOTICE_WORDS))
        out.append((3, 0.8, label, name, firsts))
    return out


def width() -> int:
    """Words that the longest rule may cover."""
    return max(words_at_most(pattern) for _, _, _, pattern, _ in rules())


_DELIMITERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
DELIMITER = "[" + "".join(f"\\x{ord(c):02X}" for c in _DELIMITERS) + "]+"


def keywords(pattern: str, firsts: list[str]) -> list[str]:
    """Words of which whatever matches the pattern holds one: a long word that the pattern always has, or else its first words."""
    flat = pattern
    while "(" in flat:
        flat = re.sub(r"\(\?:( ?)[^()]*?( ?)\)\??", r"\1~\2", flat)
    flat = flat.replace(" ?", "~")
    plain = [w for w in flat.split(" ") if re.fullmatch("[0-9a-z]+|licen\\[sc\\]e", w)]
    if any(w.startswith("licen") for w in plain):
        return ["license", "licence"] if "licen[sc]e" in plain else [next(w for w in plain if w.startswith("licen"))]
    longest = max(plain, key=len, default="")
    return [longest] if len(longest) >= 5 else firsts


def gate() -> list[str]:
    """Words of which a text must hold one for the scan to look at it: every rule has such, as have the base phrases."""
    found = {w for phrase, _ in BASE for w in phrase if w == "license"}
    for _, _, names, firsts in FAMILIES:
        for name in names:
            found |= set(keywords(name, firsts))
    for *_, pattern in SIGNATURES:
        found |= set(keywords(pattern, [pattern.split(" ")[0].split("(")[0]]))
    return sorted(found | {"spdx"})


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, DELIMITER), "")


def _detection(first: str, window: str, at: str) -> str:
    """SQL for the best detection that starts at a word: (start, end, priority, label, score), or null.

    Options are structs that sort by priority, then by length, then by the rules' order."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for order, (priority, score, label, pattern, firsts) in enumerate(rules()):
        whole = f"'^{pattern}(?= |$)'"
        size = f"size(split(regexp_extract({window}, {whole}, 0), ' '))"
        found = f"named_struct('priority', {priority}, 'shorter', -{size}, 'order', {order}, 'end', {at} + {size}, 'label', '{label}', 'score', {score}D)"
        groups.setdefault(tuple(firsts), []).append(f"if({window} rlike {whole}, {found}, null)")
    named = lambda words: ", ".join(f"'{w}'" for w in words)
    found = ", ".join(f"if({first} in ({named(firsts)}), array_min(array({', '.join(options)})), null)" for firsts, options in groups.items())
    taken = "named_struct('start', {at}, 'end', d.end, 'priority', d.priority, 'label', d.label, 'score', d.score)".format(at=at)
    return f"transform(array(array_min(array({found}))), d -> if(d is null, null, {taken}))[0]"


def _detections(words: str) -> str:
    """SQL for the detections in an array of words that no better one contains.

    One starts at a word at most, and each covers as many words as the longest rule at most, so those that could contain it stand within
    that many places of it in the list."""
    most = width()
    anchors = ", ".join(f"'{w}'" for w in sorted({w for *_, firsts in rules() for w in firsts}))
    starts = f"filter(transform({words}, (w, i) -> named_struct('w', w, 'i', i)), a -> a.w in ({anchors}))"
    window = f"array_join(slice({words}, a.i + 1, {most}), ' ')"
    found = f"transform({starts}, a -> transform(array({window}), window -> {_detection('a.w', 'window', 'a.i')})[0])"
    near = f"slice(every, greatest(k + 1 - {most}, 1), {2 * most + 1})"
    better = "e.priority < d.priority or (e.priority = d.priority and e.end - e.start > d.end - d.start)"
    kept = f"filter(every, (d, k) -> not exists({near}, e -> e.start <= d.start and e.end >= d.end and ({better})))"
    return f"transform(array(filter({found}, d -> d is not null)), every -> {kept})[0]"


def _base_places(words: Column) -> Column:
    """(start, label) of every place where a base phrase stands."""
    def at(end: Column) -> Column:
        out = F.lit(None).cast("struct<start: bigint, label: string>")
        for phrase, label in BASE:
            start = end - (len(phrase) - 1)
            match = F.lit(True)
            for k, w in enumerate(phrase[:-1]):
                match = match & (F.get(words, start + k) == w)
            out = F.when(match, F.struct(start.cast("long").alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    ends = F.filter(F.transform(words, lambda w, i: F.when(w == BASE[0][0][-1], i)), lambda i: i.isNotNull())
    return F.filter(F.transform(ends, at), lambda p: p.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """docs plus n_words, n_base, first_word, last_word, base_labels, labels, score and detections (start, end in words, label, score).

    Whole texts are scanned, however long. Null and empty texts have no words; a text without detections has empty labels, null first and last words and score 0. Repeated rows
    are scanned alike. Columns of docs by the added names are replaced. score is the best kept rule's, 0.6 at least where a base phrase stands.
    """
    docs, own = set_aside(docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"), "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    # Lower case as Spark has it touches more letters than A-Z, but parts words alike; it serves the count and the gate only.
    known = F.array(*map(F.lit, gate()))
    seen = F.transform(F.array(_words(F.lower(text))), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.arrays_overlap(w, known).alias("hit")))[0]
    docs_words = docs.withColumn("_seen", seen).withColumn("_words", F.when(F.col("_seen.hit"), _words(lower)))
    out = docs_words.withColumn("_scan", F.struct(_base_places(F.col("_words")).alias("base"), F.expr(_detections("_words")).alias("detections")))
    none = F.expr("cast(array() as array<struct<start: bigint, label: string>>)")
    base, detections = F.coalesce("_scan.base", none), F.col("_scan.detections")
    starts, base_labels = F.transform(base, lambda p: p["start"]), F.array_distinct(F.transform(base, lambda p: p["label"]))
    labels = F.array_union(base_labels, F.coalesce(F.transform(detections, lambda d: d["label"]), F.array().cast("array<string>")))
    return out.select(
        *own,
        F.col("_seen.n").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(detections, lambda d: d["score"])), F.lit(0.0)), F.when(F.size(base) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
        detections.alias("detections"),
    )
