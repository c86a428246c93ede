"""The signature rules of the license scan: (label, level, keyword, pattern), in order of rank within a level.

A pattern is a regular expression over lower-cased words with one space between
them (``v2.0`` is the words ``v2`` and ``0``); it must begin and end with whole
words, and a space in it always stands between two words.  The keyword is in
every text that the pattern matches; with spaces around it, as a whole word.  Levels: 4 an identifier, 3 a name with its
version or a formal grant, 2 a name alone, 1 a passage of a license's text.
"""

RULES = (
    # MIT and kin
    ("mit", 4, "spdx", r"spdx license identifier mit"),
    ("mit-0", 4, "spdx", r"spdx license identifier mit 0"),
    ("mit", 3, "licen", r"(?:released|licensed|distributed|available|provided|published|covered|offered) (?:under|by) (?:the )?(?:terms of (?:the )?)?mit(?: x11| expat)? licen[cs]e"),
    ("mit", 3, "licen", r"(?:under|subject to) the (?:terms|conditions) of the mit licen[cs]e"),
    ("mit", 3, "opensource", r"opensource org licenses? mit(?: license)?(?: php| html)?"),
    ("mit", 3, "choosealicense", r"choosealicense com licenses mit"),
    ("mit", 3, "dual", r"dual licensed under (?:the )?mit and \S+"),
    ("mit", 3, "licen", r"licensed under mit"),
    ("mit-0", 3, "attribution", r"mit no attribution(?: license)?"),
    ("mit", 2, "licen", r"mit(?: x11| expat| style)? licen[cs]ed?"),
    ("mit", 2, "licen", r"licen[cs]e(?: is)? mit"),
    ("mit", 2, "expat", r"expat licen[cs]e"),
    ("x11", 2, "x11", r"x11 licen[cs]e"),
    ("mit", 1, "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?"),
    ("mit", 1, "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 1, "noninfringement", r"the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", 1, "tort", r"whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    # Apache
    ("apache-2.0", 4, "spdx", r"spdx license identifier apache 2 0"),
    ("apache-1.1", 4, "spdx", r"spdx license identifier apache 1 1"),
    ("apache-2.0", 3, "apache", r"licensed under (?:the )?apache(?: software)?(?: licen[cs]e)?(?: version)? v?2(?: 0)?"),
    ("apache-2.0", 3, "apache", r"apache(?: software)? licen[cs]e(?: version)? v?2(?: 0)?"),
    ("apache-1.1", 3, "apache", r"apache(?: software)? licen[cs]e(?: version)? v?1 1"),
    ("apache-1.0", 3, "apache", r"apache(?: software)? licen[cs]e(?: version)? v?1 0"),
    ("apache-2.0", 3, "apache", r"apache org licenses(?: license)? 2 0(?: html| txt)?"),
    ("apache-2.0", 3, "opensource", r"opensource org licenses? apache 2 0"),
    ("apache-2.0", 3, " asl ", r"asl v?2(?: 0)?"),
    ("apache-2.0", 2, "apache", r"apache v?2 0"),
    ("apache", 2, "apache", r"apache(?: software)? licen[cs]ed?"),
    ("apache", 2, "apache", r"licensed under (?:the )?apache"),
    ("apache-2.0", 1, "applicable", r"unless required by applicable law or agreed to in writing(?: software)?"),
    ("apache-2.0", 1, "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-2.0", 1, "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 1, "governing", r"see the license for the specific language governing permissions and limitations under the license"),
    # GPL
    ("gpl-3.0-or-later", 4, "spdx", r"spdx license identifier gpl 3 0 or later"),
    ("gpl-3.0-only", 4, "spdx", r"spdx license identifier gpl 3 0(?: only)?"),
    ("gpl-2.0-or-later", 4, "spdx", r"spdx license identifier gpl 2 0 or later"),
    ("gpl-2.0-only", 4, "spdx", r"spdx license identifier gpl 2 0(?: only)?"),
    ("gpl-1.0-or-later", 4, "spdx", r"spdx license identifier gpl 1 0(?: or later)?"),
    ("gpl-3.0-or-later", 3, "general", r"general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version )?v?3(?: 0)?(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-2.0-or-later", 3, "general", r"general public licen[cs]e(?: as published by the free software foundation)?(?: either)? (?:version )?v?2(?: 0)?(?: of the license)? or (?:at your option )?any later version"),
    ("gpl-3.0", 3, "general", r"(?:gnu )?general public licen[cs]e (?:version )?v?3(?: 0)?"),
    ("gpl-2.0", 3, "general", r"(?:gnu )?general public licen[cs]e (?:version )?v?2(?: 0)?"),
    ("gpl-1.0", 3, "general", r"(?:gnu )?general public licen[cs]e (?:version )?v?1(?: 0)?"),
    ("gpl-3.0", 3, "general", r"version 3 of the gnu general public licen[cs]e"),
    ("gpl-2.0", 3, "general", r"version 2 of the gnu general public licen[cs]e"),
    ("gpl-3.0", 3, "gpl", r"(?:gnu )?gpl (?:version )?v?3(?: 0)?"),
    ("gpl-2.0", 3, "gpl", r"(?:gnu )?gpl (?:version )?v?2(?: 0)?"),
    ("gpl-3.0", 3, "gplv3", r"gplv3"),
    ("gpl-2.0", 3, "gplv2", r"gplv2"),
    ("gpl-3.0", 3, "opensource", r"opensource org licenses? gpl 3 0(?: html)?"),
    ("gpl-2.0", 3, "opensource", r"opensource org licenses? gpl 2 0(?: php)?"),
    ("gpl", 3, " gnu ", r"gnu org (?:licenses|copyleft) gpl(?: \d+ 0)?(?: html| txt)?"),
    ("gpl", 2, "general", r"(?:gnu )?general public licen[cs]e"),
    ("gpl", 2, " gnu ", r"gnu gpl"),
    ("gpl", 2, "gpl", r"gpl licen[cs]ed?"),
    ("gpl", 2, "gpl", r"(?:licensed|released|distributed|available) under (?:the )?gpl"),
    ("gpl", 1, "redistribute", r"(?:you can|you may) redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 1, "foundation", r"write to the free software foundation inc (?:51|59) (?:franklin street|temple place)(?: \S+){0,4} (?:boston|ma)"),
    ("gpl", 1, "general", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 1, "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("classpath-exception", 3, "classpath", r"(?:gpl|gnu general public license)(?: \S+){0,4} with (?:the )?classpath exception"),
    ("linking-exception", 2, "linking", r"(?:runtime|library|linking) linking exception"),
    # LGPL, AGPL, GFDL
    ("lgpl-3.0-or-later", 4, "spdx", r"spdx license identifier lgpl 3 0 or later"),
    ("lgpl-3.0-only", 4, "spdx", r"spdx license identifier lgpl 3 0(?: only)?"),
    ("lgpl-2.1-or-later", 4, "spdx", r"spdx license identifier lgpl 2 1 or later"),
    ("lgpl-2.1-only", 4, "spdx", r"spdx license identifier lgpl 2 1(?: only)?"),
    ("lgpl-2.0", 4, "spdx", r"spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("agpl-3.0", 4, "spdx", r"spdx license identifier agpl 3 0(?: only| or later)?"),
    ("gfdl", 4, "spdx", r"spdx license identifier gfdl 1 \d(?: only| or later)?"),
    ("lgpl-3.0", 3, "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version )?v?3(?: 0)?"),
    ("lgpl-2.1", 3, "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version )?v?2 1"),
    ("lgpl-2.0", 3, "general", r"(?:gnu )?library general public licen[cs]e(?: version)?(?: v?2(?: 0)?)?"),
    ("agpl-3.0", 3, "affero", r"(?:gnu )?affero general public licen[cs]e (?:version )?v?3(?: 0)?"),
    ("lgpl-3.0", 3, "lgpl", r"(?:gnu )?lgpl (?:version )?v?3(?: 0)?"),
    ("lgpl-2.1", 3, "lgpl", r"(?:gnu )?lgpl (?:version )?v?2 1"),
    ("lgpl-3.0", 3, "lgplv3", r"lgplv3"),
    ("agpl-3.0", 3, "agpl", r"(?:gnu )?agpl (?:version )?v?3(?: 0)?"),
    ("agpl-3.0", 3, "agplv3", r"agplv3"),
    ("gfdl", 3, "documentation", r"gnu free documentation licen[cs]e(?: version)?(?: v?1 \d)?"),
    ("lgpl", 2, "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl", 2, "lgpl", r"(?:gnu )?lgpl(?: licen[cs]ed?)?"),
    ("agpl", 2, "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl", 2, "agpl", r"(?:gnu )?agpl(?: licen[cs]ed?)?"),
    ("agpl", 1, "remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", 1, "invariant", r"with no invariant sections(?: with)? no front cover texts"),
    # BSD
    ("bsd-3-clause", 4, "spdx", r"spdx license identifier bsd 3 clause"),
    ("bsd-2-clause", 4, "spdx", r"spdx license identifier bsd 2 clause"),
    ("bsd-4-clause", 4, "spdx", r"spdx license identifier bsd 4 clause"),
    ("0bsd", 4, "spdx", r"spdx license identifier 0bsd"),
    ("bsd-3-clause", 3, "bsd", r"(?:3|three) clause bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", 3, "bsd", r"(?:new|revised|modified) bsd licen[cs]e"),
    ("bsd-3-clause", 3, "bsd", r"bsd (?:3|three) clause(?: licen[cs]e)?"),
    ("bsd-2-clause", 3, "bsd", r"(?:2|two) clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", 3, "bsd", r"(?:simplified|freebsd) bsd licen[cs]e"),
    ("bsd-2-clause", 3, "bsd", r"bsd (?:2|two) clause(?: licen[cs]e)?"),
    ("bsd-4-clause", 3, "bsd", r"(?:original|old|4 clause|four clause) bsd(?: licen[cs]e)?"),
    ("0bsd", 3, "bsd", r"(?:zero clause|0 clause) bsd(?: licen[cs]e)?"),
    ("bsd", 3, "bsd", r"(?:released|licensed|distributed|available|provided) under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: licen[cs]e)?"),
    ("bsd", 3, "opensource", r"opensource org licenses? bsd(?: license)?(?: \d clause)?(?: php)?"),
    ("bsd", 2, "bsd", r"bsd(?: style| type)? licen[cs]ed?"),
    ("bsd-3-clause", 1, "endorse", r"neither the names? of(?: the)?(?: \S+){1,8} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 1, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd", 1, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 1, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 1, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    # Creative Commons
    ("cc-by-nc-nd-4.0", 3, " cc ", r"cc by nc nd 4 0"),
    ("cc-by-nc-sa-4.0", 3, " cc ", r"cc by nc sa 4 0"),
    ("cc-by-nc-4.0", 3, " cc ", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", 3, " cc ", r"cc by nd 4 0"),
    ("cc-by-sa-4.0", 3, " cc ", r"cc by sa 4 0"),
    ("cc-by-4.0", 3, " cc ", r"cc by 4 0"),
    ("cc-by-nc-nd-3.0", 3, " cc ", r"cc by nc nd 3 0"),
    ("cc-by-nc-sa-3.0", 3, " cc ", r"cc by nc sa 3 0"),
    ("cc-by-nc-3.0", 3, " cc ", r"cc by nc 3 0"),
    ("cc-by-nd-3.0", 3, " cc ", r"cc by nd 3 0"),
    ("cc-by-sa-3.0", 3, " cc ", r"cc by sa 3 0"),
    ("cc-by-3.0", 3, " cc ", r"cc by 3 0"),
    ("cc-by-nc-nd", 3, "creativecommons", r"creativecommons org licenses by nc nd(?: \d \d)?"),
    ("cc-by-nc-sa", 3, "creativecommons", r"creativecommons org licenses by nc sa(?: \d \d)?"),
    ("cc-by-nc", 3, "creativecommons", r"creativecommons org licenses by nc(?: \d \d)?"),
    ("cc-by-nd", 3, "creativecommons", r"creativecommons org licenses by nd(?: \d \d)?"),
    ("cc-by-sa", 3, "creativecommons", r"creativecommons org licenses by sa(?: \d \d)?"),
    ("cc-by", 3, "creativecommons", r"creativecommons org licenses by(?: \d \d)?"),
    ("cc0-1.0", 3, "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc0-1.0", 3, "cc0", r"cc0 1 0(?: universal)?"),
    ("cc-by-nc-nd", 3, "commercial", r"(?:creative commons )?attribution non ?commercial no ?derivatives?(?: works)?(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", 3, "commercial", r"(?:creative commons )?attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc", 3, "commercial", r"(?:creative commons )?attribution non ?commercial(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-sa", 3, "alike", r"creative commons attribution share ?alike(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nd", 3, "derivative", r"creative commons attribution no ?derivatives?(?: works)?(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by", 3, "commons", r"creative commons attribution(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc-nd", 2, " cc ", r"cc by nc nd"),
    ("cc-by-nc-sa", 2, " cc ", r"cc by nc sa"),
    ("cc-by-nc", 2, " cc ", r"cc by nc"),
    ("cc-by-nd", 2, " cc ", r"cc by nd"),
    ("cc-by-sa", 2, " cc ", r"cc by sa"),
    ("cc-by", 2, " cc ", r"(?:under|licen[cs]ed?|licen[cs]ed under) (?:the )?cc by"),
    ("cc0-1.0", 2, "cc0", r"cc0(?: licen[cs]e| public domain dedication| waiver)?"),
    ("creative-commons", 2, "commons", r"creative commons(?: public)? licen[cs]e"),
    ("creative-commons", 1, "commons", r"(?:under|by) (?:a |the )?creative commons"),
    # Mozilla, Eclipse and other reciprocal licenses
    ("mpl-2.0", 4, "spdx", r"spdx license identifier mpl 2 0"),
    ("mpl-1.1", 4, "spdx", r"spdx license identifier mpl 1 1"),
    ("epl-2.0", 4, "spdx", r"spdx license identifier epl 2 0"),
    ("epl-1.0", 4, "spdx", r"spdx license identifier epl 1 0"),
    ("eupl-1.2", 4, "spdx", r"spdx license identifier eupl 1 2"),
    ("cddl-1.0", 4, "spdx", r"spdx license identifier cddl 1 0"),
    ("mpl-2.0", 3, "mozilla", r"mozilla public licen[cs]e(?: version)? v? ?2(?: 0)?"),
    ("mpl-1.1", 3, "mozilla", r"mozilla public licen[cs]e(?: version)? v? ?1 1"),
    ("mpl-2.0", 3, "mozilla", r"mozilla org mpl 2 0"),
    ("mpl-2.0", 3, "mpl", r"mpl (?:version )?v?2(?: 0)?"),
    ("epl-2.0", 3, "eclipse", r"eclipse public licen[cs]e(?: version)? (?:v )?v?2(?: 0)?"),
    ("epl-1.0", 3, "eclipse", r"eclipse public licen[cs]e(?: version)? (?:v )?v?1(?: 0)?"),
    ("edl-1.0", 3, "eclipse", r"eclipse distribution licen[cs]e(?: version)?(?: (?:v )?v?1(?: 0)?)?"),
    ("eupl", 3, "european", r"european union public licen[cs]e(?: version)?(?: v? ?1 \d)?"),
    ("cddl", 3, "development", r"common development and distribution licen[cs]e(?: version)?(?: v?1 \d)?"),
    ("cpl-1.0", 3, "licen", r"common public licen[cs]e(?: version)?(?: v?1 0)?"),
    ("ipl-1.0", 3, "licen", r"ibm public licen[cs]e(?: version)?(?: v?1 0)?"),
    ("osl", 3, "licen", r"open software licen[cs]e(?: version)?(?: v?\d \d)?"),
    ("apsl", 3, "licen", r"apple public source licen[cs]e(?: version)?(?: v?\d \d)?"),
    ("qpl", 3, "licen", r"q public licen[cs]e(?: version)?(?: v?1 0)?"),
    ("cecill", 3, "cecill", r"cecill(?: [bc])?(?: free software)?(?: licen[cs]e)?(?: agreement)?"),
    ("ms-pl", 3, "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", 3, "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("rpl", 3, "reciprocal", r"reciprocal public licen[cs]e(?: 1 \d)?"),
    ("sleepycat", 3, "sleepycat", r"sleepycat(?: public)? licen[cs]e"),
    ("mpl", 2, "mozilla", r"mozilla public licen[cs]e"),
    ("epl", 2, "eclipse", r"eclipse public licen[cs]e"),
    ("cddl", 2, "cddl", r"cddl(?: licen[cs]e)?"),
    ("eupl", 2, "eupl", r"eupl(?: licen[cs]e)?"),
    ("mpl-2.0", 1, "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl", 1, "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    # permissive licenses with a name
    ("isc", 4, "spdx", r"spdx license identifier isc"),
    ("zlib", 4, "spdx", r"spdx license identifier zlib"),
    ("bsl-1.0", 4, "spdx", r"spdx license identifier bsl 1 0"),
    ("unlicense", 4, "spdx", r"spdx license identifier unlicense"),
    ("cc0-1.0", 4, "spdx", r"spdx license identifier cc0 1 0"),
    ("psf-2.0", 4, "spdx", r"spdx license identifier (?:psf|python) 2 0"),
    ("ofl-1.1", 4, "spdx", r"spdx license identifier ofl 1 1"),
    ("isc", 3, " isc ", r"(?:the )?isc licen[cs]e"),
    ("zlib", 3, "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", 3, "libpng", r"libpng licen[cs]e"),
    ("bsl-1.0", 3, "boost", r"boost software licen[cs]e(?: version)?(?: v?1 0)?"),
    ("bsl-1.0", 3, "boost", r"boost org license 1 0(?: txt)?"),
    ("unlicense", 3, "unlicense", r"(?:the )?unlicense(?: org)?"),
    ("wtfpl", 3, "fuck", r"do what the fuck you want to public licen[cs]e(?: version 2)?"),
    ("wtfpl", 3, "wtfpl", r"wtfpl(?: licen[cs]e)?"),
    ("artistic-2.0", 3, "artistic", r"artistic licen[cs]e(?: version)? v?2(?: 0)?"),
    ("artistic", 2, "artistic", r"artistic licen[cs]e"),
    ("perl", 3, " perl ", r"(?:under )?the same terms as perl itself"),
    ("psf-2.0", 3, "python", r"python software foundation licen[cs]e(?: version)?(?: v?2(?: 0)?)?"),
    ("openssl", 3, "openssl", r"openssl licen[cs]e"),
    ("php-3.0", 3, "licen", r"php licen[cs]e(?: version)?(?: v?3 \d+)?"),
    ("ruby", 3, "licen", r"ruby(?: s)? licen[cs]e"),
    ("ofl-1.1", 3, "licen", r"sil open font licen[cs]e(?: version)?(?: v?1 1)?"),
    ("ofl-1.1", 2, "font", r"open font licen[cs]e"),
    ("postgresql", 3, "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", 3, "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("afl", 3, "licen", r"academic free licen[cs]e(?: version)?(?: v?\d \d)?"),
    ("w3c", 3, "licen", r"w3c software(?: and document)?(?: notice and)? licen[cs]e"),
    ("unicode", 3, "licen", r"unicode(?: inc)? licen[cs]e(?: agreement)?"),
    ("lppl", 3, "licen", r"latex project public licen[cs]e(?: version)?(?: v?1 \d)?"),
    ("zpl", 3, "licen", r"zope public licen[cs]e(?: version)?(?: v?\d \d)?"),
    ("tcl", 3, "licen", r"tcl(?: tk)? licen[cs]e"),
    ("vim", 3, "licen", r"vim licen[cs]e"),
    ("json", 3, "licen", r"json licen[cs]e"),
    ("curl", 3, "licen", r"curl licen[cs]e"),
    ("hpnd", 3, "disclaimer", r"historical permission notice and disclaimer"),
    ("blueoak-1.0.0", 3, "licen", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("upl-1.0", 3, "licen", r"universal permissive licen[cs]e(?: version)?(?: v?1 0)?"),
    ("mulan-psl", 3, "mulan", r"mulan(?: permissive software)? (?:psl|licen[cs]e)(?: v?\d)?"),
    ("beerware", 3, "beer", r"beer ?ware(?: licen[cs]e)?"),
    ("beerware", 1, "beer", r"you can buy me a beer in return"),
    ("json", 1, " evil ", r"the software shall be used for good not evil"),
    ("isc", 1, "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", 1, "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", 1, "encumbered", r"this is free and unencumbered software released into the public domain"),
    ("bsl-1.0", 1, "executable", r"in the form of machine executable object code generated by a source language processor"),
    # data, models and documents
    ("odbl-1.0", 3, "database", r"open (?:data commons )?(?:open )?database licen[cs]e(?: version)?(?: v?1 0)?"),
    ("odc-by-1.0", 3, "commons", r"open data commons attribution licen[cs]e(?: v?1 0)?"),
    ("pddl-1.0", 3, "dedication", r"open data commons public domain dedication(?: and)?(?: licen[cs]e)?"),
    ("odbl-1.0", 2, "odbl", r"odbl(?: v?1 0)?"),
    ("cdla-permissive", 3, "licen", r"community data licen[cs]e agreement permissive(?: (?:version )?\d 0)?"),
    ("cdla-sharing", 3, "licen", r"community data licen[cs]e agreement sharing(?: (?:version )?1 0)?"),
    ("ogl-uk", 3, "licen", r"open government licen[cs]e(?: version)?(?: v?\d(?: 0)?)?"),
    ("openrail", 3, "rail", r"(?:creative ml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?"),
    ("rail", 3, "responsible", r"responsible ai licen[cs]e"),
    ("llama-community", 3, "llama", r"llama(?: \d)?(?: \d)? community licen[cs]e(?: agreement)?"),
    ("opl-1.0", 3, "licen", r"open publication licen[cs]e(?: v?1 0)?"),
    ("fal-1.3", 3, "licen", r"free art licen[cs]e(?: 1 \d)?"),
    # source-available and commercial
    ("busl-1.1", 4, "spdx", r"spdx license identifier busl 1 1"),
    ("busl-1.1", 3, "licen", r"business source licen[cs]e(?: version)?(?: v?1 1)?"),
    ("sspl-1.0", 3, "licen", r"server side public licen[cs]e(?: version)?(?: v?1)?"),
    ("elastic-2.0", 3, "licen", r"elastic licen[cs]e(?: version)?(?: v?2(?: 0)?)?"),
    ("commons-clause", 3, "clause", r"commons clause(?: licen[cs]e)?(?: condition)?(?: v?1 0)?"),
    ("polyform", 3, "polyform", r"polyform (?:noncommercial|perimeter|shield|small business|strict|free trial)(?: licen[cs]e)?(?: 1 0 0)?"),
    ("eula", 3, "licen", r"end user licen[cs]e agreement"),
    ("proprietary", 3, "proprietary", r"proprietary licen[cs]e(?: agreement)?"),
    ("proprietary", 3, "commercial", r"commercial licen[cs]e(?: agreement)?"),
    ("proprietary", 3, "confidential", r"(?:proprietary and confidential|confidential and proprietary)(?: information)?"),
    ("proprietary", 2, "reserved", r"all rights reserved"),
    ("proprietary", 2, "written", r"(?:without|except with) the (?:prior )?(?:express )?(?:prior )?written (?:permission|consent) of"),
    ("non-commercial", 2, "commercial", r"(?:for|to) (?:personal )?(?:and )?non ?commercial (?:use|purposes)(?: only)?"),
    ("research-only", 2, "research", r"for (?:academic and )?research (?:use|purposes) only"),
    ("proprietary", 1, "reverse", r"(?:may|shall) not (?:copy modify |copy |modify )?reverse engineer"),
    ("proprietary", 1, "disassemble", r"(?:may|shall) not (?:copy modify |copy |modify )?(?:reverse engineer )?(?:decompile or )?disassemble"),
    # public domain, notices and hints without a license's name
    ("public-domain", 3, "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 3, "domain", r"public domain dedication"),
    ("public-domain", 2, "domain", r"(?:is|are) in the public domain"),
    ("copyleft", 2, "copyleft", r"copyleft(?: licen[cs]e)?"),
    ("copyright-notice", 2, "copyright", r"copyright (?:c )?(?:(?:19|20)\d\d )+(?:present )?(?:by )?\S+"),
    ("copyright-notice", 2, "copyright", r"copyright (?:by|of|held by) \S+"),
    ("spdx-other", 3, "spdx", r"spdx license identifier \S+"),
    ("license-reference", 1, "licen", r"see (?:the )?(?:file )?licen[cs]e(?: txt| md)?(?: file)? (?:for|in) \S+"),
    ("license-reference", 1, "licen", r"(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:an? |the )?\S+ licen[cs]e"),
    ("license-reference", 1, "licen", r"open source licen[cs]e"),
    ("license-reference", 1, "licen", r"licen[cs]e agreement"),
    ("warranty-disclaimer", 1, "warrant", r"without warranty of any kind(?: express(?:ed)? or implied)?"),
    ("warranty-disclaimer", 1, "warrant", r"without warranties or conditions of any kind(?: either express or implied)?"),
    ("warranty-disclaimer", 1, "warrant", r"without any warranty(?: without even the implied warranty of merchantability)?"),
    ("warranty-disclaimer", 1, "warrant", r"as is and any express or implied warranties"),
    ("liability-disclaimer", 1, "liable", r"in no event shall (?:the )?(?:\S+ ){1,10}be liable for any"),
)
