"""The licences that are looked for, and the rules made from them."""

from __future__ import annotations

import re
from typing import NamedTuple


class Licence(NamedTuple):
    label: str
    #: Short identifier (empty if another entry has it) and title as patterns over words in lower case, parted by single spaces.
    short: str
    title: str
    #: Words that every text matching the title contains.
    keyword: str
    #: Address as words, if the licence has one.
    address: str = ""


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: str


CC = "creative commons attribution"
VERSION = r"(?: licen[cs]e)?(?: version)?(?: v ?| )"
LICENCES = [
    Licence("mit", "mit", "mit licen[cs]e", "mit licen", "opensource org licenses mit"),
    Licence("mit-0", "mit 0", "mit no attribution", "mit no attribution", "opensource org license mit 0"),
    Licence("x11", "x11", "x11 licen[cs]e", "x11 licen", "spdx org licenses x11"),
    Licence("isc", "isc", "isc licen[cs]e", "isc licen", "opensource org licenses isc"),
    Licence("apache-1.0", "apache 1 0", "apache" + VERSION + "1 0", "apache", "apache org licenses license 1 0"),
    Licence("apache-1.1", "apache 1 1", "apache" + VERSION + "1 1", "apache", "apache org licenses license 1 1"),
    Licence("apache-2.0", "apache 2 0", "apache(?: software)?" + VERSION + "2(?: 0)?", "apache", "apache org licenses license 2 0"),
    Licence("apache", "", "apache(?: software)? licen[cs]e", "apache"),
    Licence("bsd-2-clause", "bsd 2 clause", "(?:simplified bsd|bsd 2 clause|2 clause bsd) licen[cs]e", "bsd", "opensource org licenses bsd 2 clause"),
    Licence("bsd-3-clause", "bsd 3 clause", "(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) licen[cs]e", "bsd", "opensource org licenses bsd 3 clause"),
    Licence("bsd-4-clause", "bsd 4 clause", "(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e", "bsd", "spdx org licenses bsd 4 clause"),
    Licence("0bsd", "0bsd", "(?:zero clause bsd|bsd zero clause) licen[cs]e", "zero clause", "opensource org licenses 0bsd"),
    Licence("bsd", "bsd", "bsd(?: style)? licen[cs]e", "bsd"),
    Licence("lgpl-2.0", "lgpl 2 0(?: only| or later)?", "(?:gnu )?library general public" + VERSION + "2(?: 0)?", "library general public", "gnu org licenses lgpl 2 0"),
    Licence("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "(?:gnu )?lesser general public" + VERSION + "2 1", "lesser general public", "gnu org licenses lgpl 2 1"),
    Licence("lgpl-3.0", "lgpl 3 0(?: only| or later)?", "(?:gnu )?lesser general public" + VERSION + "3(?: 0)?", "lesser general public", "gnu org licenses lgpl 3 0"),
    Licence("agpl-3.0", "agpl 3 0(?: only| or later)?", "(?:gnu )?affero general public" + VERSION + "3(?: 0)?", "affero general public", "gnu org licenses agpl 3 0"),
    Licence("gpl-1.0", "gpl 1 0(?: only| or later)?", "(?:gnu )?general public" + VERSION + "1(?: 0)?", "general public", "gnu org licenses gpl 1 0"),
    Licence("gpl-2.0", "gpl 2 0(?: only| or later)?", "(?:gnu )?general public" + VERSION + "2(?: 0)?", "general public", "gnu org licenses gpl 2 0"),
    Licence("gpl-3.0", "gpl 3 0(?: only| or later)?", "(?:gnu )?general public" + VERSION + "3(?: 0)?", "general public", "gnu org licenses gpl 3 0"),
    Licence("lgpl", "lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public", "gnu org licenses lgpl"),
    Licence("agpl", "agpl", "(?:gnu )?affero general public licen[cs]e", "affero general public", "gnu org licenses agpl"),
    Licence("gpl", "gpl", "(?:gnu )?general public licen[cs]e", "general public", "gnu org licenses gpl"),
    Licence("gfdl-1.2", "gfdl 1 2", "(?:gnu )?free documentation" + VERSION + "1 2", "free documentation", "gnu org licenses fdl 1 2"),
    Licence("gfdl-1.3", "gfdl 1 3", "(?:gnu )?free documentation" + VERSION + "1 3", "free documentation", "gnu org licenses fdl 1 3"),
    Licence("gfdl", "gfdl", "(?:gnu )?free documentation licen[cs]e", "free documentation", "gnu org licenses fdl"),
    Licence("mpl-1.1", "mpl 1 1", "mozilla public" + VERSION + "1 1", "mozilla public", "mozilla org mpl 1 1"),
    Licence("mpl-2.0", "mpl 2 0", "mozilla public" + VERSION + "2(?: 0)?", "mozilla public", "mozilla org mpl 2 0"),
    Licence("mpl", "mpl", "mozilla public licen[cs]e", "mozilla public", "mozilla org mpl"),
    Licence("epl-1.0", "epl 1 0", "eclipse public" + VERSION + "1(?: 0)?", "eclipse public", "eclipse org legal epl v10"),
    Licence("epl-2.0", "epl 2 0", "eclipse public" + VERSION + "2(?: 0)?", "eclipse public", "eclipse org legal epl 2 0"),
    Licence("eupl-1.2", "eupl 1 2", "european union public" + VERSION + "1 2", "european union public", "eupl eu 1 2"),
    Licence("cddl-1.0", "cddl 1 0", "common development and distribution" + VERSION + "1(?: 0)?", "common development", "opensource org licenses cddl 1 0"),
    Licence("artistic-2.0", "artistic 2 0", "artistic" + VERSION + "2(?: 0)?", "artistic", "opensource org licenses artistic 2 0"),
    Licence("artistic", "artistic", "artistic licen[cs]e", "artistic licen", "opensource org licenses artistic"),
    Licence("bsl-1.0", "bsl 1 0", "boost software" + VERSION + "1(?: 0)?", "boost software", "boost org license 1 0"),
    Licence("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "opensource org licenses zlib"),
    Licence("unlicense", "unlicense", "the unlicen[cs]e", "the unlicen", "unlicense org"),
    Licence("wtfpl", "wtfpl", "do what the fuck you want to public licen[cs]e", "do what the fuck", "wtfpl net"),
    Licence("postgresql", "postgresql", "postgresql licen[cs]e", "postgresql licen", "opensource org licenses postgresql"),
    Licence("python-2.0", "python 2 0", "python software foundation licen[cs]e", "python software foundation", "docs python org license"),
    Licence("ofl-1.1", "ofl 1 1", "sil open font" + VERSION + "1 1", "open font", "scripts sil org ofl"),
    Licence("ms-pl", "ms pl", "microsoft public licen[cs]e", "microsoft public", "opensource org licenses ms pl"),
    Licence("odbl-1.0", "odbl 1 0", "open database" + VERSION + "1(?: 0)?", "open database", "opendatacommons org licenses odbl"),
    Licence("cc0-1.0", "cc0(?: 1 0)?", "cc0(?: 1 0)?(?: universal)?", "cc0", "creativecommons org publicdomain zero"),
    Licence("cc0-1.0", "", "creative commons zero(?: 1 0)?(?: universal)?", "creative commons zero"),
    Licence("cc-by-1.0", "cc by 1 0", CC + " 1 0", CC, "creativecommons org licenses by 1 0"),
    Licence("cc-by-2.0", "cc by 2 0", CC + " 2 0", CC, "creativecommons org licenses by 2 0"),
    Licence("cc-by-3.0", "cc by 3 0", CC + " 3 0", CC, "creativecommons org licenses by 3 0"),
    Licence("cc-by-4.0", "cc by 4 0", CC + " 4 0", CC, "creativecommons org licenses by 4 0"),
    Licence("cc-by-sa-3.0", "cc by sa 3 0", CC + " share ?alike 3 0", CC, "creativecommons org licenses by sa 3 0"),
    Licence("cc-by-sa-4.0", "cc by sa 4 0", CC + " share ?alike 4 0", CC, "creativecommons org licenses by sa 4 0"),
    Licence("cc-by-nd-4.0", "cc by nd 4 0", CC + " no ?deriv(?:ative)?s? 4 0", CC, "creativecommons org licenses by nd 4 0"),
    Licence("cc-by-nc-3.0", "cc by nc 3 0", CC + " non ?commercial 3 0", CC, "creativecommons org licenses by nc 3 0"),
    Licence("cc-by-nc-4.0", "cc by nc 4 0", CC + " non ?commercial 4 0", CC, "creativecommons org licenses by nc 4 0"),
    Licence("cc-by-nc-sa-4.0", "cc by nc sa 4 0", CC + " non ?commercial share ?alike 4 0", CC, "creativecommons org licenses by nc sa 4 0"),
    Licence("cc-by-nc-nd-4.0", "cc by nc nd 4 0", CC + " non ?commercial no ?deriv(?:ative)?s? 4 0", CC, "creativecommons org licenses by nc nd 4 0"),
    Licence("cc-by", "cc by", CC + " licen[cs]e", CC, "creativecommons org licenses by"),
    Licence("cc-by-nc", "cc by nc", CC + " non ?commercial licen[cs]e", CC, "creativecommons org licenses by nc"),
]

#: A version behind the word licence, so that a general rule spans what the title within it does.
TAIL = "(?: version)?(?: v)?(?: v?[0-9]+){0,3}"
#: Signatures that stand for themselves: what a licence's own text says.
SIGNATURES = [
    Rule(1, "mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    Rule(1, "isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose"),
    Rule(1, "bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    Rule(1, "gpl", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation"),
    Rule(1, "lgpl", "free software foundation", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Rule(1, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    Rule(1, "agpl", "free software foundation", "under the terms of the gnu affero general public license as published by the free software foundation"),
    Rule(1, "apache-2.0", "in compliance with the license", "you may not use this file except in compliance with the license"),
    Rule(1, "mpl-2.0", "this source code form", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    Rule(1, "epl-2.0", "eclipse public", "made available under the terms of the eclipse public license(?: v(?:ersion)?)? 2 0"),
    Rule(1, "bsd-3-clause", "neither the name", "neither the name(?:s)? of (?:[^ ]+ ){1,12}?may be used to endorse or promote products"),
    Rule(1, "bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display"),
    Rule(1, "bsl-1.0", "any person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    Rule(1, "cc0-1.0", "under law", "to the extent possible under law (?:[^ ]+ ){1,12}?waived all copyright and related or neighboring rights"),
    Rule(1, "ofl-1.1", "fonts and derivatives", "the fonts and derivatives may be bundled embedded redistributed"),
    Rule(1, "python-2.0", "psf is making python", "psf is making python available to licensee on an as is basis"),
    Rule(3, "gpl-2.0", "gplv2", "gplv2(?: 0)?(?: only| or later)?"),
    Rule(3, "gpl-3.0", "gplv3", "gplv3(?: 0)?(?: only| or later)?"),
    Rule(3, "lgpl-2.1", "lgplv2 1", "lgplv2 1(?: only| or later)?"),
    Rule(3, "lgpl-3.0", "lgplv3", "lgplv3(?: 0)?(?: only| or later)?"),
    Rule(3, "agpl-3.0", "agplv3", "agplv3(?: 0)?(?: only| or later)?"),
    Rule(3, "mpl-2.0", "mplv2", "mplv2(?: 0)?"),
    Rule(3, "epl-2.0", "eplv2", "eplv2(?: 0)?"),
    Rule(2, "zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    Rule(2, "public-domain", "public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    Rule(6, "public-domain", "public domain", "public domain"),
    Rule(6, "proprietary", "all rights reserved", "all rights reserved"),
    Rule(6, "proprietary", "proprietary and confidential", "(?:unauthori[sz]ed copying .{0,200}? )?proprietary and confidential"),
    Rule(7, "commercial", "commercial licen", "commercial licen[cs]e"),
    Rule(7, "unknown-licence", "under the terms of", "under the terms of (?:the |this )?(?:[^ ]+ ){0,6}?licen[cs]e" + TAIL),
    Rule(8, "unknown-licence", "subject to the", "subject to the (?:[^ ]+ ){0,6}?licen[cs]e(?: agreement)?" + TAIL),
]
#: Families whose short identifier with a version is no ordinary text.
FAMILIES = ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "eupl", "cddl", "bsl", "ofl", "odbl", "bsd")
GRANT = "(?:licen[cs]ed|released|distributed|provided|available|published) under (?:the )?(?:terms of )?(?:the )?"


def rules() -> list[Rule]:
    """Every rule, the most telling first: a lower priority wins where two match the same words."""
    made = list(SIGNATURES)
    for place, licence in enumerate(LICENCES):
        step = place / 1000  # specific licences stand before general ones
        made.append(Rule(2 + step, licence.label, licence.keyword, f"{GRANT}{licence.title}"))
        if licence.short:
            made.append(Rule(1 + step, licence.label, "spdx license identifier", f"spdx license identifier {licence.short}"))
            made.append(Rule(3 + step, licence.label, licence.short.split("(")[0], f"{GRANT}{licence.short}(?: licen[cs]e)?"))
        if licence.label.split("-")[0] in FAMILIES and re.search(r"\d", licence.short):
            made.append(Rule(4 + step, licence.label, licence.short.split("(")[0], licence.short))
        made.append(Rule(4 + step, licence.label, licence.keyword, licence.title))
        if licence.address:
            made.append(Rule(5 + step, licence.label, licence.address, f"(?:www )?{licence.address}(?: html| txt)?"))
    return sorted(made)


#: Words one of which every text holds that any rule matches; a text without them is done.
GATES = ["licen", "spdx", "general public", "permission", "redistribution", "public domain", "rights reserved", "creative commons",
         "creativecommons", " cc0", " under ", "apache", "mozilla", "origin of this software", "opensource org", "org ", "wtfpl net", "eupl eu", "unencumbered",
         "free documentation", "eclipse public", "european union public", "common development", "artistic", "boost software", "python software", "open font",
         "microsoft public", "open database", "mit no attribution", "proprietary", "compliance with", "source code form", "neither the name", "advertising materials",
         "fonts and derivatives", "psf is", "gpl ", "gplv", "mplv", "eplv", "gfdl ", "mpl ", "epl ", "eupl ", "cddl ", "bsl ", "ofl ", "odbl ", "bsd "]

#: Phrases and labels that are always counted.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
