"""License scan by ordered signature rules.

A text becomes its words (runs of 0-9, a-z and non-ASCII letters after A-Z became a-z) joined by single spaces.
Rules are regular expressions over that: made from license names, their versions and the phrases they are cited with
(``FAMILIES``), and written one by one (``SIGNATURES``: sentences of license texts, SPDX tags, notices without the word
license). A rule is tried only on texts that hold its keyword. Detections are intervals of words. They are
resolved in order of priority (then length, then place): one that lies inside a kept interval is suppressed.

Base phrases are counted at every place, whatever the rules find, and their labels always stay.

Defined results: a null or empty text has no words, no detection, empty label strings and score 0. Texts of any length are scanned
whole. Repeated rows give equal results. Equal detections of several rules count once, for the rule that comes first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

from querygauge.llm.common import slices, utf8_bytes

#: Words, and the phrases with their labels.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, keyword, names, versions. Versions are written as words, as they stand in a normalised text.
FAMILIES = (
    ("gpl", "gnu", ("gnu general public licen[cs]e", "gnu gpl"), ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("gpl", "gpl", ("gpl", "gplv"), ("2 0", "3 0", "2", "3")),
    ("lgpl", "gnu", ("gnu (?:lesser|library) general public licen[cs]e", "gnu lgpl"), ("2 0", "2 1", "3 0", "2", "3")),
    ("lgpl", "lgpl", ("lgpl", "lgplv"), ("2 1", "3 0", "3")),
    ("agpl", "affero", ("(?:gnu )?affero general public licen[cs]e",), ("3 0", "3")),
    ("agpl", "agpl", ("agpl", "agplv"), ("3 0", "3")),
    ("gfdl", "documentation", ("gnu free documentation licen[cs]e",), ("1 1", "1 2", "1 3")),
    ("apache", "apache", ("apache (?:software )?licen[cs]e",), ("1 0", "1 1", "2 0", "2")),
    ("mit", "mit", ("mit licen[cs]e", "mit x11 licen[cs]e", "expat mit licen[cs]e"), ()),
    ("x11", "x11", ("x11 licen[cs]e",), ()),
    ("bsd", "bsd", ("(?:new |modified |simplified |revised )?bsd licen[cs]e", "bsd style licen[cs]e", "bsd [0234] clause(?: licen[cs]e)?", "[0234] clause bsd(?: licen[cs]e)?"), ()),
    ("isc", "isc", ("isc licen[cs]e",), ()),
    ("mpl", "mozilla", ("mozilla public licen[cs]e",), ("1 0", "1 1", "2 0", "2")),
    ("epl", "eclipse", ("eclipse public licen[cs]e",), ("1 0", "2 0")),
    ("edl", "eclipse", ("eclipse distribution licen[cs]e",), ("1 0",)),
    ("cddl", "development", ("common development and distribution licen[cs]e",), ("1 0", "1 1")),
    ("cpl", "common public", ("common public licen[cs]e",), ("1 0",)),
    ("eupl", "european", ("european union public licen[cs]e",), ("1 0", "1 1", "1 2")),
    ("artistic", "artistic", ("(?:perl )?artistic licen[cs]e",), ("1 0", "2 0")),
    ("boost", "boost", ("boost software licen[cs]e",), ("1 0",)),
    ("zlib", "zlib", ("zlib licen[cs]e", "zlib libpng licen[cs]e"), ()),
    ("unlicense", "unlicense", ("the unlicense",), ()),
    ("wtfpl", "what the", ("do what the [a-z]+ you want to public licen[cs]e",), ("2",)),
    ("ofl", "open font", ("sil open font licen[cs]e", "open font licen[cs]e"), ("1 0", "1 1")),
    ("odbl", "database", ("open database licen[cs]e",), ("1 0",)),
    ("odc-by", "open data", ("open data commons attribution licen[cs]e",), ("1 0",)),
    ("pddl", "public domain", ("public domain dedication and licen[cs]e",), ("1 0",)),
    ("public-domain", "public domain", ("(?:dedicated to|placed in|released into|in) the public domain",), ()),
    ("python", "python", ("python software foundation licen[cs]e", "psf licen[cs]e"), ("2",)),
    ("php", "php", ("php licen[cs]e",), ("3 0", "3 01")),
    ("ms-pl", "microsoft", ("microsoft public licen[cs]e",), ()),
    ("ms-rl", "microsoft", ("microsoft reciprocal licen[cs]e",), ()),
    ("osl", "open software", ("open software licen[cs]e",), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", ("academic free licen[cs]e",), ("1 1", "2 0", "2 1", "3 0")),
    ("ncsa", "ncsa", ("university of illinois ncsa open source licen[cs]e", "ncsa licen[cs]e"), ()),
    ("cecill", "cecill", ("cecill(?: [abc])?(?: licen[cs]e)?",), ("1 0", "2 0", "2 1")),
    ("cc0", "cc0", ("cc0",), ("1 0",)),
    ("cc0", "creative", ("creative commons (?:cc0|zero)",), ("1 0",)),
    ("cc-by", "cc by", ("cc by",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc by", ("cc by sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc by", ("cc by nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc by", ("cc by nc",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc by", ("cc by nc sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc by", ("cc by nc nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative", ("creative commons attribution",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "creative", ("creative commons attribution share ?alike",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "creative", ("creative commons attribution non ?commercial",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("proprietary", "all rights", ("all rights reserved",), ()),
)
#: Written one by one: label, keyword, priority, score, pattern. Sentences of license texts (60), notices (45), tags (70).
SIGNATURES = (
    ("mit", "permission is hereby", 60, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?! the software to deal with)"),
    ("mit", "without restriction", 60, 1.0, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"),
    ("mit", "substantial portions", 60, 1.0, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "authors or copyright", 60, 0.9, "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "permission is hereby", 62, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "x consortium", 61, 1.0, "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use", 60, 1.0, "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "isc disclaims", 60, 1.0, "isc disclaims all warranties with regard to this software"),
    ("0bsd", "permission to use", 59, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("hpnd", "permission to use", 60, 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", "redistribution and use", 60, 1.0, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source", 60, 0.9, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", 60, 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", 61, 1.0, "neither the name of (?:[a-z0-9]+ ){1,12}?nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", 61, 1.0, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache license", 61, 1.0, "apache license version 2 0 january 2004"),
    ("apache-2.0", "in compliance with", 60, 1.0, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by", 60, 0.9, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "perpetual worldwide", 60, 1.0, "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "apache group", 60, 0.9, "this product includes software developed by the apache group"),
    ("apache-1.1", "apache software foundation", 60, 0.9, "this product includes software developed by the apache software foundation"),
    ("gpl", "free software", 60, 1.0, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "should have received", 60, 1.0, "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0", "version 2 of the", 61, 1.0, "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", "version 2 1 of the", 62, 1.0, "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("gpl-3.0", "version 3 of the", 61, 1.0, "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-3.0", "version 3 of the", 62, 1.0, "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3.0", "version 3 of the", 62, 1.0, "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "freedom to share", 60, 1.0, "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended"),
    ("gpl-3.0", "free copyleft", 60, 1.0, "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "free software", 62, 1.0, "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "should have received", 62, 1.0, "you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("lgpl-2.1", "lesser gpl", 62, 1.0, "this is the first released version of the lesser gpl"),
    ("agpl", "affero", 62, 1.0, "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3.0", "remote network", 62, 1.0, "remote network interaction use with the gnu general public license"),
    ("gfdl", "invariant sections", 60, 1.0, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "source code form", 61, 1.0, "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-2.0", "incompatible with", 61, 1.0, "this source code form is incompatible with secondary licenses"),
    ("mpl-1.1", "mozilla", 61, 1.0, "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-1.0", "program and the accompanying", 61, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "program and the accompanying", 61, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("cddl", "common development", 61, 1.0, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "accompanying program", 60, 0.9, "the accompanying program is provided under the terms of this common public license"),
    ("eupl", "eupl", 61, 1.0, "licensed under the eupl"),
    ("artistic-2.0", "software package", 60, 1.0, "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-1.0", "artistic control", 60, 1.0, "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("boost-1.0", "person or organization", 60, 1.0, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1.0", "machine executable", 60, 1.0, "machine executable object code generated by a source language processor"),
    ("zlib", "misrepresented", 60, 1.0, "the origin of this software must not be misrepresented"),
    ("zlib", "altered source", 60, 1.0, "altered source versions must be plainly marked as such"),
    ("zlib", "commercial applications", 60, 0.9, "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", "unencumbered", 61, 1.0, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free", 60, 1.0, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do", 60, 1.0, "you just do what the [a-z]+ you want to"),
    ("ofl", "reserved font name", 60, 1.0, "no modified version of the font software may use the reserved font name"),
    ("ofl", "font software", 60, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("odbl", "open database", 60, 0.9, "this database is made available under the open database license"),
    ("cc0-1.0", "waives abandons", 61, 1.0, "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("cc-by-sa", "derivative work only", 55, 0.9, "you may distribute publicly display publicly perform or publicly digitally perform a derivative work only under the terms of this license"),
    ("python-2", "psf hereby", 60, 1.0, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "includes php", 60, 1.0, "this product includes php software freely available from"),
    ("openssl", "openssl project", 60, 1.0, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ncsa", "with the software without", 60, 0.9, "to deal with the software without restriction including without limitation the rights"),
    ("beerware", "buy me a beer", 60, 1.0, "you can buy me a beer in return"),
    ("json", "good not evil", 61, 1.0, "the software shall be used for good not evil"),
    ("ruby", "yukihiro matsumoto", 60, 0.8, "ruby is copyrighted free software by yukihiro matsumoto"),
    ("vim", "vim", 60, 0.9, "there are no restrictions on distributing unmodified copies of vim"),
    ("sleepycat", "redistributions in any", 60, 0.9, "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("proprietary", "unauthorized copying", 50, 0.9, "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "confidential and", 45, 0.8, "proprietary and confidential|confidential and proprietary"),
    # notices without the word license
    ("mit", "under mit", 42, 1.0, "(?:licensed|released|distributed|available) under mit"),
    ("mit", "under the mit", 42, 1.0, "(?:licensed|released|distributed|available) under the mit"),
    ("mit", "mit licensed", 42, 0.9, "mit licensed"),
    ("mit", "mit style", 41, 0.8, "mit style"),
    ("apache-2.0", "apache 2", 42, 0.9, "(?:under|license) (?:the )?apache 2 0"),
    ("apache-2.0", "apache v2", 42, 0.9, "apache v2(?: 0)?"),
    ("apache-2.0", "alv2", 42, 0.9, "alv2"),
    ("apache", "under apache", 41, 0.9, "(?:licensed|released|distributed|available) under apache"),
    ("apache-2.0", "apache org", 45, 1.0, "(?:www )?apache org licenses license 2 0"),
    ("bsd", "under bsd", 42, 0.9, "(?:licensed|released|distributed|available) under bsd"),
    ("bsd", "under the bsd", 42, 0.9, "(?:licensed|released|distributed|available) under the bsd"),
    ("bsd", "bsd licensed", 42, 0.9, "bsd licensed"),
    ("isc", "under isc", 42, 0.9, "(?:licensed|released|distributed|available) under isc"),
    ("isc", "under the isc", 42, 0.9, "(?:licensed|released|distributed|available) under the isc"),
    ("gpl", "under gpl", 42, 0.9, "(?:licensed|released|distributed|available) under gpl"),
    ("gpl-2.0", "gplv2", 46, 1.0, "gplv2"),
    ("gpl-3.0", "gplv3", 46, 1.0, "gplv3"),
    ("gpl-2.0", "gpl2", 46, 0.9, "gpl2"),
    ("gpl-3.0", "gpl3", 46, 0.9, "gpl3"),
    ("lgpl-2.1", "lgplv2", 46, 1.0, "lgplv2 1"),
    ("lgpl-3.0", "lgplv3", 46, 1.0, "lgplv3"),
    ("agpl-3.0", "agplv3", 46, 1.0, "agplv3"),
    ("gpl", "gnu org", 45, 0.9, "(?:www )?gnu org licenses gpl"),
    ("lgpl", "gnu org", 45, 0.9, "(?:www )?gnu org licenses lgpl"),
    ("agpl", "gnu org", 45, 0.9, "(?:www )?gnu org licenses agpl"),
    ("mpl-2.0", "mozilla org", 45, 1.0, "mozilla org mpl 2 0"),
    ("mpl-2.0", "mpl 2", 42, 0.9, "mpl 2 0"),
    ("mpl-1.1", "mpl 1", 42, 0.9, "mpl 1 1"),
    ("epl-2.0", "epl 2", 42, 0.9, "epl 2 0"),
    ("epl-1.0", "epl 1", 42, 0.9, "epl 1 0"),
    ("mit", "opensource org", 45, 1.0, "opensource org licenses mit"),
    ("bsd", "opensource org", 45, 1.0, "opensource org licenses bsd"),
    ("isc", "opensource org", 45, 1.0, "opensource org licenses isc"),
    ("cc-by-4.0", "creativecommons", 46, 1.0, "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "creativecommons", 46, 1.0, "creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", "creativecommons", 46, 1.0, "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "creativecommons", 46, 1.0, "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", "creativecommons", 46, 1.0, "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons", 46, 1.0, "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons", 46, 1.0, "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons", 46, 1.0, "creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", "creativecommons", 46, 1.0, "creativecommons org publicdomain zero 1 0"),
    ("unlicense", "unlicense org", 46, 1.0, "unlicense org"),
    ("ofl", "scripts sil", 46, 1.0, "scripts sil org ofl"),
    ("boost-1.0", "boost org", 46, 1.0, "boost org license 1 0 txt"),
)
#: Labels by SPDX identifier, as words; a tag is the identifier behind "spdx license identifier", or behind another one and "or" / "and".
SPDX = {
    "mit": "mit", "mit 0": "mit-0", "x11": "x11", "isc": "isc", "0bsd": "0bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "bsd 4 clause": "bsd-4-clause",
    "apache 1 0": "apache-1.0", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2.0", "gpl 1 0": "gpl-1.0", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0",
    "lgpl 2 0": "lgpl-2.0", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3.0", "agpl 1 0": "agpl-1.0", "agpl 3 0": "agpl-3.0", "gfdl 1 1": "gfdl-1.1", "gfdl 1 2": "gfdl-1.2", "gfdl 1 3": "gfdl-1.3",
    "mpl 1 0": "mpl-1.0", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0", "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1", "cpl 1 0": "cpl-1.0",
    "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2", "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0", "bsl 1 0": "boost-1.0", "zlib": "zlib", "libpng": "zlib", "unlicense": "unlicense",
    "wtfpl": "wtfpl", "ofl 1 0": "ofl-1.0", "ofl 1 1": "ofl-1.1", "odbl 1 0": "odbl-1.0", "odc by 1 0": "odc-by-1.0", "pddl 1 0": "pddl-1.0", "psf 2 0": "python-2.0", "python 2 0": "python-2.0",
    "php 3 0": "php-3.0", "php 3 01": "php-3.01", "ms pl": "ms-pl", "ms rl": "ms-rl", "osl 3 0": "osl-3.0", "afl 3 0": "afl-3.0", "ncsa": "ncsa", "cecill 2 1": "cecill-2.1", "cc0 1 0": "cc0-1.0",
    "cc by 3 0": "cc-by-3.0", "cc by 4 0": "cc-by-4.0", "cc by sa 3 0": "cc-by-sa-3.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc by nd 4 0": "cc-by-nd-4.0", "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0", "cc by nc nd 4 0": "cc-by-nc-nd-4.0", "hpnd": "hpnd", "openssl": "openssl", "curl": "curl", "json": "json", "ruby": "ruby", "vim": "vim", "beerware": "beerware",
    "sleepycat": "sleepycat", "blueoak 1 0 0": "blueoak-1.0.0", "postgresql": "postgresql", "upl 1 0": "upl-1.0", "bsd 1 clause": "bsd-1-clause",
}
#: Phrases around a name: priority, score, pattern before, pattern after. A later one is a weaker sign.
NOTICE = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered)(?: to you)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? "
PHRASES = ((40, 1.0, NOTICE, ""), (30, 0.9, r"(?:see|subject to|under the terms of|a copy of)(?: the| a)? ", ""), (10, 0.7, "", ""))
VERSION = r"(?: licen[cs]e)?(?: version| v| ver)? ?"
SEPARATE = r"(?= )"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    priority: int
    score: float
    pattern: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    """All rules: every name with every phrase, with and without each version (a version adds to the priority); then the written ones."""
    out = [Rule(label, keyword.encode(), priority, score, re.compile(f" (?:{pattern}){SEPARATE}".encode())) for label, keyword, priority, score, pattern in SIGNATURES]
    for words, label in SPDX.items():
        # of two identifiers the longer one has the higher priority
        for before in ("spdx license identifier", f"(?:{'|'.join(sorted(SPDX, key=len, reverse=True))})(?: only| or later)? (?:or|and)"):  # the first, and each next one
            out.append(Rule(label, b"spdx license identifier", 70 + words.count(" "), 1.0, re.compile(f" {before} {words}{SEPARATE}".encode())))
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            for priority, score, before, after in PHRASES:
                for version in ("", *versions):
                    body = f" {before}{name}" + (VERSION + version if version else "") + after + SEPARATE
                    tag = f"{label}-{version.replace(' ', '.')}" if version else label
                    longer = sum(label.startswith(x) for x in ("cc-by-", "lgpl", "agpl")) + label.count("-")
                    out.append(Rule(tag, keyword.encode(), priority + 5 * bool(version) + longer, score, re.compile(body.encode())))
    return tuple(sorted(out, key=lambda r: -r.priority))


def resolved(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Of (first word, last word, priority, score, label), those that no kept interval of higher order contains."""
    kept: list[tuple[int, int, int, float, str]] = []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[4])):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return sorted(kept)


def scan_words(words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, float, str]]]:
    """(base places as (word, label), resolved detections) of a text's words."""
    whole = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in BASE.items():
        needle, at = f" {phrase} ".encode(), -1
        while (at := whole.find(needle, at + 1)) >= 0:
            base.append((whole.count(b" ", 0, at), label))
    found, present = [], {}
    for r in rules():
        if r.keyword not in present:
            present[r.keyword] = r.keyword in whole
        if present[r.keyword]:
            for m in r.pattern.finditer(whole):
                first = whole.count(b" ", 0, m.start())
                found.append((first, first + m.group().count(b" ") - 1, r.priority, r.score, r.label))
    return base, resolved(found)


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<first_word bigint, last_word bigint, label string>>"


def license_scan(text: Column) -> Column:
    """A column struct of the scan's results for any text column."""

    @F.arrow_udf(SCHEMA)
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for _, part in slices(column):
            starts, data = utf8_bytes(part)
            mapped = data.tobytes().translate(WORD_BYTES)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                words = mapped[a:b].split()
                base, found = scan_words(words) if words else ([], [])
                places = [p for p, _ in base]
                labels = {x for _, x in base}
                rows.append({
                    "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
                    "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {d[4] for d in found})),
                    "score": max([d[3] for d in found] + [0.7 * bool(base)]),
                    "detections": [{"first_word": d[0], "last_word": d[1], "label": d[4]} for d in found],
                })
        place = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string())])
        kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(place))]
        return pa.array(rows, pa.struct(kinds))

    return of(text.cast("string"))
