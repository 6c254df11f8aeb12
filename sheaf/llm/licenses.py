"""Licence scans: ordered signature rules over the normalised words of a text, in SQL functions only.

A text is normalised to its words (A-Z lower-cased; runs of digits, a-z and characters beyond ASCII) with
one space between. A rule has a label, a keyword, a pattern over such text, and a score; the earlier rule
has priority. Every rule names a word that each of its matches has: the words of a text are met with all these
at once, by a hash set, and a rule is tried only where the text has its word and its keyword. An SPDX tag is taken as one
expression, however long, and cut at its or, and, with: each id and exception of the list gives a detection, unknown ones
none. A detection whose interval lies in that of a detection with higher priority
is suppressed. What contains something that was itself suppressed is contained in its suppressor as well, so
one look at all detections of higher priority resolves the overlaps.

Null and empty texts have no words and no detections. Repeated rows keep a row each. Two detections with one interval
are a tie that the earlier rule wins; a rule has each interval once. A very long text is scanned whole, in its row; the
detections that one is compared with start within the widest pattern's reach before it.
An empty table gives an empty report. Columns besides doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import constant_array, text_of

#: What separates words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: An SPDX tag in lower case: its lead, and ids joined by or, and, with; brackets stand in the gaps.
_LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
SPDX_LEAD = rf"(?<!{_LETTER})spdx[\x20-\x2F]{{1,3}}licen[sc]e[\x20-\x2F]{{1,3}}identifier[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
SPDX_JOINT = rf"{GAP}(?:or|and|with){GAP}"
_ID = rf"[0-9a-z][0-9a-z.+:_-]*+(?: v?[0-9][0-9a-z.+-]*+)?(?!{_LETTER})"
SPDX_EXPRESSION = rf"{_ID}(?:{SPDX_JOINT}{_ID})*+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    score: float
    #: Words, separated by bars: every match has one of them.
    gate: str = "licence|license"
    #: Where no whole word is sure, the gate is part of one, and this a pattern that such texts, in lower case, have too.
    shape: str = ""
    #: Whether the pattern is of an id in an SPDX expression.
    spdx: bool = False


#: Label, the name in words as a pattern, its keyword, versions (as words; none: unversioned).
FAMILIES = (
    ("agpl", "(?:gnu )?affero general public licen[sc]e", "affero", ("1 0", "3 0", "3")),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public", ("2 0", "2 1", "3 0", "3", "2")),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e", "free documentation", ("1 1", "1 2", "1 3")),
    ("gpl", "(?:gnu )?general public licen[sc]e", "general public", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("apache", "apache (?:software )?licen[sc]e", "apache", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla public licen[sc]e", "mozilla", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public licen[sc]e", "eclipse", ("1 0", "2 0")),
    ("cddl", "common development and distribution licen[sc]e", "common development", ("1 0", "1 1")),
    ("cpl", "common public licen[sc]e", "common public", ("1 0",)),
    ("eupl", "european union public licen[sc]e", "european union public", ("1 0", "1 1", "1 2")),
    ("artistic", "(?:perl )?artistic licen[sc]e", "artistic", ("1 0", "2 0")),
    ("osl", "open software licen[sc]e", "open software", ("1 0", "2 0", "3 0")),
    ("afl", "academic free licen[sc]e", "academic free", ("2 0", "2 1", "3 0")),
    ("ofl", "(?:sil )?open font licen[sc]e", "open font", ("1 0", "1 1")),
    ("bsl", "boost software licen[sc]e", "boost software", ("1 0",)),
    ("odbl", "open database licen[sc]e", "open database", ("1 0",)),
    ("bsd", "(?:(?:original|modified|new|revised|simplified) )?bsd(?: [0234] clause)? licen[sc]e", "bsd", ()),
    ("mit", "(?:the )?(?:mit|expat|x11) licen[sc]e", "licen", ()),
    ("isc", "isc licen[sc]e", "isc", ()),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", ()),
    ("unlicense", "(?:the )?unlicen[sc]e", "unlicen", ()),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "want to public", ()),
    ("python", "python software foundation licen[sc]e", "python software", ("2",)),
    ("php", "php licen[sc]e", "php", ("3 0", "3 01")),
    ("ruby", "ruby licen[sc]e", "ruby", ()),
    ("postgresql", "postgresql licen[sc]e", "postgresql", ()),
    ("ms-pl", "microsoft public licen[sc]e", "microsoft", ()),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "microsoft", ()),
    ("openssl", "openssl licen[sc]e", "openssl", ()),
    ("cecill", "cecill(?: [abc])? licen[sc]e", "cecill", ("1 0", "2 0", "2 1")),
    ("upl", "universal permissive licen[sc]e", "universal permissive", ("1 0",)),
    ("ecl", "educational community licen[sc]e", "educational community", ("1 0", "2 0")),
)
#: Label, the SPDX id without version as a pattern, and whether a version makes it clear without a notice.
SHORT = (
    ("agpl", "agpl", True), ("lgpl", "lgpl", True), ("gfdl", "gfdl", True), ("gpl", "gpl", True), ("apache", "apache", True), ("mpl", "mpl", True), ("epl", "epl", False), ("cddl", "cddl", True),
    ("cpl", "cpl", False), ("eupl", "eupl", True), ("artistic", "artistic", False), ("osl", "osl", False), ("afl", "afl", False), ("ofl", "ofl", False), ("bsl", "bsl", False), ("odbl", "odbl", True),
    ("bsd", "(?:0bsd|bsd [0-4] clause|bsd)", False), ("mit", "(?:mit|x11)(?: 0)?", False), ("isc", "isc", False), ("zlib", "zlib(?: acknowledgement)?", False), ("unlicense", "unlicense", False), ("wtfpl", "wtfpl", False),
    ("python", "(?:python|psf)", False), ("php", "php", False), ("ruby", "ruby", False), ("postgresql", "postgresql", False), ("ms-pl", "ms pl", False), ("ms-rl", "ms rl", False), ("openssl", "openssl", False),
    ("cecill", "cecill(?: [abc])?", True), ("upl", "upl", False), ("ecl", "ecl", False),
)
#: Follows a version in an SPDX id.
SPDX_END = "(?: no invariants| invariants)?(?: only| or later)?"
#: The parts that a Creative Commons licence's name is made of.
CC_PARTS = (("by", "by|attribution"), ("by-sa", "by sa|attribution share ?alike"), ("by-nd", "by nd|attribution no ?deriv(?:ative)?s?(?: works)?"), ("by-nc", "by nc|attribution non ?commercial"), ("by-nc-sa", "by nc sa|attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
CC_STARTS = (("creative commons", "creative commons", "commons"), ("cc", "cc", "cc"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: The exceptions that may follow "with" in an SPDX expression.
SPDX_EXCEPTIONS = (
    ("autoconf-exception", "autoconf exception (?:generic|[23] 0)"), ("bison-exception", "bison exception (?:1 24|2 2)"), ("classpath-exception", "classpath exception 2 0"), ("font-exception", "font exception 2 0"),
    ("gcc-exception", "gcc exception (?:2 0|3 1)"), ("linux-syscall-note", "linux syscall note"), ("llvm-exception", "llvm exception"), ("openssl-exception", "(?:cryptsetup|x11vnc) openssl exception"),
    ("universal-foss-exception", "universal foss exception 1 0"),
)
#: Sentences of licence texts, notices, exceptions and terms: label, pattern, score, and the word that every match has where no literal one is sure to be whole.
TEXTS = (
    # permissive texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", 0.95),
    ("mit-0", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 1.0),
    ("mit-advertising", "the end user documentation or (?:any )?advertising materials? must (?:include|display) (?:the following|an) acknowledgement", 0.9, "acknowledgement"),
    ("x11", "except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale", 1.0, "advertising"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted", 0.95),
    ("hpnd", "both that (?:the )?copyright notice and this permission notice appear in supporting documentation", 0.95),
    ("ntp", "makes no representations about the suitability (?:of )?this software for any purpose", 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd-1-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.85),
    ("bsd-3-clause", "neither the names? of .{1,80}? may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 1.0),
    ("bsd-4-clause-uc", "this product includes software developed by the university of california berkeley and its contributors", 1.0),
    ("bsd-clear", "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", 1.0),
    ("bsd-patent", "no licen[sc]e or right is granted under any patent rights except as expressly set forth", 0.8),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify", 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("libpng", "the png reference library is supplied as is", 1.0, "png"),
    ("libtiff", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 1.0),
    ("ijg", "this software is based in part on the work of the independent jpeg group", 1.0),
    ("freetype", "portions of this software are copyright .{1,40}? the freetype project", 1.0),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", 1.0),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.95),
    ("icu", "to permit persons to whom the software is furnished to do so provided that the above copyright notice s and this permission notice appear in all copies", 0.95),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 1.0),
    ("w3c", "w3c software (?:and document )?notice and licen[sc]e", 1.0),
    ("w3c", "by obtaining using and or copying this work you (?:the )?licensee agree", 0.9),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", 1.0, "consequential"),
    ("python", "psf is making python available to licensee on an as is basis", 1.0),
    ("python", "beopen(?: com)? (?:python )?open source licen[sc]e agreement", 1.0),
    ("cnri", "cnri (?:open source )?licen[sc]e agreement", 1.0),
    ("zpl", "zope public licen[sc]e(?: zpl)?(?: version)?", 1.0),
    ("php", "this product includes php software freely available from", 1.0),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ssleay", "this product includes cryptographic software written by eric young", 1.0),
    ("vim", "(?:the )?vim licen[sc]e", 0.9),
    ("vim", "vim is charityware", 0.9, "charityware"),
    ("json", "the software shall be used for good not evil", 1.0),
    ("beerware", "the beer ?ware licen[sc]e", 1.0),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer", 1.0, "beer"),
    ("wtfpl", "you just do what the fuck you want to", 1.0, "fuck"),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works", 1.0),
    ("naumen", "naumen public licen[sc]e", 1.0),
    ("xnet", "(?:the )?x net licen[sc]e", 0.9),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose", 1.0),
    ("bzip2", "this program bzip2 (?:and )?the associated library libbzip2", 1.0, "libbzip2"),
    ("blueoak", "blue oak model licen[sc]e", 1.0),
    ("mulan", "mulan permissive software licen[sc]e", 1.0),
    ("afl", "licensed under the academic free licen[sc]e version", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("0bsd", "with or without fee is hereby granted the software is provided as is and the author disclaims all warranties", 1.0),
    # apache
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 1.0),
    ("apache-2.0", "you may obtain a copy of the licen[sc]e at (?:http s? |https? )?www apache org licenses licen[sc]e 2 0", 1.0),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e", 1.0),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements", 1.0),
    ("apache", "you may not use this file except in compliance with the licen[sc]e", 0.9),
    ("apache-1.1", "this product includes software developed by the apache (?:software foundation|group)", 0.95),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name", 1.0),
    # copyleft texts and notices
    ("gpl", "this program is free software you can redistribute it and or modify it", 0.95),
    ("gpl-2.0-or-later", "gnu general public licen[sc]e as published by the free software foundation either version 2 (?:of the licen[sc]e )?or at your option any later version", 1.0),
    ("gpl-3.0-or-later", "gnu general public licen[sc]e as published by the free software foundation either version 3 (?:of the licen[sc]e )?or at your option any later version", 1.0),
    ("gpl-2.0-only", "gnu general public licen[sc]e version 2 (?:only )?as published by the free software foundation", 1.0),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu", 0.9),
    ("gpl", "you should have received a copy of the gnu general public licen[sc]e along with this (?:program|library|file|package)", 1.0),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed", 0.9),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("gpl-3.0", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 1.0),
    ("gpl-1.0", "the licen[sc]e agreements of most software companies try to keep users at the mercy of those companies", 1.0),
    ("gpl", "gnu gpl comes with absolutely no warranty", 0.7),
    ("lgpl", "this library is free software you can redistribute it and or modify it", 0.95),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 1.0),
    ("lgpl-2.1-or-later", "gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1", 1.0),
    ("lgpl-3.0-or-later", "gnu lesser general public licen[sc]e as published by the free software foundation either version 3", 1.0),
    ("lgpl-2.0", "(?:gnu )?library general public licen[sc]e as published by the free software foundation", 0.95),
    ("lgpl-3.0", "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3", 1.0),
    ("agpl-3.0", "remote network interaction use with the gnu general public licen[sc]e", 1.0),
    ("agpl-3.0", "interacting with it remotely through a computer network", 0.9, "remotely"),
    ("agpl-3.0-or-later", "gnu affero general public licen[sc]e as published by the free software foundation either version 3", 1.0),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1.0),
    ("gfdl-no-invariants", "with no invariant sections no front cover texts and no back cover texts", 1.0, "invariant"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0", 1.0),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[sc]e", 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 1.0),
    ("mpl-2.0-no-copyleft", "incompatible with secondary licenses as defined by the mozilla public licen[sc]e", 1.0),
    ("npl", "netscape public licen[sc]e", 0.9),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 1.0),
    ("edl", "eclipse distribution licen[sc]e", 0.9),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 1.0),
    ("cpl", "the accompanying program is provided under the terms of this common public licen[sc]e", 1.0),
    ("ipl", "ibm public licen[sc]e", 0.9),
    ("spl", "sun public licen[sc]e", 0.9),
    ("apsl", "apple public source licen[sc]e", 0.95),
    ("qpl", "(?:the )?q public licen[sc]e", 0.95),
    ("rpl", "reciprocal public licen[sc]e", 0.95),
    ("rpsl", "realnetworks public source licen[sc]e", 0.95),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code", 1.0),
    ("osl", "licensed under the open software licen[sc]e version", 1.0),
    ("cecill", "ce logiciel est r.gi par la licence cecill", 1.0),
    ("cecill", "this software is governed by the cecill(?: [abc])? licen[sc]e under french law", 1.0),
    ("eupl", "licensed under the eupl(?: version)?", 1.0),
    ("ms-pl", "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e", 0.95),
    ("cpal", "common public attribution licen[sc]e", 0.95),
    ("lppl", "latex project public licen[sc]e", 1.0),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 1.0, "package"),
    ("perl", "under the same terms as perl(?: itself)?", 0.95, "perl"),
    ("ruby", "under the same terms as ruby(?: itself)?", 0.95, "ruby"),
    # fonts, data and works
    ("ofl", "this font software is licensed under the sil open font licen[sc]e", 1.0),
    ("ofl", "with reserved font names?", 0.9),
    ("bitstream-vera", "bitstream vera is a trademark of bitstream", 1.0, "bitstream"),
    ("ubuntu-font", "ubuntu font licen[sc]e", 1.0),
    ("arphic", "arphic public licen[sc]e", 1.0),
    ("odbl", "this .{1,60}? (?:database )?is made available under the open database licen[sc]e", 1.0),
    ("odc-by", "open data commons attribution licen[sc]e", 0.95),
    ("pddl", "(?:open data commons )?public domain dedication and licen[sc]e", 0.95),
    ("ogl-uk", "open government licen[sc]e(?: v ?[123](?: 0)?)?", 0.9),
    ("etalab", "licence ouverte(?: open licence)?", 0.9),
    ("cdla", "community data licen[sc]e agreement(?: permissive| sharing)?", 0.95),
    ("cc", "this work is licensed under a creative commons .{1,80}? licen[sc]e", 0.9),
    ("cc-by-sa", "text is available under the creative commons attribution share ?alike licen[sc]e", 1.0),
    ("cc0", "to the extent possible under law .{1,120}? has waived all copyright and related or neighbou?ring rights", 1.0),
    ("cc0", "(?:cc0 )?no rights reserved", 0.7),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", 0.9, "cc0"),
    ("cc-pdm", "public domain mark(?: 1 0)?", 0.9),
    ("cc-sampling", "creative commons sampling plus", 0.9),
    ("fal", "free art licen[sc]e", 0.9),
    ("gutenberg", "(?:full )?project gutenberg tm? licen[sc]e", 0.95),
    ("gutenberg", "this ebook is for the use of anyone anywhere (?:in the united states and most other parts of the world )?at no cost", 1.0, "ebook"),
    ("openrail", "responsible ai licen[sc]e(?: openrail m?)?", 0.9),
    ("openrail", "creativeml open rail(?: plus)? m", 0.95, "creativeml"),
    ("llama", "llama(?: [23](?: [0-9])?)? community licen[sc]e agreement", 0.95),
    ("public-domain", "(?:placed|released|dedicated|put) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "this (?:file|work|code|software|image|text) is (?:hereby )?in the public domain", 0.8),
    ("public-domain", "work of the united states government (?:and|that) is (?:therefore )?(?:in the public domain|not subject to copyright)", 0.9, "government"),
    # exceptions
    ("classpath-exception", "(?:gnu )?classpath exception", 0.95, "classpath"),
    ("classpath-exception", "linking this library statically or dynamically with other modules is making a combined work", 1.0, "statically"),
    ("gcc-exception", "gcc runtime library exception", 1.0, "gcc"),
    ("autoconf-exception", "contains a configuration script generated by autoconf", 1.0, "autoconf"),
    ("bison-exception", "(?:the )?bison parser skeleton", 0.9, "bison"),
    ("openssl-exception", "link(?:ing)? (?:the code of )?(?:this program|portions of this program) with the openssl library", 0.95, "openssl"),
    ("llvm-exception", "apache licen[sc]e v(?:ersion)? ?2 0 with llvm exceptions?", 1.0),
    ("font-exception", "embed this font or unaltered portions of this font into the document", 1.0, "unaltered"),
    ("linux-syscall-note", "user programs that use kernel services by normal system calls", 1.0, "kernel"),
    ("universal-foss-exception", "universal foss exception", 1.0, "foss"),
    # source available
    ("sspl", "server side public licen[sc]e", 1.0),
    ("busl", "business source licen[sc]e", 1.0),
    ("elastic", "elastic licen[sc]e(?: 2 0| v2)?", 0.9),
    ("commons-clause", "commons clause(?: licen[sc]e condition)?", 0.9),
    ("polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial)(?: licen[sc]e)?", 0.95, "polyform"),
    ("confluent", "confluent community licen[sc]e", 1.0),
    ("rsal", "redis source available licen[sc]e", 1.0),
    ("prosperity", "prosperity public licen[sc]e", 1.0),
    ("parity", "parity public licen[sc]e", 1.0),
    ("hippocratic", "hippocratic licen[sc]e", 1.0),
    ("anti-996", "anti 996 licen[sc]e", 1.0),
    ("gfdl-no-invariants", "free documentation licen[sc]e version 1 [123] or any later version published by the free software foundation with no invariant sections", 1.0),
    ("agpl-3.0", "your modified version must prominently offer all users interacting with it remotely .{1,80}? software", 1.0),
    ("postgresql", "in no event shall the university of california be liable to any party .{1,200}? arising out of the use of this software", 1.0),
    ("wtfpl", "do what the fuck you want to public licen[sc]e terms and conditions", 1.0),
    # proprietary and general notices
    ("proprietary", "all rights reserved", 0.3),
    ("proprietary", "alle rechte vorbehalten", 0.3, "vorbehalten"),
    ("proprietary", "tous droits r.serv.s", 0.3, "droits"),
    ("proprietary", "todos los derechos reservados", 0.3, "reservados"),
    ("proprietary", "(?:contains|constitutes?) (?:valuable )?trade secrets?", 0.5, "secret|secrets"),
    ("proprietary", "proprietary and confidential", 0.6, "confidential"),
    ("proprietary", "confidential and proprietary", 0.6, "confidential"),
    ("proprietary", "unauthori[sz]ed copying of this (?:file|software|document|work)", 0.7, "copying"),
    ("proprietary", "end user licen[sc]e agreement", 0.6),
    ("proprietary", "for evaluation purposes only", 0.5, "evaluation"),
    ("non-commercial", "for (?:personal )?non ?commercial use only", 0.6, "commercial|noncommercial"),
    ("research-only", "for (?:academic |non ?commercial )?research purposes only", 0.6, "research"),
    ("freeware", "this (?:program|software) is freeware", 0.6, "freeware"),
    ("shareware", "this (?:program|software) is shareware", 0.6, "shareware"),
    ("dual", "dual licen[sc]ed under", 0.5),
    ("other", "see the file licen[sc]e for (?:details|licen[sc]e terms)", 0.4),
    ("other", "see the file copying for (?:details|copying permission)", 0.4, "copying"),
    ("other", "(?:ver.ffentlicht|lizenziert) unter (?:der|einer) .{1,40}? ?lizenz", 0.4, "lizenz", "lizenz"),
    ("other", "(?:publi. |distribu. |diffus. )?sous licence (?:libre|publique|gnu|mit|apache)", 0.4),
    ("other", "bajo licencia (?:libre|p.blica|gnu|mit|apache)", 0.4),
    ("other", "bajo la licencia (?:libre|p.blica|gnu|mit|apache)", 0.4),
    ("copyright", "copyright (?:c |© )?(?:19|20)[0-9]{2}", 0.2),
)
#: Words that lead up to a licence's name in a notice.
NOTICES = ("licen[sc]ed under(?: the)?(?: terms of(?: the)?)?", "released under(?: the)?(?: terms of(?: the)?)?", "(?:distributed|available|published|provided) under(?: the)?(?: terms of(?: the)?)?", "spdx licen[sc]e identifier")


def literals(pattern: str) -> list[str]:
    """What every match of a pattern holds: its text without groups, classes and optional characters."""
    before = None
    while before != pattern:
        before, pattern = pattern, re.sub(r"\((?:\?:)?[^()]*\)[?*]?", "\0", pattern)
    return re.sub(r"\[[^\]]*\][?*]?|\.(?:\{[^}]*\})?\??|.\?", "\0", pattern).split("\0")


def gate_of(pattern: str) -> str | None:
    """The longest word that stands whole and literally in every match, with both spellings of [sc] and [sz]; None if there is none."""
    parts = literals(pattern.replace("[sc]", "\1").replace("[sz]", "\2"))
    words = []
    for i, part in enumerate(parts):
        mine = part.split(" ")
        words += mine[i > 0 : len(mine) - (i < len(parts) - 1)]
    word = max(words, key=len, default="")
    return "|".join(sorted({word.replace("\1", x).replace("\2", y) for x in "sc" for y in "sz"})) if len(word) > 2 else None


def text_rule(label: str, pattern: str, score: float, gate: str | None = None, shape: str = "") -> Rule:
    """The rule of a sentence: its keyword is its longest literal part, from a word's start; its gate the one given or a word of its own."""
    parts = literals(pattern)
    keyword = max([parts[0], *(p.partition(" ")[2] for p in parts[1:])], key=len).strip()
    gate = gate or gate_of(pattern)
    if gate is None:
        raise ValueError(f"no gate for: {pattern}")
    return Rule(label, keyword, pattern, score, gate, shape)


def widest(patterns: list[str]) -> int | None:
    """The most characters that a match of one of the patterns has; None if there is no bound, or none is known."""
    try:
        most = max((parser.parse(p).getwidth()[1] for p in patterns), default=0)
    except re.error:  # Java's own syntax
        return None
    return most if most < 1_000_000 else None


def build_rules() -> list[Rule]:
    """Some hundreds of rules, the longest and surest first: a notice with a version, a version, texts, a notice, a name."""
    named = [(label, name, keyword, versions) for label, name, keyword, versions in FAMILIES]
    rules = spdx_rules()
    unlicense = lambda r: r._replace(gate="unlicence|unlicense") if r.label == "unlicense" and not r.spdx and not r.shape and "unlicen" in r.pattern else r
    for (label, name, keyword, versions), notice in product(named, NOTICES):
        rules += [Rule(f"{label}-{v.replace(' ', '.')}", keyword, f"{notice} {name}(?: v(?:ersion)?)? v?{v}(?: or(?: any)? later(?: version)?)?", 1.0) for v in versions]
    lead = f"(?:(?:{'|'.join(NOTICES[:3])}) )?"
    for (part, words), v, (start, keyword, gate) in product(reversed(CC_PARTS), reversed(CC_VERSIONS), CC_STARTS):
        rules.append(Rule(f"cc-{part}-{v.replace(' ', '.')}", keyword, f"{lead}{start} (?:{words}) {v}(?: international| unported| generic)?", 0.95, gate))
    for label, name, keyword, versions in named:
        rules += [Rule(f"{label}-{v.replace(' ', '.')}", keyword, f"{name}(?: v(?:ersion)?)? v?{v}(?: or(?: any)? later(?: version)?)?", 0.95) for v in versions]
    rules += [text_rule(*text) for text in TEXTS]
    rules += [Rule(label, keyword, f"{notice} {name}", 0.9) for (label, name, keyword, _), notice in product(named, NOTICES)]
    for (part, words), (start, keyword, gate) in product(reversed(CC_PARTS), CC_STARTS):
        rules.append(Rule(f"cc-{part}", keyword, f"{lead}{start} (?:{words})", 0.7, gate))
    rules += [Rule(label, keyword, name, 0.7) for label, name, keyword, _ in named]
    return [unlicense(r) for r in rules] + short_rules()


def short_versions() -> list[tuple[str, str, bool, list[tuple[str, str]]]]:
    """SHORT with each family's versions: the label of one and its pattern; 2 stands for 2.0 where it is not a version itself."""
    versions = {label: v for label, _, _, v in FAMILIES}

    def pattern(v: str, all_: tuple) -> str:
        major, _, minor = v.partition(" ")
        others = "|".join(w.partition(" ")[2] for w in all_ if w.startswith(f"{major} ") and w != v)
        return v if minor != "0" or major in all_ else f"{major}(?: 0)?" + (f"(?! (?:{others}) )" if others else "")

    return [(label, name, clear, [(f"{label}-{v.replace(' ', '.')}", pattern(v, versions[label])) for v in versions[label]]) for label, name, clear in SHORT]


def spdx_rules() -> list[Rule]:
    """What an id of an SPDX expression is: versions first, then exceptions, then names without a version."""
    rules = [Rule(label, "spdx", f"{name} v?{v}{SPDX_END}", 1.0, "spdx", spdx=True) for _, name, _, versions in short_versions() for label, v in versions]
    rules += [Rule(label, "spdx", name, 1.0, "spdx", spdx=True) for label, name in SPDX_EXCEPTIONS]
    return rules + [Rule(label, "spdx", name, 0.9, "spdx", spdx=True) for label, name, _ in SHORT]


def short_rules() -> list[Rule]:
    """Short names with a version, and BSD with its clauses; what may mean something else after a notice only."""
    under = f"(?:(?:{'|'.join(NOTICES[:3])}) )"
    rules = []
    for label, name, clear, versions in short_versions():
        for word, found in [("python", "python"), ("psf", "psf")] if label == "python" else [(name.split("(")[0], name)]:
            shape = rf"{word}[^a-z0-9]*(?:[abc][^a-z0-9]*)?(?:version)?[^a-z0-9]*v?[^a-z0-9]*[0-9]"
            rules += [Rule(full, word, f"{under}{'?' if clear else ''}{found}(?: version)? ?v? ?{v}{SPDX_END}", 0.6, word, shape) for full, v in versions]
    rules.append(Rule("bsd", "bsd", f"{under}?bsd [0-4] clause", 0.6, "bsd", r"bsd[^a-z0-9]+[0-4][^a-z0-9]+clause"))
    return rules


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def normalised(text: Column) -> Column:
    """The words with a space before, between and after; one space where there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), lower_ascii(text), F.lit(" ")), GAP, " ")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand in the array of words, counted from 0."""
    wanted = phrase.split()
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - len(wanted), F.lit(0)))
    return F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == w, F.lit(False)) for k, w in enumerate(wanted)]))


def detections_of(norm: Column, words: Column, lower: Column, rules: list[Rule]) -> Column:
    """array<struct<rule, start, end>> of all matches, in characters of the normalised text.

    The text's words say which rules can match; of these, those are tried whose keyword the text holds, a keyword that rules share
    once. The gaps between a pattern's matches and the matches themselves, added up, give the places.
    """
    by_keyword: dict[tuple[str, str], list[int]] = {}
    for i, r in enumerate(rules):
        if not r.spdx:
            by_keyword.setdefault((f" {r.keyword}", "" if r.shape else r.gate), []).append(i)
    by_gate: dict[str, list[int]] = {}
    for k, (_, gate) in enumerate(by_keyword):
        for word in gate.split("|"):
            by_gate.setdefault(word, []).append(k)
    numbers = lambda lists: F.transform(constant_array([",".join(map(str, x)) for x in lists]), lambda x: F.split(x, ",").cast("array<int>"))
    keywords, patterns = constant_array([k for k, _ in by_keyword]), constant_array([f"(?<= )(?:{r.pattern})(?= )" for r in rules])
    held, gates, behind = numbers(by_keyword.values()), constant_array(list(by_gate)), numbers(by_gate.values())
    empty = F.array().cast("array<struct<rule:int,start:int,end:int>>")

    def matches(t: Column, r: Column) -> Column:
        pattern = F.get(patterns, r)
        hits = F.regexp_extract_all(t, pattern, F.lit(0))
        between = F.split(t, pattern, -1)
        both = F.zip_with(hits, F.slice(between, 1, F.greatest(F.size(hits), F.lit(1))), lambda h, g: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        step = lambda s, x: F.struct(
            (s["at"] + x["g"] + x["h"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(r.alias("rule"), (s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + x["h"]).alias("end")))).alias("out"),
        )
        return F.when(F.size(hits) == 0, empty).otherwise(F.aggregate(F.filter(both, lambda x: x["h"].isNotNull()), start, step)["out"])

    # words that are gates, then the keywords behind these (those of rules with a shape stand behind the empty word), then the rules
    open_ = F.array_intersect(F.concat(words, F.array(F.lit(""))), gates)
    tried = F.array_distinct(F.flatten(F.transform(open_, lambda w: F.get(behind, (F.array_position(gates, w) - 1).cast("int")))))
    found = F.element_at(F.transform(F.array(norm), lambda t: F.transform(F.flatten(F.transform(F.filter(tried, lambda k: F.contains(t, F.get(keywords, k))), lambda k: F.get(held, k))), lambda r: matches(t, r))), 1)
    tags = F.when(F.array_contains(words, "spdx"), spdx_detections(lower, rules)) if any(r.spdx for r in rules) else None
    return F.flatten(F.concat(found, F.array(F.coalesce(tags, empty)))) if tags is not None else F.flatten(found)


def spdx_detections(lower: Column, rules: list[Rule]) -> Column:
    """The detections of the ids in SPDX expressions, in characters of the normalised text. lower: the text with A-Z lower-cased.

    A piece of a text adds its words, each with a space, to the normalised one, so places are sums over pieces: what
    stands before the expression, its lead, and each id and operator.
    """
    own = [(i, r) for i, r in enumerate(rules) if r.spdx]
    numbers, patterns = constant_array([i for i, _ in own], "int"), constant_array([f"^(?:{r.pattern}) " for _, r in own])
    size = lambda x: F.length(F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), GAP, " ")) - 1
    empty = F.array().cast("array<struct<rule:int,start:int,end:int>>")
    tags, between = F.regexp_extract_all(lower, F.lit(SPDX_LEAD + SPDX_EXPRESSION), F.lit(0)), F.split(lower, SPDX_LEAD + SPDX_EXPRESSION, -1)

    def ids(tag: Column, at: Column) -> Column:
        rest = F.regexp_replace(tag, "^" + SPDX_LEAD, "")
        names, joints = F.split(rest, SPDX_JOINT, -1), F.regexp_extract_all(rest, F.lit(SPDX_JOINT), F.lit(0))
        pieces = F.zip_with(names, joints, lambda n, j: F.struct(F.trim(F.regexp_replace(F.concat(F.lit(" "), n, F.lit(" ")), GAP, " ")).alias("name"), F.coalesce(size(j), F.lit(0)).alias("joint")))
        which = lambda name: F.get(F.filter(F.sequence(F.lit(0), F.lit(len(own) - 1)), lambda k: F.regexp_like(F.concat(name, F.lit(" ")), F.get(patterns, k))), F.lit(0))
        start = F.struct((at + size(F.regexp_extract(tag, "^" + SPDX_LEAD, 0))).alias("at"), empty.alias("out"))
        step = lambda s, x: F.struct(
            (s["at"] + F.length(x["name"]) + 1 + x["joint"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(F.get(numbers, which(x["name"])).alias("rule"), s["at"].alias("start"), (s["at"] + F.length(x["name"])).alias("end")))).alias("out"),
        )
        return F.filter(F.aggregate(pieces, start, step)["out"], lambda d: d["rule"].isNotNull())

    both = F.zip_with(F.slice(between, 1, F.size(tags)), tags, lambda g, t: F.struct(size(g).alias("g"), size(t).alias("h"), t.alias("tag")))
    start = F.struct(F.lit(1).alias("at"), empty.alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["g"] + x["h"]).alias("at"), F.concat(s["out"], ids(x["tag"], s["at"] + x["g"])).alias("out"))
    return F.when(F.size(tags) > 0, F.aggregate(both, start, step)["out"]).otherwise(empty)


def may_match(words: Column, lower: Column, rules: list[Rule]) -> Column:
    """Whether a text, by its words and in lower case, has the gate of a rule and, if that has one, its shape."""
    gates = sorted({w for r in rules if not r.shape for w in r.gate.split("|")})
    plain = F.arrays_overlap(words, constant_array(gates))
    parts = sorted({r.gate for r in rules if r.shape}, key=lambda w: (len(w), w))
    if not parts:
        return plain
    least = [w for i, w in enumerate(parts) if not any(x in w for x in parts[:i])]
    return plain | (reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in least]) & F.rlike(lower, F.lit("|".join(sorted({r.shape for r in rules if r.shape})))))


def license_report(docs: DataFrame, rules: list[Rule] | None = None, base: tuple = BASE_PHRASES) -> DataFrame:
    """A row for each document: counts of words and base phrases, base labels, all labels, the best score, detections kept."""
    rules = build_rules() if rules is None else rules
    longest = widest([r.pattern for r in rules])  # a detection starts at most so many characters before one that it contains
    gate = may_match(F.col("_words"), F.col("_lower"), [*rules, *[Rule(label, phrase, "", 0, phrase.split()[-1]) for phrase, label in base]])
    split = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), lower_ascii(text_of()).alias("_lower")).withColumn("_words", F.split(F.concat(F.lit(" "), F.col("_lower"), F.lit(" ")), GAP, -1))
    gated = split.withColumn("_gate", gate)
    texts = gated.select(
        "doc_id", "_row", (F.size("_words") - 2).cast("long").alias("n_words"), F.when(F.col("_gate"), F.col("_words")).alias("_words"), F.when(F.col("_gate"), F.col("_lower")).alias("_lower"),
        F.when(F.col("_gate"), F.when(F.size("_words") > 2, F.array_join("_words", " ")).otherwise(F.lit(" "))).alias("_norm"),
    )
    labelled = lambda ws, p, label: F.transform(phrase_starts(ws, p), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
    maybe = F.col("_norm").rlike("|".join(f" {p} " for p, _ in base) if base else "(?!)")
    none = F.array().cast("array<struct<at:int,label:string>>")
    words = F.when(maybe, F.split(F.trim("_norm"), " "))
    places = F.when(maybe, F.element_at(F.transform(F.array(words), lambda ws: F.concat(none, *[labelled(ws, p, label) for p, label in base])), 1))
    found = F.when(F.col("_norm").isNotNull(), detections_of(F.col("_norm"), F.col("_words"), F.col("_lower"), rules))
    scanned = texts.select(
        "_row", "doc_id", "n_words",
        places.alias("_places"), F.explode_outer(found).alias("_d"),
    ).select(
        "_row", "doc_id", "n_words", F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("_n"),
        F.array_min(F.transform("_places", lambda p: p["at"])).cast("long").alias("first_word"), F.array_max(F.transform("_places", lambda p: p["at"])).cast("long").alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("_places", lambda p: p["label"]))), F.array().cast("array<string>")).alias("_base"), "_d.*",
    ).withColumn("n_base", F.greatest("_n", F.lit(0).cast("long")))
    # among the detections that start at most `longest` characters before, one of higher priority contains this one
    near = W.partitionBy("_row").orderBy("start").rangeBetween(W.unboundedPreceding if longest is None else -longest, 0)
    before = F.collect_list(F.when(F.col("start").isNotNull(), F.struct("rule", "start", "end"))).over(near)
    shadowed = F.exists("_before", lambda o: (o["rule"] < F.col("rule")) & (o["start"] <= F.col("start")) & (o["end"] >= F.col("end")))
    kept = scanned.withColumn("_before", before).withColumn("_keep", F.col("rule").isNotNull() & ~shadowed).drop("_before")
    labels, scores = constant_array([r.label for r in rules]), constant_array([r.score for r in rules], "double")
    hit = F.when(F.col("_keep"), F.struct(F.get(labels, F.col("rule")).alias("label"), F.get(scores, F.col("rule")).alias("score")))
    per_doc = kept.withColumn("_hit", hit).groupBy("_row", "doc_id", "n_words", "n_base", "first_word", "last_word", "_base").agg(
        F.collect_set("_hit.label").alias("_labels"), F.coalesce(F.max("_hit.score"), F.lit(0.0)).alias("_score"), F.count("_hit").alias("n_detections")
    )
    return per_doc.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_base", "_labels")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.greatest("_score", F.lit(0.7))).otherwise(F.col("_score")).alias("score"), "n_detections",
    )
