"""Signature rules of licences, in order of priority: the first that covers a place is the one that counts.

A rule is read over the lower-cased words of a text with one blank between them (punctuation is gone: `v2.0` is `v2 0`).
A family gives its label and its patterns. What a text must hold before a rule is tried follows from the pattern.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

#: (label, patterns), the most specific first.
FAMILIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("agpl-3.0-or-later", (
        r"spdx license identifier agpl 3 0 or later", r"affero general public license version 3 or (?:\(?at your option )?any later version",
        r"agpl ?v?3 (?:0 )?or later", r"agpl 3 0 or later")),
    ("agpl-3.0", (
        r"spdx license identifier agpl 3 0 only", r"(?:gnu )?affero general public license (?:version|v) ?3(?: 0)?", r"agpl ?v ?3(?: 0)?", r"agpl 3 0(?: only)?",
        r"gnu org licenses agpl 3 0", r"(?:gnu )?affero general public license", r"gnu agpl")),
    ("lgpl-2.1-or-later", (
        r"spdx license identifier lgpl 2 1 or later", r"lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1 (?:of the license )?or (?:at your option )?any later version",
        r"lgpl ?v?2 1 or later")),
    ("lgpl-2.1", (
        r"spdx license identifier lgpl 2 1 only", r"(?:gnu )?lesser general public license (?:version|v) ?2 1", r"lgpl ?v? ?2 1(?: only)?", r"gnu org licenses (?:old licenses )?lgpl 2 1")),
    ("lgpl-3.0-or-later", (
        r"spdx license identifier lgpl 3 0 or later", r"lesser general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:at your option )?any later version",
        r"lgpl ?v?3 (?:0 )?or later")),
    ("lgpl-3.0", (
        r"spdx license identifier lgpl 3 0 only", r"(?:gnu )?lesser general public license (?:version|v) ?3(?: 0)?", r"lgpl ?v? ?3(?: 0)?(?: only)?", r"gnu org licenses lgpl 3 0")),
    ("lgpl-2.0", (
        r"(?:gnu )?library general public license(?: (?:version|v) ?2(?: 0)?)?", r"lgpl ?v? ?2 0", r"spdx license identifier lgpl 2 0(?: only| or later)?")),
    ("lgpl", (r"(?:gnu )?lesser general public license", r"gnu lgpl", r"spdx license identifier lgpl", r"under the lgpl")),
    ("gpl-2.0-or-later", (
        r"spdx license identifier gpl 2 0 or later", r"spdx license identifier gpl 2 0 plus", r"general public license (?:as published by the free software foundation )?(?:either )?version 2 (?:0 )?(?:of the license )?or (?:at your option )?any later version",
        r"gpl ?v?2 (?:0 )?or later")),
    ("gpl-3.0-or-later", (
        r"spdx license identifier gpl 3 0 or later", r"general public license (?:as published by the free software foundation )?(?:either )?version 3 (?:0 )?(?:of the license )?or (?:at your option )?any later version",
        r"gpl ?v?3 (?:0 )?or later")),
    ("gpl-2.0", (
        r"spdx license identifier gpl 2 0(?: only)?", r"(?:gnu )?general public license (?:version|v) ?2(?: 0)?(?: only)?", r"gpl ?v ?2(?: 0)?", r"gpl 2 0(?: only)?", r"gnu org licenses (?:old licenses )?gpl 2 0", r"gplv2")),
    ("gpl-3.0", (
        r"spdx license identifier gpl 3 0(?: only)?", r"(?:gnu )?general public license (?:version|v) ?3(?: 0)?(?: only)?", r"gpl ?v ?3(?: 0)?", r"gpl 3 0(?: only)?", r"gnu org licenses gpl 3 0", r"gplv3")),
    ("gpl-1.0", (r"(?:gnu )?general public license (?:version|v) ?1(?: 0)?", r"spdx license identifier gpl 1 0(?: only| or later)?", r"gpl ?v ?1(?: 0)?")),
    ("gpl", (
        r"gnu general public license", r"general public license", r"gnu gpl", r"licensed under (?:the )?gpl", r"released under (?:the )?gpl", r"terms of the gpl", r"gpl license")),
    ("gfdl-1.3", (r"gnu free documentation license (?:version|v) ?1 3", r"gfdl ?v? ?1 3", r"spdx license identifier gfdl 1 3")),
    ("gfdl-1.2", (r"gnu free documentation license (?:version|v) ?1 2", r"gfdl ?v? ?1 2", r"spdx license identifier gfdl 1 2")),
    ("gfdl", (r"gnu free documentation license", r"under the gfdl")),
    ("apache-2.0", (
        r"spdx license identifier apache 2 0", r"licensed under the apache license version 2 0(?: the license)?", r"apache license (?:version|v) ?2(?: 0)?", r"apache (?:software )?license 2(?: 0)?",
        r"apache org licenses license 2 0", r"apache 2 0 license", r"apache 2 license", r"asl 2 0")),
    ("apache-1.1", (r"apache (?:software )?license (?:version |v ?)?1 1", r"spdx license identifier apache 1 1", r"apache org licenses license 1 1")),
    ("apache-1.0", (r"apache (?:software )?license (?:version |v ?)?1 0", r"spdx license identifier apache 1 0", r"apache org licenses license 1 0")),
    ("apache", (r"apache (?:software )?license", r"under the apache license", r"apache licensed", r"apache style license")),
    ("mit-0", (r"mit no attribution", r"spdx license identifier mit 0", r"mit 0 license")),
    ("mit", (
        r"spdx license identifier mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        r"(?:the )?mit license(?: mit)?", r"released under (?:the )?mit", r"licensed under (?:the )?(?:terms of the )?mit(?: license)?", r"mit licensed", r"opensource org licenses mit", r"expat license", r"mit style license", r"mit x11 license")),
    ("x11", (r"x11 license", r"spdx license identifier x11", r"x consortium license")),
    ("bsd-4-clause", (r"bsd 4 clause(?: license)?", r"spdx license identifier bsd 4 clause", r"(?:original|old) bsd license", r"four clause bsd")),
    ("bsd-3-clause", (
        r"spdx license identifier bsd 3 clause", r"bsd 3 clause(?: new or revised)?(?: license)?", r"3 clause bsd(?: license)?", r"three clause bsd", r"(?:new|revised|modified) bsd license", r"opensource org licenses bsd 3 clause",
        r"neither the name of (?:the )?(?:\w+ ){1,8}nor the names of (?:its|their) contributors may be used to endorse")),
    ("bsd-2-clause", (
        r"spdx license identifier bsd 2 clause", r"bsd 2 clause(?: simplified)?(?: license)?", r"2 clause bsd(?: license)?", r"two clause bsd", r"(?:simplified|freebsd) (?:bsd )?license", r"opensource org licenses bsd 2 clause")),
    ("0bsd", (r"zero clause bsd", r"spdx license identifier 0bsd", r"0bsd license", r"bsd zero clause(?: license)?")),
    ("bsd", (
        r"bsd license", r"bsd style license", r"under (?:the )?bsd", r"redistribution and use in source and binary forms with or without modification are permitted")),
    ("isc", (r"isc license", r"spdx license identifier isc", r"opensource org licenses isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")),
    ("mpl-2.0", (
        r"spdx license identifier mpl 2 0", r"mozilla public license (?:version |v ?)?2(?: 0)?", r"mozilla org mpl 2 0", r"mpl ?v? ?2(?: 0)?", r"this source code form is subject to the terms of the mozilla public license v 2 0")),
    ("mpl-1.1", (r"mozilla public license (?:version |v ?)?1 1", r"mpl ?v? ?1 1", r"spdx license identifier mpl 1 1", r"mozilla org mpl mpl 1 1")),
    ("mpl-1.0", (r"mozilla public license (?:version |v ?)?1 0", r"mpl ?v? ?1 0", r"spdx license identifier mpl 1 0")),
    ("mpl", (r"mozilla public license", r"licensed under (?:the )?mpl")),
    ("epl-2.0", (r"eclipse public license (?:version |v ?)?2(?: 0)?", r"spdx license identifier epl 2 0", r"epl ?v? ?2(?: 0)?", r"eclipse org legal epl 2 0")),
    ("epl-1.0", (r"eclipse public license (?:version |v ?)?1(?: 0)?", r"spdx license identifier epl 1 0", r"epl ?v? ?1(?: 0)?", r"eclipse org legal epl v10")),
    ("edl-1.0", (r"eclipse distribution license(?: (?:version |v ?)?1(?: 0)?)?", r"eclipse org org documents edl v10")),
    ("epl", (r"eclipse public license",)),
    ("cddl-1.1", (r"common development and distribution license (?:version |v ?)?1 1", r"cddl ?v? ?1 1", r"spdx license identifier cddl 1 1")),
    ("cddl-1.0", (r"common development and distribution license (?:version |v ?)?1 0", r"cddl ?v? ?1 0", r"spdx license identifier cddl 1 0")),
    ("cddl", (r"common development and distribution license", r"under the cddl")),
    ("cpl-1.0", (r"common public license(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier cpl 1 0")),
    ("ipl-1.0", (r"ibm public license(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier ipl 1 0")),
    ("eupl-1.2", (r"european union public licen[cs]e (?:version |v ?)?1 2", r"eupl ?v? ?1 2", r"spdx license identifier eupl 1 2")),
    ("eupl-1.1", (r"european union public licen[cs]e (?:version |v ?)?1 1", r"eupl ?v? ?1 1", r"spdx license identifier eupl 1 1")),
    ("eupl", (r"european union public licen[cs]e", r"under the eupl")),
    ("cecill-2.1", (r"cecill (?:version |v ?)?2 1", r"spdx license identifier cecill 2 1")),
    ("cecill-b", (r"cecill b(?: license)?", r"spdx license identifier cecill b")),
    ("cecill-c", (r"cecill c(?: license)?", r"spdx license identifier cecill c")),
    ("cecill", (r"cecill(?: free software)? license", r"licence cecill")),
    ("artistic-2.0", (r"artistic license (?:version |v ?)?2(?: 0)?", r"spdx license identifier artistic 2 0", r"opensource org licenses artistic license 2 0")),
    ("artistic-1.0", (r"artistic license (?:version |v ?)?1(?: 0)?", r"spdx license identifier artistic 1 0(?: perl)?")),
    ("artistic", (r"(?:the )?artistic license", r"same terms as perl itself")),
    ("bsl-1.0", (r"boost software license(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier bsl 1 0", r"boost org license 1 0")),
    ("busl-1.1", (r"business source license(?: (?:version |v ?)?1 1)?", r"spdx license identifier busl 1 1")),
    ("sspl-1.0", (r"server side public license(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier sspl 1 0", r"sspl ?v? ?1(?: 0)?")),
    ("elastic-2.0", (r"elastic license (?:version |v ?)?2(?: 0)?", r"spdx license identifier elastic 2 0", r"elastic license")),
    ("zlib", (r"zlib license", r"zlib libpng license", r"spdx license identifier zlib", r"altered source versions must be plainly marked as such")),
    ("libpng", (r"libpng license(?: (?:version |v ?)?2)?", r"spdx license identifier libpng(?: 2 0)?")),
    ("unlicense", (r"(?:the )?unlicense", r"spdx license identifier unlicense", r"unlicense org", r"this is free and unencumbered software released into the public domain")),
    ("wtfpl", (r"wtfpl(?: (?:version |v ?)?2)?", r"spdx license identifier wtfpl", r"do what the f\w* you want to public license")),
    ("cc0-1.0", (r"cc0 1 0(?: universal)?", r"spdx license identifier cc0 1 0", r"creative commons zero", r"creativecommons org publicdomain zero 1 0", r"cc0 license")),
    ("cc-by-nc-nd-4.0", (r"cc by nc nd 4 0", r"attribution noncommercial noderiv(?:ative)?s 4 0", r"attribution non commercial no deriv(?:ative)?s 4 0", r"creativecommons org licenses by nc nd 4 0")),
    ("cc-by-nc-nd-3.0", (r"cc by nc nd 3 0", r"attribution noncommercial noderiv(?:ative)?s 3 0", r"creativecommons org licenses by nc nd 3 0")),
    ("cc-by-nc-sa-4.0", (r"cc by nc sa 4 0", r"attribution noncommercial sharealike 4 0", r"attribution non commercial share alike 4 0", r"creativecommons org licenses by nc sa 4 0")),
    ("cc-by-nc-sa-3.0", (r"cc by nc sa 3 0", r"attribution noncommercial sharealike 3 0", r"creativecommons org licenses by nc sa 3 0")),
    ("cc-by-nc-4.0", (r"cc by nc 4 0", r"attribution non ?commercial 4 0", r"creativecommons org licenses by nc 4 0")),
    ("cc-by-nc-3.0", (r"cc by nc 3 0", r"attribution non ?commercial 3 0", r"creativecommons org licenses by nc 3 0")),
    ("cc-by-nd-4.0", (r"cc by nd 4 0", r"attribution no ?deriv(?:ative)?s 4 0", r"creativecommons org licenses by nd 4 0")),
    ("cc-by-sa-4.0", (r"cc by sa 4 0", r"attribution share ?alike 4 0", r"creativecommons org licenses by sa 4 0")),
    ("cc-by-sa-3.0", (r"cc by sa 3 0", r"attribution share ?alike 3 0", r"creativecommons org licenses by sa 3 0")),
    ("cc-by-sa-2.0", (r"cc by sa 2 [05]", r"attribution share ?alike 2 [05]", r"creativecommons org licenses by sa 2 [05]")),
    ("cc-by-4.0", (r"cc by 4 0", r"(?:creative commons )?attribution 4 0(?: international)?", r"creativecommons org licenses by 4 0")),
    ("cc-by-3.0", (r"cc by 3 0", r"(?:creative commons )?attribution 3 0(?: unported)?", r"creativecommons org licenses by 3 0")),
    ("cc-by-2.0", (r"cc by 2 [05]", r"creativecommons org licenses by 2 [05]")),
    ("cc-by-nc", (r"creative commons attribution non ?commercial", r"cc by nc(?! \d)")),
    ("cc-by-sa", (r"creative commons attribution share ?alike", r"cc by sa(?! \d)")),
    ("cc-by", (r"creative commons attribution(?: license)?", r"cc by license")),
    ("creative-commons", (r"creative commons licen[cs]e", r"licensed under (?:a )?creative commons", r"creativecommons org licenses")),
    ("odbl-1.0", (r"open data ?base license(?: odbl)?(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier odbl 1 0", r"opendatacommons org licenses odbl")),
    ("odc-by-1.0", (r"open data commons attribution license(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier odc by 1 0", r"opendatacommons org licenses by")),
    ("pddl-1.0", (r"public domain dedication and license(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier pddl 1 0")),
    ("ofl-1.1", (r"sil open font license(?: (?:version |v ?)?1 [01])?", r"spdx license identifier ofl 1 [01]", r"scripts sil org ofl")),
    ("openssl", (r"openssl license", r"spdx license identifier openssl", r"this product includes software developed by the openssl project")),
    ("psf-2.0", (r"python software foundation license(?: (?:version |v ?)?2(?: 0)?)?", r"spdx license identifier (?:python|psf) 2 0", r"psf license")),
    ("php-3.01", (r"php license(?: (?:version |v ?)?3 01)?", r"spdx license identifier php 3 0?1", r"php net license 3 01")),
    ("ruby", (r"ruby license", r"ruby s license", r"spdx license identifier ruby")),
    ("postgresql", (r"postgresql license", r"spdx license identifier postgresql")),
    ("ncsa", (r"university of illinois ncsa open source license", r"ncsa license", r"spdx license identifier ncsa")),
    ("ms-pl", (r"microsoft public license(?: ms pl)?", r"spdx license identifier ms pl", r"ms pl license")),
    ("ms-rl", (r"microsoft reciprocal license(?: ms rl)?", r"spdx license identifier ms rl")),
    ("afl-3.0", (r"academic free license(?: (?:version |v ?)?3(?: 0)?)?", r"spdx license identifier afl 3 0")),
    ("osl-3.0", (r"open software license(?: (?:version |v ?)?3(?: 0)?)?", r"spdx license identifier osl 3 0")),
    ("upl-1.0", (r"universal permissive license(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier upl 1 0")),
    ("mulan-2.0", (r"mulan psl ?v? ?2", r"mulan permissive software license(?: (?:version |v ?)?2)?", r"spdx license identifier mulanpsl 2 0")),
    ("vim", (r"vim license", r"spdx license identifier vim")),
    ("curl", (r"curl license", r"spdx license identifier curl")),
    ("ftl", (r"freetype (?:project )?license", r"spdx license identifier ftl")),
    ("ijg", (r"independent jpeg group license", r"spdx license identifier ijg", r"this software is based in part on the work of the independent jpeg group")),
    ("beerware", (r"beer ?ware license", r"spdx license identifier beerware", r"you can buy me a beer in return")),
    ("json", (r"json license", r"the software shall be used for good not evil", r"spdx license identifier json")),
    ("intel", (r"intel open source license", r"spdx license identifier intel")),
    ("qpl-1.0", (r"q public license(?: (?:version |v ?)?1(?: 0)?)?", r"spdx license identifier qpl 1 0")),
    ("nasa-1.3", (r"nasa open source agreement(?: (?:version |v ?)?1 3)?", r"spdx license identifier nasa 1 3")),
    ("ecl-2.0", (r"educational community license(?: (?:version |v ?)?2(?: 0)?)?", r"spdx license identifier ecl 2 0")),
    ("w3c", (r"w3c software (?:notice and )?license", r"w3c license", r"spdx license identifier w3c")),
    ("openrail", (r"creativeml open rail m(?: license)?", r"openrail(?: m)? license", r"responsible ai license", r"bigscience rail(?: license)?")),
    ("llama", (r"llama [234](?: [0-9])? community license(?: agreement)?", r"llama community license(?: agreement)?")),
    ("public-domain", (r"(?:released|placed|dedicated|put) (?:in ?to|to|in) the public domain", r"public domain dedication", r"in the public domain")),
    ("proprietary", (
        r"all rights reserved", r"proprietary and confidential", r"unauthorized (?:copying|reproduction|distribution) of this (?:file|document|software)", r"strictly prohibited without (?:prior )?written permission", r"not licensed for redistribution")),
    ("commercial", (r"commercial license(?: agreement)?", r"end user license agreement", r"licensed not sold")),
    ("dual-license", (r"dual licensed under", r"dual license")),
    ("copyright-notice", (r"copyright c? ?(?:19|20)\d\d", r"copyright notice", r"c copyright", r"copyright holders?")),
    ("unspecific", (
        r"spdx license identifier (?:\w+ ?){1,3}", r"see the license file", r"license agreement", r"under the terms of the \w+ licen[cs]e", r"licensed under the \w+ licen[cs]e", r"open source licen[cs]e", r"free software license")),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    gate: bytes
    whole: bool
    pattern: re.Pattern


def required(pattern: str) -> tuple[bytes, bool]:
    """(gate, whole): a word, if `whole`, or else a part of the text between blanks, that every match of the pattern holds.

    Only literals outside of groups, repeats and classes count. A match begins and ends at a blank or an end of the text.
    """
    runs = [" "]
    for kind, value in parser.parse(pattern):
        if kind is sre.LITERAL:
            runs[-1] += chr(value)
        else:
            runs.append("")
    runs[-1] += " "
    words = [w for run in runs for w in run.split(" ")[1:-1]]
    word = max(words, key=len, default="")
    if len(word) > 2:
        return word.encode(), True
    return max(runs, key=lambda run: len(run.strip())).encode(), False


def rules() -> list[Rule]:
    out = []
    for label, patterns in FAMILIES:
        for pattern in patterns:
            out.append(Rule(label, len(out), *required(pattern), re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")))
    return out
