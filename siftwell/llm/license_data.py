"""Known licence sentences and the rules over them (fixed values)."""

from __future__ import annotations

import re


def normal(sentence: str) -> str:
    """Lower-case ASCII words, as the scan compares them."""
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip().lower()


# Sentences of licence texts and headers, and their identifiers.
TEXTS = (
    ("MIT_GRANT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MIT_NOTICE", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT_WARRANTY", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("MIT_LIABILITY", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("APACHE2_REF", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("APACHE2_COMPLY", "you may not use this file except in compliance with the License"),
    ("APACHE2_COPY", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE2_COPY", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("APACHE2_BASIS", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("APACHE2_GRANT", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("GPL3_GRANT", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL2_GRANT", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL2_ONLY_GRANT", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL_WARRANTY", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("LGPL21_GRANT", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL3_GRANT", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
    ("LGPL_WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("AGPL3_GRANT", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("FSF_VERBATIM", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("GPL3_BODY", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("GPL2_BODY", "The licenses for most software are designed to take away your freedom to share and change it"),
    ("AGPL3_BODY", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("LGPL3_BODY", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("BSD_GRANT", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD_BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD_ENDORSE", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD_DISCLAIMER", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'),
    ("MPL2_REF", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC_GRANT", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC_WARRANTY", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("EPL2_REF", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL1_REF", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("CC0_WAIVER", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("ZLIB_WARRANTY", "This software is provided 'as-is', without any express or implied warranty"),
    ("ZLIB_GRANT", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL1_GRANT", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("UNLICENSE", "This is free and unencumbered software released into the public domain"),
    ("UNLICENSE_GRANT", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("WTFPL_GRANT", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("ALL_RIGHTS", "All rights reserved"),
)
# Identifiers of references, and the names by which a licence is referred to.
NAMES = (
    ("MIT_REF", ("the MIT License", "MIT License", "the MIT Licence")),
    ("APACHE2_REF", ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License")),
    ("GPL3_REF", ("the GNU General Public License version 3", "the GNU General Public License v3.0", "the GNU GPL v3", "the GPL-3.0 License")),
    ("GPL2_REF", ("the GNU General Public License version 2", "the GNU General Public License v2.0", "the GNU GPL v2", "the GPL-2.0 License")),
    ("LGPL21_REF", ("the GNU Lesser General Public License version 2.1", "the GNU Lesser General Public License v2.1", "the GNU LGPL v2.1")),
    ("LGPL3_REF", ("the GNU Lesser General Public License version 3", "the GNU Lesser General Public License v3.0", "the GNU LGPL v3")),
    ("AGPL3_REF", ("the GNU Affero General Public License version 3", "the GNU Affero General Public License v3.0", "the GNU AGPL v3")),
    ("BSD2_REF", ("the BSD 2-Clause License", "the Simplified BSD License")),
    ("BSD3_REF", ("the BSD 3-Clause License", "the New BSD License")),
    ("MPL2_REF", ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0")),
    ("EPL2_REF", ("the Eclipse Public License 2.0", "the EPL 2.0")),
    ("ISC_REF", ("the ISC License",)),
    ("BSL1_REF", ("the Boost Software License, Version 1.0", "the Boost Software License 1.0")),
    ("ZLIB_REF", ("the zlib License",)),
    ("CC0_REF", ("CC0 1.0", "the CC0 1.0 Universal License")),
    ("CC_BY_REF", ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License")),
    ("CC_BY_SA_REF", ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC_BY_NC_REF", ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License")),
)
SUBJECTS = ("", "This work is ", "This project is ", "This software is ", "This file is ", "This code is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "available under ")

# SPDX identifiers that headers name, with the family of each.
SPDX = (
    ("mit", "MIT"), ("apache", "Apache-2.0"), ("gpl", "GPL-2.0-only"), ("gpl", "GPL-2.0-or-later"), ("gpl", "GPL-3.0-only"), ("gpl", "GPL-3.0-or-later"), ("lgpl", "LGPL-2.1-only"), ("lgpl", "LGPL-2.1-or-later"),
    ("lgpl", "LGPL-3.0-only"), ("lgpl", "LGPL-3.0-or-later"), ("agpl", "AGPL-3.0-only"), ("agpl", "AGPL-3.0-or-later"), ("bsd", "BSD-2-Clause"), ("bsd", "BSD-3-Clause"), ("mpl", "MPL-2.0"), ("epl", "EPL-2.0"),
    ("isc", "ISC"), ("bsl", "BSL-1.0"), ("zlib", "Zlib"), ("cc0", "CC0-1.0"), ("unlicense", "Unlicense"),
)

# Ordered rules (family, licence, identifiers in order). Within a family the first wins.
TEXT_RULES = (
    ("mit", "MIT", ("MIT_GRANT", "MIT_NOTICE", "MIT_WARRANTY")),
    ("mit", "MIT-partial", ("MIT_GRANT", "MIT_NOTICE")),
    ("apache", "Apache-2.0", ("APACHE2_GRANT",)),
    ("apache", "Apache-2.0-header", ("APACHE2_REF", "APACHE2_COMPLY", "APACHE2_COPY")),
    ("gpl", "GPL-3.0-or-later", ("GPL3_GRANT", "GPL_WARRANTY")),
    ("gpl", "GPL-2.0-or-later", ("GPL2_GRANT", "GPL_WARRANTY")),
    ("gpl", "GPL-2.0-only", ("GPL2_ONLY_GRANT",)),
    ("gpl", "GPL-3.0-text", ("FSF_VERBATIM", "GPL3_BODY")),
    ("gpl", "GPL-2.0-text", ("FSF_VERBATIM", "GPL2_BODY")),
    ("lgpl", "LGPL-2.1-or-later", ("LGPL21_GRANT", "LGPL_WARRANTY")),
    ("lgpl", "LGPL-3.0-or-later", ("LGPL3_GRANT", "LGPL_WARRANTY")),
    ("lgpl", "LGPL-3.0-text", ("FSF_VERBATIM", "LGPL3_BODY")),
    ("agpl", "AGPL-3.0-or-later", ("AGPL3_GRANT", "GPL_WARRANTY")),
    ("agpl", "AGPL-3.0-text", ("FSF_VERBATIM", "AGPL3_BODY")),
    ("bsd", "BSD-3-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("bsd", "BSD-2-Clause", ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY")),
    ("isc", "ISC", ("ISC_GRANT",)),
    ("epl", "EPL-1.0", ("EPL1_REF",)),
    ("zlib", "Zlib", ("ZLIB_WARRANTY", "ZLIB_GRANT")),
    ("bsl", "BSL-1.0", ("BSL1_GRANT",)),
    ("cc0", "CC0-1.0", ("CC0_WAIVER",)),
    ("unlicense", "Unlicense", ("UNLICENSE",)),
    ("wtfpl", "WTFPL", ("WTFPL_GRANT",)),
    ("reserved", "all-rights-reserved", ("ALL_RIGHTS",)),
)
REFERENCE_RULES = (
    ("mit", "MIT-reference", ("MIT_REF",)), ("apache", "Apache-2.0-reference", ("APACHE2_REF",)), ("gpl", "GPL-3.0-reference", ("GPL3_REF",)), ("gpl", "GPL-2.0-reference", ("GPL2_REF",)),
    ("lgpl", "LGPL-2.1-reference", ("LGPL21_REF",)), ("lgpl", "LGPL-3.0-reference", ("LGPL3_REF",)), ("agpl", "AGPL-3.0-reference", ("AGPL3_REF",)), ("bsd", "BSD-3-Clause-reference", ("BSD3_REF",)),
    ("bsd", "BSD-2-Clause-reference", ("BSD2_REF",)), ("mpl", "MPL-2.0", ("MPL2_REF",)), ("epl", "EPL-2.0", ("EPL2_REF",)), ("isc", "ISC-reference", ("ISC_REF",)), ("bsl", "BSL-1.0-reference", ("BSL1_REF",)),
    ("zlib", "Zlib-reference", ("ZLIB_REF",)), ("cc0", "CC0-1.0-reference", ("CC0_REF",)), ("cc", "CC-BY-NC-4.0", ("CC_BY_NC_REF",)), ("cc", "CC-BY-SA-4.0", ("CC_BY_SA_REF",)), ("cc", "CC-BY-4.0", ("CC_BY_REF",)),
)


def spdx_id(name: str) -> str:
    return "SPDX_" + re.sub("[^A-Z0-9]+", "_", name.upper())


def sentences() -> dict[str, str]:
    """Normal sentence -> identifier: texts, references by subject, verb and name, and SPDX lines."""
    out = {normal(t): i for i, t in TEXTS}
    for i, names in NAMES:
        for n in names:
            for s in SUBJECTS:
                for verb in VERBS:
                    out.setdefault(normal(s + verb + n), i)
    for _, name in SPDX:
        out[normal(f"SPDX-License-Identifier: {name}")] = spdx_id(name)
    return out


def rules() -> tuple:
    """Texts outrank SPDX lines, which outrank references."""
    return (*TEXT_RULES, *((f, n, (spdx_id(n),)) for f, n in SPDX), *REFERENCE_RULES)
