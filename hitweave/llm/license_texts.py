"""The public licenses that the license scan knows, and the base phrases with their labels."""

from __future__ import annotations

import pkgutil

# The base phrases and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# Texts of public license notices.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    (
        "mit",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at",
    ),
    (
        "apache",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    (
        "bsd",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    (
        "mit",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("cc0", "This work is licensed under a Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

# Whole license texts, by file in texts/.
TEXTS = {
    "apache-2.0": "apache",
    "bsd-3-clause": "bsd",
    "cc0-1.0": "cc0",
    "gpl-2": "gpl",
    "gpl-3": "gpl",
    "lgpl-2.1": "lgpl",
    "lgpl-3": "lgpl",
    "mpl-2.0": "mpl",
}
# The names of licenses, as notices of one line give them after an opening.
NAMES = [
    ("agpl", "GNU Affero General Public License, version 3"),
    ("apache", "Apache License, Version 2.0"),
    ("artistic", "Artistic License 2.0"),
    ("boost", "Boost Software License, Version 1.0"),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "BSD 3-Clause License"),
    ("epl", "Eclipse Public License, Version 2.0"),
    ("gpl", "GNU General Public License, version 2"),
    ("gpl", "GNU General Public License, version 3"),
    ("isc", "ISC License"),
    ("lgpl", "GNU Lesser General Public License, version 2.1"),
    ("lgpl", "GNU Lesser General Public License, version 3"),
    ("mit", "MIT License"),
    ("mpl", "Mozilla Public License, version 2.0"),
    ("zlib", "zlib License"),
]
#: Openings shorter than a match that begins a chain: it holds a word of the name.
OPENINGS = ("Distributed under the", "Licensed under the", "Released under the")
# The Creative Commons licences.
_CC = {
    "cc-by": "Attribution",
    "cc-by-sa": "Attribution-ShareAlike",
    "cc-by-nd": "Attribution-NoDerivatives",
    "cc-by-nc": "Attribution-NonCommercial",
    "cc-by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "cc-by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}


def templates() -> list[tuple[str, str]]:
    """Label and text of everything that is searched for: notices, one-line forms by rule, whole licenses."""
    out = [*TEMPLATES, *((label, f"{opening} {name}") for label, name in NAMES for opening in OPENINGS)]
    out += [("cc0", f"{o.removesuffix(' the')} CC0 1.0") for o in OPENINGS]
    for label, name in _CC.items():
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            out += [(label, f"{o.removesuffix(' the')} CC {label[3:].upper()} {version}") for o in OPENINGS]
            out.append((label, f"This work is licensed under a Creative Commons {name} {version} {port} License"))
    for name, label in TEXTS.items():
        out.append((label, pkgutil.get_data(__package__, f"texts/{name}.txt").decode("utf-8")))
    return out
