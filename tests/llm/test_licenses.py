"""Licences: names, full texts, headers, denials and expressions."""

import pytest

from chunkwell.llm import license_scan

NAMED = {
    "Apache-2.0": "the Apache License, Version 2.0", "Apache-1.1": "the Apache Software License, Version 1.1", "MIT": "the MIT License", "MIT-0": "the MIT No Attribution License", "X11": "the X11 License", "0BSD": "the Zero-Clause BSD License",
    "BSD-4-Clause": "the original BSD license", "BSD-3-Clause": "the 3-Clause BSD License", "BSD-2-Clause": "the simplified BSD license", "ISC": "the ISC License", "Zlib": "the zlib License", "BSL-1.0": "the Boost Software License, Version 1.0",
    "Artistic-2.0": "the Artistic License 2.0", "Artistic-1.0": "the Artistic License", "EPL-2.0": "the Eclipse Public License 2.0", "EPL-1.0": "the Eclipse Public License - v 1.0", "MPL-2.0": "the Mozilla Public License, v. 2.0", "MPL-1.1": "the Mozilla Public License Version 1.1",
    "CDDL-1.0": "the Common Development and Distribution License", "CDDL-1.1": "the Common Development and Distribution License (CDDL) version 1.1", "CPL-1.0": "the Common Public License 1.0", "EUPL-1.2": "the European Union Public Licence v. 1.2", "EUPL-1.1": "the EUPL 1.1 licence", "Unlicense": "the Unlicense",
    "WTFPL": "the WTFPL, a license", "MS-PL": "the Microsoft Public License (Ms-PL)", "MS-RL": "the Microsoft Reciprocal License", "Python-2.0": "the Python Software Foundation License", "PostgreSQL": "the PostgreSQL License", "OFL-1.1": "the SIL Open Font License, Version 1.1",
    "OpenSSL": "the OpenSSL License", "AFL-3.0": "the Academic Free License version 3.0", "OSL-3.0": "the Open Software License v. 3.0", "ECL-2.0": "the Educational Community License, Version 2.0", "NCSA": "the University of Illinois/NCSA Open Source License", "PHP-3.01": "the PHP License, version 3.01",
    "UPL-1.0": "the Universal Permissive License (UPL), Version 1.0", "Ruby": "the Ruby license", "Vim": "the Vim License", "Sleepycat": "the Sleepycat License", "Beerware": "the Beer-Ware License", "LPPL-1.3c": "the LaTeX Project Public License", "ODbL-1.0": "the Open Database License (ODbL)", "CC0-1.0": "CC0 1.0",
    "GPL-2.0-only": "the GNU General Public License, version 2", "GPL-2.0-or-later": "the GNU General Public License v2 or later", "GPL-3.0-only": "the GNU GPL version 3", "GPL-3.0-or-later": "the GPLv3+", "LGPL-2.1-only": "the GNU Lesser General Public License, version 2.1", "LGPL-3.0-or-later": "the GNU Lesser General Public License, version 3 or any later version",
    "AGPL-3.0-only": "the GNU Affero General Public License, version 3", "AGPL-3.0-or-later": "the AGPL-3.0+", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-3.0": "the Creative Commons Attribution-ShareAlike 3.0 license", "CC-BY-ND-4.0": "CC BY-ND 4.0", "CC-BY-NC-SA-4.0": "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
}

LEAD = "With thanks to everybody who has ever sent us a patch, a question or a postcard over these many years, the whole of this project and all of its parts "


@pytest.mark.parametrize("name", sorted(NAMED))
def test_names(name):
    for text in (f"Licensed under {NAMED[name]}.", f"This project is licensed under {NAMED[name]} - see the LICENSE file for details.", f"{LEAD}are released under the terms of {NAMED[name]}.", f"x | y\n * It is distributed under {NAMED[name]}, see below"):
        assert license_scan.scan(text)[0] == [name], text
    for text in (f"This is not licensed under {NAMED[name]}.", f"It isn't released under {NAMED[name]}.", f"It is no longer distributed under {NAMED[name]}."):
        assert license_scan.scan(text)[0] == [], text


ASIS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT\nLIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR\nOTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE.'
BSD = """Copyright (c) 2001, A. U. Thor. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GNU = """    This {what} is free software{mark} you can redistribute it and/or modify
    it under the terms of the GNU {name} License as published by
    the Free Software Foundation{mark2} either version {version} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {name} License for more details.
"""

FULL = [
    ("MIT", f'MIT License\n\nCopyright (c) 2020 A. U. Thor\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n{ASIS}\n'),
    ("BSD-2-Clause", BSD.format(more="")), ("BSD-3-Clause", BSD.format(more=ENDORSE)),
    ("ISC", 'Copyright (c) 2004 A. U. Thor\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY\nAND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,\nINDIRECT, OR CONSEQUENTIAL DAMAGES.\n'),
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.\n2. Altered source versions must be plainly marked as such, and must not be\n   misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.\n"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\nexecute, and transmit the Software, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including\nthe above license grant, must be included in all copies of the Software, in\nwhole or in part.\n"),
    ("Apache-2.0", '   Licensed under the Apache License, Version 2.0 (the "License");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0\n\n   Unless required by applicable law or agreed to in writing, software\n   distributed under the License is distributed on an "AS IS" BASIS,\n   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n   See the License for the specific language governing permissions and\n   limitations under the License.\n'),
    ("GPL-3.0-or-later", GNU.format(what="program", mark=":", mark2=",", name="General Public", version="3")), ("GPL-2.0-or-later", GNU.format(what="program", mark=";", mark2=";", name="General Public", version="2")),
    ("LGPL-2.1-or-later", GNU.format(what="library", mark=";", mark2=";", name="Lesser General Public", version="2.1")), ("AGPL-3.0-or-later", GNU.format(what="program", mark=":", mark2=",", name="Affero General Public", version="3")),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.\n"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.\n"),
]


@pytest.mark.parametrize(("name", "text"), FULL, ids=[n for n, _ in FULL])
def test_full_texts_in_other_text_and_in_comments(name, text):
    assert license_scan.scan(text)[0] == [name]
    assert license_scan.scan(f"Some prose before.\n\n{text}\nSome prose behind it. And more.")[0] == [name]
    if not text.startswith("/*"):
        assert license_scan.scan("".join(f"# {line}\n" for line in text.split("\n")))[0] == [name]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("// SPDX-License-Identifier: gpl-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0-or-later WITH Classpath-exception-2.0"]), ("/* SPDX-License-Identifier: (MIT OR apache-2.0) */", ["(MIT OR Apache-2.0)"]),
        ("# SPDX-License-Identifier: LicenseRef-Own", ["LicenseRef-Own"]), ("the museum has dedicated to the public domain a small garden.", []), ("This work is dedicated to the public domain.", ["CC0-1.0"]), ("This work is not dedicated to the public domain.", []),
        ("Licensed under the MIT License or, at your option, something else.\nLicensed under the ISC License.\nLicensed under the MIT License.", ["MIT", "ISC"]), ("Admitted under the licence of the summit.", []), ("y" * 300_000 + " is licensed under the MIT License.", ["MIT"]),
    ],
)
def test_expressions_and_other_sentences(text, expected):
    assert license_scan.scan(text)[0] == expected


def test_scan_of_the_table_finds_every_planted_phrase(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    planted = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: set(r["licenses"]) for r in license_scan.license_scan(docs).collect()}
    assert got == {i: {name for phrase, name in planted.items() if phrase in t} for i, t in texts.items()}
