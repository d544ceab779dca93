"""Published headers and licence texts, as they stand in files: wrapped, in comments, with lines of their own between. By hand: the licence that a reader sees."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so{conditions}

{notice}THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY."""
NOTICE = """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
APACHE = """Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
BSD2 = """2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_ADS = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the University.
"""
BSD3 = """3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY {} "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
HOLDERS = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
GNU = """{} is free software{} you can redistribute it and/or modify
it under the terms of the GNU {} Public License{} as published by
the Free Software Foundation{}

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
LATER = "{} either version {} of the License, or\n(at your option) any later version."

TEXTS = [
    ("MIT:1", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + MIT.format(conditions=", subject to the following conditions:", notice=NOTICE)),
    ("MIT:1", "The MIT License (MIT)\n\n" + MIT.format(conditions=", subject to the following conditions:", notice=NOTICE).replace("\n", " ")),
    ("MIT-0:1", "MIT No Attribution\n\n" + MIT.format(conditions=".", notice="")),
    ("X11:1", MIT.format(conditions=", subject to the following conditions:", notice=NOTICE) + "\n\nExcept as contained in this notice, the name of the copyright holder shall not be\nused in advertising or otherwise to promote the sale, use or other dealings in\nthis Software without prior written authorization from the copyright holder."),
    ("NCSA:1", MIT.format(conditions=", subject to the following conditions:", notice="").replace("to deal\nin the", "to deal\nwith the")),
    ("Apache-2.0:1", "Copyright 2020 Somebody\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + APACHE),
    ("Apache-2.0:1", "Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements.  See the NOTICE file\ndistributed with this work for additional information\nregarding copyright ownership.  The ASF licenses this file\nto you under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License.  You may obtain a copy of the License at\n\n  https://www.apache.org/licenses/LICENSE-2.0\n\n" + APACHE),
    ("BSD-1-Clause:1", BSD + BSD_END.format(HOLDERS)),
    ("BSD-2-Clause:1", "BSD 2-Clause License\n\n" + BSD + BSD2 + BSD_END.format(HOLDERS)),
    ("BSD-3-Clause:1", BSD + BSD2 + BSD3.format("the copyright holder") + BSD_END.format(HOLDERS)),
    ("BSD-3-Clause:1", BSD + BSD2 + BSD3.format("Google Inc.") + BSD_END.format("THE REGENTS AND CONTRIBUTORS")),
    ("BSD-4-Clause:1", BSD + BSD2 + BSD_ADS + BSD3.replace("3.", "4.").format("the University") + BSD_END.format("THE REGENTS AND CONTRIBUTORS")),
    ("ISC:1", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS."),
    ("ISC:1", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("0BSD:1", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH\nREGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND\nFITNESS."),
    ("PostgreSQL:1", "Permission to use, copy, modify, and distribute this software and its\ndocumentation for any purpose, without fee, and without a written agreement\nis hereby granted, provided that the above copyright notice and this\nparagraph and the following two paragraphs appear in all copies."),
    ("Zlib:1", "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.\n2. Altered source versions must be plainly marked as such, and must not be\n   misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0:1", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the \"Software\") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:"),
    ("Unlicense:1", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."),
    ("CC0-1.0:1", "To the extent possible under law, the person who associated CC0 with\nthis work has waived all copyright and related or neighboring rights\nto this work."),
    ("WTFPL:1", "Everyone is permitted to copy and distribute verbatim or modified\ncopies of this license document, and changing it is allowed as long\nas the name is changed.\n\n           DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n  TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Beerware:1", "<me@example.org> wrote this file.  As long as you retain this notice you\ncan do whatever you want with this stuff. If we meet some day, buy me a beer."),
    ("GPL-2.0-or-later:1", GNU.format("This program", ";", "General", "", LATER.format(";", 2))),
    ("GPL-3.0-or-later:1", GNU.format("This program", ":", "General", "", LATER.format(", ".strip(), 3))),
    ("GPL-3.0-or-later:1", GNU.format("Some Other Tool", ":", "General", "", LATER.format(",", 3))),
    ("GPL-3.0-only:1", GNU.format("This program", ":", "General", "", ", version 3 of the License.")),
    ("GPL-3.0-only:1", GNU.format("This program", ":", "General", "", ", version 3.")),
    ("GPL-2.0-only:1", GNU.format("This program", ";", "General", " version 2", ".")),
    ("LGPL-2.1-or-later:1", GNU.format("This library", ";", "Lesser General", "", LATER.format(";", "2.1"))),
    ("LGPL-3.0-or-later:1", GNU.format("This library", ":", "Lesser General", "", LATER.format(",", 3))),
    ("LGPL-2.0-or-later:1", GNU.format("This library", ";", "Library General", "", LATER.format(";", 2))),
    ("AGPL-3.0-or-later:1", GNU.format("This program", ":", "Affero General", "", LATER.format(",", 3))),
    ("AGPL-3.0-only:1", GNU.format("This program", ":", "Affero General", "", ", version 3 of the License.")),
    ("MPL-2.0:1", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1:1", "The contents of this file are subject to the Mozilla Public License Version\n1.1 (the \"License\"); you may not use this file except in compliance with\nthe License."),
    ("CDDL-1.0:1", "The contents of this file are subject to the terms of the\nCommon Development and Distribution License (the \"License\").\nYou may not use this file except in compliance with the License."),
    ("EPL-2.0-reference:1", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0-reference:1", "All rights reserved. This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution."),
    ("OFL-1.1-reference:1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("Python-2.0:1", "PSF is making Python available to Licensee on an \"AS IS\"\nbasis."),
    ("Artistic-2.0-reference:1", "This library is distributed under the Artistic License 2.0."),
    ("CC-BY-4.0-reference:1", "This work is licensed under a Creative Commons Attribution 4.0\nInternational License."),
    ("CC-BY-SA-4.0-reference:1", "This work is licensed under the Creative Commons\nAttribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0-reference:1", "Some words\nLicensed under CC\nBY-NC 4.0."),
    ("CC-BY-NC-SA-4.0-reference:1", "Licensed under CC BY-NC-SA 4.0."),
    ("GPL-3.0-reference:1", "This work is licensed under the GNU General Public\nLicense, version 3."),
    ("GPL-2.0-reference:1", "Distributed under the terms of the GNU General Public License v2\n".replace("General Public License v2", "GPL v2")),
    ("GPL-3.0-or-later-reference:1", "// SPDX-License-Identifier: GPL-3.0-or-later\nint main() {}"),
    ("LGPL-2.1-only-reference:1", "# SPDX-License-Identifier: LGPL-2.1-only\nimport os"),
    ("MIT-reference:1", "/* SPDX-License-Identifier: MIT */\nint x;"),
    ("MIT-reference:1", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0-reference:1", "Released under the\nApache 2.0 license."),
    ("Apache-2.0-reference:1,BSD-3-Clause-reference:1", "Licensed under the Apache License, Version 2.0.\nReleased under the BSD 3-Clause License."),
    ("", "This file is not licensed under the MIT license."),
    ("", "Permission was granted to the visitors to enter the hall, provided that they wear shoes."),
]


def in_comment(text: str, lead: str) -> str:
    """The text as a comment of a source file, with code around it."""
    return "first line of code\n" + "\n".join(f"{lead} {line}".rstrip() for line in text.split("\n")) + "\n\nlast line of code\n"
