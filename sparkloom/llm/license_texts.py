"""Known licences: identifiers and texts. Fixed values; the long ones are the files in license_bodies, as their publishers wrap them.

A text differs by title, list marks, wrapping (a line that starts with the word copyright is no part of the canonical
text), appendix and the publisher's address, so usual variants stand beside each.
"""

from __future__ import annotations

import re
from pathlib import Path

PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB_BODY = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

KNOWN: dict[str, str] = {
    "MIT": "MIT License\n\nCopyright (c) <year> <copyright holders>\n\n" + MIT_BODY,
    "MIT (without title)": "Copyright (c) <year> <copyright holders>\n\n" + MIT_BODY,
    "ISC": f"ISC License\n\nCopyright (c) <year> <holder>\n\n{PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{ISC_WARRANTY}",
    "0BSD": f"BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n{PERMISSION}.\n\n{ISC_WARRANTY}",
    "BSD-2-Clause": f"BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\nAll rights reserved.\n\n{BSD_GRANT}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n{BSD_WARRANTY}",
    "BSD-3-Clause": f"BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\nAll rights reserved.\n\n{BSD_GRANT}\n\n1. {BSD_1}\n\n2. {BSD_2}\n\n3. {BSD_3}\n\n{BSD_WARRANTY}",
    "Zlib": "zlib License\n\nCopyright (c) <year> <holder>\n\n" + ZLIB_BODY,
    "Zlib (without title)": "Copyright (c) <year> <holder>\n\n" + ZLIB_BODY,
    "Apache-2.0 (notice)": """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "MIT (line)": "Released under the MIT License.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
}

REGENTS = BSD_WARRANTY.replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR").replace("COPYRIGHT OWNER OR", "REGENTS OR")
END, APPENDIX = "END OF TERMS AND CONDITIONS", re.compile(r"\n[^\n]*(?:How to Apply These Terms to Your New|APPENDIX: How to apply the Apache|ADDENDUM: How to use this License|E(?:xhibit|XHIBIT) A -).*", re.S)
FRANKLIN, OLDER = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston, MA\s+02110-1301,?\s+USA"), {"59 Temple Place": "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave": "675 Mass Ave, Cambridge, MA 02139, USA"}


def unwrapped(text: str) -> str:
    """One line a paragraph."""
    return re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", text)


def bodies() -> dict[str, str]:
    """The long texts and their variants: without appendix, without the end mark, with an older address, unwrapped."""
    out = {}
    for path in sorted(Path(__file__).with_name("license_bodies").glob("*.txt")):
        name, text = path.stem, path.read_text("utf-8")
        own = {"": text}
        if APPENDIX.search(text):
            own["without appendix"] = APPENDIX.sub("", text)
        if END in text:
            own["without end mark"] = text[: text.index(END)]
        for key, address in OLDER.items():
            own |= {", ".join(filter(None, [k, key])): FRANKLIN.sub(address, t) for k, t in own.items() if FRANKLIN.search(t) and "Mass" not in k and "Temple" not in k}
        # unwrapped, an address at the top stands in the copyright line; these three have it in the appendix too
        told = OLDER if name in ("GPL-2.0", "LGPL-2.0", "LGPL-2.1") else ()
        own |= {", ".join(filter(None, [k, "unwrapped"])): unwrapped(t) for k, t in own.items() if name not in ("CC0-1.0", "Unlicense") and (k in told or not any(a in k for a in OLDER))}
        out |= {f"{name} ({k})" if k else name: t for k, t in own.items()}
    return out


def short() -> dict[str, str]:
    """Short texts under their other usual titles, or none, and with other list marks."""
    own = "Copyright (c) <year> <holder>\n\n"
    older = PERMISSION.replace("and/or", "and")
    notice = "provided that the above copyright notice and this permission notice appear in all copies."
    out = {f"MIT ({t})": f"{t}\n\n{own}{MIT_BODY}" for t in ("The MIT License", "The MIT License (MIT)")}
    for t in ("", "ISC License", "The ISC License", "ISC License (ISC)"):
        out |= {f"ISC ({t or 'without title'}{k})": f"{t}\n\n{own}{p}, {notice}\n\n{ISC_WARRANTY}" for k, p in (("", PERMISSION), (", and distribute", older))}
    out |= {f"0BSD ({t or 'without title'})": f"{t}\n\n{own}{PERMISSION}.\n\n{ISC_WARRANTY}" for t in ("", "Zero-Clause BSD")}
    out["Zlib (The zlib License)"] = f"The zlib License\n\n{own}{ZLIB_BODY}"
    regents_3 = BSD_3.replace("the copyright holder", "the University")
    for name, titles, parts, warranty in (
        ("BSD-2-Clause", ("", "BSD 2-Clause License", "The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License"), (BSD_1, BSD_2), BSD_WARRANTY),
        ("BSD-3-Clause", ("", "BSD 3-Clause License", "The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License"), (BSD_1, BSD_2, BSD_3), BSD_WARRANTY),
        ("BSD-3-Clause, University", ("",), (BSD_1, BSD_2, regents_3), REGENTS),
    ):
        for t in titles:
            for k, marks in (("", "123"), (", bullets", "***")):
                out[f"{name} ({t or 'without title'}{k})"] = "\n\n".join([t, own, BSD_GRANT, *[f"{m}{'' if m == '*' else '.'} {x}" for m, x in zip(marks, parts)], warranty])
    return {k: v for k, v in out.items() if k not in ("ISC (ISC License)", "BSD-2-Clause (BSD 2-Clause License)", "BSD-3-Clause (BSD 3-Clause License)")}


KNOWN |= short() | bodies()
