"""License texts and notices to look for.

Fixed values: wording of public licenses (whole text, the notice that goes into files, and lines of a few words). A label
may have several wordings. ``NAMES`` has the license's own name in each line of a few words, ``FAMILIES`` the labels whose
wordings differ in a word or a clause only.
"""

from strata_spark.llm.license_full_texts import FULL_TEXTS

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu_header(name: str, version: str, it: str = "program") -> str:
    return f"""This {it} is free software: you can redistribute it and/or modify it under the terms of the {name} as published
by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {it}
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""


#: Label and the license's own name, for lines such as "Released under the (name)".
_NAMED = (
    *[("MIT-notice", n) for n in ("MIT License",)],
    *[("Apache-2.0-notice", n) for n in ("Apache License Version 2.0", "Apache License 2.0", "Apache 2.0 License")],
    *[(f"{k}-{v}.0-notice", n) for k, g in (("GPL", "GNU"), ("LGPL", "GNU Lesser"), ("AGPL", "GNU Affero")) for v in (2, 3)
      if (k, v) in (("GPL", 2), ("GPL", 3), ("LGPL", 3), ("AGPL", 3)) for n in (
          f"{g} General Public License version {v}", f"{g} General Public License version {v}.0", f"{g} General Public License v{v}",
          f"{g} General Public License v{v}.0", f"GNU {k} version {v}", f"GNU {k} v{v}", f"{k} version {v}", f"{k} v{v} License",
          f"{k}v{v} License", f"{k} {v}.0 License")],
    *[("LGPL-2.1-notice", n) for n in ("GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1",
                                       "GNU LGPL version 2.1", "LGPL v2.1 License", "LGPLv2.1 License")],
    *[(f"BSD-{k}-Clause-notice", n) for k in (2, 3) for n in (f"BSD {k}-Clause License", f"{k}-Clause BSD License")],
    *[("MPL-2.0-notice", n) for n in ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v. 2.0")],
    *[("ISC-notice", n) for n in ("ISC License",)],
    *[("CC0-1.0-notice", n) for n in ("CC0 1.0 Universal", "CC0 1.0 license", "Creative Commons Zero v1.0 Universal")],
)
#: Parts of the Creative Commons licenses: label, long names.
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
       ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
#: Wording, label and own name of lines of a few words.
_LINES = (
    *[(f"Licensed under the {n}.", label, n) for label, n in _NAMED],
    *[(f"Licensed under CC {k} {v}.", f"CC-{k}-{v}-notice", f"CC {k} {v}") for k, _ in _CC for v in ("3.0", "4.0")],
    *[(f"This work is licensed under a Creative Commons {n} {v} {where} License.", f"CC-{k}-{v}-notice", f"Creative Commons {n} {v}")
      for k, n in _CC for v, where in (("3.0", "Unported"), ("4.0", "International"))],
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-notice", "GNU General Public License version 3"),
    ("This work is marked with CC0 1.0 Universal.", "CC0-1.0-notice", "CC0 1.0 Universal"),
)

TEMPLATES = (
    ("MIT", f"{_PERMISSION} {_AS_IS}"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0-header", _gnu_header("GNU General Public License", "2")),
    ("GPL-3.0-header", _gnu_header("GNU General Public License", "3")),
    ("LGPL-2.1-header", _gnu_header("GNU Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0-header", _gnu_header("GNU Lesser General Public License", "3")),
    ("AGPL-3.0-header", _gnu_header("GNU Affero General Public License", "3")),
    ("AGPL-3.0-section-13", """Notwithstanding any other provision of this License, if you modify the Program, your modified version
must prominently offer all users interacting with it remotely through a computer network (if your version supports such
interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding
Source from a network server at no charge, through some standard or customary means of facilitating copying of software."""),
    ("BSD-2-Clause", f"{_CLAUSES} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_CLAUSES} {_ENDORSE} {_BSD_AS_IS}"),
    ("MPL-2.0-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means."""),
    *FULL_TEXTS,
    *[(label, text) for text, label, _ in _LINES],
)
#: Own name by wording.
NAMES = {text: name for text, _, name in _LINES}
#: Of hits of one family at one place in a text only the best stays.
FAMILIES = ({"GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0-header", "AGPL-3.0-header"},
            {"BSD-2-Clause", "BSD-3-Clause"})
