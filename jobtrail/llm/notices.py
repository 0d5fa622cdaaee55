"""What licence scans look for besides the short notices: whole texts, standard headers, other wordings, SPDX tags."""

from __future__ import annotations

import re
from pathlib import Path

# Whole licence texts, by SPDX identifier; read on the driver only.
FOLDER = Path(__file__).parent / "license_texts"
# Texts up to this many terms are also looked for inside files, as permission notices above code.
EMBEDDED_TERMS = 400

GNU = ("This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published "
       "by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
       "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
       "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
GNU_NAMES = {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"),
             "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"),
             "AGPL-3.0": ("Affero General Public License", "3")}
CC_NAMES = {"CC-BY-4.0": ("BY", "Attribution"), "CC-BY-NC-4.0": ("BY-NC", "Attribution-NonCommercial"),
            "CC-BY-SA-4.0": ("BY-SA", "Attribution-ShareAlike")}
NAMED = {"Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
         "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "MIT": ["MIT License"],
         "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
         "CC0-1.0": ["CC0 1.0 Universal license"], "ISC": ["ISC License"]}

APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
          "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
          "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
          "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
          "governing permissions and limitations under the License.")
MPL = ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
       "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")
CC0 = ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
       "software to the public domain worldwide. This software is distributed without any warranty.")

# A window stands for a notice of up to so many terms only if it has the same ones of these, so that no licence passes
# for its neighbour; longer ones differ by more.
MARKED_TERMS = 16
MARKS = frozenset("""apache bsd mit isc mozilla mpl gnu gpl lgpl agpl affero lesser library general cc by nc nd sa cc0
    clause creative commons attribution noncommercial sharealike noderivatives noderivs eclipse artistic boost
    0 1 2 3 4""".split())

# Texts that no whole text above tells from their siblings; their titles do.
TITLES = {"gnu affero general public license version 3": "AGPL-3.0", "attribution 4 0 international": "CC-BY-4.0",
          "attribution noncommercial 4 0 international": "CC-BY-NC-4.0",
          "attribution sharealike 4 0 international": "CC-BY-SA-4.0"}
TITLED = {"CC-BY-SA-4.0"}
TITLE_TERMS = 40

TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")


def whole_texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(FOLDER.glob("*.txt"))}


def notices(templates: dict[str, str]) -> list[tuple[str, str]]:
    """Licence and text of every header, wording and short licence text, with the ``templates``."""
    out = list(templates.items())
    out += [(name, text) for name, text in (("Apache-2.0", APACHE), ("MPL-2.0", MPL), ("CC0-1.0", CC0))]
    named = dict(NAMED)
    for key, (name, version) in GNU_NAMES.items():
        out += [(key, GNU.format(thing=thing, name=name, version=version)) for thing in ("program", "library")]
        named[key] = [f"GNU {name}, version {version}", f"GNU {name} v{version}",
                      f"{''.join(w[0] for w in name.split())} version {version}", f"GNU {''.join(w[0] for w in name.split())}v{version}"]
    for key, (short, long) in CC_NAMES.items():
        named[key] = [f"CC {short} 4.0", f"a Creative Commons {long} 4.0 International License"]
    for key, names in named.items():
        out += [(key, f"{verb} the {name}") for name in names
                for verb in ("Licensed under", "Released under", "This file is distributed under", "under the terms of")]
    return out


def tagged(text: str) -> str | None:
    """The first licence an SPDX tag of the text names; GNU licences without ``-only`` and ``-or-later``."""
    for tag in TAG.finditer(text):
        for name in IDENTIFIER.findall(tag.group(1)):
            if name.upper() not in ("AND", "OR", "WITH"):
                return re.sub(r"(-only|-or-later|\+)$", "", name, flags=re.IGNORECASE)
    return None
