"""Standard notices and whole license texts, beside the one-line templates of license_scan.

Words of these are compared without ASCII punctuation at their edges, and words of
punctuation alone (comment marks, bullets) don't count. Relatives share most of their
words, so that a text may hold several; the greatest containment tells the nearest.
"""

from __future__ import annotations

from pathlib import Path

_GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
_MIT = """to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: (text, name). Lines with which files name their license, and notices that stand at their head.
NOTICES = (
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache-2.0"),
    ("licensed under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), " + _MIT, "mit"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    (_BSD, "bsd-2-clause"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3-clause"),
    *((_GNU.format(what="program", name="General Public License", version=v), f"gpl-{v}.0-or-later") for v in "23"),
    (_GNU.format(what="library", name="Lesser General Public License", version="2.1"), "lgpl-2.1-or-later"),
    (_GNU.format(what="library", name="Lesser General Public License", version="3"), "lgpl-3.0-or-later"),
    (_GNU.format(what="program", name="Affero General Public License", version="3"), "agpl-3.0-or-later"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl-2.0"),
)
_FILES = {"Apache-2.0": "apache-2.0", "GPL-2": "gpl-2.0", "GPL-3": "gpl-3.0", "LGPL-2.1": "lgpl-2.1", "LGPL-3": "lgpl-3.0", "MPL-2.0": "mpl-2.0", "CC0-1.0": "cc0-1.0", "Artistic": "artistic-1.0"}


def whole_texts() -> tuple:
    folder = Path(__file__).parent / "licenses"
    return tuple(((folder / file).read_text("utf-8"), name) for file, name in _FILES.items())
