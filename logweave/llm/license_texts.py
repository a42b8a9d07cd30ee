"""What texts say of their licence: public licence texts, headers, notices and tags, as (name, text)."""

from __future__ import annotations

# Titles by which licences are called.
TITLES = {
    "MIT": ("MIT License", "MIT/Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License", "Apache Software License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL version 3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL version 3"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "EPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"),
}
# What a title follows.
NOTICES = ("under the {}", "under the terms of the {}", "subject to the terms of the {}", "governed by the {}", "licensed {}", "license: {}")
# Parts of Creative Commons licences.
COMMONS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _long = "-".join(COMMONS[c] for c in _code.split("-"))
    for _n in ("3.0", "4.0"):
        TITLES[f"CC-{_code}-{_n}"] = (f"CC {_code} {_n}", f"Creative Commons {_long} {_n}")

# The wording of licences and of the headers that they ask for.
TEXTS = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither
the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "Zlib",
        """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
misrepresented; you must not claim that you wrote the original software.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    ),
    (
        "Apache-2.0",
        """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0""",
    ),
    *(
        (
            name,
            f"""you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version""",
        )
        for name, title, version in (
            ("GPL-2.0", "GNU General Public License", "2"),
            ("GPL-3.0", "GNU General Public License", "3"),
            ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
            ("LGPL-3.0", "GNU Lesser General Public License", "3"),
            ("AGPL-3.0", "GNU Affero General Public License", "3"),
        )
    ),
)
TEMPLATES = (
    *TEXTS,
    *((name, notice.format(title)) for name, titles in TITLES.items() for title in titles for notice in NOTICES),
    *((name, f"SPDX-License-Identifier: {name}") for name in TITLES),
)
