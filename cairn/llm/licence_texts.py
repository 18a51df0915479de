"""Licence notices, as published: label, mandatory phrases, text. What stands in brackets or differs by user is left out."""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_HEAD = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published
by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GNU_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_CC = "This work is licensed under a Creative Commons {kind} {version} International License."

TEXTS = (
    ("mit", ("permission is hereby granted free of charge", "the software is provided as is"), f"{_MIT_GRANT} {_MIT_REST}"),
    ("mit", ("permission is hereby granted",), _MIT_GRANT),
    ("mit", ("permission is hereby granted",), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", ("mit license",), "Released under the MIT License."),
    ("mit", ("mit license",), "This project is licensed under the terms of the MIT License, see the LICENSE file for details."),
    ("isc", ("permission to use copy modify",), """Permission to use, copy, modify, and/or distribute this software for any purpose with
        or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
        OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2", ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce"), f"{_BSD_2} {_BSD_REST}"),
    ("bsd-3", ("redistribution and use in source and binary forms", "endorse or promote products"), f"{_BSD_2} {_BSD_3} {_BSD_REST}"),
    ("bsd-3", ("endorse or promote products",), f"{_BSD_2} {_BSD_3}"),
    ("zlib", ("provided as is without any express or implied warranty", "altered source versions"), """This software is provided 'as-is',
        without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you
        must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("bsl-1", ("boost software license",), "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at the Boost web site."),
    ("bsl-1", ("machine executable object code",), """Permission is hereby granted, free of charge, to any person or organization obtaining
        a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the
        above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
        part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor."""),
    ("unlicense", ("released into the public domain",), """This is free and unencumbered software released into the public domain. Anyone is
        free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means."""),
    ("unlicense", ("released into the public domain",), "This is free and unencumbered software released into the public domain."),
    ("wtfpl", ("you just do what the fuck you want to",), """Everyone is permitted to copy and distribute verbatim or modified copies of this
        license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND
        CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("0bsd", ("permission to use copy modify",), """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("apache-2", ("licensed under the apache license",), """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
        this file except in compliance with the License. You may obtain a copy of the License at the Apache web site. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License."""),
    ("apache-2", ("apache license",), "Licensed under the Apache License, Version 2.0."),
    ("apache-2", ("apache software foundation",), """Licensed to the Apache Software Foundation (ASF) under one or more contributor license
        agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF
        licenses this file to you under the Apache License, Version 2.0"""),
    ("gpl-2", ("gnu general public license", "either version 2"), _GNU_HEAD.format(name="General Public License", version=2)),
    ("gpl-3", ("gnu general public license", "either version 3"), _GNU_HEAD.format(name="General Public License", version=3)),
    ("gpl-3", ("gnu general public license",), "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", ("without even the implied warranty", "gnu general public license"), _GNU_REST.format(name="General Public License")),
    ("lgpl-2.1", ("gnu lesser general public license", "either version 2 1"), _GNU_HEAD.format(name="Lesser General Public License", version="2.1")),
    ("lgpl-3", ("gnu lesser general public license", "either version 3"), _GNU_HEAD.format(name="Lesser General Public License", version=3)),
    ("lgpl", ("without even the implied warranty", "gnu lesser general public license"), _GNU_REST.format(name="Lesser General Public License")),
    ("agpl-3", ("gnu affero general public license", "either version 3"), _GNU_HEAD.format(name="Affero General Public License", version=3)),
    ("agpl", ("without even the implied warranty", "gnu affero general public license"), _GNU_REST.format(name="Affero General Public License")),
    ("mpl-2", ("mozilla public license",), """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at the Mozilla web site."""),
    ("epl-2", ("eclipse public license",), """This program and the accompanying materials are made available under the terms of the Eclipse
        Public License 2.0 which accompanies this distribution, and is available at the Eclipse web site"""),
    ("cddl-1", ("common development and distribution license",), """The contents of this file are subject to the terms of the Common
        Development and Distribution License (the "License"). You may not use this file except in compliance with the License."""),
    ("ofl-1.1", ("sil open font license",), """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is
        available with a FAQ at the SIL web site."""),
    ("artistic-2", ("artistic license 2 0",), "This package is free software; you may redistribute it under the terms of the Artistic License 2.0 as published by the Perl Foundation."),
    ("postgresql", ("without a written agreement",), """Permission to use, copy, modify, and distribute this software and its documentation for
        any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this
        paragraph and the following two paragraphs appear in all copies."""),
    ("cc0-1", ("waived all copyright",), """To the extent possible under law, the author has waived all copyright and related or neighboring
        rights to this work, which is published under Creative Commons CC0 1.0 Universal."""),
    ("cc-by", ("creative commons attribution",), _CC.format(kind="Attribution", version="4.0")),
    ("cc-by-sa", ("attribution sharealike",), _CC.format(kind="Attribution-ShareAlike", version="4.0")),
    ("cc-by-nd", ("attribution noderivatives",), _CC.format(kind="Attribution-NoDerivatives", version="4.0")),
    ("cc-by-nc", ("attribution noncommercial 4",), _CC.format(kind="Attribution-NonCommercial", version="4.0")),
    ("cc-by-nc-sa", ("attribution noncommercial sharealike",), _CC.format(kind="Attribution-NonCommercial-ShareAlike", version="4.0")),
    ("cc-by-nc-nd", ("attribution noncommercial noderivatives",), _CC.format(kind="Attribution-NonCommercial-NoDerivatives", version="4.0")),
    ("cc-by", ("cc by 4 0",), "Licensed under CC BY 4.0."),
    ("cc-by-sa", ("cc by sa",), "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", ("cc by nc",), "Licensed under CC BY-NC 4.0."),
)
