"""Known licences by SPDX identifier (or identifier and form): texts of short ones and of notices, digests of long ones."""

_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_BSD_THREE = _BSD_TWO + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_REGENTS = f"{_BSD_TWO}\n3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _WARRANTY_BSD.replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR")

KNOWN: dict[str, str] = {
    "MIT": _MIT,
    "MIT (titled)": "MIT License\n\n" + _MIT,
    "MIT (The, titled)": "The MIT License (MIT)\n\n" + _MIT,
    "MIT (notice)": "Released under the MIT License.",
    "BSD-2-Clause": f"{_BSD_TWO}\n{_WARRANTY_BSD}",
    "BSD-2-Clause (titled)": f"BSD 2-Clause License\n\n{_BSD_TWO}\n{_WARRANTY_BSD}",
    "BSD-3-Clause": f"{_BSD_THREE}\n{_WARRANTY_BSD}",
    "BSD-3-Clause (titled)": f"BSD 3-Clause License\n\n{_BSD_THREE}\n{_WARRANTY_BSD}",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "ISC (titled)": f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "0BSD": f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}",
    "0BSD (titled)": f"BSD Zero Clause License\n\n{_ISC_GRANT}.\n\n{_ISC_WARRANTY}",
    "Unlicense": _UNLICENSE,
    "Zlib": _ZLIB,
    "Zlib (titled)": "zlib License\n\n" + _ZLIB,
    "Apache-2.0 (notice)": _APACHE_NOTICE,
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST,
    "BSL-1.0 (untitled)": _BOOST,
    "BSD-3-Clause (regents)": _BSD_REGENTS,
}

#: md5 of the canonical form (licenses.canonical) of the licences' published texts, whole and without what follows their terms.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "46c5873a18595cb4528bc1040715fdcb",
    "Apache-2.0 (terms)": "a113de1ddc235b81140ac33ceccc4edb",
    "Apache-2.0 (terms, no end mark)": "ed7cd2d94d2445641bbe005972e8bd2c",
    "Artistic-1.0-Perl": "1ba7bd13be043105f565e2954ed1c30a",
    "CC0-1.0": "33b60d2bcc436a336d1830b3b1c03687",
    "GFDL-1.2": "87ec2f03f2a1bdc556727513e2615c68",
    "GFDL-1.2 (no addendum)": "246de2305e988a06773c52f8b3af0960",
    "GFDL-1.3": "95a1ed22a3b9076185b9d7b0e2fe7fa1",
    "GFDL-1.3 (no addendum)": "e49647c1439036af40c6e9aff6dc23ce",
    "GPL-1.0": "d2f44e30b003b30174e5dc8825fcd0b9",
    "GPL-1.0 (terms)": "906761728851549b2aabdd20795ea046",
    "GPL-1.0 (terms, no end mark)": "022b47454d400ad4acc064c32a271b57",
    "GPL-2.0": "a8d0ebec2d5a658459b131eeedf94611",
    "GPL-2.0 (terms)": "e4aef4b8d3b95ff6d8db7f09257f5916",
    "GPL-2.0 (terms, no end mark)": "25c2ff5ccc60117e70956f7af347351f",
    "GPL-3.0": "afb6846abf24d0b51c49340985ebf3c5",
    "GPL-3.0 (terms)": "a9cb5137b6d7db06463d7ec6d39e1fc4",
    "GPL-3.0 (terms, no end mark)": "38a60ce66da83de7216d288c941d4450",
    "LGPL-2.0": "289b8c8abd5a8204301d2d50f8e715e1",
    "LGPL-2.0 (terms)": "ca593525ffc8b053f6551e0f7bc36897",
    "LGPL-2.0 (terms, no end mark)": "f0505109f086078adcab98a1dfc551c0",
    "LGPL-2.1": "dacc1a6026025becbf022dd1ad568b9c",
    "LGPL-2.1 (terms)": "94b19caf74c8cee6d52baed78f6c4849",
    "LGPL-2.1 (terms, no end mark)": "d250b912f3e7fa950d8b643e4bc9ecd0",
    "LGPL-3.0": "45ec14853d944805ef573d0b3a40cda3",
    "MPL-1.1": "3a4e6f19977adf5be64de6b71cda6e8a",
    "MPL-2.0": "d3531cab9bbce919d7d482d36f2ea222",
    "MPL-2.0 (no exhibits)": "ee3f830d24ce0cbfc588727c1bd2a762",
}
