"""Wording of public licences as templates, and the phrases of the base scan."""

#: Phrases (lower-case words) and their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the <<var;limit=3>>), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
substantial portions of the Software."""

MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL <<var;limit=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_THIRD = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;limit=15>> nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;limit=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL <<var;limit=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

#: Labels and templates of public licences and licence notices.
TEMPLATES = [
    ("mit", f"{MIT_GRANT} {MIT_WARRANTY}"),
    ("mit-grant", MIT_GRANT),
    ("bsd-2-clause", f"{BSD_OPENING} {BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{BSD_OPENING} {BSD_THIRD} {BSD_DISCLAIMER}"),
    (
        "isc",
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the <<var;limit=2>>); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at <<var;limit=12>> Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied.""",
    ),
    (
        "gpl-notice",
        """This program is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the
        GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License as published by
        the Free Software Foundation<<beginOptional>>, either version <<var;limit=2>> of the License, or (at your option) any later
        version<<endOptional>>""",
    ),
    (
        "cc-notice",
        """This work is licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>terms
        of the<<endOptional>> Creative Commons Attribution <<var;limit=6>> License""",
    ),
    ("mit-notice", "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("apache-notice", "Licensed under the Apache License, Version <<var;limit=1>> <<beginOptional>>0<<endOptional>>"),
    (
        "gpl-version",
        "This work is licensed under the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public License, version 3",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC <<var;limit=1>> <<beginOptional>>0<<endOptional>>"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("rights-notice", "All rights reserved. <<var;limit=10>> No part of this <<var;limit=4>> may be reproduced"),
]
