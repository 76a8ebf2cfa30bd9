"""Licence texts as published, with their own line breaks, headings, blank lines and comment marks."""

import pytest

from wakeline.llm import license_scan

MIT = """MIT License

Copyright (c) 2024 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
BSD3 = """BSD 3-Clause License

Copyright (c) 2024, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
APACHE2 = """Copyright 2024 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL3 = """<one line to give the program's name and a brief idea of what it does.>
Copyright (C) 2024  Some Body

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE2_IDS = "apache2.licensed,apache2.copy,apache2.basis,apache2.see"
GPL3_IDS = "gpl3.free,gpl3.hope,gpl3.details"
COMMENTED = "/*\n" + "".join(f" * {line}".rstrip() + "\n" for line in APACHE2.splitlines()) + " */\nint main;\n"
CASES = [
    (MIT, "mit.grant,mit.notice", "MIT", "allow"),
    (MIT.replace("\n", "\r\n"), "mit.grant,mit.notice", "MIT", "allow"),
    (" ".join(MIT.split()).replace("Body Perm", "Body. Perm"), "mit.grant,mit.notice", "MIT", "allow"),
    (BSD3, "reserved,bsd3.use", "BSD-3-Clause", "allow"),
    (APACHE2, APACHE2_IDS, "Apache-2.0", "allow"),
    (COMMENTED, APACHE2_IDS, "Apache-2.0", "allow"),
    ("".join(f"# {line}\n" for line in GPL3.splitlines()), GPL3_IDS, "GPL-3.0-or-later", "deny"),
    (GPL3, GPL3_IDS, "GPL-3.0-or-later", "deny"),
    ("Terms:\n  a) This work is\n     licensed under the GNU General Public\n     License, version 3", "gpl3.short", "GPL-3.0", "deny"),
    ("x" * 5000 + "\n" + " " * 5000 + "All" + "\n" * 2000 + "rights reserved", "reserved", "Proprietary", "deny"),
    ("It is not licensed under the MIT License. Nor are all rights reserved by us", "", None, "none"),
    ("Permission is hereby granted. Free of charge, to any person", "", None, "none"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_published_texts(spark, k):
    text, identifiers, licence, verdict = CASES[k]
    r = license_scan.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.identifiers, r.licence, r.verdict) == (identifiers, licence, verdict)
