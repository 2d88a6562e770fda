"""Which licence a text names: a table of (text, licence), independent of the query's SQL."""

import pytest

from strandline.llm import licenses

BODY = "\n\nThe body goes on with many words that are of no licence, line after line,\nas such texts do.\n" * 30
NOTICE = "This {kind} is free software; you can redistribute it and/or modify it\nunder the terms of the GNU {name} Public License as published by\nthe Free Software Foundation; either version {version} of the License, or\n(at your option) any later version.\n"
#: Titles as licence files have them, and what else these files say.
NAMES = [
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n" + BODY + "13. Use with the GNU Affero General Public License.\n\nyou have permission to link a work licensed under version 3 of the GNU Affero General Public License into a single combined work\n", "GPL-3.0"),
    ("\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.\n" + BODY + NOTICE.format(kind="program", name="General", version="2"), "GPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989\n" + BODY, "GPL-1.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007\n\nThis version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.\n" + BODY, "LGPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n" + BODY + NOTICE.format(kind="library", name="Lesser General", version="2.1"), "LGPL-2.1"),
    ("GNU LIBRARY GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n" + BODY, "LGPL-2.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n" + BODY, "AGPL-3.0"),
    ("GNU Free Documentation License\nVersion 1.2, November 2002\n" + BODY, "GFDL-1.2"),
    ("MOZILLA PUBLIC LICENSE\nVersion 1.1\n\n---------------\n" + BODY, "MPL-1.1"),
    ("Mozilla Public License Version 2.0\n==================================\n" + BODY, "MPL-2.0"),
    ("Copyright (c) The Regents of the University.\nAll rights reserved.\n\n" + licenses.TEMPLATES["BSD-3-Clause"][0], "BSD-3-Clause"),
    ('The "Artistic License"\n\nPreamble\n\nThe intent of this document is to state the conditions under which a\nPackage may be copied, such that the Copyright Holder maintains some\nsemblance of artistic control over the development of the package,\n' + BODY, "Artistic-1.0"),
    ("# SPDX-License-Identifier: GPL-2.0-only\nx = 1\n", "GPL-2.0"),
    ("/* SPDX-License-Identifier: LGPL-2.1-or-later */\nint x;\n", "LGPL-2.1"),
    ("// SPDX-License-Identifier: AGPL-3.0-or-later\n", "AGPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
    ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Copyright 2020 Somebody. All rights reserved.", "Proprietary"),
    ("Released under the MIT License.\n" + NOTICE.format(kind="program", name="General", version="2") + BODY, "GPL-2.0"),
    ("We like licences, and software, and the public." + BODY, None),
]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"d{i}/{'LICENSE' if len(text) > 1000 else 'a.c'}", text) for i, (text, _) in enumerate(NAMES)]
    return {r["doc_id"]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, path string, text string")).collect()}


@pytest.mark.parametrize("i", range(len(NAMES)))
def test_named_rightly(named, i):
    assert named[i] == NAMES[i][1]
