"""Whole licence texts, and texts whose marks are broken by white space or punctuation."""

import os

import pytest
from filigree.llm import license_scan

PUBLIC = "/usr/share/common-licenses"
NAMES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.license_id) for r in license_scan.scan(df).where("scope = 'text'").collect()}


@pytest.mark.skipif(not os.path.isdir(PUBLIC), reason="no licence texts on this machine")
def test_whole_licences(spark):
    texts = []
    for name in NAMES:
        with open(f"{PUBLIC}/{name}", encoding="utf-8") as f:
            texts.append(f.read())
    texts += [texts[0].upper().replace("\n", "\n\n"), texts[0] + " and more"]
    assert found(spark, texts) == {(k, i) for k, i in enumerate([*NAMES.values(), "Apache-2.0"])}


def test_marks_survive_canonicalisation(spark):
    texts = ["This work is in the public\ndomain.", "All rights  reserved.", "all\trights\nreserved", "All rights-reserved", "This work is in the public-domain.", "Licenced under the MIT licence", "nothing here", "", None]
    assert found(spark, texts) == {(0, "LicenseRef-public-domain"), (1, "LicenseRef-all-rights-reserved"), (2, "LicenseRef-all-rights-reserved"), (3, "LicenseRef-all-rights-reserved"), (4, "LicenseRef-public-domain"), (5, "MIT")}


def test_short_licences(spark):
    texts = [f"Copyright (c) 2020 Someone\n\n{license_scan._ZLIB}", f"{license_scan._UNLICENSE.format('http://unlicense.org')}\n", f"The MIT License (MIT)\nCopyright 1999 X Y\n{license_scan._MIT_BODY.lower()}", license_scan._MIT_0, license_scan._0BSD, license_scan._BSL]
    assert found(spark, texts) == {(0, "Zlib"), (1, "Unlicense"), (2, "MIT"), (3, "MIT-0"), (4, "0BSD"), (5, "BSL-1.0")}
