"""Places against a plain search, expressions against hand-made truth."""

import random
import re

from cohortspark.llm.license import BASE_PHRASES, PERMISSIVE, evaluate, identifiers, scan, scan_licenses, to_rpn

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_places(spark):
    rng = random.Random(1)
    parts = ["CC BY", "cc-by", "by cc", "General  Public\nLicense", "all rights", "All Rights Reserved.", "é", "reserved", "MIT License", "x1"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "cc by cc by", "cc by " * 30_000]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert scan_licenses(docs.limit(0)).count() == 0


def test_expressions():
    assert to_rpn("mit or apache-2.0 and isc") == ["mit", "apache-2.0", "isc", "and", "or"]
    assert to_rpn("(mit or gpl-2.0) and isc trailing words") == ["mit", "gpl-2.0", "or", "isc", "and"]
    assert to_rpn("gpl-2.0-only with classpath-exception-2.0 or mit") == ["gpl-2.0-only", "classpath-exception-2.0", "with", "mit", "or"]
    assert to_rpn("or mit") == [] and to_rpn("") == [] and to_rpn("(mit") == [] and to_rpn("mit) x") == ["mit"]
    assert evaluate(to_rpn("mit or gpl-3.0"), PERMISSIVE) and not evaluate(to_rpn("mit and gpl-3.0"), PERMISSIVE)
    assert identifiers(to_rpn("a with e or b and c")) == ["a", "b", "c"]


def test_labels():
    row = scan(b"// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND ISC\nint x;")
    assert row[5] == "gpl-2.0-only,isc,mit" and row[8] and row[6] > 0.9
    assert scan(b"Licensed under the Apache License, Version 2.0.")[5] == "apache,apache-2.0"
    assert scan(b"the art of public speaking")[5:7] == ("", 0.0)


def test_tags_and_identifiers():
    assert scan(b"SPDX-License-Identifier: MIT OR\n // Apache-2.0\nint x;")[5] == "apache-2.0,mit"
    assert scan(b"# SPDX-License-Identifier: (MIT\n#   OR Apache-2.0) AND ISC\nimport x")[5] == "apache-2.0,isc,mit"
    assert scan(b"SPDX-License-Identifier: DocumentRef-x:LicenseRef-y\nOR is the next word")[5] == "documentref-x:licenseref-y,is"
    assert scan(b"Name: x\nLicense: MIT\n")[5] == "mit" and scan(b"license: see the file LICENSE")[5] == ""
    assert scan(b'{"license": "BSL-1.0"}')[5] == "bsl-1.0" and scan(b"License: EUPL-1.2 OR GPL-3.0-or-later")[5] == "eupl-1.2,gpl-3.0-or-later"
    assert scan(b"Distributed under the Boost Software License and GPLv3")[5] == "bsl-1.0,gpl-3.0"
    assert scan(b"SPDX-License-Identifier:")[5] == "" and scan(b"SPDX-License-Identifier: OR\n")[5] == ""
