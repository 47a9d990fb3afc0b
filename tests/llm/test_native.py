"""Personal data, mixing and licences: DataFrame operators against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import licenses, mixing, pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    return sum(int(c) if i % 2 == 0 else int("0246813579"[int(c)]) for i, c in enumerate(reversed(x))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


TEXTS = [
    "write a@b.com_x@y.zz or me.you@mail.example.org, a@b c@d. @x.y",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 9.9.9",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 then 5500000000000004 00000000000000000000 4111 1111 1111 1111 2",
    "call +1 (487) 555-7209 or +44.20.7946.0958, +1 2, +123456789012345678",
    "日本 é +49 30 1234567 — x@é.com é@x.com a@x.comé 12.34.56.78",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33; account DE89370400440532013000",
    "", None, "5" * 5000, "a" * 5000 + "@", "@" * 300, "+" * 300, "1.1." * 400, "a@b.c" * 300, "\n1.1.1.1\n",
]


def test_pii_spans(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, pii string")
    got = {r["doc_id"]: r for r in pii.digest(rows).collect()}
    for i, t in enumerate(TEXTS):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert got[i]["n_email"] == sum(w.startswith("email") for w in want)
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("iban")] == want
    assert got[5]["spans"].count("iban") == 2


def test_pii_redact_and_score(spark, docs, nothing):
    rows = spark.createDataFrame([(0, "pay by card 4111 1111 1111 1111 or mail a@b.com", 9), (1, None, None), (2, "clean", 5)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in pii.redact(rows).collect()}
    assert out[0]["text"] == "pay by card <card> or mail <email>" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[1]["text"] is None and out[2]["text"] == "clean"
    assert [round(s["score"], 1) for s in pii.find(rows).where("doc_id = 0").first()["pii"]] == [1.0, 0.9]
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == docs.count()
    assert pii.digest(nothing).count() == 0


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_mixing_targets(docs, nothing):
    rows = mixing.mix(docs).collect()
    size = defaultdict(int)
    for r in docs.collect():
        size[r["source"]] += words(r["text"])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(size)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= over
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(r["copies"])
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
    assert len(rows) == docs.count()
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert mixing.mix(nothing).count() == 0


def test_mixing_positions_follow_the_schedule(docs):
    """Each source's words run through its schedule: the share of demand up to a copy's middle is the integral up to its position."""
    got = mixing.ordered(docs).collect()
    placed = [r for r in got if r["position"] is not None]
    assert got == placed + [r for r in got if r["taken"] == 0] and [r["position"] for r in placed] == sorted(r["position"] for r in placed)
    rows = mixing.mix(docs).collect()
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s))
    for k, source in enumerate(names):
        a, b = mixing.SCHEDULES[k % 3 % len(mixing.SCHEDULES)]
        copies = sorted((p, w) for r in rows if r["source"] == source for p, w in zip(r["positions"], r["copies"], strict=True))
        goal, done = sum(w for _, w in copies), 0
        for p, w in copies:
            assert (a * p + (b - a) * p * p / 2) / ((a + b) / 2) == pytest.approx(min(1.0, (done + w / 2) / goal), abs=1e-9)
            done += w


def test_stages_keep_columns_of_any_name(spark, docs):
    names = ["pii", "size", "source_size", "target", "taken", "copies", "positions", "position", "_doc", "_position", "_pii_email", "kind"]
    odd = docs.select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for stage in (pii.redact, mixing.curriculum):
        out = stage(odd)
        assert out.columns == odd.columns and {tuple(r[3:]) for r in out.collect()} == {tuple(range(len(names)))}


def test_mixing_order_and_reruns(docs):
    first, again = mixing.curriculum(docs), mixing.curriculum(docs.repartition(7))
    key = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    assert key(first) == key(again) and first.columns == docs.columns
    assert sum(words(t) for _, t in key(first)) == sum(r["taken"] for r in mixing.mix(docs).collect())


def test_schedule_inverts():
    for a, b in mixing.SCHEDULES:
        for t in (0.0, 0.3, 1.0):
            x = (a * t + (b - a) * t * t / 2) / ((a + b) / 2)
            y = x * (a + b) / 2
            assert (y / a if a == b else ((a * a + 2 * (b - a) * y) ** 0.5 - a) / (b - a)) == pytest.approx(t)


def test_licenses(spark, docs, nothing):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy.\nThe above copyright notice and this permission notice shall be included.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    texts = [mit, "x. Licensed under the Apache License, Version 2.0. y", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "the license plate", None, "", mit + "\n" + mit]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(8)] == ["MIT", "Apache-2.0", "MIT,CC-BY-NC", "GPL-3.0", "", "", "", "MIT"]
    assert got[0]["n_sentences"] == 3 and got[0]["identifiers"] == "<mit_grant><mit_notice><as_is>"
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0


def test_licenses_wrapped_and_dual(spark):
    texts = {
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above\ncopyright notice.": "BSD-2-Clause",
        "Copyright (c) 2020 A\n\nPermission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that": "ISC",
        " * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or later.": "GPL-3.0",
        "You can modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.": "GPL-2.0",
        "Licensed under the MIT License or the Apache License, Version 2.0.": "MIT,Apache-2.0",
        "// SPDX-License-Identifier: MIT OR Apache-2.0\nint main;": "MIT,Apache-2.0",
        "// SPDX-License-Identifier: GPL-2.0 or later\nint main;": "GPL-2.0",
        "by A\nCopyright 2020 A\nAll rights reserved": "All-Rights-Reserved",
        "Licensed under the GNU General Public License, version 2, or the MIT License.": "GPL-2.0,MIT",
        "Licensed under the Apache License, Version 2.0. Distributed on an \"AS IS\" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.": "Apache-2.0",
    }
    more = {
        "Released under CC0 1.0.": "CC0",
        "Available under CC BY-SA 4.0 from us.": "CC-BY-SA",
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License": "LGPL-2.1",
        "Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license": "BSL-1.0",
        "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications": "Zlib",
        "Redistribution and use in source and binary forms, with or without modification,\nare permitted.\n\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above\n   copyright notice.\n3. Neither the name of the holder nor the names of its\n   contributors may be used to endorse or promote products.\n\nTHIS SOFTWARE IS PROVIDED BY THE HOLDERS \"AS IS\" AND\nANY EXPRESS OR IMPLIED WARRANTIES": "BSD-3-Clause",
        "under the terms of the GNU Affero General Public License as published by us,\neither version 3 of the License.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY.\n\nYou should have received a copy of the GNU Affero General Public License": "AGPL-3.0",
        "dedicated to the public\n * domain": "Public-Domain",
    }
    texts |= more
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {t: set(got[i]["licenses"].split(",")) for i, t in enumerate(texts)} == {t: set(w.split(",")) for t, w in texts.items()}
    assert got[9]["identifiers"] == "<apache2><apache_basis>"


def _texts(pattern, last):
    """A text that a pattern fits: its first or last alternatives, without or with its options."""
    p = pattern.replace("^", "").replace("$", "").replace(r"\b", "").replace(".*", "some words ").replace("[0-9]{4}", "2020").replace("http ", "http ")
    while (g := re.search(r"\(([^()]*)\)(\?|\+)?", p)) is not None:
        inner = g[1].split("|")[-1 if last else 0]
        p = p[: g.start()] + ("" if g[2] == "?" and not last else inner) + p[g.end() :]
    return re.sub(r"(.)\?", r"\1" if last else "", p)


def test_hint_is_in_every_sentence(spark):
    """The gate passes whatever a pattern fits, in any case of letters, and such a text is found."""
    made = [(n, _texts(p, last)) for n, p in licenses.SENTENCES for last in (False, True)]
    for (n, p), (_, text) in zip([x for x in licenses.SENTENCES for _ in (0, 1)], made, strict=True):
        assert re.search(p, text), (n, text)
        assert re.search(licenses.HINT, text) and re.search(licenses.HINT, text.upper()), (n, text)
    rows = spark.createDataFrame([(i, t.replace("spdx license identifier ", "SPDX-License-Identifier: ")) for i, (_, t) in enumerate(made)], "doc_id long, text string")
    got = {r["doc_id"]: r["identifiers"] for r in licenses.scan(rows).collect()}
    assert [made[i] for i, found in got.items() if not found] == []


def test_licenses_denied_short_and_far(spark):
    far = "and words of no weight " * 40
    header = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"
    texts = {
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
        "The origin of this software must not be misrepresented": "Zlib",
        "Distributed under the MIT license.": "MIT",
        "This project is under the MIT License.": "MIT",
        "SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0",
        "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "SPDX-License-Identifier: ISC": "ISC",
        "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
        "// SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause": "GPL-2.0,BSD-3-Clause",
        "SPDX-License-Identifier: MIT AND Zlib AND Unlicense": "MIT,Zlib,Unlicense",
        "This software is not licensed under the MIT License.": "",
        "It is no longer distributed under the GNU General Public License, version 2, it is licensed under the MIT License.": "MIT",
        header: "Apache-2.0",
        f"Licensed under the MIT License, {far} or the Apache License, Version 2.0.": "MIT,Apache-2.0",
        "read this under the mit license plate": "",
        "word " * 200_000 + "\nReleased under the MIT License.": "MIT",
    }
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, identifiers string, licenses string")
    got = {r["doc_id"]: r for r in licenses.scan(rows).collect()}
    assert {t[:80]: set(got[i]["licenses"].split(",")) for i, t in enumerate(texts)} == {t[:80]: set(w.split(",")) for t, w in texts.items()}
    assert got[12]["identifiers"] == "<apache2><apache_copy><apache_basis>"


def test_pii_of_very_many_matches(spark):
    """More matches than a block of blocks: places and redaction are those of plain Python."""
    text = " ".join(f"é{i} u{i}@ex{i % 7}.org 10.0.{i % 256}.{i // 256} x" for i in range(3000))
    df = spark.createDataFrame([(1, text, len(text), "a"), (2, None, 0, "b")], "doc_id long, text string, n_chars long, pii string")
    found = {r["doc_id"]: r["pii"] for r in pii.find(df).collect()}
    for kind in ("email", "ip"):
        want = [(m.start(), m.end()) for m in re.finditer(PATTERNS[kind], text)]
        assert [(s["start"], s["end"]) for s in found[1] if s["kind"] == kind] == want and len(want) == 3000
    assert found[2] == []
    kept = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert kept[1]["text"] == " ".join(f"é{i} <email> <ip> x" for i in range(3000)) and kept[1]["n_chars"] == len(kept[1]["text"]) and kept[2]["text"] is None
