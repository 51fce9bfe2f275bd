import re

from skyloom.llm.licenses import BASE, WORDINGS, licenses, rules
from skyloom.llm.queries import op10_license_scan

SMALL = "/root/testdata/sf0.001"
KEYWORDS = [(r, re.compile(r.pattern)) for r in rules()]


def by_hand(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    line = f" {' '.join(words)} "
    found = []
    for r, p in KEYWORDS:
        if p.search(line):
            found += [(i, -(i + r.words), -r.priority, r.id, r) for i in range(len(words)) if p.fullmatch(" ".join(words[i : i + r.words]))]
    found.sort(key=lambda x: x[:4])
    base = [(i, r.label) for i, *_, r in found if r.base]
    labels, score = {x for _, x in base}, 0.9 if base else 0.0
    for n, (i, end, p, _, r) in enumerate(found):
        if not any(e <= end and q <= p for _, e, q, _, _ in found[:n]):
            labels.add(r.label)
            score = max(score, r.score)
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


def test_rules():
    assert len(rules()) > 300 and [r.pattern for r in rules() if r.base] == [p for p, *_ in BASE]
    assert all("(?:" not in r.pattern or re.compile(r.pattern).groups == 0 for r in rules())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = {r.doc_id: tuple(r)[1:] for r in op10_license_scan(spark, SMALL).collect()}
    assert rows == {d.doc_id: by_hand(d.text) for d in docs}


def test_odd_texts(spark):
    texts = {
        1: None, 2: "", 3: "!!", 4: "Under the MIT\nlicense; released under the MIT License.", 5: "CC-BY-NC cc by nc by nc", 6: "Released under CC-BY-NC-SA 4.0.",
        7: "Apache License, Version 2.0 (Apache license version 2)", 8: "SPDX-License-Identifier: BSD-3-Clause", 9: "under the mit licensé",
        10: "Licensed under the GNU General Public License, version 3. Terms of the Mozilla Public License", 11: "x" * 200_000 + " CC0",
        12: "Das ist mit der Lizenz under the mit license " * 150, 13: "under the K mit license", 14: "released under three clause BSD licences",
    }
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, label string, row int")
    rows = licenses(df.unionByName(df.where("doc_id = 5")).unionByName(df.where("doc_id = 5").selectExpr("null as doc_id", "text", "label", "row"))).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert got.pop(None) == got[5] and len(rows) == len(texts) + 2
    for k, t in texts.items():
        assert got[k] == by_hand(t), k
    assert got[6][5] == "cc-by-nc,cc-by-nc-sa" and got[8][6] == 1.0
    assert licenses(df.limit(0)).count() == 0


MIT = """Copyright (c) 2020 A. Person. Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."""
NOTICE = """# This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
# as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""


def test_wordings(spark):
    """Every sentence is found as it stands; longer ones suppress names within them."""
    plain = lambda p: re.sub(r"\(\?:(.*?)\|.*?\)|\[(.).*?\]|.\?", lambda m: m[1] or m[2] or m[0].rstrip("?"), p)
    wanted = [(label, keyword, text) for label, _, _, keyword, texts in WORDINGS for text in texts]
    assert len(wanted) > 100 and len({t for *_, t in wanted}) == len(wanted)
    assert all(w in text for _, keyword, text in wanted for w in keyword.split())
    texts = [plain(t).upper().replace(" ", ", ") for *_, t in wanted] + [MIT, NOTICE, "permission is hereby granted to sell the software, provided as is"]
    rows = {r.doc_id: tuple(r)[1:] for r in licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {i: by_hand(t) for i, t in enumerate(texts)}
    for i, (label, *_) in enumerate(wanted):
        assert label in rows[i][5].split(","), wanted[i]
    assert [rows[len(wanted) + k][5] for k in range(3)] == ["mit", "gpl-3", ""]
