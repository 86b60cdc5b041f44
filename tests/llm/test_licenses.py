import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rasterloom.llm import licenses as L
from rasterloom.llm import queries

from . import oracle

BSD = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:"
GPL = "/* This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU General Public\n * License as published by the Free Software Foundation, either\n * version 3 of the License, or (at your option) any later version. */"
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance\nwith the License.'
MPL = "This Source Code Form is subject to\nthe terms of the Mozilla Public\nLicense, v. 2.0. If a copy of it was not distributed, you can obtain one."
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
CODE = "\nimport os\nfor k in range(3):\n    print(k)\n"


@pytest.mark.parametrize("common", [False, True])
def test_wrapped(spark, common):
    texts = {"BSD-3-Clause": BSD + CODE, "GPL-3.0": CODE + GPL + CODE, "Apache-2.0": APACHE, "MPL-2.0": CODE + MPL, "MIT": MIT.replace("\n", " ")}
    rows = [(f"{k}/x.py", t, k) for k, t in texts.items()] + [("m/LICENSE", MIT, "MIT"), ("m/a/y.py", CODE, None)]
    prose = "the use of this and that in any form to you with or under" if common else "other prose"
    rows += [(f"p/{k}", f"{prose} {k}\nnothing else is said of it", None) for k in range(60)]
    found = {r.path: r for r in L.scan(spark.createDataFrame([x[:2] for x in rows], "path string, text string")).collect()}
    assert {p: found[p].own_license for p, _, _ in rows} == {p: k for p, _, k in rows}
    assert (found["m/a/y.py"].license, found["m/a/y.py"].licence_dir) == ("MIT", "m")


GNU = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version."
BSD_2 = BSD + """

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
CC = "This work is licensed under the Creative Commons Attribution{} {} International License."
CASES = [
    ("GPL-2.0", GNU.format("", "2")), ("GPL-3.0", GNU.format("", "3")), ("LGPL-3.0", GNU.format("Lesser ", "3")), ("LGPL-2.1", GNU.format("Lesser ", "2.1")), ("AGPL-3.0", GNU.format("Affero ", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", CC.format("", "4.0")), ("CC-BY-SA-4.0", CC.format("-ShareAlike", "4.0")), ("CC-BY-NC-4.0", CC.format("-NonCommercial", "4.0")), ("CC-BY-ND-4.0", CC.format("-NoDerivatives", "4.0")), (None, CC.format("-NonCommercial-ShareAlike", "4.0")), (None, CC.format("", "3.0")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-2-Clause", BSD_2), ("BSD-3-Clause", BSD_3), ("MIT", MIT), ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."),
    ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at"), ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (None, "This is not released under the MIT License."), (None, "This was never\nreleased under the MIT\nLicense."), ("MIT", "Released under the MIT License."), ("MIT", "como no.\nReleased under the MIT License."), ("Apache-2.0", APACHE), ("MPL-2.0", MPL),
]


def test_licences_that_differ_in_one_word(spark, tmp_path):
    rows = [(f"{k}/x.py", CODE + t + CODE) for k, (_, t) in enumerate(CASES)] + [(f"p/{k}", f"other prose {k}\nnothing else is said of it") for k in range(60)]
    found = {r.path: r.own_license for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [(found[f"{k}/x.py"], t) for k, (_, t) in enumerate(CASES)] == CASES


def test_same_as_sql_on_wrapped_texts(spark, tmp_path):
    texts = [CODE + t for _, t in CASES] + [t.replace("\n", " ") for _, t in CASES] + [None, "", "MIT", "licensed under the " * 30]
    pq.write_table(pa.table({"doc_id": [50 * k for k in range(len(texts))], "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "source": ["src0"] * len(texts)}), f"{tmp_path}/documents.parquet")
    oracle.same(queries.op6_license_scan(spark, str(tmp_path)), queries.oracle_sql()["op6_license_scan"], str(tmp_path))


def test_a_tie_of_licence_files_and_other_columns(spark):
    rows = [("d/LICENSE", "Released under the MIT License.", 1, "a", 0.5), ("d/COPYING", "Licensed under CC BY-NC 4.0.", 2, "b", 0.5), ("d/e/x.py", CODE, 3, "c", None)]
    df = spark.createDataFrame(rows, "path string, text string, __DIR int, Own_License string, license double")
    found = L.scan(df)
    assert found.columns == ["path", "__DIR", "own_license", "cosine", "license", "basis", "licence_dir"]
    got = {r.path: r for r in found.collect()}
    # both files match wholly, so the later name decides
    assert (got["d/e/x.py"].license, got["d/e/x.py"].basis, got["d/e/x.py"]["__DIR"]) == ("MIT", "directory", 3)
    assert L.scan(df.limit(0)).count() == 0
