from pyspark.sql import functions as F

from pointlens.llm import licenses
from pointlens.llm.licenses import scan
from pointlens.llm.queries import op7_license_scan

LINES = {
    "cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.", "proprietary": "All rights reserved.",
}


def test_query_finds_all_license_lines(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op7_license_scan(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.licenses == ",".join(sorted(k for k, v in LINES.items() if v in texts[r.doc_id])) and r.n_unknown == 0


def test_held_out_forms_and_edges(spark):
    rows = [
        (1, "Some text here.\nthis project is licensed under the apache license version 2.0, see below"), (2, "Copyright 2019 Jane. Released under the MIT license"),
        (3, "This story is about rights, a licence to drive and general public opinion under the sun."), (4, None), (5, ""), (5, ""), (None, "Licensed under CC BY-SA 4.0."), (6, "All rights reserved.\n" * 3),
        (7, "word " * 50000 + "\nReleased under the BSD 3-Clause License."),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licenses string")
    found = sorted(((r.doc_id, r.licenses, r.n_licensed) for r in scan(docs).collect()), key=repr)
    assert found == sorted([(1, "apache-2.0", 1), (2, "mit", 1), (3, "", 0), (4, "", 0), (5, "", 0), (5, "", 0), (None, "cc-by-sa", 1), (6, "proprietary", 3), (7, "bsd", 1)], key=repr)
    assert scan(docs.limit(0)).collect() == []


#: Texts that are neither in the training nor in the calibration, nor templates.
UNSEEN = {
    "mit": ["/* SPDX-License-Identifier: MIT */ int main()", "The sources are free under the MIT licence.", "Permission is hereby granted, free of charge, to any person who obtains a copy of this software, to deal in the Software without restriction, and to permit persons to whom the Software is furnished to do so",
            "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files, to deal in the\nSoftware without restriction"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "bsd": ["This module may be used under the BSD-3-Clause terms.", "Redistribution and use in source and binary forms are permitted provided that these conditions are met:", "SPDX-License-Identifier: BSD-2-Clause"],
    "apache-2.0": ["This product is made available under the Apache License, Version 2.0", "# SPDX-License-Identifier: Apache-2.0 #", "you may not use this file except in compliance with the Apache License, Version 2.0"],
    "gpl": ["It is free software under the GPLv3", "You can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["linked under the GNU Lesser General Public License, version 2.1 only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl": ["The server is covered by the GNU Affero General Public License, version 3", "License: AGPLv3"],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, version 2.0, as it stands", "License: MPL-2.0"],
    "cc-by": ["Text and pictures: Creative Commons Attribution 4.0 International License", "These pages are published under CC BY 4.0"],
    "cc-by-sa": ["These pages are published under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc": ["Photos are licensed under CC BY-NC 4.0"],
    "cc0": ["The data set is published under CC0 1.0 Universal"],
    "proprietary": ["Copyright 2020 Acme Corp. All rights reserved."],
}
TALK = [
    "He lost his driving licence after the accident.", "The MIT study was published in the spring.", "General public opinion on the subject has not changed.", "The version of events that he gave was not true.", "Mit dem Zug sind es zwei Stunden.",
    "The Apache helicopter landed at noon.", "All the rooms are reserved.", "We met at the eclipse in 1999.", "You may use the kitchen free of charge.", "A copy of the letter was sent to every person in the house.",
    "The terms of the contract were met.", "She wrote a book about copyright.", "Two or three clauses of the law were changed.",
]


def test_precision_and_recall_on_unseen_texts(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(family, text) for family, texts in UNSEEN.items() for text in texts] + [("", text) for text in TALK]
    seen = {t for t, _ in licenses.training_texts() + licenses.held_out_texts()}
    assert not seen & {t for _, t in rows if "SPDX" not in t and "License: " not in t}  # those have one form only
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    everything = documents.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(table)
    found = {r.doc_id: r for r in scan(everything).where("doc_id < 1000").collect()}
    right = sum(found[i].licenses == family != "" for i, (family, _) in enumerate(rows))
    told = sum(found[i].licenses != "" for i in range(len(rows)))
    positives = sum(family != "" for family, _ in rows)
    wrong = [(rows[i], found[i].licenses) for i in found if found[i].licenses != rows[i][0]]
    assert right / told >= 0.95 and right / positives >= 0.85, wrong
    assert all(found[i].n_unknown == 0 for i, (family, _) in enumerate(rows) if family == ""), wrong


def test_calibration_and_unknown(spark, sf_dir):
    """Notices with words left out are told as their family or as unknown, never as another family; the curve is one of held-out rows."""
    classifier = licenses.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert classifier.slope > 0 and (classifier.slope, classifier.shift) != (1.0, 0.0)
    rows = [(family, " ".join(w for i, w in enumerate(t.split()) if i % 7 != 3)) for family, texts in licenses.TEXTS.items() for t in texts if len(t.split()) > 8]
    found = licenses.classify(spark.createDataFrame(rows, "name string, _paragraph string"), classifier).collect()
    right = sum(r._family == r.name for r in found)
    assert len(found) == len(rows) and all(0 <= r._probability <= 1 for r in found)
    assert all(r._family in (r.name, licenses.UNKNOWN) for r in found) and right >= 0.9 * len(found)
    strict = licenses.classify(spark.createDataFrame(rows, "name string, _paragraph string"), classifier, licenses.ScanOptions(least_overlap=1.01)).collect()
    assert {r._family for r in strict} == {licenses.UNKNOWN}


def test_wrapped_notices_and_odd_columns(spark):
    wrapped = "Redistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:"
    rows = [(1, f"Title\n\n{wrapped}\n\nplain text", "a", "b"), (2, "A list\nof short\nlines\nLicense: MIT\nand more", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _text string")
    assert sorted((r.doc_id, r.licenses, r.n_licensed, r.n_unknown) for r in scan(docs).collect()) == [(1, "bsd", 1, 0), (2, "mit", 1, 0)]
