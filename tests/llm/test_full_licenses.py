"""Full licence texts and the corpus's own licence lines."""

import os

import pytest

from strataloom.llm import licenses as L

FOLDER = "/usr/share/common-licenses"
FULL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def ids(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license_id"] for r in L.scan(docs).orderBy("doc_id").collect()]


def test_lines(spark):
    assert ids(spark, ["Licensed under CC BY-NC 4.0.", "A text.\nLicensed under CC BY-NC 4.0."]) == ["CC-BY-NC-4.0", None]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no licence texts")
def test_full_texts(spark):
    texts = [open(f"{FOLDER}/{f}", encoding="utf-8").read() for f in FULL]
    assert ids(spark, texts) == list(FULL.values())
    assert ids(spark, [t + "\nand more" for t in texts]) == [None] * len(FULL)
