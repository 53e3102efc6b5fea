"""text_normalize over texts that are longer than its limits."""

import hashlib
import re

from observatory.functions.text import CUT_MARK
from observatory.plans.queries import QUERIES


def cut(text, most):
    text = text.strip()
    return text[:most].rstrip() + CUT_MARK if len(text) > most else text


def test_whole_text_is_normalised(spark, tmp_path):
    line = "word \t word\x07\n\n"
    texts = [line * 3 + "end", "a" * 299 + " b\nlast", line * 100, line * 2000, "x" * 9999 + "\ny"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.payload, r.excerpt) for r in QUERIES["text_normalize"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        plain = text.replace("\x07", "")
        assert got[i][0] == cut(plain.replace("\n", " \r\n"), 120)
        assert got[i][1] == hashlib.md5(cut(re.sub(r"[ \t]+(?=\n|$)", "", plain), 10000).encode()).hexdigest(), i
