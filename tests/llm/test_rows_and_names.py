"""Repeated and null ids, identical rows, and extra columns named like the operators' own."""

import hashlib
import re

from pyspark.sql import functions as F

from framelens.llm import exact_dedup, line_dedup, near_dedup, quality, warc

DOCS = "doc_id long, text string, n_chars long"
HELPERS = [
    "text__", "drop__", "id__", "row__", "gone_", "gone_doc_", "counts", "counts_text", "counts_words", "COUNTS_HASH",
    "line_dedup_gone", "Line_Dedup_Text", "near_dedup_id", "id", "row", "at", "lines", "key", "h1", "size", "rank",
]


def test_rows_of_one_id_that_agree_in_length_and_prefix(spark):
    same = "p" * 300
    texts = [(None, same + "a"), (None, same + "b"), (None, same + "c"), (5, same + "d"), (5, same + "e"), (6, same + "e "), (6, same + "e ")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts], DOCS)
    rows = exact_dedup.with_digest(docs, exact_dedup.exact_groups(docs)).collect()
    assert len(rows) == len(texts)
    want = sorted(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest() for _, t in texts)
    assert sorted(r.text_sha256 for r in rows) == want
    assert sorted(r.group_size for r in rows) == [1, 1, 1, 1, 3, 3, 3]
    assert {r.keep_id for r in rows if r.group_size == 3} == {6}


def test_identical_pages_three_times(spark, tmp_path):
    big = "x" * 200
    pages = [(1, "u", big)] * 3 + [(2, "u", big), (3, "u", big), (None, None, big), (None, "none", big), (4, "u", "s"), (4, "u", "s")]
    warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "a"))
    rows = warc.resolved(warc.read_archive(spark, str(tmp_path / "a"))).collect()
    assert len(rows) == len(pages)
    assert len({r.record_id for r in rows}) == 6
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == sorted(
        [(1, "response", 0)] * 3 + [(2, "revisit", 1), (3, "revisit", 1)] + [(0, "revisit", 1)] * 2 + [(4, "response", 0)] * 2
    )


def test_stages_pass_on_columns_named_like_their_own(spark):
    line = "a line of some length that occurs in several documents of this table"
    words = " ".join(f"word{i}" for i in range(60))
    texts = [f"{line}\n{words} one two", f"{words} three four five\n{line}", words + " six", None, ""]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], DOCS)
    docs = docs.withColumns({c: F.lit(f"kept {i}") for i, c in enumerate(HELPERS)})
    plain = docs.select("doc_id", "text", "n_chars")
    for stage in (line_dedup.without_repeated_lines, near_dedup.without_near_copies, quality.good_documents):
        found = stage(docs)
        assert found.columns == docs.columns
        assert sorted(r.text or "" for r in found.collect()) == sorted(r.text or "" for r in stage(plain).collect())
        for i, c in enumerate(HELPERS):
            assert found.where(F.col(c) != f"kept {i}").isEmpty()
