from __future__ import annotations

import pytest

#: Texts every operator must take: null, empty, white space, ties and copies, odd characters, one long text.
ODD = [None, "", " \n\t ", "one", "a b c", "same text here " * 6, "same text here " * 6, "É ñ ß \x1c \x85 \xa0 x\x00y 中文",
       "<|endoftext|> it's 'S 12 3", "x " * 20_000 + "end", "line\nline\nline\n", "###### $$$ %%% !!! ||| <<<>>>"]


@pytest.fixture()
def odd_docs(spark):
    """Edge rows with null and repeated ids, null columns and clashing extra columns."""
    rows = [(i if i != 3 else None, t, None, "s", None, 1.5, "t") for i, t in enumerate(ODD)]
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score double, y string")
    # names that operators use inside
    return docs.selectExpr("*", "7 AS _t", "8 AS _id", "9 AS _th", "1 AS _u", "2 AS sig", "3 AS n", "4 AS shard", "5 AS _r", "6 AS _h", "0 AS th")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture()
def some_labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture()
def no_labels(some_labels):
    return some_labels.limit(0)
