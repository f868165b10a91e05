import pytest


@pytest.fixture()
def docs(spark):
    """Rows given as (doc_id, text, lang, source) to a table with the columns of ``documents`` and a clashing extra one."""

    def build(rows):
        full = [(r[0], r[1], *(list(r[2:]) + [None, None])[:2]) for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        return frame.selectExpr("*", "cast(1 as int) as key", "'x' as `TEXT_2`", "cast(2 as long) as node", "'a' as `t`", "1.5 as `_u`")

    return build
