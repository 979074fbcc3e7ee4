import pytest

KINDS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, n_words long, node string, key string, path string, line string",
    "labels": "doc_id long, quality int, toxic int, text string",
    "conversations": "conv_id long, turn long, role string, text string, message string",
    "embeddings": "vec_id long, embedding array<float>, label int, v string, n int",
}


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables, with extra columns of clashing names, to a folder."""

    def write(**rows):
        for name, kind in KINDS.items():
            width = kind.count(",") + 1
            full = [tuple(r) + ("x",) * 0 + (None,) * (width - len(r)) for r in rows.get(name, [])]
            spark.createDataFrame(full, kind).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def rows(df, *by):
    return sorted((tuple(r[c] for c in df.columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
