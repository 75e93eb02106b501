import duckdb
import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, sig long, token string, row_key long, label string, score double"


@pytest.fixture
def make_docs(spark, tmp_path):
    """Writes documents (doc_id, text[, lang]) with extra columns whose names the
    operators use themselves; returns the DataFrame, the folder and a DuckDB connection."""
    count = {"n": 0}

    def make(rows, parts=3):
        count["n"] += 1
        folder = str(tmp_path / f"t{count['n']}")
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), "x", 1, "t", 2, None, None) for r in rows]
        spark.createDataFrame(full, DOC_SCHEMA).repartition(parts).write.parquet(f"{folder}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        return spark.read.parquet(f"{folder}/documents.parquet"), folder, con

    return make


ODD_TEXTS = [None, "", " ", "\n", "\n\n\n", "a", "A b\tc", "é", "1 2 3", "...", "x" * 30_000, "word " * 6_000, "Kelvin İstanbul ﬁ", "tab\tnew\rline\x0b\x0c end", "\x00zero", "😀 emoji 的 文 字"]
