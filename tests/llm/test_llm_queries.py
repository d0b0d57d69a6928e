import pytest
from compare import rows_of, rows_of_sql

from weftline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_against_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, SF)) == rows_of_sql(queries.oracle_sql()[name], SF)


def test_names_and_columns(spark):
    made = queries.queries()
    assert [n.split("_")[0] for n in made] == [f"op{k}" for k in range(1, 11)]
    first = {
        "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op3_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op4_simhash": ["doc_id", "fingerprint", "component_id"],
        "op5_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    }
    for name, columns in first.items():
        df = made[name](spark, SF)
        assert df.columns[: len(columns)] == columns
        kinds = dict(df.dtypes)
        assert all(kinds[c] == "bigint" for c in columns if c.startswith("n_") or c in ("word_chars", "doc_id", "page_id", "component_id"))


@pytest.mark.parametrize("name", ["op6_sentencepiece", "op7_decontamination", "op8_token_counts", "op9_licenses"])
def test_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.count() == n or name == "op7_decontamination"
    assert name != "op6_sentencepiece" or df.where("not round_trip").count() == 0
