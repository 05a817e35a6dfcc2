import pytest

from skysieve.sources.relations import read_star_csv

LINES = """source_id,spec_class,peculiarity_suffix,xmatch_batch_id,is_evolved,has_core_features,teff_gspphot,random_index,own_note
Gaia-12,G,"var, ""x"" y",b1,1,true,5777.5,3,n 1
7,,,,0,False,,,
"""


def test_text_ids_unlisted_columns_and_flags(spark, tmp_path):
    (tmp_path / "a.csv").write_text(LINES)
    rows = [tuple(r) for r in read_star_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert rows[0] == ("Gaia-12", "G", 'var, "x" y', "b1", True, True, 5777.5, 3, "n 1")
    assert rows[1] == ("7", None, None, None, False, False, None, None, None)


def test_contract_may_ask_for_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source_id,ruwe\n12,1.5\n")
    assert read_star_csv(spark, str(tmp_path), {"source_id": "bigint"}).first()[0] == 12


@pytest.mark.parametrize("cell", ["12,abc,1", "12,1.0,maybe"])
def test_cells_that_do_not_convert_are_errors(spark, tmp_path, cell):
    (tmp_path / "a.csv").write_text(f"source_id,ruwe,is_evolved\n{cell}\n")
    with pytest.raises(Exception, match="column (ruwe|is_evolved) is no"):
        read_star_csv(spark, str(tmp_path)).collect()


def test_files_with_another_column_order_are_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source_id,ruwe\n1,1.0\n")
    (tmp_path / "b.csv").write_text("ruwe,source_id\n1.0,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_star_csv(spark, str(tmp_path)).collect()
