"""A few registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["detect_connect", "c9_lines_to_cells", "c4_link_endpoints", "extract_elines", "d8_hull_chord", "w4_exact_split", "d13_classification_metrics", "a5_catalog_key", "a1_read_images", "a2_images_to_pixels", "a4_lines_through_files", "b4_nonwhite", "c1_contour_pixels", "c8_collinear_merge_edges", "j3_concat_lines", "d9_hull", "m4_resize_images", "m5_score_images", "m6_evaluate", "c7_attach_leftovers", "m6_evaluate_folder", "j8_classify_folder"]


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    want = sorted(repr(plain([row[found.columns.index(c)] for c in columns])) for row in found.fetchall())
    assert sorted(repr(plain([r[c] for c in columns])) for r in df.collect()) == want
