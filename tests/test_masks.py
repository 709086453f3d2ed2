"""The masks of documents against their SQL, where matches stand side by side."""

import duckdb

from tessera import plans

TEXTS = [
    "a@b.com john.doe@x.com", "a@b.com-x.y@z.org a.b@c.vn", "a@b.com@c.d@e.f", ",\n0é-é+1@đ-k.vn.q%w@e.r-t.y_-", "a@b.com,b@c.com,c.c@d.com",
    "123456789012 123456789012 0123456789 0123456789-123C456789.123C456789", "1@2.3 x.1@2.3_", "", None,
]


def test_masks_side_by_side(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.masked for r in plans.QUERIES["pii_mask_documents"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(c.sql(plans.SQL["pii_mask_documents"]).fetchall())
