from __future__ import annotations

SF = "/root/testdata/sf0.001"


def write_tables(folder, documents, labels) -> str:
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)
