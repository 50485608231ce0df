"""Substring search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DocumentSearch:
    """Case-sensitive containment, in document order; the empty needle matches every non-null text."""

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.documents, self.id_col, self.text_col = documents, id_col, text_col

    def add_documents(self, more: DataFrame) -> "DocumentSearch":
        return DocumentSearch(self.documents.unionByName(more), self.id_col, self.text_col)

    def search(self, needle: str) -> DataFrame:
        return self.documents.where(F.contains(F.col(self.text_col), F.lit(needle))).orderBy(self.id_col)
