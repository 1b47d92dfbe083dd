"""The search and lookup interface: argument checks, modes, and JSON-RPC over tables. Answers are small and are collected here only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import graph, retrieval

MODES = ("keyword", "semantic", "hybrid")
# JSON-RPC error codes.
UNKNOWN_METHOD, INTERNAL_ERROR = -32601, -32603


@dataclass
class Library:
    """documents (doc, title, section_title, text, url), their text index, vectors (doc, embedding), articles (id, title, url), sections
    (article_id, section_title, section_text, section_order), redirects (source_title, target_title), and an embedding function."""

    spark: SparkSession
    documents: DataFrame
    index: retrieval.TextIndex
    vectors: DataFrame | None
    articles: DataFrame
    sections: DataFrame
    redirects: DataFrame
    embed: Callable[[str], list[float]] | None = None

    def search(self, query: str, mode: str = "hybrid", limit: int = 10) -> DataFrame:
        """(rank, score, doc, title, section_title, url, excerpt). Keyword search also finds similar words, hybrid search doesn't."""
        if not 1 <= len(query) <= 1000:
            raise ValueError("a query has 1 to 1,000 characters")
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if not 1 <= limit <= 100:
            raise ValueError("limit is from 1 to 100")
        asked = retrieval.query_terms(self.spark.createDataFrame([(1, query)], "query_id int, query string"), english=True)
        if mode == "keyword":
            hits = retrieval.top(retrieval.bm25(retrieval.fuzzy_terms(asked, self.index), self.index), limit)
        else:
            if self.embed is None or self.vectors is None:
                raise ValueError("semantic search needs vectors and an embedding function")
            vector = self.spark.createDataFrame([(1, [float(x) for x in self.embed(query)])], "query_id int, embedding array<float>")
            if mode == "semantic":
                hits = retrieval.knn_hits(retrieval.knn(self.vectors, vector, limit))
            else:
                hits = retrieval.hybrid(asked, self.index, self.vectors, vector, limit)
        return retrieval.search_results(hits, self.documents, "doc").drop("query_id").orderBy("rank")

    def article(self, title: str) -> DataFrame:
        """The article of a title, see :func:`lexloom.operators.graph.title_lookup`, with its sections in order."""
        q = self.spark.createDataFrame([(title,)], "query string")
        found = graph.title_lookup(q, self.articles, self.redirects).select("id")
        return with_sections(self.articles.join(found, "id", "left_semi"), self.sections)

    def article_by_id(self, page_id: int) -> DataFrame:
        return with_sections(self.articles.where(F.col("id") == page_id), self.sections)

    def call(self, request: dict) -> dict:
        """A JSON-RPC request for one of the tools."""
        tools = {"search_wikipedia": self.search, "get_article": self.article, "get_article_by_id": self.article_by_id}
        params = request.get("params") or {}
        answer = {"jsonrpc": "2.0", "id": request.get("id")}
        if request.get("method") == "tools/list":
            return answer | {"result": {"tools": [*tools, "health_check"]}}
        if request.get("method") != "tools/call" or params.get("name") not in [*tools, "health_check"]:
            return answer | {"error": {"code": UNKNOWN_METHOD, "message": "unknown method or tool"}}
        if params["name"] == "health_check":
            return answer | {"result": {"status": "healthy"}}
        try:
            rows = tools[params["name"]](**(params.get("arguments") or {})).collect()
        except (TypeError, ValueError) as error:
            return answer | {"error": {"code": INTERNAL_ERROR, "message": str(error)}}
        return answer | {"result": [r.asDict(recursive=True) for r in rows]}


def with_sections(articles: DataFrame, sections: DataFrame) -> DataFrame:
    """Articles with an array of their sections in order; empty for those without any."""
    one = F.struct("section_order", "section_title", "section_text")
    grouped = sections.groupBy(F.col("article_id").alias("__article")).agg(F.array_sort(F.collect_list(one)).alias("sections"))
    kind = grouped.schema["sections"].dataType.simpleString()
    out = articles.join(grouped, F.col("id") == F.col("__article"), "left").drop("__article")
    return out.withColumn("sections", F.coalesce("sections", F.array().cast(kind)))
