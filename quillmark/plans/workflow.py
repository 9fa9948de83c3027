"""The document workflow: which steps run, in what order, on one set of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.html import extracted
from quillmark.operators import documents, textmining


@dataclass
class Workflow:
    """Switches of the steps; by default only ingest and extract run. Vectors are made if a later step needs them."""

    ingest: bool = True
    extract: bool = True
    annotate: bool = False
    kmeans: bool = False
    sips: bool = False
    simdoc: bool = False
    clusters: int = 20
    overwrite: bool = True
    ngrams: int = 1
    annotator: Callable | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)

    def steps(self) -> list[str]:
        vectorize = self.annotate or self.kmeans or self.sips or self.simdoc
        chosen = [("ingest", self.ingest), ("extract", self.extract), ("vectorize", vectorize), ("annotate", self.annotate), ("kmeans", self.kmeans), ("simdoc", self.simdoc), ("sips", self.sips), ("index_sips", self.sips)]
        return [name for name, on in chosen if on]

    def run(self, stored: DataFrame, batch: DataFrame) -> dict[str, DataFrame]:
        """stored and batch are document tables; a batch that adds nothing raises."""
        docs = stored
        for step in self.steps():
            docs = getattr(self, f"_{step}")(docs, batch)
            self.results[step] = docs if step in ("ingest", "extract", "annotate") else self.results[step]
        self.results["documents"] = docs
        return self.results

    def _ingest(self, docs: DataFrame, batch: DataFrame) -> DataFrame:
        if not batch.take(1):
            raise ValueError("no document was added")
        return documents.upsert(docs, batch, self.overwrite)

    def _extract(self, docs: DataFrame, _: DataFrame) -> DataFrame:
        rows = documents.extraction_status(docs)
        todo = rows.where("status = 'extract'").select("id", F.decode("content", "UTF-8").alias("html"))
        found = extracted(todo, "id", "html").select("id", F.col("text").alias("_text"))
        return rows.join(found, "id", "left").withColumn("text", F.coalesce(F.nullif("text", F.lit("")), "_text")).drop("_text", "status")

    def _vectorize(self, docs: DataFrame, _: DataFrame) -> DataFrame:
        texts = textmining.tokenised(documents.has_text(docs).select("id", "text"))
        tf = textmining.term_frequencies(texts, "id", self.ngrams)
        self.results["vectorize"] = textmining.tfidf(tf, texts.count(), "id", min_support=1, max_df_percent=95, norm=2)
        return docs

    def _annotate(self, docs: DataFrame, _: DataFrame) -> DataFrame:
        return documents.merge_annotations(docs, textmining.annotated(documents.has_text(docs), self.annotator or textmining.token_annotator))

    def _kmeans(self, docs: DataFrame, _: DataFrame) -> DataFrame:
        texts = documents.has_text(docs).select("id", "text")
        self.results["kmeans"] = textmining.clustered(textmining.vectorised(texts, max_df=1.0), self.clusters).select("id", "cluster")
        return docs

    def _simdoc(self, docs: DataFrame, _: DataFrame) -> DataFrame:
        self.results["simdoc"] = textmining.similar_documents(textmining.row_similarity(self.results["vectorize"], "id"))
        return docs

    def _sips(self, docs: DataFrame, _: DataFrame) -> DataFrame:
        self.results["sips"] = textmining.collocations(textmining.tokenised(documents.has_text(docs)))
        return docs

    def _index_sips(self, docs: DataFrame, _: DataFrame) -> DataFrame:
        self.results["index_sips"] = textmining.sips(self.results["sips"])
        return docs
