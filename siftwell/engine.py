"""The search engine: build, open, search, suggest, fetch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.analyzer import BIGRAM, RULES_VERSION, analyze, units
from .functions.snippets import excerpt, highlight
from .operators.build import build_index
from .operators.evaluate import evaluate, small
from .operators.spelling import corrections, lookup, with_prefix
from .operators.storage import FORMAT, Files, IndexFormatError, local_rows, small_batches
from .plans.parser import parse, truncate
from .plans.planner import MAX_EXPANSIONS, Lookups, compounds, correct, correctable, plan, rewrite

__all__ = ["Index", "IndexFormatError", "build_index", "open_index"]
COLUMNS = {
    "meta": {"documents", "average", "terms", "words", "format", "rules", "stemming", "title_boost", "created", "bytes"}, "documents": {"doc_id", "url", "title", "body"}, "doc_stats": {"doc_id", "length"},
    "postings": {"term", "doc_id", "title_tf", "body_tf", "length", "positions"}, "dictionary": {"term", "df"}, "lexicon": {"word", "display", "df"}, "lexicon_bigrams": {"bigram", "word", "df", "n"},
}
TABLES = tuple(COLUMNS)
#: Hits whose documents are looked up by a pushed-down filter.
FETCHED = 1000
_MARKED = "struct<text:string,highlights:array<struct<start:int,end:int>>>"


def checked_page(offset: int, limit: int, most: int = 100) -> None:
    if offset < 0:
        raise ValueError("offset must be >= 0")
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if offset + limit > 10_000:
        raise ValueError("offset + limit must not exceed 10000")


def open_index(spark: SparkSession, root: str) -> Index:
    """Opens the published version.  The next build doesn't change what it reads; ``latest`` opens what was built since."""
    root = root.rstrip("/")
    name = Files(spark).read(f"{root}/CURRENT").strip()
    return Index(spark, f"{root}/versions/{name}")


class Index:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        files = Files(spark)
        for name in TABLES:
            # a table whose write has ended holds this mark
            if not files.fs(folder).exists(files.path(f"{folder}/{name}/_SUCCESS")):
                raise IndexFormatError(f"{folder}: the table {name} is missing or not whole")
            setattr(self, name, spark.read.parquet(f"{folder}/{name}"))
            if lost := COLUMNS[name] - set(getattr(self, name).columns):
                raise IndexFormatError(f"{folder}: the table {name} lacks {', '.join(sorted(lost))}")
        self.info = self.meta.first().asDict()
        if self.info["format"] != FORMAT:
            raise IndexFormatError(f"format {self.info['format']} isn't {FORMAT}; build the index again")
        if self.info["rules"] != RULES_VERSION:
            raise IndexFormatError(f"analyzer rules {self.info['rules']} aren't {RULES_VERSION}; build the index again")
        self.stemming = self.info["stemming"]

    def latest(self) -> Index:
        """This index, or the version that has been published since."""
        root, _, name = self.folder.rpartition("/versions/")
        return self if Files(self.spark).read(f"{root}/CURRENT").strip() == name else open_index(self.spark, root)

    def register_views(self, prefix: str = "index_") -> None:
        """Temporary views of all tables, for Spark SQL."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def cache(self) -> Index:
        """Keeps the lookup tables in memory for interactive use."""
        for name in ("dictionary", "lexicon", "lexicon_bigrams"):
            setattr(self, name, getattr(self, name).cache())
        return self

    # queries

    def _known(self, terms: set[str]) -> set[str]:
        return {r[0] for r in lookup(self.spark, self.dictionary.select("term"), sorted(terms), "term").collect()} if terms else set()

    def _lookups(self, parsed: list[tuple[str, list]], auto: list[bool]) -> Lookups:
        """All that the plans of a batch ask of the index, in a bounded number of jobs."""
        out = Lookups()
        prefixes = sorted({p.token.surface for _, parts in parsed for p in parts if p.kind == "prefix" and units(p.token.surface) >= 2})
        if prefixes:
            for r in sorted(with_prefix(self.spark, self.lexicon, prefixes, MAX_EXPANSIONS).collect(), key=lambda r: r["rank"]):
                out.prefixes.setdefault(r["prefix"], []).append(r["word"])
        asked = {t.term for words in out.prefixes.values() for w in words for t in analyze(w, 0, self.stemming)}
        for raw, parts in parsed:
            asked |= {t.term for p in parts for t in p.tokens} | set(compounds(raw, parts, self.stemming).values())
        out.terms = self._known(asked)
        wrong = [p.token.surface for (_, parts), on in zip(parsed, auto, strict=True) if on for p in parts if p.kind == "word" and not p.negated and correctable(p.token) and p.token.term not in out.terms]
        out.corrections = corrections(self.spark, self.lexicon, self.lexicon_bigrams, wrong)
        out.terms |= self._known({t.term for w, _ in out.corrections.values() for t in analyze(w, 0, self.stemming)} - out.terms)
        return out

    def search_batch(self, queries: list[tuple], snippets: bool = True) -> tuple[DataFrame, DataFrame]:
        """queries: (query_id, text[, offset, limit, auto_correct]).  Returns hits and results, one plan for all.

        hits: query_id, rank, doc_id, url, score, matched, title, snippet.  results: query_id, query,
        corrected_query, match_mode, total.
        """
        full = [(q[0], truncate(q[1]), *(q[2:] + (0, 10, True)[len(q) - 2 :])) for q in queries]
        for q in full:
            checked_page(q[2], q[3])
        parsed = [(q[1], parse(q[1], self.stemming)) for q in full]
        known = self._lookups(parsed, [q[4] for q in full])
        rows, terms, texts = [], {}, []
        for (query_id, raw, _, _, auto), (_, parts) in zip(full, parsed, strict=True):
            fixed = correct(parts, known, self.stemming) if auto else {}
            made = plan(raw, parts, known, fixed, self.stemming)
            rows += made.rows(query_id) if made.required else []
            terms[query_id] = made.highlight
            texts.append((query_id, raw, rewrite(raw, fixed)))
        hits, totals = evaluate(self.spark, self.postings, self.dictionary, rows, [(q[0], q[2], q[3]) for q in full], self.info["documents"], self.info["average"], self.info["title_boost"])
        results = local_rows(self.spark, texts, "query_id int, query string, corrected_query string").join(totals, "query_id")
        return (self._presented(hits, terms, sum(q[3] for q in full)) if snippets else hits), results

    def _presented(self, hits: DataFrame, terms: dict[int, list[str]], most: int) -> DataFrame:
        """hits, at most ``most``, with stored fields and highlights; only the pages' documents are fetched.

        The ids of a few pages are collected, so that they reach the scan of the documents as a filter.
        """
        stemming, documents = self.stemming, self.documents
        if most <= FETCHED:
            rows = hits.collect()
            hits = local_rows(self.spark, rows, hits.schema)
            documents = documents.filter(F.col("doc_id").isin(sorted({r["doc_id"] for r in rows})))
        docs = documents.join(small(hits, most), "doc_id").select("query_id", "rank", "doc_id", "url", "score", "matched", "title", "body")

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mark = lambda x: {"text": x[0], "highlights": [{"start": a, "end": b} for a, b in x[1]]}
            for f in frames:
                own = [set(terms.get(q, ())) for q in f["query_id"]]
                title = [mark(highlight(t, w, stemming)) for t, w in zip(f["title"], own, strict=True)]
                snippet = [mark(excerpt(t, w, stemming)) for t, w in zip(f["body"], own, strict=True)]
                yield f.drop(columns=["body"]).assign(title=title, snippet=snippet)

        small_batches(self.spark)
        return docs.mapInPandas(task, f"query_id int, rank int, doc_id long, url string, score double, matched int, title {_MARKED}, snippet {_MARKED}")

    def search(self, text: str, offset: int = 0, limit: int = 10, auto_correct: bool = True) -> dict:
        hits, results = self.search_batch([(0, text, offset, limit, auto_correct)])
        r = results.first()
        return {"query": r["query"], "corrected_query": r["corrected_query"], "match_mode": r["match_mode"], "total": r["total"], "hits": [h.asDict(True) for h in hits.orderBy("rank").collect()]}  # one page

    def search_json(self, text: str, page: int = 1, size: int = 10, exact: bool = False) -> str:
        """The result as JSON; markup characters are escaped, so it can stand in a page."""
        import json
        import time

        start = time.monotonic()
        if not text or not text.strip():
            raise ValueError("q is required")
        if units(text) > 1000:
            raise ValueError("q must be at most 1000 characters")
        if not 1 <= size <= 50:
            raise ValueError("size must be between 1 and 50")
        if page < 1:
            raise ValueError("page must be >= 1")
        found = self.search(text, (page - 1) * size, size, not exact)
        for h in found["hits"]:
            h["score"] = round(h["score"], 3)
        out = json.dumps({**found, "page": page, "size": size, "took_ms": round(1000 * (time.monotonic() - start), 2)}, ensure_ascii=False)
        for c in ("<", ">", "&", "\u2028", "\u2029"):
            out = out.replace(c, f"\\u{ord(c):04x}")
        return out

    def suggest_batch(self, inputs: list[tuple[int, str]], limit: int = 8) -> DataFrame:
        """query_id, rank, suggestion for the inputs (query_id, text typed so far)."""
        asked = []
        for query_id, text in inputs:
            tokens = analyze(text, 0, self.stemming) if text and units(text) <= 200 and not text[-1].isspace() else []
            if tokens and tokens[-1].end == len(text) and tokens[-1].script not in BIGRAM and units(tokens[-1].surface) >= 2:
                asked.append((query_id, text[: tokens[-1].start], tokens[-1].surface))
        schema = "query_id int, rank int, suggestion string"
        if not asked or limit <= 0:
            return local_rows(self.spark, [], schema)
        words = with_prefix(self.spark, self.lexicon, sorted({a[2] for a in asked}), limit, exact=False)
        typed = local_rows(self.spark, asked, "query_id int, base string, prefix string")
        rows = words.join(F.broadcast(typed), "prefix").select("query_id", "rank", F.concat("base", "display").alias("suggestion"))
        return rows.groupBy("query_id", "suggestion").agg(F.min("rank").alias("rank")).select("query_id", "rank", "suggestion")

    def suggest(self, text: str, limit: int = 8) -> list[str]:
        return [r["suggestion"] for r in self.suggest_batch([(0, text)], limit).orderBy("rank").collect()]  # at most limit rows

    def document(self, doc_id: int, most: int = 500_000) -> dict | None:
        """A stored document; the body is cut at ``most`` characters."""
        row = self.documents.filter(F.col("doc_id") == doc_id).first()
        if row is None:
            return None
        body = truncate(row["body"], most)
        return {**row.asDict(), "body": body, "truncated": len(body) < len(row["body"])}

    def stats(self) -> dict:
        return {**self.info, "version": self.folder.rpartition("/")[2]}
