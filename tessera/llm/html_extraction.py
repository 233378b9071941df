"""HTML extraction: boosted trees over features of DOM nodes, and a hierarchical decoding that keeps no node below a dropped one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import boosting, dom
from tessera.llm.common import small_batches, table
from tessera.llm.example_pages import example_pages


@dataclass
class Extractor:
    tag_odds: dict[str, float]
    token_odds: dict[str, float]
    trees: boosting.Trees

    def texts(self, pages: list[str | None]) -> list[str]:
        parsed = [dom.parse(p) if p else None for p in pages]
        found = [dom.features(t, self.tag_odds, self.token_odds) for t in parsed if t is not None]
        logits = iter(np.split(self.trees.logit(np.concatenate(found)), np.cumsum([len(f) for f in found])[:-1])) if found else iter(())
        return [dom.text_of(t, dom.decode(t, next(logits))) if t is not None else "" for t in parsed]


def _labels(tree: dom.Tree) -> np.ndarray:
    own = [0] * len(tree.tag)
    for k in range(len(own)):
        p = tree.parent[k]
        own[k] = tree.label[k] if tree.label[k] is not None else own[p] if p >= 0 else 0
    y = np.array([own[k] if t == "#run" else 0 for k, t in enumerate(tree.tag)])
    for k in range(len(own) - 1, 0, -1):
        y[tree.parent[k]] |= y[k]
    return y


@lru_cache(maxsize=2)
def train(pages: int = 850, seed: int = 5) -> Extractor:
    """Trained on a bounded number of made-up pages; the same on every call."""
    trees = [dom.parse(p, labelled=True) for p in example_pages(pages, seed)]
    labels = [_labels(t) for t in trees]
    kept, seen, kept_tag, seen_tag = Counter(), Counter(), Counter(), Counter()
    for t, y in zip(trees, labels):
        for tag, tokens, k in zip(t.tag, t.tokens, y.tolist()):
            seen_tag[tag] += 1
            kept_tag[tag] += k
            for token in tokens:
                seen[token] += 1
                kept[token] += k
    odds = lambda k, n: float(np.log((k + 1) / (n - k + 1)))
    tag_odds = {t: odds(kept_tag[t], n) for t, n in seen_tag.items()}
    token_odds = {t: odds(kept[t], n) for t, n in seen.items() if n >= 6}
    x = np.concatenate([dom.features(t, tag_odds, token_odds) for t in trees])
    return Extractor(tag_odds, token_odds, boosting.fit(x, np.concatenate(labels)))


def html_extraction(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A null or empty page has an empty text. Repeated rows get a row each; null ids and urls are kept. Pages are whole, however long.
    An empty table gives an empty result. Other columns are neither read nor returned.
    """
    model = train()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 200):
                part = b.iloc[k : k + 200]
                texts = model.texts(part["html"].tolist())
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]}).astype({"page_id": "Int64"})

    own = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInPandas(extract, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"))
