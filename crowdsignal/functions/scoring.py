"""Scoring of texts: an expression over a word list, and an adapter for models that score batches in Python.

A score is (score_pos, score_neg, score_neu), three floats; a blank or null text has none. In a pipeline, posts are linked and
filtered first, then scored once each, then fanned out to tickers (``score_linked``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdsignal.functions.linking import fan_out, link_posts

#: Words that a post's tone is told by where no model is at hand.
POSITIVE = "beat bull bullish buy calls gain gains green growth high improving long moon profit recovered rose solid squeezed strong undervalued up upgrade win winner".split()
NEGATIVE = "bear bearish bleed crash debt down downgrade drop faded fell loss losing lost low miss overheated puts red rough sell short slipping stalled weak".split()

SCORES = ("score_pos", "score_neg", "score_neu")


def lexicon_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the shares of positive, negative and no words, one word of no tone added: p, n, 1 over p + n + 1. Whole texts count.

    The counts are columns of their own first, so that each is made once.
    """
    low = F.lower(F.col(text))
    count = lambda known: F.regexp_count(low, F.lit(f"(?<![a-z])(?:{'|'.join(known)})(?![a-z])"))
    counted = df.withColumns({"_p": count(POSITIVE), "_n": count(NEGATIVE), "_some": F.col(text).rlike(r"(?U)[^\s\x1c-\x1f]")})
    total = (F.col("_p") + F.col("_n") + 1).cast("double")
    scores = {name: F.when(F.col("_some"), (x / total).cast("float")) for x, name in zip((F.col("_p"), F.col("_n"), F.lit(1)), SCORES, strict=True)}
    return counted.withColumns(scores).drop("_p", "_n", "_some")


class Model(Protocol):
    """Scores a batch of texts: n rows of (positive, negative, neutral)."""

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


_MODELS: dict[str, Model] = {}
#: The tones in the order of SCORES.
TONES = ("positive", "negative", "neutral")


def tone_columns(labels: Sequence[str]) -> list[int]:
    """Where a model that names its columns ``labels`` has the positive, the negative and the neutral one; names are told by three letters.

    ValueError if one is missing or named twice, as columns taken for one another would turn every score.
    """
    heads = [label.strip().lower()[:3] for label in labels]
    if bad := [t for t in TONES if heads.count(t[:3]) != 1]:
        raise ValueError(f"{bad} must each be named once among {list(labels)}")
    return [heads.index(t[:3]) for t in TONES]


def usable_device(capability: Callable[[], tuple[int, int] | None], least: tuple[int, int] = (7, 0)) -> str:
    """``cuda`` where the worker's device is at least of that compute capability; ``cpu`` for older ones and where there is none."""
    found = capability()
    return "cuda" if found is not None and tuple(found) >= least else "cpu"


def model_scores(
    df: DataFrame, text: str, name: str, load: Callable[..., Model], batch_size: int = 32, labels: Sequence[str] | None = None, device: Callable[[], str] | None = None, most_tokens: int | None = None
) -> DataFrame:
    """``df`` with the scores of a model that each Python worker loads once, under ``name``; texts go to it in small batches.

    Blank and null texts get null scores and never reach the model. ``labels`` are the names of the model's columns, if they aren't in the
    order of SCORES (see ``tone_columns``). ``load`` is called in the worker, with the keyword ``device`` if that is given, of which
    the worker is asked, and with ``most_tokens`` if that is, the length at which a model that can't read on cuts a text.
    """
    order = tone_columns(labels) if labels is not None else [0, 1, 2]
    given = {} if most_tokens is None else {"most_tokens": most_tokens}
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in SCORES), *(T.StructField(c, T.FloatType()) for c in SCORES)])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _MODELS:
            _MODELS[name] = load(**given, **({"device": device()} if device else {}))
        for batch in batches:
            texts = batch[text]
            rows = np.flatnonzero([isinstance(t, str) and bool(t.strip()) for t in texts])
            rows = rows[np.argsort([len(texts.iloc[r]) for r in rows], kind="stable")]  # texts of like length together
            scores = np.full((len(batch), 3), np.nan, np.float32)
            for at in range(0, len(rows), batch_size):
                scores[rows[at : at + batch_size]] = np.asarray(_MODELS[name]([texts.iloc[r] for r in rows[at : at + batch_size]]))[:, order]
            out = batch.drop(columns=[c for c in SCORES if c in batch])
            for k, c in enumerate(SCORES):
                out[c] = pd.array(scores[:, k], dtype="Float32")
                out.loc[np.isnan(scores[:, k]), c] = pd.NA
            yield out

    return df.mapInPandas(work, schema)


def lexicon_model() -> Model:
    """The word list as a model, for the adapter."""
    import re

    positive, negative = frozenset(POSITIVE), frozenset(NEGATIVE)

    def score(texts: Sequence[str]) -> np.ndarray:
        found = [re.split("[^a-z]+", t.lower()) for t in texts]
        p, n = (np.array([sum(w in known for w in words) for words in found], np.float64) for known in (positive, negative))
        return np.stack([p, n, np.ones(len(found))], 1) / (p + n + 1)[:, None]

    return score


def score_linked(posts: DataFrame, tickers: DataFrame, scored: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Posts to scored rows, one per post and ticker; no shuffle. ``scored`` adds the three scores, by default from the word list."""
    linked = link_posts(posts, tickers)
    linked = scored(linked) if scored else lexicon_scores(linked)
    return fan_out(linked).select("doc_id", "subreddit", "created_utc", "ticker", "is_comment", F.col("score").alias("doc_score"), *SCORES)
