"""Quality rules: fixed base rules, then boosted trees over document statistics with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.boosted_trees import FlatTrees, fit
from docloom.llm.common import fresh, key_and_text, text_groups
from docloom.llm.labelled import GROUP_BYTES, label_sample, sample_stats
from docloom.llm.text_stats import FEATURES, all_stats, ratios

#: More symbols, repetition or shouting never raise the score.
FALLING = {"symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "loud_ratio", "run_ratio"}
#: Labelled rows the trees are fitted on, at the most.
SAMPLE_ROWS = 20_000
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FlatTrees:
    """Trees for labels.quality; without labelled rows a constant model that keeps what the base rules keep.

    Labels without an id or a quality teach nothing, an id labelled more than once takes its largest label; null texts count as empty; repeated
    rows count each; other columns are ignored.
    """
    stats, y = sample_stats(docs, label_sample(labels, "quality", sample_rows))
    x = ratios(stats) if len(stats) else np.zeros((0, len(FEATURES)))
    return fit(x, (y > 0).astype(float), [-(f in FALLING) for f in FEATURES])


def judge_documents(docs: DataFrame, model: FlatTrees, threshold: float = 0.5) -> DataFrame:
    """Statistics, base_failed, kept and score per row of documents.

    base_failed: under 50 words, or more than half of the words in repeated three-word windows. kept is
    false for these, else whether the trees give `threshold` or more. A null text has no words and
    fails; a null doc_id stays null; repeated rows get equal results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches, GROUP_BYTES):
            stats = np.array([all_stats(t) for t in texts], np.int64)
            score = model.probability(ratios(stats))
            failed = (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])
            columns = [pa.array(keys, pa.int64()), *(pa.array(stats[:, i]) for i in range(5)), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return key_and_text(docs).mapInArrow(run, SCHEMA)


def keep_documents(docs: DataFrame, model: FlatTrees, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that judge_documents() keeps, with all their columns, whatever their names, without a join.

    A null or empty text has no words and goes. Repeated rows go or stay alike, rows without an id are judged like any other; an empty table gives an empty one.
    """
    place = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            text = batch.column(place)
            for _, texts in text_groups(iter([pa.RecordBatch.from_arrays([text, text], ["doc_id", "text"])]), GROUP_BYTES):
                stats = np.array([all_stats(t) for t in texts], np.int64)
                failed = (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])
                keep.append(~failed & (model.probability(ratios(stats)) >= threshold))
            yield batch.select(range(place)).filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.select("*", docs["text"].cast("string").alias(fresh(docs, "judged_text"))).mapInArrow(run, docs.schema)
