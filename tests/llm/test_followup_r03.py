"""Findings on the corpus operators that were open after round 3."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from draftlake.llm import attention, scoring
from draftlake.llm.words import mix


def test_f19_every_training_window_is_trained_on(spark):
    # One text of one window each, in rows whose hash a share of an eighth would pass over.
    none = [r for r in range(200) if mix(mix(np.array([r], np.uint64)) + np.uint64(0))[0] % np.uint64(8)][:12]
    ids = 50
    text = np.arange(1, 12, dtype="<u2")
    text[0] = text[-1] = ids - 1
    rows = spark.createDataFrame([(text.tobytes(), r) for r in none], "ids binary, row long").coalesce(1)
    pairs = scoring.pair_counts(rows, ids)
    voc = scoring.count_vocabulary(pairs, ids)
    assert (scoring.learn(rows, voc, share=8) == attention.fresh()).all()
    for row in none[:3]:
        assert (scoring.learn(rows.where(f"row = {row}"), voc) != attention.fresh()).any()
