from __future__ import annotations

import pytest


#: Names that operators use themselves, or might.
AWKWARD = {k: f"own {k}" for k in "kept id h s n score rep key cell size order copies position positions taken_id kept_id lang_pred tie body rest row a.b __id __s __sha __at __position __lang_pred __score __salt __in".split()}


@pytest.fixture()
def docs_of(spark):
    """Rows (doc_id, text, lang, source) with further columns of awkward names."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), *AWKWARD.values()) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{k}` string" for k in AWKWARD))

    return make
