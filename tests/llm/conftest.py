from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number string, _text string"


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Plain, repeated, near-equal, empty, null and long texts."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "it's", "über", "été", "naïve", "x1", "42", "<|endoftext|>", "日本", "a,b"]
    make = lambda n: " ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))
    rows: list[tuple[int | None, str | None]] = [(i, make(rng.randrange(1, 80))) for i in range(30)]
    base = make(120).split()
    for i in range(30, 40):
        changed = list(base)
        changed[rng.randrange(len(changed))] = f"edit{i}"
        rows.append((i, " ".join(changed)))
    rows += [(50, rows[0][1]), (51, rows[0][1]), (52, ""), (53, None), (54, "   "), (55, "one"), (56, make(9000)), (57, "..., !!! 123"), (None, "no id"), (58, "tie tie"), (58, "tie tie")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", "s", len(t or ""), "r", "q") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
