"""Rows that every operator has to take."""

import pytest

#: Texts that every operator has to take: nulls, blanks, ties, repeated rows.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \t\r\n\f\x0b "),
    (4, "one"),
    (5, "one"),
    (5, "one"),
    (None, "null id, some words here and there"),
    (None, None),
    (7, "…—·€ 123 ###"),
    (8, "é" * 500),
    (9, "word " * 2000),
    (10, "x" * 5000),
    (-3, "Ünïcode çafé   line 𝒳 <|endoftext|> </s>[INST] \\ \\\\"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows with extra columns whose names may clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"{c} string" for c in ("size", "taken", "member", "block", "held_out", "slot", "shard",
                                "_key", "__text_a", "letter", "label")
    )
    rows = [(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None, *["x"] * 11)
            for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, schema)
