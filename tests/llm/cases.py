"""Rows that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 89}" for i in range(30_000))
SIMILAR = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, "Same Text here", "en", "a", 14),
    (2, "same text HERE", "en", "b", 14),
    (3, "same text here", None, None, None),
    (3, "same text here", None, None, None),
    (4, None, "en", "a", 0),
    (5, "", "en", None, 0),
    (6, " \n\t ", "de", "a", 4),
    (None, "no id at all", "en", "b", 12),
    (7, "Émile Ä same", "fr", "\U0001f600", 12),
    (8, "émile Ä same", "fr", "￿", 12),
    (9, LONG, "en", "a", len(LONG)),
    (10, LONG + " x", "en", "a", len(LONG) + 2),
    (11, SIMILAR, "en", "b", len(SIMILAR)),
    (12, SIMILAR + " tail", "en", "b", len(SIMILAR) + 5),
    (13, "one\ntwo\nthree\n\nfour", "en", "a", 19),
    (14, "zero\none\ntwo\nthree", "en", "a", 18),
    (15, "one\n\ntwo", "en", "a", 8),
    (16, "x" * 5_000, "en", "c", 5_000),
]
