"""Small documents that hold every awkward case."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(f"{w}{i % 97}" for i in range(9000) for w in WORDS[i % 20:i % 20 + 2])

#: doc_id, text: nulls, empties, white space, ties, repeated rows, copies, near copies, one very long text.
ROWS = [
    (1, "One two  three four five six seven eight nine ten"), (2, "One two three four\tfive six seven eight nine ten "),
    (3, "one two three four five six seven eight nine ten"), (4, None), (5, ""), (6, " \n\t "), (7, "!!!"), (8, "Alpha"), (9, "alpha"),
    (10, "alpha beta"), (10, "alpha beta"), (11, "été déjà vu, naïve façade; 中文 words \U0001F600"), (12, LONG), (13, LONG + " end"),
    (None, "a row without an id, and some words"), (None, "a row without an id, and some words"), (14, "alpha beta gamma"), (14, "delta epsilon"),
    (15, " ".join(WORDS * 3)), (16, " ".join(WORDS * 3) + " x"), (17, "x " + " ".join(WORDS * 3)),
]
CLASHING = ("id", "fp", "key", "root", "part", "kept", "n", "label", "least", "segment", "score", "count", "_n", "h", "s", "u", "t")
