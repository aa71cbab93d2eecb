DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and white-space-only texts, repeated rows, ties, other white space, a very long text.
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "One two three four five six seven eight nine ten eleven", "en", "s", 55),
    (5, "One two three four five six seven eight nine ten eleven", "en", "s", 55),
    (5, "One two three four five six seven eight nine ten eleven", "en", "s", 55),
    (6, "a  b  c　　d \r\n e\x1c\x1ff <|endoftext|> it's DON'T ΣΣ", "xx", None, 1),
    (None, "no id here", None, None, None),
    (7, "word " * 60_000 + "x" * 5_000, "en", "hot", 305_000),
    (8, "Été " + "9" * 3_000, "fr", "s", 3_004),
]
CLASHES = ("fp", "part", "length", "body", "_body", "_spans", "_items", "u", "v", "root", "piece", "score", "_score", "size", "shard", "block", "bucket", "slot", "pii", "_t", "_kept", "held", "row")
