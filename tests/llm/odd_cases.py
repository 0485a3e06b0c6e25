"""Rows that every operator must bear."""

#: Null and empty texts, a null id, a repeated row, a very long text and one without a blank.
ODD = [(0, None), (1, ""), (None, "no id here"), (2, "same row"), (2, "same row"), (3, "word " * 30_000), (4, "x" * 5_000), (5, " \n\t "), (6, "é​😀 ﷽\x00")]
