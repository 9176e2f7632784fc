#: Null, empty, blank, repeated and very long texts, and one with a null id.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "same words here again"), (6, "same words here again"), (5, "same words here again"), (7, "x" * 70_000), (8, "word " * 15_000), (None, "no id here"), (9, "é😀 ß ü")]
