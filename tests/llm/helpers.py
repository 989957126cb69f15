"""Documents of every awkward kind, small enough to check by hand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + WORDS[(x >> 16) % len(WORDS)])
    return " ".join(out)


def documents(spark, n: int = 40):
    """Plain texts, and nulls, empty and blank texts, a very long one, repeated rows, ties, null ids and sources."""
    rows = [(i, prose(i, 60 + i), "en", f"s{i % 3}", 1) for i in range(n)]
    rows += [
        (1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \t\n", "en", "s0", 3), (1003, prose(7, 30_000), "en", "s1", 1), (1004, "Übung ß 日本語 🎉 \x00 end", "de", "s1", 1),
        (5, rows[5][1], "en", "s2", 1), (5, rows[5][1], "en", "s2", 1), (1005, rows[6][1].upper(), "en", None, 1), (None, rows[8][1], "en", "s0", 1), (1006, "one", "en", "s0", 3), (1007, "one two", "en", "s9", 7),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """With columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    out = df
    for name in (
        "score", "size", "words", "fp", "component_id", "label", "held_out", "target", "taken", "hashes", "key", "row", "src", "tie", "id", "held", "block", "body", "n", "h", "wave", "Wave_1", "again",
        "copies", "times", "stay_id", "stay_n", "__mix_size", "__toxicity", "__quality", "__wave", "__sim_id", "__sim_row", "a.b",
    ):
        out = out.withColumn(name, F.lit("x"))
    return out


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
