"""Rows that operators must handle, and made-up prose."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    x, out = seed * 2654435761 + 1, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)] + ("s" if x >> 60 & 1 else ""))
    return " ".join(out)


ODD = [
    (1, "Hello World", "en", "s"),
    (2, "hello world", "en", "s"),
    (2, "hello world", "en", "s"),  # a repeated row
    (3, None, None, None),
    (4, "", "en", "s"),
    (None, "a row without identifier", "en", None),
    (None, "hello WORLD", None, "s"),
    (5, prose(1, 40_000), "en", "s"),  # very long
    (6, prose(2, 60), "fr", "s"),
    (7, prose(2, 59) + " other", "fr", "t"),
    (8, "\n\n \t", "en", "s"),
    (9, "ÀÉ é 日本語 😀 ½²³ Σας <|endoftext|> it's  two   spaces \n x", "de", "s"),
]
