"""Made-up prose for tests."""

WORDS = [a + b for a in "ka lo mi re su ta ne vo".split() for b in "ba di fu go hel jin".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", rng.choice(WORDS)]) for _ in range(n))
