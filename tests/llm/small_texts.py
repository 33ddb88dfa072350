"""Made-up text for the tests of this folder."""

import hashlib
import random

R = random.Random(5)
LETTERS = "aeiounrst"


def prose(n, r=R):
    return " ".join("".join(r.choices(LETTERS, k=r.randint(2, 9))) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
