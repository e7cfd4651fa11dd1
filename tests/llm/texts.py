"""Small documents for the tests: prose over a small vocabulary with copies, near copies and odd rows."""

import random
import re

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rnd, n, vocabulary=4000):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def edited(rnd, text, share):
    return " ".join(f"e{rnd.randrange(9999)}" if rnd.random() < share else w for w in text.split(" "))


def corpus(seed=1):
    """Unrelated texts, exact copies, chains and crowds of near copies, a passage that many share, odd rows."""
    rnd = random.Random(seed)
    passage = prose(rnd, 70)
    out = [prose(rnd, rnd.randint(1, 200)) for _ in range(60)]
    out += [out[3], out[3].upper(), out[7], out[7]]
    base = prose(rnd, 120)
    out += [edited(rnd, base, 0.02) for _ in range(60)]
    chain = prose(rnd, 90)
    for _ in range(12):
        chain = edited(rnd, chain, 0.03)
        out.append(chain)
    out += [f"{prose(rnd, rnd.randint(0, 60))} {passage} {prose(rnd, rnd.randint(0, 60))}" for _ in range(40)]
    out += [passage, f"{passage}\n\n{passage}", "x y", "x  y\n", "X Y", "one", "", None, " \t\n", "spam " * 400, "spam " * 90, "日本 é   𝒳" * 5]
    rnd.shuffle(out)
    ids = rnd.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


def words(text):
    return WORD.findall(text or "")
