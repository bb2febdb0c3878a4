"""Small tables with all the cases that operators define, and brute-force versions of what they compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", lowered(text))


def lowered(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "tho", "li", "ñe", "ou"]) for _ in range(1 + k % 4)) for k in (r.randrange(vocabulary) for _ in range(n)))


def documents():
    """Near and exact copies, shared passages, nulls, blanks, multi-byte characters, a long text, repeated rows."""
    r = random.Random(1)
    base = [prose(k, 60 + 10 * k) for k in range(12)]
    passage = prose(77, 70)
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[3]), (21, base[3] + " tail"), (22, base[4].upper()), (23, base[5].replace(" ", "\n"))]
    for k in range(24, 40):
        w = base[9].split()
        for _ in range(r.randrange(1, 25)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((k, " ".join(w)))
    rows += [(k, prose(k, 30) + " " + passage + " " + prose(k + 1, 30)) for k in range(40, 46)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "one"), (55, "one two three four five"), (56, "ONE two three four five"), (57, "a" * 300), (58, "a" * 200), (59, "é" * 120), (60, "x" + "é" * 120)]
    rows += [(61, prose(5, 6000)), (62, prose(5, 6000) + " end"), (53, "one"), (7, base[7])]
    return [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4], len(t or "")) for i, t in rows]
