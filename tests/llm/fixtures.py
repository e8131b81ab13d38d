"""Small documents with every odd case: nulls, empties, long words and texts, copies, repeats, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, size int, block int, score double, "
          "cluster string, bucket int, n int, first int, part int, url string, start string, _key int")


def prose(rng, n, words=400):
    return " ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(words)}", f"x{rng.randrange(words)}é", f"Y{rng.randrange(words)}."]) for _ in range(n))


def texts(seed=1, n=40):
    rng = random.Random(seed)
    out = [prose(rng, rng.randrange(1, 120)) for _ in range(n)]
    out += [None, "", " \n\t ", "one", "two words", "a b c d e", " x y z", "é" * 7000, "word " * 3000, prose(rng, 6000)]
    base = prose(rng, 100)
    for k in range(12):  # near copies: a few words changed
        words = base.split()
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(9999)}"
        out.append(" ".join(words))
    out += [base] * 5 + [base.replace(" ", "\n")] + ["", None]
    return out


def rows(seed=1, n=40, sources=("a", "b", None, "")):
    found = [(i, t, "en", sources[i % len(sources)], len(t or ""), "k", 1, 2, 0.5, "c", 1, 2, 3, 4, "u", "s", 7) for i, t in enumerate(texts(seed, n))]
    found.append((None, "null id here and there", "en", "a", 22, *found[0][5:]))
    return [*found, found[3], found[3]]  # a repeated row


def documents(spark, seed=1, n=40):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def shingles(text, size=5):
    words = [w for w in _split(text or "")]
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def _split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def thue_morse(n, letters="ab"):
    """A word of n letters and its complement: polynomials modulo 2^64 hash them alike from some 1,000 letters on."""
    word = "".join(letters[k.bit_count() % 2] for k in range(n))
    return word, "".join(letters[1 - letters.index(c)] for c in word)
