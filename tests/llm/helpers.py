"""Fixtures in code: a table of documents with every odd case, and brute-force definitions."""

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(n=120, seed=1):
    """Random prose with copies, near copies, shared passages, boilerplate, junk and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéñß", k=rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, line = prose(60), " ".join(prose(8))
    texts = []
    for i in range(n):
        body = prose(rng.randint(1, 120))
        if i % 5 == 1 and texts:
            body = texts[rng.randrange(len(texts))].split(" ")
            for _ in range(rng.randint(0, 3)):
                body[rng.randrange(len(body))] = rng.choice(vocabulary)
        if i % 7 == 2:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.randint(0, 20) : rng.randint(30, 60)]
        if i % 11 == 3:
            body = [w + rng.choice(["###", "&&&", "%%%"]) for w in body]
        text = " ".join(body)
        texts.append(text if i % 4 else f"{line}\n{text}\n\n{line}")
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), len(t)) for i, t in enumerate(texts)]
    odd = [None, "", " \t\n", "one", "One two  three", "a\tb\x0bc\x0cd\re\nf", "x " * 3000, "▁ a▁b  c d", "<|endoftext|> A <|endoftext|>", "\U0001f600 中文 'll 12", "w" * 5000]
    rows += [(n + i, t, "en", "s1", None) for i, t in enumerate(odd)]
    rows += [rows[3], rows[3], (5, "another text under an id that is taken", "en", "s2", 3), (None, texts[1], None, None, None), (None, None, "fr", "s9", 0)]
    return rows


def shingles(text, k=5):
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_components(rows):
    """(id, n_shingles, component_id, kept) of each row, by all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    different = list(dict.fromkeys(s for s in sets if s))
    top = {s: s for s in different}

    def root(s):
        while top[s] != s:
            s = top[s]
        return s

    for i, a in enumerate(different):
        for b in different[:i]:
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                top[root(a)] = root(b)
    ids = {}
    for (i, _), s in zip(rows, sets):
        if s:
            ids.setdefault(root(s), []).append(i)
    out = []
    for (i, _), s in zip(rows, sets):
        known = [x for x in ids[root(s)] if x is not None] if s else []
        label = (min(known) if known else None) if s else i
        out.append((i, len(s), label, i == label))
    return Counter(out)


def kept_words(rows, width=13):
    """(id, n_words, n_removed, kept) of each row."""
    first = {}
    split = [words(t) for _, t in rows]
    for (i, _), w in zip(rows, split):
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)
