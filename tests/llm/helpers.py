"""Small documents with every oddity, and plain-Python versions of the operators to hold results against."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingle_set(text, n):
    w = words(text, lower=True)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


class Groups:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def near_components(texts, n, percent=80):
    """Smallest linked id of every id, by comparing all sets that share a shingle."""
    sets, held, groups = {}, defaultdict(list), Groups()
    for i in sorted(texts):
        sets[i] = shingle_set(texts[i], n)
        common = Counter(j for s in sets[i] for j in held[s])
        for s in sets[i]:
            held[s].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                groups.link(i, j)
    return {i: groups.root(i) for i in sets}, sets


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def odd_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, blanks, copies, near copies, shared passages, a long text and repeats."""
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w30", "changed")
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, None, None, None), (5, "", "en", "b"), (6, " \t\n ", "de", None),
        (7, f"start here {PASSAGE} and end", "en", "c"), (8, f"{PASSAGE} again\n{PASSAGE}", "fr", "c"), (9, "Short", "en", "a"), (10, "short", "en", "a"),
        (11, "x " * 3000 + "tail", "en", "d"), (12, " ".join(f"v{k % 997}" for k in range(20000)), "en", "d"), (13, "naïve café 漢字 😀 ▁ x", "fr", "b"),
        (14, "line one is here\nline two is here\nline one is here", "en", "a"), (15, "Line ONE is here\n\nother", "en", "a"), (16, base.upper(), "en", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
