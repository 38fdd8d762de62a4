"""Small tables with every odd row, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, a long, b string, id long, key string, label string, n long, part string, row int"


def texts():
    """``(doc_id, text)``: real rows, then copies, near copies, shared passages and odd texts."""
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(90)]
    passage = " ".join(word() for _ in range(60))
    number = 10_000
    for _ in range(25):  # one group of exact copies
        rows.append((number := number + 1, " ".join(base)))
    for _ in range(40):  # near copies of it, and nearly near ones
        own = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            own[rng.randrange(90)] = word()
        rows.append((number := number + 1, " ".join(own)))
    for i in range(20):  # a passage that many texts share, at different places
        rows.append((number := number + 1, " ".join([*(word() for _ in range(i)), passage, *(word() for _ in range(80 * (i % 2)))])))
    for text in ("", None, "   \n\t ", "one", "One", "a b c d", "A b c D", "a b c d e", "a  b\nc d e", "x" * 70_000, "ß É \x1c \u2003 日本語 \U0001f600", "The the THE", "\n\n\n"):
        rows.append((number := number + 1, text))
    rows.append((number := number + 1, " ".join(word() for _ in range(4000))))
    rows.append((number + 1, " ".join(["same"] * 300)))
    rows += [rows[3], rows[3], (rows[5][0], rows[5][1])]  # repeated rows
    return rows


def table(spark, rows, lang="en"):
    full = [(i, t, lang, "s", 0, 1, "b", 2, "k", "l", 3, "p", 4) for i, t in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    union = Union()
    for x, (i, s) in enumerate(sets):
        union.find(i)
        for j, r in sets[:x]:
            common = len(s & r)
            if common and 100 * common >= percent * (len(s) + len(r) - common):
                union.join(i, j)
    return sorted((i, len(s), union.find(i)) for i, s in sets)


def without_repeats(rows, width=20):
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        w = WORD.findall(text)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            content = tuple(w[k : k + width])
            if content in seen:
                gone[k : k + width] = [True] * width
            seen.add(content)
        kept = [x for x, y in zip(w, gone, strict=True) if not y]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return sorted((i, *out[i]) for i, _ in rows)


def base_secrets(text):
    text = text or ""
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort()
    return [sum(k == kind for _, k, _ in found) for kind in range(3)], [x for _, _, x in found]


def word_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    places = {}
    for k in range(len(w) - 7):
        places.setdefault(tuple(w[k : k + 8]), []).append(k)
    inside = {k + d for own in places.values() if len(own) > 1 for k in own for d in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def checksum(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
