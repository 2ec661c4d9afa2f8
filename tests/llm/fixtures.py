"""A small table with every awkward row, and plain versions of the operators."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid int, kept string, `row` int, digest string, score int"


def documents(seed=5):
    """Nulls, empty texts, repeated rows, copies, near copies, shared passages, one long text."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = prose(90)
    texts = [prose(r.randint(0, 200)) for _ in range(30)]
    texts += [f"{prose(30)} {passage} {prose(40)}" for _ in range(8)]
    base = prose(150)
    for k in range(6):
        w = base.split(" ")
        w[20 * k + 7] = "changed"
        texts.append(" ".join(w))
    texts += [base, base.upper(), base, "one two", "one two", "x", "Ä ä ß 中文 😀 naïve", "<|endoftext|> a<|endoftext|>"]
    texts += [None, "", "", "   \n\t ", "ab " * 300, "line of words\n" * 40 + "another one", "# * $ %\n" * 20]
    texts += ["password = hunter2secret and token:'abc', AKIA" + "Q7" * 10, "deadbeef" * 4 + " api_key=\"zzzzzz\" secret=token:abcdefg", passage * 30]
    rows = [(i, t, r.choice(["en", None, "xx"]), r.choice(["s", "s", "s", "t", None]), None, 1, "k", 2, "d", 3) for i, t in enumerate(texts)]
    rows.append((None, base, "en", "s", 1, 1, "k", 2, "d", 3))
    rows.append((None, "lonely text without an id", "en", "s", 1, 1, "k", 2, "d", 3))
    rows.append(rows[3])
    return rows


def grams(text, n=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(rows, threshold=0.8):
    """(class id, links) of each row, from all pairs."""
    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, row in enumerate(rows):
        if row[0] is not None:
            ids[find(i)].append(row[0])
    return [(row[0], min(ids[find(i)], default=None), links[i]) for i, row in enumerate(rows)]


def substring(rows, length=35):
    seen = Counter()
    words = [WORD.findall(r[1] or "") for r in rows]
    for w in words:
        seen.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix(rows, length=400):
    seen = Counter()
    data = [(r[1] or "").encode() for r in rows]
    for b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def spans(text):
    """Base spans of secrets as (start, order, kind, stop)."""
    text = text or ""
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def base_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def main_script(text, ranges):
    """Which script most letters have; ``ranges`` are (first code point, script)."""
    order, times = ["latin", "cyrillic"], Counter()
    for c in text:
        if "a" <= c.lower() <= "z" and c.isascii() or 0xC0 <= ord(c) < 0x250:
            times["latin"] += 1
        elif ord(c) >= 0x250:
            name = [s for first, s in ranges if first <= ord(c)][-1]
            times[name] += 1
    marked = times.pop("vi", 0)
    times["latin"] += marked
    times.pop("", None)
    order += sorted(set(times) - {"latin", "cyrillic", "other"}) + ["other"]
    main = max(order, key=lambda x: (times[x], -order.index(x)))
    return "vi" if main == "latin" and marked and 10 * marked >= times["latin"] else main


def fertility(text, lang, ids, pieces, bands, ranges):
    """Whether characters per token, share of characters without a piece and entropy fit the band."""
    text = text or ""
    b = bands.get(lang) or bands[main_script(text, ranges)]
    per = len(text) / max(1, len(ids))
    bare = sum(ord(c) > 127 and pieces.piece_to_id(c) == pieces.unk_id() for c in text) / max(1, len(text))
    n, h = len(ids), 1.0
    if n > 1:
        h = -sum(c / n * math.log(c / n) for c in Counter(ids).values()) / math.log(min(n, 1024))
    # From 128 to 1,024 tokens the floor rises evenly with the logarithm of their number.
    floor = b.entropy + b.rise * min(1.0, max(0.0, math.log(max(n, 1) / 128, 8)))
    return b.low <= per <= b.high and bare <= b.fallback and h >= floor


def ngram_counts(text):
    """Word and shape n-grams of a text, and how often each comes."""
    words = [w.translate(LOW).encode() for w in WORD.findall(text or "")]
    shapes = []
    for w in WORD.findall(text or ""):
        folded = bytes(97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in w.encode())
        shapes.append(bytes(c for i, c in enumerate(folded) if not i or c != folded[i - 1]))
    found = Counter()
    for kind, units, most in (("word", words, 2), ("shape", shapes, 3)):
        for n in range(1, most + 1):
            found.update((kind, tuple(units[i : i + n])) for i in range(len(units) - n + 1))
    return found


def follow_leader(rows, place, shards, cost, alpha, beta, l1, l2, rounds):
    """FTRL-proximal with one dictionary entry per place; ``rows`` are (text, label), ``shards`` lists of row numbers."""
    vectors = []
    for text, _ in rows:
        v, found = defaultdict(float), ngram_counts(text)
        for gram, times in found.items():
            v[place(*gram)] += 10.0 * times / max(1, found.total())
        vectors.append(v)

    def weight(z, n):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)

    z, n = Counter(), Counter()
    for _ in range(rounds):
        ends = []
        for own in shards:
            zs, ns = Counter(z), Counter(n)
            for i in own:
                w = {p: weight(zs[p], ns[p]) for p in vectors[i]}
                dot = sum(w[p] * x for p, x in vectors[i].items())
                for p, x in vectors[i].items():
                    g = cost[rows[i][1]] * (1 / (1 + math.exp(-dot)) - rows[i][1]) * x
                    zs[p] += g - (math.sqrt(ns[p] + g * g) - math.sqrt(ns[p])) / alpha * w[p]
                    ns[p] += g * g
            ends.append((zs, ns))
        z = {p: sum(e[0][p] for e in ends) / len(ends) for p in set().union(*[e[0] for e in ends])}
        n = {p: sum(e[1][p] for e in ends) / len(ends) for p in set().union(*[e[1] for e in ends])}
    return {p: weight(z[p], n[p]) for p in z}
