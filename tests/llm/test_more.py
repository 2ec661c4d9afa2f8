"""Whitening, spelling variants and token files against plain versions, on awkward rows."""

import math
import mmap
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import fixtures as fx
from vidspark.llm import spectrum, spelling, tokenfiles, whiten
from vidspark.llm.common import vocabulary
from vidspark.llm.queries import QUERIES

key = lambda t: tuple((x is None, str(x)) for x in t)
same = lambda a, b: sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)
# Names that the operators use inside, results' names, and names that need quoting.
EXTRA = "`a.b` string, _cuts int, _c0 int, `start` string, n string, whitened string, word string, ids string, rid long"
MORE = ("x", 1, 2, "s", "n", "w", "v", "i", 7)


@pytest.fixture(scope="module")
def rows():
    return fx.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(r[0], r[1], *MORE) for r in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, {EXTRA}").repartition(3)


def matrices():
    r = np.random.default_rng(3)
    for d in (1, 2, 5, 24):
        m = r.standard_normal((d, d))
        q, _ = np.linalg.qr(m)
        yield m @ m.T
        yield (m + m.T) * 1e9
        yield q @ np.diag(np.repeat(np.arange(1.0, d + 1), 3)[:d]) @ q.T
        yield q @ np.diag(10.0 ** -np.arange(d)) @ q.T
        yield q @ np.diag(np.where(np.arange(d) % 2, 1 + 1e-13 * np.arange(d), -1.0)) @ q.T
        yield np.eye(d) * 7
        yield np.zeros((d, d))


def test_leading_eigenpairs():
    for a in matrices():
        a = (a + a.T) / 2
        want = np.linalg.eigvalsh(a)[::-1][:16]
        values, vectors = spectrum.leading(a, 16)
        scale = max(1e-300, np.abs(np.linalg.eigvalsh(a)).max())
        assert np.abs(values - want).max() <= 1e-12 * scale
        assert np.abs(a @ vectors.T - vectors.T * values).max() <= 1e-11 * scale
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() <= 1e-11


def test_inertia_and_solution():
    r = np.random.default_rng(4)
    for a in matrices():
        a = (a + a.T) / 2 + 0.37 * np.diag(r.standard_normal(len(a)))
        f = spectrum.Factors(a)
        assert f.positive() == (np.linalg.eigvalsh(a) > 0).sum()
        v = r.standard_normal(len(a))
        assert np.allclose(a @ f.solve(v, 1e-300), v, atol=1e-6 * max(1.0, np.abs(a).max()))


def plain_whitening(vectors, components=16):
    """By row number: n, deviation, whitened (up to signs), explained. Vectors of one length."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    distinct = [list(t) for t in sorted({tuple(r) for r in x})]
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    dev = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    y = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in distinct])
    cov = y.T @ y / n
    w, q = np.linalg.eigh(cov)
    w, q = w[::-1][:components], q[:, ::-1][:, :components]
    z = np.array(dev, float) / n @ q / np.sqrt(np.where(w > 1e-9, w, np.nan))
    return n, [sum(d * d for d in r) for r in dev], z, w / np.trace(cov)


def test_whitening(spark):
    r = random.Random(2)
    vectors = [[r.gauss(0, 1 + j) for j in range(20)] for _ in range(120)]
    vectors += [vectors[0]] * 40 + [[c + 1e-9 for c in vectors[1]]] + [[0.0] * 20, [-0.0] * 20]
    bad = [None, [], [math.nan] + [0.0] * 19, [math.inf] + [0.0] * 19, [None] + [0.0] * 19, [1e300] * 20]
    data = [(i % 90, v, *MORE) for i, v in enumerate(vectors)] + [(None, vectors[2], *MORE)] + [(900 + i, v, *MORE) for i, v in enumerate(bad)]
    df = spark.createDataFrame(data, f"vec_id long, embedding array<double>, {EXTRA}").repartition(4)
    got = whiten.whiten(df).collect()
    n, dev, z, share = plain_whitening([*vectors, vectors[2]])
    assert len(got) == len(vectors) + 1 and got[0]["n"] == n == 121
    assert [c for c in df.columns if c not in ("n", "whitened")] == [c for c in whiten.whiten(df).columns if c in df.columns and c not in ("n", "whitened")]
    assert got[0]["a.b"] == "x" and got[0]["_c0"] == 2
    by = {}
    for (i, v, *_), d, row in zip([*data[: len(vectors) + 1]], dev, z, strict=True):
        by.setdefault((i, tuple(v)), (d, row))
    mine = [by[g["vec_id"], tuple(g["embedding"])] for g in got]
    assert [g["deviation"] for g in got] == [d for d, _ in mine]
    a, b = np.array([g["whitened"] for g in got]), np.array([row for _, row in mine])
    assert np.abs(a * np.sign((a * b).sum(0)) - b).max() < 1e-9
    assert np.abs(np.array(got[0]["explained"]) - share).max() < 1e-12 and got[0]["identity_error"] < 1e-10


def test_whitening_without_spread(spark):
    """Components without variance are null; lengths are fitted apart; large entries keep their digits."""
    schema = "vec_id long, embedding array<double>"
    flat = whiten.whiten(spark.createDataFrame([(i, [float(i % 2), 3.0, 3.0]) for i in range(6)] + [(9, [5.0])], schema)).collect()
    by = {g["vec_id"]: g for g in flat}
    assert by[9]["n"] == 1 and by[9]["whitened"] == [None] and by[9]["explained"] == [None] and by[9]["identity_error"] is None
    assert by[0]["n"] == 2 and by[0]["whitened"][1:] == [None, None] and abs(by[0]["whitened"][0]) == pytest.approx(1)
    assert by[1]["explained"] == pytest.approx([1, 0, 0]) and by[0]["deviation"] == 64**2
    huge = [(0, [2.0**50, 1.0]), (1, [-(2.0**50), 2.0]), (2, [1.0, 5.0])]
    got = whiten.whiten(spark.createDataFrame(huge, schema)).collect()
    assert all(g["deviation"] is None for g in got if g["vec_id"] < 2) and got[0]["identity_error"] < 1e-6
    n, dev, _, _ = plain_whitening([v for _, v in huge])
    assert {g["vec_id"]: g["deviation"] for g in got} == {i: d if d < 2**63 else None for i, d in enumerate(dev)}
    empty = whiten.whiten(spark.createDataFrame([], schema))
    assert empty.count() == 0 and whiten.whitened_rows(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0


def test_whitening_query(spark, sf):
    vectors = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    rows = sorted(QUERIES["op11_embedding_whitening"](spark, sf).collect(), key=lambda r: (r["vec_id"], r["component"]))
    n, dev, z, share = plain_whitening([v for _, v in vectors])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in rows] == [(i, k, n, d) for (i, _), d in zip(vectors, dev, strict=True) for k in range(1, 17)]
    a = np.array([r["whitened"] for r in rows]).reshape(z.shape)
    assert np.abs(a * np.sign((a * z).sum(0)) - z).max() < 1e-8
    assert np.abs(np.array([r["explained"] for r in rows[:16]]) - share).max() < 1e-12 and rows[0]["identity_error"] < 1e-9


def plain_variants(rows, min_length=6, min_count=5, times=5):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fx.LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}
    near = {w: set() for w in words}
    for a in words:
        for b in words:
            if len(a) == len(b):
                hit = sum(x != y for x, y in zip(a, b, strict=True)) == 1
            else:
                hit = len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))
            if hit:
                near[a].add(b)
                near[b].add(a)
    form = {w: min(near[w], key=lambda o: (-words[o], o)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= times * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return out


@pytest.fixture(scope="module")
def spelt():
    """Chains of ever rarer variants, repeated letters, ties, letters beyond ASCII, long words."""
    r = random.Random(8)
    words = {"abcdefgh": 700, "abcdefg": 130, "abcdef": 26, "xabcdef": 5, "aaaaaaa": 90, "aaaaaa": 6, "aaaaaaaa": 90}
    words |= {"Straße": 50, "straßen": 300, "strassen": 7, "STRASSEN": 4, "Äpfelig": 9, "äpfelig": 40, "naïvety÷": 6}
    words |= {"q" * 5000: 5, "q" * 4999 + "r": 30, "q" * 5001: 5, "x" * 70000: 5, "short": 50, "rarely": 4}
    for i in range(200):
        words["".join(r.choice("abc") for _ in range(r.randint(6, 9)))] = r.choice([5, 6, 30, 160])
    runs = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(runs)
    texts = [r.choice([" ", "-", "_1", "ā", "中"]).join(runs[at : at + 60]) for at in range(0, len(runs), 60)]
    return [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, "12 中"), (5, texts[5]), (5, texts[5])]


def test_spelling_variants(spark, spelt):
    df = spark.createDataFrame([(i, t, *MORE) for i, t in spelt], f"doc_id long, text string, {EXTRA}").repartition(3)
    want = plain_variants(spelt)
    assert any(w[1] and w[2] != w[1] for w in want)
    assert same(spelling.spelling_variants(df).collect(), want)
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(df.filter("doc_id = 3")).count() == 0


def test_spelling_in_rounds(spark, spelt):
    """Filters too large for one round are probed part by part, with the same result."""
    df = spark.createDataFrame(spelt, "doc_id long, text string")
    sizes = Counter(len(w[0]) for w in plain_variants(spelt))
    assert len(spelling.plan_shards(sizes, 96)) > 3 and any(s.parts > 1 for g in spelling.plan_shards(sizes, 96) for s in g)
    assert same(spelling.spelling_variants(df, limit=96).collect(), plain_variants(spelt))


def test_edit_hashes():
    r = random.Random(6)
    for n in range(1, 13):
        words = ["".join(r.choice("abzéÿ") for _ in range(n)) for _ in range(5)]
        e = spelling.Edits(words)
        assert (e.deletions().ravel() == spelling.plain_hash([e.without(w, i) for w in range(5) for i in range(n)])).all()
        letters = range(e.replacements(0, n).shape[2])
        want = spelling.plain_hash([e.replaced(w, i, k) for w in range(5) for i in range(n) for k in letters])
        assert (e.replacements(0, n).ravel() == want).all()


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, most in ((1, 0), (1, 2**64 - 1), (5, 3), (256, 0), (257, 10**6), (1000, 10), (3000, 2**63), (4000, 2**64 - 1)):
        v = np.sort(r.integers(0, most, n, dtype=np.uint64, endpoint=True))
        data = tokenfiles.EliasFano.encode(v)
        e = tokenfiles.EliasFano(data)
        assert len(e) == n and (e.span(0, n) == v).all()
        assert all(e[int(i)] == int(v[i]) for i in r.integers(0, n, 40))
        for a, b in np.sort(r.integers(0, n + 1, (20, 2)), axis=1):
            assert (e.span(int(a), int(b)) == v[a:b]).all()
        # Two bits and the low width per entry, and the notes.
        assert 8 * len(data) <= n * (3 + e.width) + 32 * (n // 256 + 1) + 300
    assert len(tokenfiles.EliasFano(tokenfiles.EliasFano.encode(np.zeros(0)))) == 0


def plain_files(rows, library, eos=0):
    """(doc_id, n, crc) in file order; the order of rows with equal ids is the input's, thus open."""
    out = []
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, eos]
        out.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("size", [1, 500, 1 << 24])
def test_token_files(spark, docs, rows, library, size):
    out = tokenfiles.write_tokens(docs, vocabulary("byte_bpe_50k.json"), file_tokens=size)
    got = sorted(tokenfiles.read_tokens(spark, out).collect(), key=lambda r: r["start"])
    want = plain_files(rows, library)
    assert same([(r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got], want)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]


def test_token_files_extremes(spark, library):
    rows = [(-(2**63), "low"), (2**63 - 1, "high"), (0, None), (0, ""), (None, "none"), (7, "word " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokenfiles.token_files(df, vocabulary("byte_bpe_50k.json")).orderBy("start").collect()
    assert same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], plain_files(rows, library))
    assert [r["doc_id"] for r in got] == [None, -(2**63), 0, 0, 7, 2**63 - 1]
    assert tokenfiles.token_files(df.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_token_file_in_place(spark, library):
    """A file is read from a memory map: by number, by id, and not if it is cut short."""
    import glob

    df = spark.createDataFrame([(3 * i, f"text number {i} " * (i % 5)) for i in range(3000)], "doc_id long, text string").coalesce(1)
    out = tokenfiles.write_tokens(df, vocabulary("byte_bpe_50k.json"), file_tokens=9000)
    seen = 0
    for name in glob.glob(f"{out}/ids/part-*"):
        with open(name, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if len(data) == 0:
            continue
        file = tokenfiles.TokenFile(data)
        for i in (0, len(file) // 2, len(file) - 1):
            doc = file.doc_id(i)
            assert file.find(doc) == i and file.find(doc + 1) is None
            text = f"text number {doc // 3} " * (doc // 3 % 5)
            assert file.document(i).tolist() == [*library.encode(text).ids, 0]
        seen += len(file)
        with pytest.raises(ValueError):
            tokenfiles.TokenFile(data[: len(data) - 20])
    assert seen == 3000


def test_token_files_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(QUERIES["op13_token_files"](spark, sf).collect(), key=lambda r: r["start"])
    want = plain_files(docs, library)
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    assert [r["start"] for r in got] == [0, *np.cumsum([w[1] for w in want])[:-1]]
